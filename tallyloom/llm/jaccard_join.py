"""N-gram Jaccard join by chosen paths: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. One pass over the texts turns each set of shingles into an exact key of the set, ``COORDS`` min-hash coordinates (a
   one-byte sketch of each) and, for each of ``RUNS`` independent runs, a tree of paths: every node draws ``BRANCH``
   coordinates from its path, and the set goes to each child that is named by a token which they sample from it.
2. Rows of equal sets form a class, combined before any exchange. Only one representative of each goes on.
3. The recursion: buckets of one set end, buckets of at most ``LIMIT`` are leaves, larger ones are split by the next
   token. Runs are repeated until a pair at the threshold, whose paths part with probability 1 - J at every child, shares a
   leaf with probability ``RECALL``. A bucket that is still larger at the last level is not cut short: its members are compared block by block,
   each pair of blocks in a group of its own.
4. Leaves are brute-forced by sketches; a pair belongs to the first place at which its sets share a leaf, so it is treated
   once. Members of likely pairs fetch their whole sets, and the similarity is computed exactly.
5. A leaf returns one row per member: its links and the member that its part of the leaf hangs on; pairs are never
   written out. Components of these stars give the class ids.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, ASCII case folded. A text of one to four
words has one shingle of all of them. A null text, or one without words, has no shingle and links to nothing, also not
to others of its kind. A null id stands above all others when the smallest id of a group is taken; repeated rows link to
one another. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import wordhash
from tallyloom.llm.shared import free_name, own_names, small, spread, written

N, THRESHOLD = 5, (4, 5)  # words of a shingle; similarity as a fraction
COORDS, BRANCH, DEPTH, LIMIT, RECALL = 128, 2, 2, 256, 0.9995
#: Members of a leaf that are compared in one group; a larger leaf is dealt into blocks of so many, and each pair of blocks is a group.
BLOCK = 1024


def _missed(depth: int) -> float:
    """The probability that a pair at the threshold shares no node at a depth of one run: each child parts it, or all below it do."""
    return (1 - THRESHOLD[0] / THRESHOLD[1] * (1 - _missed(depth - 1))) ** BRANCH if depth else 0.0


#: Runs until a pair at the threshold is missed by all with probability 1 - RECALL even if its leaves lie deepest.
RUNS = math.ceil(math.log(1 - RECALL) / math.log(_missed(DEPTH)))
#: Places of nodes at each level, in the order of paths, and of leaves: a leaf above the last level takes the first place below it.
WIDTHS = [RUNS * BRANCH ** (d + 1) for d in range(DEPTH)]
PLACES = WIDTHS[-1]
#: Nodes of the tree below a first child, itself included.
TREE = sum(BRANCH**d for d in range(DEPTH))
#: A sketch's estimate may fall this many standard deviations below the threshold before its pair is dropped.
SLACK = 4.0
FLOOR = THRESHOLD[0] / THRESHOLD[1] - SLACK * math.sqrt(0.8 * 0.2 / COORDS)
#: Rows of 16 to 40 bytes that are sent to every task at most: bucket sizes, and the keys of sets to be fetched.
BROADCAST_ROWS = 1 << 19
PAIRS_AT_ONCE = 1 << 17

_rng = np.random.Generator(np.random.PCG64(7))
_FACTOR = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(0, 1 << 63, RUNS, dtype=np.uint64)

_SKETCH = "doc_id long, tag long, cls binary, sketch binary, paths array<long>"
_MEMBER = "g long, cls binary, block int, crossed boolean, run int, leaves array<long>, sketch binary, size long"


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for _, _, data, offsets in wordhash.chunks(*wordhash.text_bytes(texts)):
        h, upto = wordhash.words(data, offsets)
        g = wordhash.grams(h, N)
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            if b - a >= N:
                yield np.unique(g[a : b - N + 1])
            else:
                yield wordhash.grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * f, starts) for f in _FACTOR], axis=1)


def _paths(m: np.ndarray) -> np.ndarray:
    """(sets, WIDTHS[0] * TREE): the trees of the nodes that a set reaches, each level by level; 0 where two children of a node have one name."""
    n, levels, each = len(m), [], np.arange(len(m))[:, None]
    above = np.broadcast_to(_SEED[None, :RUNS], (n, RUNS))
    for _ in range(DEPTH):
        nodes = np.repeat(above, BRANCH, axis=1)
        draw = np.tile(np.arange(1, BRANCH + 1, dtype=np.uint64), above.shape[1]) * np.uint64(0xD6E8FEB86659FD93)
        coordinate = (wordhash.mix(nodes + draw) % np.uint64(COORDS)).astype(np.int64)
        child = wordhash.mix(nodes * np.uint64(0x9E3779B97F4A7C15) + m[each, coordinate]) | np.uint64(1)
        child[nodes == 0] = 0
        family = child.reshape(n, -1, BRANCH)
        for k in range(1, BRANCH):  # a child that an earlier draw of its node has named already
            family[:, :, k][(family[:, :, :k] == family[:, :, k : k + 1]).any(axis=2)] = 0
        above = child
        levels.append(child.reshape(n, WIDTHS[0], -1))
    return np.concatenate(levels, axis=2).reshape(n, -1)


def _sketched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        n = part.num_rows
        cls, sketch, paths = [None] * n, [None] * n, [None] * n
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                m = _min_hashes([s for _, s in held])
                short, path = (wordhash.mix(m) & np.uint64(255)).astype(np.uint8), _paths(m).astype(np.int64)
                for k, (i, s) in enumerate(held):
                    cls[i], sketch[i], paths[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest(), short[k].tobytes(), path[k]
                held.clear()

        waiting = 0
        for i, s in enumerate(shingles(part.column("text"))):
            if len(s):
                held.append((i, s))
                waiting += len(s)
                if waiting > 1 << 18:
                    flush()
                    waiting = 0
        flush()
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("tag"), pa.array(cls, pa.binary()), pa.array(sketch, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
            names=["doc_id", "tag", "cls", "sketch", "paths"],
        )


def _leaves(reps: DataFrame) -> DataFrame:
    """cls, place, leaf, n: where the recursion ends for each class and path, without buckets of one."""
    trees = F.transform(F.sequence(F.lit(0), F.lit(WIDTHS[0] - 1)), lambda p: F.struct(p.alias("at"), F.slice("paths", p * TREE + 1, TREE).alias("tree")))
    open_, done = reps.select("cls", F.inline(trees)), None
    for d, width in enumerate(WIDTHS):
        at = open_.withColumn("leaf", F.col("tree")[0]).where("leaf <> 0")
        counts = written(at.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), "join-counts")
        at = written(at.join(small(counts, BROADCAST_ROWS), "leaf").withColumn("tree", F.when(F.col("n") > LIMIT, F.col("tree"))), "join-level")
        last = d == DEPTH - 1
        ends = at if last else at.where(F.col("n") <= LIMIT)
        ends = ends.select("cls", (F.col("at") * (PLACES // width)).alias("place"), "leaf", "n")
        done = ends if done is None else done.unionByName(ends)
        if not last:
            open_ = at.where(F.col("n") > LIMIT).select("cls", F.inline(F.array(*[_below(j, DEPTH - 1 - d) for j in range(BRANCH)])))
    return done


def _below(j: int, levels: int) -> Column:
    """struct(at, tree) of the j-th child: of every further level its share of the nodes."""
    places, begin = [], 1
    for k in range(levels):
        places += [begin + j * BRANCH**k + i for i in range(BRANCH**k)]
        begin += BRANCH ** (k + 1)
    return F.struct((F.col("at") * BRANCH + j).alias("at"), F.array(*[F.col("tree")[i] for i in places]).alias("tree"))


def _members(reps: DataFrame) -> DataFrame:
    """One row per class and leaf; of a leaf above BLOCK, one for each pair of blocks that the class's block is in."""
    leaves = _leaves(reps)
    by_place = F.map_from_entries(F.collect_list(F.struct("place", "leaf")))  # at most PLACES entries
    known = leaves.groupBy("cls").agg(by_place.alias("m")).select(
        "cls", F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda r: F.coalesce(F.element_at("m", r), F.lit(0).cast("long"))).alias("leaves")
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls", "leaf"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    g = F.xxhash64("leaf", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(g.alias("g"), "cls", "block", (F.col("block") != F.col("other")).alias("crossed"), F.col("place").alias("run"))
    rows = rows.join(known, "cls").join(reps.select("cls", "sketch", "size"), "cls")
    return rows.select([x.split()[0] for x in _MEMBER.split(", ")])


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``g``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        rows += part.num_rows
        if rows < 4096:
            continue
        table = pa.Table.from_batches(held)
        whole = table.column("g").to_numpy()
        last = int(np.argmax(whole == whole[-1]))
        if last:
            yield table.slice(0, last).combine_chunks()
            held = table.slice(last).to_batches()
            rows = table.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _owned(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group whose sketches are alike and that meet in this run first."""
    n = table.num_rows
    g = table.column("g").to_numpy()
    block, crossed, run = (table.column(c).to_numpy() for c in ("block", "crossed", "run"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, COORDS)
    leaves = np.array(table.column("leaves").to_pylist(), np.int64).reshape(n, PLACES)
    ends = np.flatnonzero(np.append(g[1:] != g[:-1], True)) + 1
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) - 1
    upto = np.cumsum(later)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")))
        reps = later[first:end]
        i = np.repeat(np.arange(first, end), reps)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
        ok = ~crossed[i] | (block[i] != block[j])
        i, j = i[ok], j[ok]
        alike = (sketch[i] == sketch[j]).mean(axis=1)
        ok = (alike - 1 / 256) / (1 - 1 / 256) >= FLOOR
        i, j = i[ok], j[ok]
        same = (leaves[i] == leaves[j]) & (leaves[i] != 0)
        ok = same.argmax(axis=1) == run[i]
        yield i[ok], j[ok]
        first = end


def _likely(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(parts):
        wanted = np.zeros(table.num_rows, bool)
        for i, j in _owned(table):
            wanted[i] = wanted[j] = True
        yield from table.filter(pa.array(wanted)).to_batches()


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
    i, j = place[: len(i)], place[len(i) :]
    flat = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    token, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1  # a token of one set alone is in no intersection
    ok = n[at] > 1
    row, at = row[ok], column[at[ok]]
    width = max(1, (4 << 20) // len(used))
    total = np.zeros((len(used), len(used)), np.float32)
    for left in range(0, int(column[-1]) + 1, width):
        here = (at >= left) & (at < left + width)
        grid = np.zeros((len(used), min(width, int(column[-1]) + 1 - left)), np.float32)
        grid[row[here], at[here] - left] = 1
        total += grid @ grid.T
    return total[i, j].astype(np.int64)


def _verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    num, den = THRESHOLD
    for table in _groups(parts):
        n = table.num_rows
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        size, cls, g = table.column("size").to_numpy(), table.column("cls").to_pylist(), table.column("g").to_numpy()
        weight, links, root = np.array([len(s) for s in sets]), np.zeros(n, np.int64), np.arange(n)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in _owned(table):
            edges = np.flatnonzero(np.append(g[i[1:]] != g[i[:-1]], True)) + 1 if len(i) else []
            for a, b in zip([0, *edges[:-1]], edges):
                p, q = i[a:b], j[a:b]
                both = _shared(sets, p, q)
                ok = both * (num + den) >= (weight[p] + weight[q]) * num
                p, q = p[ok], q[ok]
                np.add.at(links, p, size[q])
                np.add.at(links, q, size[p])
                for x, y in zip(p.tolist(), q.tolist()):
                    x, y = top(x), top(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
        found = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array([cls[k] for k in found], pa.binary()), pa.array([cls[top(k)] for k in found], pa.binary()), pa.array(links[found])], names=["cls", "hub", "links"]
        )


def _components(edges: DataFrame) -> DataFrame:
    """cls -> the smallest key of its component, by minimum labels with shortcuts; the driver sees counts alone."""
    both = written(edges.unionByName(edges.select(F.col("hub").alias("cls"), F.col("cls").alias("hub"))).distinct(), "join-edges")
    labels = written(both.groupBy("cls").agg(F.min("hub").alias("m")).select("cls", F.least("cls", "m").alias("label")), "join-labels")
    while True:
        near = both.join(labels.select(F.col("cls").alias("hub"), "label"), "hub").groupBy("cls").agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "cls").select("cls", "label", F.least("label", "near").alias("low")), "join-labels")
        jump = lower.select(F.col("cls").alias("low"), F.col("low").alias("next"))
        nxt = written(lower.join(jump, "low").select("cls", F.least("low", "next").alias("label"), (F.least("low", "next") != F.col("label")).alias("moved")), "join-labels")
        if nxt.where("moved").isEmpty():
            return nxt.select("cls", "label")
        labels = nxt.select("cls", "label")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of all that it is linked with, directly or by others),
    n_links (other documents at the threshold), tag (hash of its text), stays (it is its class's one document)."""
    rows = own_names(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "xxhash64(coalesce(text, '')) tag", "text")
    sketches = written(spread(rows).mapInArrow(_sketched, _SKETCH), "join-sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    reps = sketches.where("cls is not null").groupBy("cls").agg(F.count("*").alias("size"), rep.alias("rep"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    reps = written(reps, "join-reps")

    by_group = lambda df: df.repartition("g").sortWithinPartitions("g", "cls")
    likely = written(by_group(_members(reps)).mapInArrow(_likely, _MEMBER), "join-likely")
    needed = written(likely.select("cls").distinct().join(reps, "cls").select("cls", F.col("rep.doc_id").alias("r"), F.col("rep.tag").alias("t")), "join-needed")
    texts = rows.join(small(needed, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("tag") == F.col("t")))

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([s.tobytes() for s in shingles(part.column("text"))], pa.binary())], names=["cls", "shingles"])

    sets = texts.select("cls", "text").mapInArrow(fetch, "cls binary, shingles binary").dropDuplicates(["cls"])
    found = by_group(likely.join(sets, "cls")).mapInArrow(_verified, "cls binary, hub binary, links long")
    found = written(found, "join-found")

    labels = _components(found.where("cls <> hub").select("cls", "hub"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = reps.select("cls", "size", "rep").join(links, "cls", "left").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    known = written(known, "join-known")
    heads = known.groupBy("label").agg(F.min("rep").alias("head"))
    info = known.join(heads, "label").select("cls", "head", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketches.select("doc_id", "tag", "cls").join(info, "cls", "left")
    alone = F.col("head").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tag") == F.col("head.tag")))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "tag", stays.alias("stays"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs``: of each class the document with the smallest id (all rows that repeat it)."""
    tag, twin = free_name(docs, "text_tag"), free_name(docs, "twin_id")
    found = join(docs, id_col=id_col, text_col=text_col, **options)
    gone = small(written(found.where("not stays").select(F.col("tag").alias(tag), F.col("doc_id").alias(twin)).distinct(), "join-gone"))
    marked = docs.withColumn(tag, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return marked.join(gone, (marked[tag] == gone[tag]) & marked[id_col].eqNullSafe(gone[twin]), "left_anti").drop(tag)


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{80}-\x{10FFFF}]+') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i : i + least(len(l), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM l WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM b JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE both_n * 9 >= (nx.n + ny.n) * 4),
reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON p.x = r.y)
SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS class_id, coalesce(k, 0) AS n_links
FROM documents d
LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS k FROM p GROUP BY x) c ON c.x = d.doc_id
"""
