"""Near-duplicate components by bottom-k sketches: documents whose sets of four-word shingles have a similarity of 0.8 or more.

1. One pass over the texts keeps of every set the ``K`` smallest values of one hash function, and an exact key of the set.
   Rows of equal sets form a class, combined before any exchange; only one representative of each goes on.
2. Inverted lists hold the ``LOW`` smallest values of each class. Classes at the threshold share at least ``SHARED`` of these
   (all but some 3 in 100,000 do), so they share one of the ``LOW`` - ``SHARED`` + 1 that the fewest classes have; a class stands
   only in the lists of these. Passages that many documents repeat are thereby left to the last.
3. First each class is compared with one hub, the list member with which its lists generate the most overlaps: n near
   copies of one text cost n comparisons. The union sketch of both (the ``K`` smallest values of their union) estimates the
   similarity, and what is likely is verified on the full sets. Components of these links are labelled.
4. Lists that hold more than one label are then compared whole, but for pairs of one label, which are connected anyhow. A
   list above ``BLOCK`` is dealt into blocks, and each pair of blocks is a group; members of a label that fills blocks
   of its own meet only the blocks of the others. A pair belongs to the first list that both are in.
5. Members of likely pairs fetch their full sets, exact similarities join labels, and components of labels give the result.

Words are what white space (blank, tab, line ends) separates, A-Z lower-cased. A text of one to three words has one shingle of
all of them; one without words, or a null text, has none and links to nothing. A null id stands above all others when the
smallest id is taken; repeated rows link to one another and are all kept if one is. Very long texts are compared by all of
their shingles. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import wordhash
from tallyloom.llm.jaccard_join import _components as components
from tallyloom.llm.jaccard_join import _groups as groups
from tallyloom.llm.shared import own_names, small, spread, written

N, THRESHOLD = 4, (4, 5)  # words of a shingle; similarity as a fraction
#: Values of a sketch, values that have lists, and how many of these two classes at the threshold share at least.
K, LOW, SHARED = 128, 32, 16
#: Members of a block of a list, each counted with a thousandth of its shingles; members that meet a hub in one group.
BLOCK, AT_HUB = 1024, 4096
#: Values of a quick first estimate, and standard deviations that the full and the quick estimate may fall below the threshold.
QUICK, SLACK, QUICK_SLACK = 24, 4.0, 5.0
PAIRS_AT_ONCE = 1 << 14
NONE = np.uint32(0xFFFFFFFF)

_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False

_SKETCH = "doc_id long, tag long, n long, cls binary, low array<long>, sketch binary"
_MEMBER = "g long, v long, c long, label long, block int, crossed boolean, prefix array<long>, sketch binary"


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for _, _, data, offsets in wordhash.chunks(*wordhash.text_bytes(texts)):
        h, upto = wordhash.words(data, offsets, _WORD)
        g = wordhash.grams(h, N)
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            if b - a >= N:
                yield np.unique(g[a : b - N + 1])
            else:
                yield wordhash.grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _sketched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        n, cls, low, sketch = [], [], [], []
        for s in shingles(part.column("text")):
            n.append(len(s))
            cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            low.append(s[:LOW].view(np.int64))
            sketch.append((s[:K] >> np.uint64(32)).astype("<u4").tobytes())
        columns = [part.column("doc_id"), part.column("tag"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(low, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "n", "cls", "low", "sketch"])


def _sketches(raw: list[bytes]) -> np.ndarray:
    """(members, K), filled up with ``NONE``."""
    out = np.full((len(raw), K), NONE, np.uint32)
    for i, b in enumerate(raw):
        s = np.frombuffer(b, "<u4")
        out[i, : len(s)] = s
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of the sets behind the rows of two arrays of sketches, from the smallest values of their unions."""
    k = a.shape[1]
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(~again, axis=1) + 1  # of distinct values, from the second place on
    shared = (again & (both[:, 1:] != NONE) & (rank <= k)).sum(axis=1)
    union = np.minimum(k, rank[:, -1] - (both[:, -1] == NONE))
    return shared / np.maximum(union, 1)


def _floor(k: int, slack: float) -> float:
    s = THRESHOLD[0] / THRESHOLD[1]
    return s - slack * math.sqrt(s * (1 - s) / k)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows' estimates reach the floor: a quick look at the smallest values first."""
    found = estimate(a[:, :QUICK], b[:, :QUICK]) >= _floor(QUICK, QUICK_SLACK)
    found[found] = estimate(a[found], b[found]) >= _floor(K, SLACK)
    return found


def _similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    num, den = THRESHOLD
    return shared * (num + den) >= (a + b) * num


def _lists(reps: DataFrame) -> DataFrame:
    """c, prefix: the values in whose lists a class stands, fewest classes first."""
    values = reps.select("c", "n", F.explode("low").alias("v"))
    counts = written(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "minhash-values")
    own = values.join(small(counts), "v").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("known"))  # at most LOW
    kept, exact = F.least("n", F.lit(LOW)), F.floor(F.lit(LOW) * THRESHOLD[0] / THRESHOLD[1])  # up to so many shingles, partners have whole sets in the lists
    shared = F.when(F.col("n") <= exact, F.ceil(F.col("n") * THRESHOLD[0] / THRESHOLD[1])).otherwise(SHARED)
    places = kept - shared + 1 - (kept - F.size("known"))  # values of one class alone stand first and have no list
    prefix = F.transform(F.slice("known", 1, F.greatest(places, F.lit(0)).cast("int")), lambda x: x["v"])
    return written(own.select("c", prefix.alias("prefix")).where(F.size("prefix") > 0), "minhash-lists")


def _by_hub(pairs: DataFrame) -> DataFrame:
    """c, hub, salt, member: one row for each pair, and one of the hub itself for every ``AT_HUB`` of its pairs."""
    sizes = written(pairs.groupBy("hub").agg(F.ceil(F.count("*") / AT_HUB).alias("salts")), "minhash-salts")
    members = pairs.join(small(sizes), "hub").select("c", "hub", F.pmod(F.xxhash64("c"), "salts").cast("int").alias("salt"), F.lit(True).alias("member"))
    heads = sizes.select(F.col("hub").alias("c"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"), F.lit(False).alias("member"))
    return members.unionByName(heads)


def _streamed(rows: DataFrame, column: str, compare) -> DataFrame:
    """c, hub of the pairs that ``compare`` (hub's value, member's value) accepts; a hub's row stands before its members."""

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for part in parts:
            c, hub, salt, member, value = (part.column(x).to_pylist() for x in ("c", "hub", "salt", "member", column))
            found = []
            for i in range(part.num_rows):
                if not member[i]:
                    at, own = (hub[i], salt[i]), value[i]
                elif at == (hub[i], salt[i]) and compare(own, value[i]):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in found], pa.int64()), pa.array([hub[i] for i in found], pa.int64())], names=["c", "hub"])

    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(stream, "c long, hub long")


def _near_sketches(a: bytes, b: bytes) -> bool:
    return bool(_alike(_sketches([a]), _sketches([b]))[0])


def _near_sets(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.searchsorted(x, y)
    return _similar(int((x[np.minimum(at, len(x) - 1)] == y).sum()), len(x), len(y))


def _with_sets(roles: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """``roles`` with the full set of each row's class ``c``, made again from its representative's text."""
    needed = roles.select("c").distinct().join(reps, "c").select("c", F.col("rep.doc_id").alias("r"), F.col("rep.tag").alias("t"))
    needed = written(needed, "minhash-needed")
    texts = rows.join(small(needed), F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("tag") == F.col("t")))

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("c"), pa.array([s.tobytes() for s in shingles(part.column("text"))], pa.binary())], names=["c", "shingles"])

    return roles.join(texts.select("c", "text").mapInArrow(fetch, "c long, shingles binary").dropDuplicates(["c"]), "c")


def _members(lists: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """One row per class and list of several labels; in lists above BLOCK one for each pair of blocks that its block is in."""
    own = lists.join(labels, "c", "left").select("c", "prefix", F.coalesce("label", "c").alias("label"))
    own = written(own.join(reps.select("c", (1 + F.col("n") / 1024).alias("w")), "c"), "minhash-labelled")
    posts = own.select(F.explode("prefix").alias("v"), "c", "label", "w")
    each = posts.groupBy("v", "label").agg(F.sum("w").alias("w"))
    lists = each.groupBy("v").agg(F.max_by("label", "w").alias("major"), F.max("w").alias("most"), F.sum("w").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    apart = F.col("most") >= BLOCK  # its members get blocks of their own, behind the others'
    lists = lists.select("v", F.when(apart, F.col("major")).alias("major"), F.ceil(F.when(apart, F.col("all") - F.col("most")).otherwise(F.col("all")) / BLOCK).cast("int").alias("a"), F.when(apart, F.ceil(F.col("most") / BLOCK)).otherwise(0).cast("int").alias("d"))
    lists = written(lists, "minhash-open")
    rows = posts.join(small(lists), "v").withColumn("major", F.coalesce(F.col("label") == F.col("major"), F.lit(False)))
    dealt = F.xxhash64("c", "v")
    block = F.when(F.col("major"), F.col("a") + F.pmod(dealt, "d")).otherwise(F.pmod(dealt, "a")).cast("int")
    upto = F.when(F.col("major"), F.col("a")).otherwise(F.col("a") + F.col("d")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), upto - 1)))
    g = F.xxhash64("v", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(g.alias("g"), "v", "c", "label", "block", (F.col("block") != F.col("other")).alias("crossed"))
    rows = rows.join(own.select("c", "prefix"), "c").join(reps.select("c", "sketch"), "c")
    return rows.select([x.split()[0] for x in _MEMBER.split(", ")])


def _owned(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group of unlike labels whose sketches are alike and whose first common list this is."""
    n = table.num_rows
    g, v, label, block = (table.column(c).to_numpy() for c in ("g", "v", "label", "block"))
    crossed = table.column("crossed").to_numpy(zero_copy_only=False)
    sketch = _sketches(table.column("sketch").to_pylist())
    prefix = np.zeros((n, LOW), np.int64)
    for i, p in enumerate(table.column("prefix").to_pylist()):
        prefix[i, : len(p)] = p
    ends = np.flatnonzero(np.append(g[1:] != g[:-1], True)) + 1
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) - 1
    upto = np.cumsum(later)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")))
        reps = later[first:end]
        i = np.repeat(np.arange(first, end), reps)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
        ok = (label[i] != label[j]) & (~crossed[i] | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        ok = _alike(sketch[i], sketch[j])
        i, j = i[ok], j[ok]
        common = ((prefix[i][:, :, None] == prefix[j][:, None, :]) & (prefix[i] != 0)[:, :, None]).any(axis=2)
        ok = prefix[i, common.argmax(axis=1)] == v[i]
        yield i[ok], j[ok]
        first = end


def _likely(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(parts):
        wanted = np.zeros(table.num_rows, bool)
        for i, j in _owned(table):
            wanted[i] = wanted[j] = True
        yield from table.filter(pa.array(wanted)).to_batches()


def _verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, hub: for each label of a group that a link joins with others, the least of them."""
    for table in groups(parts):
        sets = table.column("shingles").to_pylist()
        label, root = table.column("label").to_pylist(), {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in _owned(table):
            for a, b in zip(i.tolist(), j.tolist()):
                x, y = top(label[a]), top(label[b])
                if x != y and _near_sets(sets[a], sets[b]):
                    root[max(x, y)] = min(x, y)
        found = [x for x in root if top(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([top(x) for x in found], pa.int64())], names=["cls", "hub"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of all that links reach), kept."""
    rows = own_names(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "xxhash64(coalesce(text, '')) tag", "text")
    sketches = written(spread(rows).mapInArrow(_sketched, _SKETCH), "minhash-sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    reps = sketches.where("cls is not null").groupBy("cls", "n").agg(rep.alias("rep"), F.first("low").alias("low"), F.first("sketch").alias("sketch"))
    reps = written(reps.withColumn("c", F.monotonically_increasing_id()), "minhash-reps")
    lists = _lists(reps)

    posts = lists.select(F.explode("prefix").alias("v"), "c")
    hub = F.min(F.struct(F.xxhash64("c").alias("h"), "c"))["c"]
    hubs = written(posts.groupBy("v").agg(hub.alias("hub"), F.count("*").alias("size")).where("size > 1").select("v", "hub"), "minhash-hubs")
    overlaps = posts.join(small(hubs), "v").where("c <> hub").groupBy("c", "hub").agg(F.count("*").alias("overlap"))
    best = written(overlaps.groupBy("c").agg(F.max(F.struct("overlap", "hub"))["hub"].alias("hub")), "minhash-best")
    by_hub = _by_hub(best).join(reps.select("c", "sketch"), "c")
    likely = written(_streamed(by_hub, "sketch", _near_sketches), "minhash-likely")
    linked = written(_streamed(_with_sets(_by_hub(likely), reps, rows), "shingles", _near_sets), "minhash-linked")
    labels = written(components(linked.select(F.col("c").alias("cls"), "hub")).withColumnRenamed("cls", "c"), "minhash-labels")

    by_group = lambda df: df.repartition("g").sortWithinPartitions("g", "c")
    close = written(by_group(_members(lists, labels, reps)).mapInArrow(_likely, _MEMBER), "minhash-close")
    joined = by_group(_with_sets(close, reps, rows)).mapInArrow(_verified, "cls long, hub long")
    higher = components(written(joined, "minhash-joined")).select(F.col("cls").alias("label"), F.col("label").alias("higher"))

    known = reps.select("c", "cls", "rep").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    known = known.join(written(higher, "minhash-higher"), "label", "left").withColumn("label", F.coalesce("higher", "label"))
    known = written(known.select("cls", "label", "rep"), "minhash-known")
    heads = known.groupBy("label").agg(F.min("rep").alias("head"))
    info = known.join(heads, "label").select("cls", F.col("head.doc_id").alias("component_id"), F.lit(True).alias("some"))
    out = sketches.select("doc_id", "n", "cls").join(info, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("some"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i : i + least(len(l), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM l WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM b JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE both_n * 9 >= (nx.n + ny.n) * 4),
reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON p.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
