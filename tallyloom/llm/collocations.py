"""Phrases whose words stand together more often than chance: count tries of shards, merged by ranges of prefixes.

1. Words are counted by language. Those with at least ``min_count`` occurrences are the trie's first level.
2. Every task builds count tries of its share of the texts, a shard at a time: a node is a phrase, named by the hash of its
   path. Only nodes whose parts are frequent are built, as a phrase is never more frequent than these: first those of depth 2,
   below them those of depth 3, each as keys and counts alone, then depths 2 to 5 with their structure. Which nodes are frequent
   is told by a bit filter of at most 16 MB (``FILTER_BITS``) a depth; what it lets through in error only costs rows, as the
   merged counts decide.
3. A shard's trie is serialised in the order of its paths, the first two words first, as packed chunks. Boundaries are
   taken from the chunks' first paths, so that ranges hold about ``RANGE_NODES`` nodes each, however frequent a prefix
   is. A task merges the sorted runs of one range of all shards and adds their counts.
4. In the merged trie a node's parent is its phrase without the last word, its suffix link its phrase without the first.
   Level by level, a node takes the counts of its left parts from its parent (the walk from the root) and those of its right
   parts from its suffix link. Scores are computed as decimals of 38 digits.
5. A phrase is dropped if one that is longer by a word has at least ``cover`` per cent of its count; longer ones are never
   more frequent than these, so no further comparison is needed.

A-Z are lower-cased, ``[.,;:!?]`` and line ends cut texts into pieces, blanks and tabs cut these into words. Null texts and
texts without words count nothing; a null language is ``und``, together with those that are named so. Repeated rows count
each. Very long texts are counted whole. Ties are broken by count and phrase, which is unique within a language. Paths are
told apart by 64-bit hashes. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import wordhash
from tallyloom.llm.shared import own_names, spread, written

DEPTH, MIN_COUNT, TOP, COVER = 5, 100, 2000, 100
#: Depths that are counted one by one before the trie of all depths is built.
COUNTED = 3
#: Positions that a task gathers before it builds a shard's trie of them, nodes of a serialised chunk and of a merged range.
SHARD_PLACES, CHUNK_NODES, RANGE_NODES = 1 << 20, 1 << 13, 1 << 18
#: Bytes of chunks that a task takes in at once.
BATCH_BYTES = 16 << 20
#: Bits of a filter at most, and for each key as long as that allows.
FILTER_BITS, BITS_PER_KEY = 1 << 27, 16

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAKS
_WORD[[9, 32]] = False

_WORDS = "lang string, key long, word string, n long"
_TRIE = "first long, nodes int, keys binary, counts binary, more binary"
_PART = "range int, keys binary, counts binary, more binary"
_NODES = "key long, f long, depth int, parent long, link long"
#: What a node holds besides its key where the trie keeps its structure.
_MORE = np.dtype([("top", "<u4"), ("depth", "u1"), ("parent", "<u8"), ("link", "<u8")])


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _located(part: pa.RecordBatch) -> Iterator[tuple]:
    """For chunks of rows: each word's hash (of its language too), piece, row, begin and end, and the bytes."""
    langs = part.column("lang").to_pylist()
    seeds = {x: _seed(x) for x in set(langs)}
    seed = np.array([seeds[x] for x in langs], np.uint64)
    for top, _, data, offsets in wordhash.chunks(*wordhash.text_bytes(part.column("text"))):
        starts, ends = wordhash.spans(data, offsets, _WORD)
        row = np.searchsorted(offsets, starts, "right") - 1
        h = wordhash.mix(wordhash.span_hashes(data, starts, ends, wordhash.VALUE_FOLDED) ^ seed[top + row])
        piece = np.cumsum(_BREAKS[data])[starts] + row if len(data) else starts  # rises at each break and each row
        yield h, piece, top + row, starts, ends, data


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings, A-Z lower-cased."""
    size = ends - starts
    upto = np.concatenate(([0], np.cumsum(size)))
    flat = data[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(wordhash.FOLDED[flat].tobytes()))


def _counted_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        keys, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        found, first, place = np.unique(keys, return_index=True, return_inverse=True)
        total, take = np.zeros(len(found), np.int64), pa.array(first)
        np.add.at(total, place, n)
        return found, total, *(pa.concat_arrays([x[k] for x in held]).take(take) for k in (2, 3))

    def batch() -> pa.RecordBatch:
        keys, n, words, langs = merged()
        return pa.RecordBatch.from_arrays([langs, pa.array(keys.view(np.int64)), words.cast(pa.string()), pa.array(n)], names=["lang", "key", "word", "n"])

    rows = 0
    for part in parts:
        lang = part.column("lang")
        for h, _, row, starts, ends, data in _located(part):
            found, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((found, n, _strings(data, starts[first], ends[first]), lang.take(pa.array(row[first]))))
            rows += len(found)
            if rows >= SHARD_PLACES // 4:
                held[:] = [merged()]
                rows = len(held[0][0])
                if rows >= SHARD_PLACES // 8:  # mostly distinct words: a shard of its own
                    yield batch()
                    held.clear()
                    rows = 0
    if held:
        yield batch()


class Filter:
    """A bit filter of keys: two bits each. It may hold what was never put in, but never lacks what was."""

    def __init__(self, keys: DataFrame, n: int, most: int):
        self.mask = min(most, max(1 << 16, 1 << (BITS_PER_KEY * n - 1).bit_length())) - 1
        at = F.explode(F.array(F.col("key").bitwiseAND(self.mask), F.shiftrightunsigned("key", 29).bitwiseAND(self.mask)))
        cells = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits"))
        found = cells.toArrow()  # at most mask / 64 rows
        self.bits = np.zeros((self.mask + 1) // 64, np.uint64)
        self.bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in (keys & np.uint64(self.mask), (keys >> np.uint64(29)) & np.uint64(self.mask)):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _child(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The paths' names one word further down."""
    return wordhash.mix(parent * np.uint64(0x9E3779B97F4A7C15) + word)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Steps modulo 2 ** 64 by planes of 32, 16 and 16 bits; the last is nearly always 0 where keys are sorted."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return b"".join((steps >> np.uint64(at)).astype(kind).tobytes() for at, kind in ((0, "<u4"), (32, "<u2"), (48, "<u2")))


def _unpack_keys(raw: bytes) -> np.ndarray:
    n = len(raw) // 8
    steps = np.frombuffer(raw, "<u4", n).astype(np.uint64)
    for bits, at in ((32, 4 * n), (48, 6 * n)):
        steps |= np.frombuffer(raw, "<u2", n, at).astype(np.uint64) << np.uint64(bits)
    return np.cumsum(steps, dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    """A byte each; counts from 255 follow in full."""
    large = n >= 255
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[large].astype("<i8").tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def _place(keys: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """A node's place in the order of paths, as a positive long: 32 bits of its first two words, 31 of all of it."""
    top = keys >> np.uint64(32) if more is None else more["top"].astype(np.uint64)
    return (top << np.uint64(31) | keys >> np.uint64(33)).astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Nodes in the order of paths, equal ones added. The sort is stable: it merges the runs that it is given."""
    order = np.argsort(keys, kind="stable")
    if more is not None:
        order = order[np.argsort(_place(keys[order], more[order]), kind="stable")]
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    total = np.add.reduceat(n[order], first) if len(keys) else n
    return keys[first], total, None if more is None else more[order][first]


def _nodes(h: np.ndarray, piece: np.ndarray, filters: list[Filter], structure: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Nodes (keys, and the rest where there is structure) of a chunk's positions, depth by depth.

    ``at``: where the nodes of a depth begin; ``held[i]``: a node of the depth above begins at i, and ``name[i]`` is its key. A
    node of the next depth begins where one does at its own place and one at the next place, which is its suffix link.
    """
    at = np.flatnonzero(filters[0].holds(h))
    key, top = h[at], None
    for depth in range(2, DEPTH + 1 if structure else len(filters) + 2):
        held, name = np.zeros(len(h) + 1, bool), np.zeros(len(h) + 1, np.uint64)
        held[at], name[at] = True, key
        on = held[at + 1]
        if depth == 2:
            on[on] = piece[at[on]] == piece[at[on] + 1]
        at, parent = at[on], key[on]
        key = _child(parent, h[at + depth - 1])
        top = key if depth == 2 else top[on]
        if depth <= len(filters):
            known = filters[depth - 1].holds(key)
            at, key, parent, top = at[known], key[known], parent[known], top[known]
        if structure:
            more = np.zeros(len(key), _MORE)
            more["top"], more["depth"], more["parent"], more["link"] = top >> np.uint64(32), depth, parent, name[at + 1]
            yield key, more
        elif depth > len(filters):
            yield key, None


def _tries(filters: list[Filter], structure: bool):
    """Serialised shard tries below the nodes that ``filters`` hold, one for each depth from 1 on.

    Without ``structure`` they have the nodes of the next depth alone, whose parts are all held, as keys and counts. With it they
    have those of depths 2 to DEPTH, each with its parent and suffix link.
    """

    def chunks(held: list[tuple[np.ndarray, np.ndarray | None]]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _ in held])
        keys, n, more = _summed(keys, np.ones(len(keys), np.int64), np.concatenate([m for _, m in held]) if structure else None)
        place = _place(keys, more)
        for a in range(0, len(keys), CHUNK_NODES):
            b = min(a + CHUNK_NODES, len(keys))
            row = [int(place[a]), b - a, _pack_keys(keys[a:b]), _pack_counts(n[a:b]), None if more is None else more[a:b].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["first", "nodes", "keys", "counts", "more"])

    def tries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray | None]] = []
        size = 0
        for part in parts:
            for h, piece, *_ in _located(part):
                for found in _nodes(h, piece, filters, structure):
                    held.append(found)
                    size += len(found[0])
                if size >= SHARD_PLACES:
                    yield from chunks(held)
                    held, size = [], 0
        if size:
            yield from chunks(held)

    return tries


def _cut(bounds: np.ndarray):
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks cut where ranges begin."""
        for part in parts:
            for raw_keys, raw_counts, raw_more in zip(*(part.column(c) for c in ("keys", "counts", "more"))):
                keys = _unpack_keys(raw_keys.as_py())
                n, more = _unpack_counts(raw_counts.as_py(), len(keys)), np.frombuffer(raw_more.as_py(), _MORE) if raw_more.is_valid else None
                owner = np.searchsorted(bounds, _place(keys, more), "right")
                edges = np.flatnonzero(np.diff(owner, prepend=-1, append=len(bounds) + 1))
                rows = [(int(owner[a]), _pack_keys(keys[a:b]), _pack_counts(n[a:b]), None if more is None else more[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["range", "keys", "counts", "more"])

    return cut


def _merge(least: int):
    def merge(key, table):
        """One range of all shards: its nodes with at least so many occurrences."""
        keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
        n = np.concatenate([_unpack_counts(c, len(k)) for c, k in zip(table.column("counts").to_pylist(), keys)])
        raw = table.column("more").to_pylist()
        more = None if raw[0] is None else np.concatenate([np.frombuffer(m, _MORE) for m in raw])
        keys, n, more = _summed(np.concatenate(keys), n, more)
        often = n >= least
        more = np.zeros(len(keys), _MORE)[often] if more is None else more[often]
        columns = [keys[often].view(np.int64), n[often], more["depth"].astype(np.int32), more["parent"].astype(np.uint64).view(np.int64), more["link"].astype(np.uint64).view(np.int64)]
        return pa.table(dict(zip(("key", "f", "depth", "parent", "link"), map(pa.array, columns))))

    return merge


def _merged(tries: DataFrame, least: int, range_nodes: int) -> DataFrame:
    tries = written(tries, "phrase-tries")
    total = tries.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("n"), F.count("*").alias("chunks")).first()
    ranges = max(1, min(total["chunks"], 2 * tries.sparkSession.sparkContext.defaultParallelism), math.ceil(total["n"] / range_nodes))
    shares = [k / ranges for k in range(1, ranges)]
    found = tries.agg(F.percentile_approx("first", shares or [0.5], 10 * ranges + 100).alias("b")).first()["b"] if shares else []
    bounds = np.unique(np.array(found or [], np.int64))
    return tries.select("keys", "counts", "more").mapInArrow(_cut(bounds), _PART).groupBy("range").applyInArrow(_merge(least), _NODES)


def _scored(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)) without rounding: 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, below = (wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)")).alias("t"), (wide(left) * wide(right)).alias("b")
    return F.call_function("div", top, below)


def mine(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER,
    filter_bits: int = FILTER_BITS, range_nodes: int = RANGE_NODES,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score."""
    rows = own_names(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    rows = spread(rows)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    words = written(rows.mapInArrow(_counted_words, _WORDS).groupBy("lang", "key", "word").agg(F.sum("n").alias("f")), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level = written(words.where(F.col("f") >= min_count).select("key", "lang", "f", F.array("word").alias("words"), *[F.array().cast("array<long>").alias(c) for c in ("lefts", "rights")]), "phrase-level")
    filters = [Filter(level.select("key"), level.count(), filter_bits)]
    for _ in range(2, COUNTED + 1):
        keys = written(_merged(rows.mapInArrow(_tries(filters, False), _TRIE), min_count, range_nodes).select("key"), "phrase-keys")
        filters.append(Filter(keys, keys.count(), filter_bits))
    nodes = written(_merged(rows.mapInArrow(_tries(filters, True), _TRIE), min_count, range_nodes), "phrase-nodes")

    found = None
    for depth in range(2, DEPTH + 1):
        parents = level.select(F.col("key").alias("parent"), "lang", F.col("words").alias("before"), "lefts", F.col("f").alias("left"))
        links = level.select(F.col("key").alias("link"), F.element_at("words", -1).alias("last"), "rights", F.col("f").alias("right"))
        own = nodes.where(F.col("depth") == depth).join(parents, "parent").join(links, "link")
        own = own.select(
            "key", "lang", "f", F.concat("before", F.array("last")).alias("words"), "parent", "link",
            F.concat("lefts", F.array("left")).alias("lefts"), F.concat(F.array("right"), "rights").alias("rights"),
        )
        level = written(own, "phrase-level")
        found = level if found is None else found.unionByName(level)
    longer = found.where(F.size("words") > 2)
    longer = longer.select(F.col("parent").alias("key"), "f").unionByName(longer.select(F.col("link").alias("key"), "f")).groupBy("key").agg(F.max("f").alias("most"))
    kept = found.join(longer, "key", "left").where(F.coalesce(F.col("most").cast("decimal(19,0)") * 100 < F.col("f").cast("decimal(19,0)") * cover, F.lit(True)))
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda z, k: F.struct(_scored(F.col("f"), F.col("n"), z["lefts"], z["rights"]).alias("score"), k.alias("k"), z["lefts"].alias("l"), z["rights"].alias("r")))
    best = kept.join(sizes, "lang").select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", F.array_min(cuts).alias("cut"))
    best = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS MATERIALIZED (
  SELECT lang, g, count(*) AS f FROM (
    SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) r(k) WHERE len(w) >= k))
  GROUP BY lang, g HAVING count(*) >= 100),
x AS (
  SELECT a.lang, a.g, a.f AS a, l.f AS l, r.f AS r, n.n, CAST(CAST(1000 AS HUGEINT) * a.f * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, k
  FROM c a, range(1, 5) s(k) JOIN n ON n.lang = a.lang JOIN c l ON l.lang = a.lang AND l.g = a.g[1:k] JOIN c r ON r.lang = a.lang AND r.g = a.g[k + 1:]
  WHERE len(a.g) > k),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
d AS (SELECT lang, g[i : j] AS g, max(f) AS f FROM c, range(1, 6) s(i), range(1, 6) t(j) WHERE j > i AND j <= len(g) AND j - i + 1 < len(g) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank
  FROM b LEFT JOIN d ON d.lang = b.lang AND d.g = b.g WHERE d.f IS NULL OR 100 * d.f < 100 * b.a) WHERE rank <= 2000
"""
