"""Stupid-backoff scores of documents against the n-gram counts of the rest of their corpus.

1. Documents are dealt into blocks of about ``block_bytes`` by a hash of id, text and place in the table.
2. Each block explodes its texts into the n-grams of orders 1 to ``order`` and sends every distinct one, with its count,
   to the shard that its hash names: one row per (block, order, shard) holds them packed, sorted and delta coded.
3. Each shard adds the counts of its n-grams over all blocks. That is the count table, partitioned by hash. It is joined
   back to the blocks' n-grams: a row per (block, order, shard) with the total counts in the same order.
4. The block's documents meet these counts, and logarithms of the scores are summed by document.

A document's own n-grams are taken out of every count, so a text is scored by the rest of the corpus (its copies
included): S(w | h) = c(h w) / c(h) if c(h w) > 0, else ``backoff`` * S(w | shorter h); a word that no other text has
counts as one place in the corpus after one more backoff. Nothing is sampled or pruned, and what is gathered grows in
proportion to the corpus. A frequent n-gram is one entry of a block, however often it occurs there.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, ASCII case folded. N-grams are told apart
by a hash of 48 bits within their shard, of 64 in all from 65,536 shards on; shards double with the corpus, without a limit.

Nulls: a null text has no words; its score is 0 and its mean null. A null id is passed on. Repeated rows are part of the
corpus each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import wordhash
from tallyloom.llm.shared import own_names, written

ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a block, and of text behind a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 8 << 20
KEY_BITS = 48


def _key_bits(shard_bits: int) -> int:
    """Bits that are left to the key of a 64-bit hash once its first ``shard_bits`` name the shard."""
    return min(KEY_BITS, 64 - shard_bits)


_SENT = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SENT_DDL = "block long, n int, shard int, keys binary, counts binary"
_BACK_DDL = "block long, n int, shard int, counts binary"
_OUT_DDL = "doc_id long, n_words long, sum_log double, n_base long"


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; counts from 255 follow in full."""
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as steps: their low 32 bits, then the byte above, then the highest, which is nearly always 0."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return b"".join((steps >> np.uint64(at)).astype(kind).tobytes() for at, kind in ((0, "<u4"), (32, "u1"), (40, "u1")))


def _unpack_keys(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    steps = np.frombuffer(raw, "<u4", n).astype(np.uint64)
    for at, place in ((32, 4 * n), (40, 5 * n)):
        steps |= np.frombuffer(raw, "u1", n, place).astype(np.uint64) << np.uint64(at)
    return np.cumsum(steps, dtype=np.uint64)


def _grams(texts: pa.Array, order: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each row; the row of each word; for each order the key of the n-gram that ends at each word, ~0 where none does."""
    data, offsets = wordhash.text_bytes(texts)
    hashes, counts = [], []
    for _, _, part, at in wordhash.chunks(data, offsets):
        h, upto = wordhash.words(part, at)
        hashes.append(h)
        counts.append(np.diff(upto))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    per_row = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(per_row)), per_row)
    place = np.arange(len(h)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    keys = []
    for n in range(1, order + 1):
        key = np.full(len(h), ~np.uint64(0))
        if len(h) >= n:
            g = wordhash.grams(h, n) >> np.uint64(64 - _key_bits(shard_bits) - shard_bits)
            key[n - 1 :] = np.where(place[n - 1 :] >= n - 1, g, ~np.uint64(0))
        keys.append(key)
    return per_row, row, keys


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys without ~0, their counts, and for each place the position of its key (its own length where none)."""
    found, place, n = np.unique(key, return_inverse=True, return_counts=True)
    if len(found) and found[-1] == ~np.uint64(0):
        found, n = found[:-1], n[:-1]
    return found, n, place


def _texts(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _explode(order: int, shard_bits: int):
    bits = _key_bits(shard_bits)
    low = np.uint64((1 << bits) - 1)

    def explode(key, table):
        _, _, keys = _grams(_texts(table), order, shard_bits)
        rows = []
        for n in range(order):
            found, counts, _ = _distinct(keys[n])
            shard = (found >> np.uint64(bits)).astype(np.int64)
            edges = np.flatnonzero(np.diff(shard, prepend=-1, append=1 << shard_bits))
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a:
                    rows.append((key[0].as_py(), n + 1, int(shard[a]), _pack_keys(found[a:b] & low), _pack_counts(counts[a:b])))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)

    return explode


def _add(key, table):
    """One shard of one order: total counts for every block's keys."""
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    flat = np.concatenate(keys)
    own = np.concatenate([_unpack_counts(c, n) for c, n in zip(table.column("counts").to_pylist(), sizes)])
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sums = np.repeat(np.add.reduceat(own[order], start), np.diff(start, append=len(flat)))
    total = np.empty(len(flat), np.int64)
    total[order] = sums
    edges = np.cumsum([0, *sizes])
    packed = [_pack_counts(total[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return table.select(["block", "n", "shard"]).append_column("counts", pa.array(packed, pa.binary()))


def _score(order: int, shard_bits: int, backoff: float):
    def score(key, docs, back):
        per_row, row, keys = _grams(_texts(docs), order, shard_bits)
        answers = {(n, s): c for n, s, c in zip(*(back.column(x).to_pylist() for x in ("n", "shard", "counts")))}
        rest = []  # for each order and word: the count of the n-gram that ends there, in the other documents
        for n in range(1, order + 1):
            found, _, place = _distinct(keys[n - 1])
            shard = (found >> np.uint64(_key_bits(shard_bits))).astype(np.int64)
            edges = np.flatnonzero(np.diff(shard, prepend=-1, append=1 << shard_bits))
            total = np.concatenate([_unpack_counts(answers[n, int(shard[a])], int(b - a)) for a, b in zip(edges[:-1], edges[1:]) if b > a] or [np.zeros(0, np.int64)])
            ok = place < len(found)
            pair = row * (len(found) + 1) + place
            _, which, own = np.unique(pair, return_inverse=True, return_counts=True)
            other = np.zeros(len(place), np.int64)
            other[ok] = total[place[ok]] - own[which[ok]]
            rest.append(other)
        place = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        value, base, open_ = np.zeros(len(row)), np.zeros(len(row), np.int64), np.ones(len(row), bool)
        for n in range(order, 1, -1):
            there = open_ & (place >= n - 1)
            hit = there & (rest[n - 1] > 0)
            context = np.ones(len(row), np.int64)
            context[1:] = rest[n - 2][:-1]  # the n-gram without its last word ends one word earlier
            value[hit] += np.log(rest[n - 1][hit] / context[hit])
            open_ &= ~hit
            value[there & ~hit] += math.log(backoff)
        value[open_] += np.where(rest[0][open_] > 0, np.log(np.maximum(rest[0][open_], 1)), math.log(backoff))
        base[open_] = 1
        n_docs = len(per_row)
        sums, bases = np.bincount(row, value, n_docs).astype(np.float64), np.bincount(row, base, n_docs).astype(np.int64)
        return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(per_row.astype(np.int64)), pa.array(sums), pa.array(bases)], names=["doc_id", "n_words", "sum_log", "n_base"])

    return score


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, score (sum of natural logarithms), mean_score (per word)."""
    rows = own_names(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shard_bits = max(1, -(-size // block_bytes)), min(31, max(0, math.ceil(math.log2(max(1, size / shard_bytes)))))
    # rows that are equal, or without id, part as well: their place in the table is in the hash
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(blocks).cast("long")))
    sent = dealt.groupBy("block").applyInArrow(_explode(order, shard_bits), _SENT_DDL)
    back = sent.groupBy("n", "shard").applyInArrow(_add, _BACK_DDL)
    out = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(order, shard_bits, backoff), _OUT_DDL)
    out = written(out, "lm-sums")
    words = out.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)).cast("double")
    total = F.col("sum_log") - F.col("n_base") * F.log(others)
    return out.select("doc_id", "n_words", total.alias("score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_score"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i, len(l) AS n_words FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[0-9a-z\x{80}-\x{10FFFF}]+') AS l FROM documents)),
g AS (
  SELECT *, lag(w, 1) OVER d AS v, lag(w, 2) OVER d AS u FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT w, doc_id, count(*) AS own, sum(count(*)) OVER (PARTITION BY w) AS every FROM g GROUP BY w, doc_id),
two AS (SELECT v, w, doc_id, count(*) AS own, sum(count(*)) OVER (PARTITION BY v, w) AS every FROM g WHERE v IS NOT NULL GROUP BY v, w, doc_id),
three AS (SELECT u, v, w, doc_id, count(*) AS own, sum(count(*)) OVER (PARTITION BY u, v, w) AS every FROM g WHERE u IS NOT NULL GROUP BY u, v, w, doc_id),
c AS (
  SELECT g.doc_id, g.i, g.n_words, CAST(a.every - a.own AS DOUBLE) AS c1, CAST(pa.every - pa.own AS DOUBLE) AS p1,
         CAST(b.every - b.own AS DOUBLE) AS c2, CAST(pb.every - pb.own AS DOUBLE) AS p2, CAST(t.every - t.own AS DOUBLE) AS c3,
         (SELECT count(*) FROM g) - g.n_words AS others
  FROM g JOIN one a ON a.w = g.w AND a.doc_id = g.doc_id
  LEFT JOIN one pa ON pa.w = g.v AND pa.doc_id = g.doc_id
  LEFT JOIN two b ON b.v = g.v AND b.w = g.w AND b.doc_id = g.doc_id
  LEFT JOIN two pb ON pb.v = g.u AND pb.w = g.v AND pb.doc_id = g.doc_id
  LEFT JOIN three t ON t.u = g.u AND t.v = g.v AND t.w = g.w AND t.doc_id = g.doc_id),
s AS (
  SELECT doc_id, CASE
      WHEN c3 > 0 THEN ln(c3 / p2)
      WHEN c2 > 0 THEN ln(c2 / p1) + CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END
      ELSE CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END + CASE WHEN i >= 2 THEN ln(0.4) ELSE 0 END
           + CASE WHEN c1 > 0 THEN ln(c1) ELSE ln(0.4) END - ln(greatest(others, 1)) END AS x
  FROM c)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(x, 0) AS score, x / n AS mean_score
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(x) AS x FROM s GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
