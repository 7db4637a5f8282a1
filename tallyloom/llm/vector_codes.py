"""Compression of vectors to one-byte codes by parts: product quantisation in whole numbers, so that every run agrees.

1. Each component x becomes floor(4096 * x); a vector is cut into ``PARTS`` consecutive parts, equal where its length
   allows it, else the first ones are longer by one component.
2. Vectors are written as columnar blocks: one row holds up to ``BLOCK`` vectors of one length, component by component.
3. The entries of each part's codebook begin as that part of the ``ENTRIES`` smallest ids' vectors. A round is one RDD
   ``treeAggregate`` over the blocks: a block's distances to all entries accumulate dimension by dimension, ``np.add.at``
   adds its members' components and their number to int64 tensors, and the tensors of all tasks merge through a tree of
   reductions. What reaches the driver is one tensor of entries times components, whatever the number of vectors.
4. A last pass assigns all parts and returns codes and errors. Errors are summed by label before they are joined back.

Blocks lie in the shared folder, so a lost executor costs a re-read. Rows whose vector is null or holds null or
non-finite components drop out. Vectors of different lengths have codebooks of their own, and the hash is that of the
row's own length. A null id is above all others when entries are chosen, equal ids stand in the order of their
components; repeated rows count each. With fewer vectors than entries, a codebook has as many entries as there are
vectors. An empty vector has codes 0 and error 0. Components beyond 2 ** 26 are computed in whole numbers of any size, and
an error beyond a long is given as the largest long. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import own_names, small, spread, written

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK = 8, 16, 6, 4096, 8192
#: Components up to this size keep all distances and sums within int64; larger ones are Python integers.
PLAIN = 1 << 26
LARGEST = (1 << 63) - 1


def bounds(dim: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    each, more = divmod(dim, PARTS)
    ends = [each * (p + 1) + min(p + 1, more) for p in range(PARTS)]
    return list(zip([0, *ends[:-1]], ends))


def whole(data: bytes, dim: int, n: int) -> np.ndarray:
    """(dim, n) scaled and floored components of a block."""
    x = np.frombuffer(data, "<f8").reshape(dim, n)
    if np.abs(x).max(initial=0) * SCALE < PLAIN:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(dim, n)


def assign(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each column of ``part`` (width, n) in ``book`` (entries, width), ties to the lower one, and its distance."""
    kind = object if object in (part.dtype, book.dtype) else np.int64
    far = np.zeros((len(book), part.shape[1]), kind)
    for j in range(len(part)):
        step = part[j][None, :] - book[:, j, None]
        far += step * step
    code = far.argmin(axis=0)
    return code, np.take_along_axis(far, code[None, :], 0)[0]


def _blocks(dim_type: str):
    names = ["dim", "n", "ids", "labels", "data"]

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}
        rows: dict[int, int] = {}

        def row(dim: int) -> pa.RecordBatch:
            got = held.pop(dim)
            n = rows.pop(dim)
            ids, labels = (pa.concat_arrays([g[k] for g in got]) for k in (0, 1))
            data = np.concatenate([g[2] for g in got]).T.astype("<f8").tobytes()  # component by component
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a) for a in (ids, labels)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int32()), *lists, pa.array([data], pa.binary())], names=names)

        for part in parts:
            v = part.column("v")
            size = np.diff(np.asarray(v.offsets))
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                some = part.take(pa.array(own))
                x = some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dim)
                held.setdefault(dim, []).append((some.column("vec_id"), some.column("label"), x))
                rows[dim] = rows.get(dim, 0) + len(own)
                if rows[dim] >= BLOCK:
                    yield row(dim)
        for dim in list(held):
            yield row(dim)

    return blocks, f"dim int, n int, ids array<long>, labels array<{dim_type}>, data binary"


def _smallest(found: dict, block) -> dict:
    """The ``ENTRIES`` first (id is null, id, vector) of each length."""
    q = whole(block.data, block.dim, block.n)
    ids = block.ids
    order = sorted(range(block.n), key=lambda i: (ids[i] is None, ids[i] or 0))
    last = order[min(ENTRIES, block.n) - 1]
    upto = [i for i in order[:ENTRIES]] + [i for i in order[ENTRIES:] if ids[i] == ids[last]]
    own = [(ids[i] is None, ids[i] or 0, tuple(int(c) for c in q[:, i])) for i in upto]
    return _merged_smallest(found, {block.dim: own})


def _merged_smallest(a: dict, b: dict) -> dict:
    return {dim: sorted(a.get(dim, []) + b.get(dim, []))[:ENTRIES] for dim in a.keys() | b.keys()}


def _added(books: dict):
    def added(total: dict, block) -> dict:
        """The members' components and number by part and entry, added to those of the blocks before."""
        q, own = whole(block.data, block.dim, block.n), books[block.dim]
        sums, counts = total.get(block.dim) or ([np.zeros_like(b) for b in own], np.zeros((PARTS, len(own[0])), np.int64))
        for p, (a, b) in enumerate(bounds(block.dim)):
            code, _ = assign(q[a:b], own[p])
            if q.dtype == object and sums[p].dtype != object:
                sums[p] = sums[p].astype(object)
            np.add.at(sums[p], code, q[a:b].T)
            np.add.at(counts[p], code, 1)
        total[block.dim] = (sums, counts)
        return total

    return added


def _merged(a: dict, b: dict) -> dict:
    for dim, (sums, counts) in b.items():
        if dim in a:
            a[dim] = ([x + y for x, y in zip(a[dim][0], sums)], a[dim][1] + counts)
        else:
            a[dim] = (sums, counts)
    return a


def _integers(rows: list[tuple[int, ...]]) -> np.ndarray:
    """Rows of components as int64, or as Python integers where these are large."""
    plain = all(abs(c) < PLAIN for r in rows for c in r)
    return np.array(rows, np.int64 if plain else object).reshape(len(rows), -1)


def codebooks(blocks: DataFrame, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """For each length of vectors the final codebook, (entries, width), of every part."""
    rdd = blocks.rdd
    seeds = rdd.treeAggregate({}, _smallest, _merged_smallest)
    books = {dim: [_integers([v[a:b] for _, _, v in first]) for a, b in bounds(dim)] for dim, first in seeds.items()}
    for _ in range(rounds):
        for dim, (sums, counts) in rdd.treeAggregate({}, _added(books), _merged).items():
            for p in range(PARTS):
                used = counts[p] > 0
                books[dim][p] = books[dim][p].astype(sums[p].dtype, copy=True)
                books[dim][p][used] = sums[p][used] // counts[p][used, None]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()


def _coded(books: dict):
    shas = {dim: digest(b) for dim, b in books.items()}

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                dim, n = part.column("dim")[k].as_py(), part.column("n")[k].as_py()
                q, error, codes = whole(part.column("data")[k].as_py(), dim, n), np.zeros(n, np.int64), np.zeros((n, PARTS), np.uint8)
                for p, (a, b) in enumerate(bounds(dim)):
                    codes[:, p], far = assign(q[a:b], books[dim][p])
                    error = error + far
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("ids")[k].values, part.column("labels")[k].values,
                        pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
                        pa.array([min(int(e), LARGEST) for e in error], pa.int64()), pa.array([shas[dim]] * n, pa.string()),
                    ],
                    names=["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    return coded


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: vec_id, code, error, label_error, codebooks_sha256."""
    kind = vectors.schema[label_col].dataType.simpleString()
    rows = own_names(vectors, vec_id=id_col, v=vector_col, label=label_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), "label")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    make, schema = _blocks(kind)
    blocks = written(spread(rows.where(F.coalesce(fine, F.lit(False)))).mapInArrow(make, schema), "codes-blocks")
    books = codebooks(blocks, rounds)
    found = blocks.mapInArrow(_coded(books), f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")
    found = written(found, "codes-found")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = written(found.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "codes-sums")
    return found.join(small(sums), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    far = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)])"
    near = f"SELECT i, part, min(CAST({far} AS HUGEINT) * 64 + e) AS m FROM p JOIN b{{r}} USING (part) GROUP BY i, part"
    sql = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, q) AS i, * FROM (
    SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)),
p AS MATERIALIZED (SELECT i, part, q[part * len(q) // {PARTS} + 1 : (part + 1) * len(q) // {PARTS}] AS v FROM k, range({PARTS}) r(part)),
b0 AS MATERIALIZED (SELECT part, i - 1 AS e, v AS c FROM p WHERE i <= {ENTRIES}),"""
    for r in range(ROUNDS):
        sql += f"""
s{r} AS (SELECT part, m % 64 AS e, j, sum(v[j]) AS s, count(*) AS n FROM ({near.format(r=r)}) JOIN p USING (i, part), range(1, 65) g(j) WHERE j <= len(v) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(n.c, b{r}.c) AS c FROM b{r} LEFT JOIN (
    SELECT part, e, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY j) AS c FROM s{r} GROUP BY part, e) n USING (part, e)),"""
    return sql + f"""
f AS MATERIALIZED ({near.format(r=ROUNDS)}),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS}),
o AS (SELECT i, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM f GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (i), sha
"""


ORACLE = _oracle()
