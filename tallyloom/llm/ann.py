"""Maximum inner product search with score-aware (anisotropic) quantisation.

1. Equal vectors form one entry, which keeps its ``k`` + 1 smallest ids: no query can return more of them. They are
   ranked before the exchange, so a vector that a third of all rows share moves as a few rows of each task.
2. Codebooks of 16 centres for every two components are fitted on at most ``SAMPLE`` entries, chosen by hash. The loss
   weighs the residual along a vector ``eta`` times as much as that across it, since the former is what changes large
   inner products; assignment is by coordinate descent, centres are the weighted least-squares solutions.
3. Every entry is encoded: half a byte for two components, and a signed byte for what is left of each, as a share of the entry's
   largest rest. With the codes goes the length of the error that remains, so that they bound an entry's product from above.
   The scan ships codes alone: blocks of queries meet blocks of codes and rank them by that bound, which is the product with the
   decoded codes and the error's length. Entries lie in blocks by hash, so a block sends on its share of the ``rerank`` best and six standard deviations more.
4. The ``rerank`` best of all blocks are kept by a ranking per query. They go back to the blocks of their entries, where
   the original vectors wait: each vector moves once for every ``ASKED`` queries, each query once for every block that holds
   some of its candidates. There the products are computed exactly, and the ``k`` best are ranked again.
5. A query is done if its ``k`` best lie above the bounds of all that was left out. The others (more near copies around than are ranked
   exactly) meet the vectors of all blocks, of which each sends on its ``k`` best. So the result is exact on any rows.

Nearness is the inner product in double precision, summed in the order of components; ties go to the smaller id.
Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id. Vectors of different
lengths have no product: each length is searched by itself. Repeated rows count once; an id with several vectors is a query by the smallest of them and a candidate
by each, at its best. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import own_names, written

CENTRES, WIDTH = 16, 2
SAMPLE, ROUNDS, T = 8192, 6, 0.2
#: Entries of a block, queries that meet it at once in the scan and in the exact ranking, candidates of a query, queries in one array.
BLOCK, QUERIES, ASKED, RERANK, AT_ONCE = 32768, 4096, 65536, 512, 64


def _split(x: np.ndarray) -> np.ndarray:
    """(n, parts, WIDTH); a last part is filled up with zeros."""
    n, d = x.shape
    parts = -(-d // WIDTH)
    parts += parts % 2  # codes are joined in twos
    out = np.zeros((n, parts * WIDTH), np.float32)
    out[:, :d] = x
    return out.reshape(n, parts, WIDTH)


def encode(x: np.ndarray, books: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """(n, parts) codes: for one part after another the centre of least anisotropic loss, the others held."""
    xs = _split(x)
    unit = xs / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
    n, parts, _ = xs.shape
    code, along = np.empty((n, parts), np.int64), np.zeros(n, np.float32)
    for m in range(parts):
        code[:, m] = ((xs[:, m, None, :] - books[m]) ** 2).sum(-1).argmin(1)
        along += ((xs[:, m] - books[m][code[:, m]]) * unit[:, m]).sum(1)
    for _ in range(passes if eta > 1 else 0):
        for m in range(parts):
            rest = along - ((xs[:, m] - books[m][code[:, m]]) * unit[:, m]).sum(1)
            left = xs[:, m, None, :] - books[m]
            part = rest[:, None] + (left * unit[:, m, None, :]).sum(-1)
            code[:, m] = ((left**2).sum(-1) + (eta - 1) * part**2).argmin(1)
            along = np.take_along_axis(part, code[:, m, None], 1)[:, 0]
    return code


def eta_of(dim: int) -> float:
    return max(1.0, (dim - 1) * T * T / (1 - T * T))


def fit(x: np.ndarray, eta: float) -> np.ndarray:
    """(parts, CENTRES, WIDTH) codebooks."""
    rng = np.random.Generator(np.random.PCG64(5))
    xs = _split(x)
    n, parts, _ = xs.shape
    books = np.stack([xs[rng.permutation(n)[np.arange(CENTRES) % n], m] for m in range(parts)])
    unit = xs / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
    for r in range(ROUNDS):
        weight = 1.0 if r < ROUNDS // 2 else eta
        code = encode(x, books, weight)
        left = xs - np.stack([books[m][code[:, m]] for m in range(parts)], 1)
        along = (left * unit).sum((1, 2))
        for m in range(parts):
            rest = along - (left[:, m] * unit[:, m]).sum(1)
            for c in range(CENTRES):
                own = code[:, m] == c
                if own.any():
                    u = unit[own, m].astype(float)
                    a = own.sum() * np.eye(WIDTH) + (weight - 1) * u.T @ u
                    b = xs[own, m].astype(float).sum(0) + (weight - 1) * ((rest[own, None] + (xs[own, m] * unit[own, m]).sum(1)[:, None]) * u).sum(0)
                    books[m, c] = np.linalg.solve(a, b)
            left[:, m] = xs[:, m] - books[m][code[:, m]]
            along = rest + (left[:, m] * unit[:, m]).sum(1)
    return books


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def decoded(code: np.ndarray, rest: np.ndarray, step: np.ndarray, books: np.ndarray, dim: int) -> np.ndarray:
    """(n, dim) vectors of codes, of which a byte has two parts' codes, and of their rests in steps."""
    both = np.empty((len(code), books.shape[0]), np.uint8)
    both[:, 0::2], both[:, 1::2] = code >> 4, code & 15
    out = books[np.arange(books.shape[0]), both].reshape(len(code), -1)[:, :dim]
    return out + rest * step[:, None]


def scan(queries: np.ndarray, known: np.ndarray, error: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (of length 1) the places of the ``keep`` entries of the largest bounds, and these, the smallest one last."""
    total = queries.astype(np.float32) @ known.T
    total += error
    if len(known) > keep:
        best = np.argpartition(-total, keep - 1, axis=1)[:, :keep]
    else:
        best = np.tile(np.arange(len(known)), (len(queries), 1))
    return best, np.take_along_axis(total, best, 1)


def _shares(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in their largest component's measure first so that squares stay finite."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(books: np.ndarray, eta: float, dim: int, unit: float):
    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column("v"), dim) / unit
            code = encode(x.astype(np.float32), books, eta).astype(np.uint8)
            packed = code[:, 0::2] * np.uint8(CENTRES) + code[:, 1::2]
            left = x - decoded(packed, np.zeros((1, 1), np.float32), np.zeros(len(x), np.float32), books, dim)
            step = (np.abs(left).max(1) / 127).astype(np.float32) if len(x) else np.zeros(0, np.float32)
            rest = np.clip(np.rint(left / np.maximum(step, 1e-30)[:, None]), -127, 127).astype(np.int8)
            known = decoded(packed, rest, step, books, dim).astype(np.float32)
            # the error's length, and what sums of single precision may lose
            error = (np.linalg.norm(x - known, axis=1) * (1 + 1e-5) + (dim + 8) * 3e-7 * np.linalg.norm(known, axis=1) + 1e-30).astype(np.float32)
            for name, value in (("code", pa.array([c.tobytes() for c in packed], pa.binary())), ("rest", pa.array([c.tobytes() for c in rest], pa.binary())), ("step", pa.array(step)), ("error", pa.array(error))):
                part = part.append_column(name, value)
            yield part

    return coded


def _scanned(books: np.ndarray, dim: int, keep: int):
    def scanned(key, left, right):
        """One block of codes (left) and one of queries (right): the block's best entries of every query."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "e": pa.array([], pa.int64()), "near": pa.array([], pa.float32()), "cut": pa.array([], pa.bool_())})
        bytes_of = lambda name, kind: np.frombuffer(b"".join(left.column(name).to_pylist()), kind).reshape(left.num_rows, -1)
        known = decoded(bytes_of("code", np.uint8), bytes_of("rest", np.int8), left.column("step").to_numpy(), books, dim)
        entry, error, q, names = left.column("e").to_numpy(), left.column("error").to_numpy(), _shares(_matrix(right.column("v"), dim)), right.column("query_id").to_numpy()
        parts = []
        for a in range(0, len(q), AT_ONCE):
            best, near = scan(q[a : a + AT_ONCE], known, error, keep)
            cut = near == near.min(1, keepdims=True) if len(known) > keep else np.zeros(near.shape, bool)  # more entries may reach as far
            parts.append((np.repeat(names[a : a + AT_ONCE], best.shape[1]), entry[best.ravel()], near.ravel(), cut.ravel()))
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pa.table(dict(zip(("query_id", "e", "near", "cut"), map(pa.array, columns))))

    return scanned


def _ranked(dim: int, k: int):
    def ranked(key, left, right):
        """One block of entries (left) and the queries that have candidates in it (right): exact products, the ``k`` best of each query."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        order = np.argsort(left.column("e").to_numpy(), kind="stable")
        entry, x, ids = left.column("e").to_numpy()[order], _matrix(left.column("v"), dim)[order], left.column("ids").to_pylist()
        first = np.array([ids[p][0] for p in order], np.int64)
        q, names, wanted = _matrix(right.column("v"), dim), right.column("query_id").to_pylist(), right.column("es").to_pylist()
        out_q, out_v, out_s = [], [], []
        for name, own, es in zip(names, q, wanted):
            places = np.searchsorted(entry, np.array(es, np.int64))
            exact, some = np.zeros(len(places)), x[places]
            for d in range(dim):
                exact += some[:, d] * own[d]
            near = np.lexsort((first[places], -exact))[: k + 1]
            found = sorted((-exact[p], i) for p in near for i in ids[order[places[p]]] if i != name)[:k]
            out_q += [name] * len(found)
            out_v += [i for _, i in found]
            out_s += [-s for s, _ in found]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return ranked


def _all_ranked(dim: int, k: int):
    def ranked(key, left, right):
        """One block of entries (left) and queries (right): exact products with all of them, the ``k`` best of each query."""
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left.column("v"), dim), left.column("ids").to_pylist()
            first, longest = np.array([own[0] for own in ids], np.int64), np.linalg.norm(x, axis=1).max()
            q, names = _matrix(right.column("v"), dim), right.column("query_id").to_pylist()
            for a in range(0, len(q), AT_ONCE):
                total = q[a : a + AT_ONCE] @ x.T
                for name, own, near in zip(names[a:], q[a : a + AT_ONCE], total):
                    if len(x) > k + 1:  # sums in another order differ by roundings
                        least = np.partition(near, -k - 1)[-k - 1] - (dim + 8) * 1e-15 * longest * np.linalg.norm(own)
                        places = np.flatnonzero(~(near < least))
                    else:
                        places = np.arange(len(x))
                    exact, some = np.zeros(len(places)), x[places]
                    for d in range(dim):
                        exact += some[:, d] * own[d]
                    best = np.lexsort((first[places], -exact))[: k + 1]
                    found = sorted((-exact[p], i) for p in best for i in ids[places[p]] if i != name)[:k]
                    out_q += [name] * len(found)
                    out_v += [i for _, i in found]
                    out_s += [-s for s, _ in found]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return ranked


def search(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    sample: int = SAMPLE,
    block: int = BLOCK,
    rerank: int = RERANK,
) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score."""
    rows = own_names(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))  # one kind of zero
    found = None
    for dim in sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()):  # lengths of vectors
        part = _found(rows.where(F.size("v") == dim), dim, every, k, sample, block, rerank)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, dim: int, every: int, k: int, sample: int, block: int, rerank: int) -> DataFrame:
    """query_id, vec_id, score: candidates of every query among vectors of one length, the ``k`` best among them."""
    among = Window.partitionBy("h", "v").orderBy("vec_id")
    few = rows.withColumn("h", F.xxhash64("v")).withColumn("r", F.dense_rank().over(among)).where(F.col("r") <= k + 1)
    entries = few.groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))  # at most k + 1 ids
    entries = written(entries.withColumn("e", F.monotonically_increasing_id()), "ann-entries")
    got = entries.orderBy("h", "v").limit(sample).select("v").toArrow()
    unit = entries.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]  # codes are single precision
    x = (_matrix(got.column("v"), dim) / unit).astype(np.float32)
    eta = eta_of(dim)
    books = fit(x, eta).astype(np.float32)
    entries = written(entries.mapInArrow(_coded(books, eta, dim, unit), "h long, v array<double>, ids array<long>, e long, code binary, rest binary, step float, error float"), "ann-codes")

    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = written(asked, "ann-queries")
    n, m, cores = entries.count(), asked.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block))
    at_least = max(1, min(m, 2 * cores // blocks))  # turns, so that every core has work
    turns, wide = max(at_least, -(-m // QUERIES)), max(at_least, -(-m // ASKED))
    share = rerank / blocks
    keep = min(rerank, math.ceil(share + 6 * math.sqrt(share) + 8))

    of = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts).cast("long"))
    all_of = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    # every block of codes meets every block of queries: the pair is the key, each side goes once to each of its pairs
    codes = entries.select("e", "code", "rest", "step", "error", of("e", blocks).alias("b")).withColumn("t", all_of(turns))
    questions = asked.withColumn("t", of("query_id", turns)).withColumn("b", all_of(blocks))
    near = codes.groupBy("b", "t").cogroup(questions.groupBy("b", "t")).applyInArrow(_scanned(books, dim, keep), "query_id long, e long, near float, cut boolean")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "e")
    near = written(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= rerank + 1), "ann-near")

    wanted = near.where(F.col("r") <= rerank).groupBy(F.col("query_id").alias("q"), of("e", blocks).alias("b")).agg(F.collect_list("e").alias("es"))  # at most rerank
    wanted = wanted.join(asked, F.col("q") == F.col("query_id")).select("b", "query_id", "v", "es", of("query_id", wide).alias("t"))
    vectors = entries.select("e", "v", "ids", of("e", blocks).alias("b")).withColumn("t", all_of(wide))
    found = vectors.groupBy("b", "t").cogroup(wanted.groupBy("b", "t")).applyInArrow(_ranked(dim, k), "query_id long, vec_id long, score double")
    found = written(found, "ann-found")

    # queries whose k best may be exceeded by an entry that was left out
    beyond = near.where("cut or r > %d" % rerank).groupBy("query_id").agg(F.max("near").cast("double").alias("beyond"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    reached = found.withColumn("p", place).where(F.col("p") == k).select("query_id", F.col("score").alias("reached"))
    largest = F.array_max(F.transform("v", F.abs))
    length = largest * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + (c / largest) * (c / largest)))
    sure = F.coalesce(F.col("reached") / length / F.lit(unit) > F.col("beyond"), F.lit(False))
    again = written(asked.join(beyond, "query_id").join(reached, "query_id", "left").where(~sure).select("query_id", "v"), "ann-again")
    m = again.count()
    if not m:
        return found
    turns = max(1, min(m, 2 * cores // blocks), -(-m // QUERIES))
    vectors = entries.select("v", "ids", of("e", blocks).alias("b")).withColumn("t", all_of(turns))
    questions = again.withColumn("t", of("query_id", turns)).withColumn("b", all_of(blocks))
    rest = vectors.groupBy("b", "t").cogroup(questions.groupBy("b", "t")).applyInArrow(_all_ranked(dim, k), "query_id long, vec_id long, score double")
    return found.unionByName(rest)


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
