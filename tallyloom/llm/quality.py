"""A quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Tokens are runs of letters and digits, and runs of other characters that are no ASCII white space, by their 64-bit hashes;
two edge marks stand before a text. Everything is DataFrame work:

1. Trusted documents are split by hash into a half for training, all of which is used unless ``max_train_docs`` is given,
   and a half that is held out for the thresholds.
2. Training: trigrams are counted, continuation counts, discounts (from counts of counts) and interpolation weights
   follow by grouping and joining these count tables, one order after the other. Grams below ``CUTOFFS`` are discounted
   by their whole count, which keeps the sums at one and the tables short. Single trigrams, nearly all, are counted in
   the task that has their bigram and never written; the positions of larger texts are shuffled in ``SLICES``.
3. Scoring: every whole text is exploded into its positions, which are joined to the three tables by the hash of the
   gram. A table has the logarithm of what a gram's probability is over what the lower order gives it, so that a text's
   logarithm is a sum over its grams and a gram that is missing adds nothing. Of each table the most frequent rows, one in
   ``SENT_SHARE`` and ``broadcast_rows`` at most, go to every task, so that most of the corpus is not shuffled. For rarer
   rows the texts are read again: only positions that a bit filter of these rows lets through are shuffled and joined to
   them, all of them, in up to ``PARTS`` parts of the texts. The filter only leaves out what would find no row.
4. Thresholds: for each language the ``quantile`` of the perplexities of all trusted documents not trained on, from
   a histogram of log perplexities in steps of 0.001; languages with fewer than ``min_docs`` such documents, and null,
   take that of all languages. A document is kept if its perplexity is at most its threshold.

Nulls: a null or empty text, or one of white space alone, has no perplexity and is rejected; a null id matches no label
but is scored. Very long texts are scored whole. Repeated rows are scored each; ties with a threshold are kept; a
document with several labels is trusted if all say so. An empty table gives an empty result; without any trusted
document all that have tokens are kept. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import forget_since, free_name, own_names, scratch_mark, small, spread, written

TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x09-\x0D\x20]+"
#: Where the SQL twin cuts off the documents it is fitted on; the operator is fitted on all of the half that hashes to even numbers.
MAX_TRAIN_DOCS = 2000
#: Counts of the orders 1 to 3 from which a gram has a share of its own; rarer ones are left to the lower order, all their count being discounted.
CUTOFFS = (1, 2, 2)
#: Rows of a table that are sent to every task at most (some 25 MB as a hashed relation, of which the driver holds two forms for each of
#: three tables); a table of more than SENT_WHOLE rows sends one row in SENT_SHARE, the most frequent.
BROADCAST_ROWS, SENT_WHOLE, SENT_SHARE = 1 << 18, 1 << 15, 8
#: Training texts of more characters are counted in slices, as many as SLICES; rare rows beyond PART_ROWS are looked up by parts of the texts, as many as PARTS.
SLICE_CHARS, SLICES, PART_ROWS, PARTS = 1 << 24, 4, 3 << 19, 16
#: Of 64 words each: 34 MB at most.
MAX_BUCKETS = 1 << 16
QUANTILE, MIN_DOCS, STEP = 0.995, 50, 1000


def _half(doc_id: Column) -> Column:
    """60 bits of the id's MD5, so that other engines can take the same half."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 15), 16, 10).cast("long")


def _hashes(text: str) -> Column:
    """The hashes of a text's tokens."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def positions(texts: DataFrame) -> DataFrame:
    """The columns but ``text``, and a, b, c: the hashes of each token's two predecessors and its own, null without any; last: no token follows."""
    others = [c for c in texts.columns if c != "text"]
    return _positions(texts.select(*others, _hashes("text").alias("c")))


def _positions(rows: DataFrame) -> DataFrame:
    """:func:`positions` of texts whose hashes are in an array c."""
    edge = F.xxhash64(F.lit(""))  # no token is empty
    others = [c for c in rows.columns if c != "c"]
    n = F.size("c")
    before = [F.slice(F.concat(F.array_repeat(edge, k), "c"), 1, n).alias(name) for k, name in ((2, "a"), (1, "b"))]
    zipped = rows.select(*others, n.alias("size"), F.arrays_zip(*before, F.col("c")).alias("t"))
    each = zipped.select(*others, "size", F.posexplode_outer("t").alias("at", "t"))
    return each.select(*others, "t.a", "t.b", "t.c", (F.col("at") + 1 == F.col("size")).alias("last"))


def _grams(texts: DataFrame) -> list[DataFrame]:
    """Trigrams seen ``CUTOFFS[2]`` times or more, (a, b, c, n), and all bigrams with a null a: n contexts, raw times, of which ends at a text's end.

    Positions go to the task of their bigram, which so sees all its contexts; single trigrams are counted there and never written.
    Larger texts are taken in slices of bigrams, one after the other, so that only a slice's positions are on disk at once;
    their tokens are hashed once, before.
    """
    texts = written(texts.select(_hashes("text").alias("c"), F.length("text").alias("chars")), "kn-hashes", drop_shuffles=True)
    chars = texts.agg(F.sum("chars")).first()[0] or 0
    slices, found = min(SLICES, 1 + chars // SLICE_CHARS), []
    for i in range(slices):
        rows = _positions(texts.select("c")).where("c is not null")
        rows = rows.where(F.pmod(F.xxhash64("c", "b"), F.lit(slices)) == i) if slices > 1 else rows
        seen = rows.repartition("b", "c").groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.count_if("last").alias("ends"))
        often = seen.where(F.col("n") >= CUTOFFS[2]).select("a", "b", "c", "n", F.col("n").alias("raw"), "ends")
        pairs = seen.groupBy("b", "c").agg(F.count("*").alias("n"), F.sum("n").alias("raw"), F.sum("ends").alias("ends"))
        both = often.unionByName(pairs.select(F.lit(None).cast("long").alias("a"), "b", "c", "n", "raw", "ends"))
        found.append(written(both, "kn-counts", drop_shuffles=True))
    return found


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts of one, two and more, from the numbers of counts of 1 to 4; 0.5, 1 and 1.5 where these lack."""
    n = [0, *n]
    if not all(n[1:]):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), float(k)) for k in (1, 2, 3))


def _cut(order: int, d: tuple[float, float, float]) -> Column:
    """What is taken off a count n."""
    share = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    return F.when(F.col("n") < CUTOFFS[order - 1], F.col("n").cast("double")).otherwise(share)


def model(texts: DataFrame) -> tuple[list[DataFrame], float, float]:
    """Tables of order 1 to 3, (k, v, w, f), the logarithm of an unseen word's probability, and that of a text's first context's weights.

    v: the logarithm of a gram's probability over what the lower order gives it; w: of its weight as a context; null: none. So a
    text's logarithm is a sum over its grams. f: how often a gram is seen. ``texts`` is read once.
    """
    mark, edge = scratch_mark(), F.xxhash64(F.lit(""))
    counts = reduce(DataFrame.unionByName, _grams(texts))
    how_often = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]
    third = written(counts.where("a is not null").select("a", "b", "c", "n"), "kn-third")
    pairs = counts.where("a is null").drop("a")
    words = written(pairs.groupBy("c").agg(F.count("*").alias("n"), F.sum("raw").alias("f")), "kn-words", drop_shuffles=True)
    *n1, vocabulary, total = words.agg(*how_often, F.count("*"), F.sum("n")).first()
    *n2, contexts = pairs.agg(*how_often, F.sum("n")).first()  # all trigrams are contexts of bigrams
    n3 = list(third.agg(*how_often, F.count("*")).first())
    n3[0] = (contexts or 0) - n3.pop()
    d = [_discounts(n) for n in (n1, n2, n3)]

    p = lambda: F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
    unit = 1.0 / (vocabulary + 1)
    weight = words.agg(F.sum(_cut(1, d[0])) / F.sum("n")).first()[0] if vocabulary else 1.0
    one = words.withColumn("cut", _cut(1, d[0])).withColumns({"total": F.lit(total), "weight": F.lit(weight), "below": F.lit(unit)}).withColumn("p", p())
    firsts = pairs.groupBy("b").agg(F.sum("n").alias("total"), (F.sum(_cut(2, d[1])) / F.sum("n")).alias("weight"), F.sum("raw").alias("raw"))
    firsts = written(firsts, "kn-firsts", drop_shuffles=True)
    # what is seen once is neither part nor context of a gram that has a share of its own
    two = pairs.where("raw > 1").withColumn("cut", _cut(2, d[1])).join(firsts.drop("raw"), "b").join(one.select("c", F.col("p").alias("below")), "c").withColumn("p", p())
    two = two.select("b", "c", "p", F.when(F.col("n") >= CUTOFFS[1], F.log(F.col("p") / (F.col("weight") * F.col("below")))).alias("v"), (F.col("raw") - F.col("ends")).alias("total"), F.col("raw").alias("f"))
    two = written(two, "kn-second", drop_shuffles=True)
    forget_since(mark, 4)

    three = third.withColumn("cut", _cut(3, d[2]))
    gains = three.groupBy("a", "b").agg(F.sum(F.col("n") - F.col("cut")).alias("gain"))
    starts = firsts.where(F.col("b") == edge).select(edge.alias("a"), "b", F.col("raw").alias("total"))  # one row
    totals = two.select(F.col("b").alias("a"), F.col("c").alias("b"), "total").unionByName(starts)
    before = gains.join(totals, ["a", "b"]).select("a", "b", "total", (1 - F.col("gain") / F.col("total")).alias("weight"))
    before = written(before, "kn-before", drop_shuffles=True)

    none = F.lit(None).cast("double")
    v1 = one.select(F.col("c").alias("k"), F.log(F.col("p") / (F.col("weight") * F.col("below"))).alias("v"), none.alias("w"), "f")
    w1 = firsts.where("weight < 1").select(F.col("b").alias("k"), none.alias("v"), F.log("weight").alias("w"), F.lit(0).cast("long").alias("f"))
    v2 = two.where("v is not null").select(F.xxhash64("b", "c").alias("k"), "v", none.alias("w"), "f")
    w2 = before.where("weight < 1").select(F.xxhash64("a", "b").alias("k"), none.alias("v"), F.log("weight").alias("w"), F.col("total").alias("f"))
    v3 = three.join(before, ["a", "b"]).join(two.select("b", "c", F.col("p").alias("below")), ["b", "c"])
    v3 = v3.select(F.xxhash64("a", "b", "c").alias("k"), F.log(p() / (F.col("weight") * F.col("below"))).alias("v"), none.alias("w"), F.col("n").alias("f"))
    merged = lambda x, y: x.unionByName(y).groupBy("k").agg(F.max("v").alias("v"), F.max("w").alias("w"), F.max("f").alias("f"))
    tables = [written(t, "kn-table", drop_shuffles=True) for t in (merged(v1, w1), merged(v2, w2), v3)]
    forget_since(mark, 3)
    start = sum(t.where(F.col("k") == k).agg(F.max("w")).first()[0] or 0.0 for t, k in zip(tables, (edge, F.xxhash64(edge, edge))))
    return tables, math.log(unit * weight), start


def _divided(found: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of a table that are seen most often, at most ``rows`` and a share of a larger table, and the others, if any."""
    n = found.count()
    rows = min(rows, max(SENT_WHOLE, n // SENT_SHARE))
    if n <= rows:
        return found, None
    upto = found.groupBy("f").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("f"))))  # few numbers
    least = upto.where(F.col("upto") <= rows).agg(F.min("f")).first()[0]
    return (found.where("false"), found) if least is None else (found.where(F.col("f") >= least), found.where(F.col("f") < least))


def _bits(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Rows (bucket, bits) of 64 words in which two bits a key are set, and the number of buckets: 64 to 128 keys each, MAX_BUCKETS at most."""
    buckets = min(MAX_BUCKETS, 1 << max(0, n // 128).bit_length())
    empty = keys.sparkSession.range(buckets).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("bucket"))  # has all words, none with a bit
    rows = keys.select("k", _bucket("k", buckets).alias("bucket")).unionByName(empty).repartition("bucket")
    places = F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _places("k")])
    none = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("word"), F.lit(None).cast("int").alias("bit")))
    words = rows.select("bucket", F.explode(F.when(F.col("k").isNull(), none).otherwise(places)).alias("x"))
    words = words.groupBy("bucket", "x.word").agg(F.expr("coalesce(bit_or(shiftleft(1L, x.bit)), 0L)").alias("set"))
    of = words.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("word", "set"))).alias("m"))
    return written(of.select("bucket", F.col("m.set").alias("bits")), "kn-bits", drop_shuffles=True), buckets


def _bucket(k: str, buckets: int) -> Column:
    return F.shiftrightunsigned(k, 24).bitwiseAND(F.lit(buckets - 1).cast("long"))


def _places(k: str) -> list[tuple[Column, Column]]:
    """Word and bit of a key in its bucket, twice."""
    six = lambda by: F.shiftrightunsigned(k, by).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return [(six(6), six(0)), (six(18), six(12))]


def _asked(rows: DataFrame, bits: DataFrame, buckets: int, keys: dict[str, Column]) -> DataFrame:
    """h, last, k: the keys of positions that the filter lets through."""
    rows = rows.select("h", "last", *[x.alias(f"k_{k}") for k, x in keys.items()])
    for k in keys:
        places = [(F.get("bits", w), b) for w, b in _places(f"k_{k}")]
        rows = rows.withColumn("at", _bucket(f"k_{k}", buckets)).join(F.broadcast(bits), F.col("at") == F.col("bucket"), "left")
        isset = reduce(Column.__and__, [F.call_function("getbit", word, bit) == 1 for word, bit in places])
        rows = rows.withColumn(f"k_{k}", F.when(isset, F.col(f"k_{k}"))).drop("at", "bucket", "bits")
    some = rows.where(F.coalesce(*[f"k_{k}" for k in keys]).isNotNull())
    return some.select("h", "last", F.explode(F.array(*[f"k_{k}" for k in keys])).alias("k")).where("k is not null")


def _rest(docs: DataFrame, rare: DataFrame, n: int, keys: dict[str, Column]) -> DataFrame:
    """docs: h, text -> h, rest: the sum of the values of a text's grams (``keys``) in ``rare`` (n rows), over all rows of that text."""
    bits, buckets = _bits(rare.select("k"), n)
    parts, found = min(PARTS, 1 + n // PART_ROWS), []
    for i in range(parts):
        rows = positions(docs.where(F.pmod("h", F.lit(parts)) == i) if parts > 1 else docs).where("c is not null")
        value = F.coalesce("v", F.lit(0.0)) + F.when(F.col("last"), 0.0).otherwise(F.coalesce("w", F.lit(0.0)))
        sums = _asked(rows, bits, buckets, keys).join(rare.select("k", "v", "w").hint("shuffle_hash"), "k").groupBy("h").agg(F.sum(value).alias("rest"))
        found.append(written(sums, "kn-rest", drop_shuffles=True))
    return reduce(DataFrame.unionByName, found)


def log_perplexity(docs: DataFrame, fitted: tuple[list[DataFrame], float, float], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs: doc_id, lang, tag, text -> doc_id, lang, tag, n_tokens, log_pp."""
    tables, unseen, start = fitted
    docs = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = positions(docs.withColumn("row", F.monotonically_increasing_id()))
    keys = {"c": F.col("c"), "bc": F.xxhash64("b", "c"), "abc": F.xxhash64("a", "b", "c")}
    rows, rare, value = rows.withColumns({k: x for k, x in keys.items() if k != "c"}), {}, F.lit(0.0)
    for k, found in zip(keys, tables):
        often, others = _divided(found, broadcast_rows)
        rare |= {k: others} if others is not None else {}
        named = often.select(F.col("k").alias(f"k_{k}"), F.col("v").alias(f"v_{k}"), *([F.col("w").alias(f"w_{k}")] if k != "abc" else []))
        rows = rows.join(F.broadcast(named), F.col(k) == F.col(f"k_{k}"), "left").drop(f"k_{k}")
        value = value + F.coalesce(f"v_{k}", F.lit(0.0))
        value = value + F.when(F.col("last"), 0.0).otherwise(F.coalesce(f"w_{k}", F.lit(0.0))) if k != "abc" else value
    sums = rows.groupBy("row", "doc_id", "lang", "tag", "h").agg(F.count("c").alias("n_tokens"), F.sum(value).alias("s"))
    rest = F.lit(0.0)
    if rare:
        asked = {k: keys[k] for k in rare}  # only of orders that have rare rows
        rare = written(reduce(DataFrame.unionByName, rare.values()), "kn-rare")
        sums = written(sums, "kn-sums", drop_shuffles=True)
        others = _rest(docs.select("h", "text"), rare, rare.count(), asked)
        each = sums.groupBy("h").agg(F.count("*").alias("rows")).join(others, "h").select("h", (F.col("rest") / F.col("rows")).alias("rest"))
        sums, rest = sums.join(each, "h", "left"), F.coalesce("rest", F.lit(0.0))
    log_p = F.lit(start) + F.col("s") + rest + F.col("n_tokens") * F.lit(unseen)
    return sums.select("doc_id", "lang", "tag", "n_tokens", F.when(F.col("n_tokens") > 0, -log_p / F.col("n_tokens")).alias("log_pp"))


def _quantile(held: DataFrame, by: list[str], quantile: float, name: str) -> DataFrame:
    """The smallest bin that at least ``quantile`` of a group's documents reach, and the group's size; some 20,000 bins of a group at most."""
    bins = held.groupBy(*by, F.ceil(F.col("log_pp") * STEP).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("bin")
    rows = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return rows.where(F.col("upto") >= F.col("all") * quantile).groupBy(*by).agg((F.min("bin") / STEP).alias(name), F.max("all").alias("docs"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_train_docs: int | None = None,
    quantile: float = QUANTILE,
    min_docs: int = MIN_DOCS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: doc_id, lang, n_tokens, perplexity, threshold, keep, tag (hash of the text)."""
    spark = docs.sparkSession
    rows = own_names(docs, doc_id=id_col, text=text_col, lang=lang_col).selectExpr("cast(doc_id as long) doc_id", "text", "lang", "xxhash64(coalesce(text, '')) tag")
    good = own_names(labels, doc_id="doc_id", quality="quality").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    good = written(good.where("doc_id is not null").withColumn("h", _half(F.col("doc_id"))), "kn-trusted")
    half = good.where("h % 2 = 0")
    half = half if max_train_docs is None else half.orderBy("h", "doc_id").limit(max_train_docs)
    trained = small(written(half.select("doc_id"), "kn-half"))
    mark = scratch_mark()
    fitted = model(rows.join(trained, "doc_id", "left_semi").select("text"))
    forget_since(mark, 3)
    scored = written(log_perplexity(spread(rows), fitted, broadcast_rows), "kn-scores", drop_shuffles=True)
    forget_since(mark)

    held = scored.join(good, "doc_id", "left_semi").join(trained, "doc_id", "left_anti").where("log_pp is not null")
    pooled = _quantile(held.withColumn("one", F.lit(1)), ["one"], quantile, "pooled").select("pooled")
    each = _quantile(held.where("lang is not null"), ["lang"], quantile, "own").where(F.col("docs") >= min_docs).select("lang", "own")
    limits = pooled.limit(1).unionByName(spark.sql("select cast(null as double) pooled")).agg(F.max("pooled").alias("pooled"))
    found = scored.join(each, "lang", "left").crossJoin(F.broadcast(limits))  # one row
    limit = F.coalesce("own", "pooled", F.lit(float("inf")))
    keep = F.coalesce(F.ceil(F.col("log_pp") * STEP) / STEP <= limit, F.lit(False))
    return found.select("doc_id", "lang", "n_tokens", F.exp("log_pp").alias("perplexity"), F.exp(limit).alias("threshold"), keep.alias("keep"), "tag")


def kept(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs``, without the rejected documents."""
    away = classify(docs, labels, id_col=id_col, text_col=text_col, **options).where("not keep")
    tag, twin = free_name(docs, "text_tag"), free_name(docs, "twin_id")
    gone = small(written(away.select(F.col("tag").alias(tag), F.col("doc_id").alias(twin)).distinct(), "kn-rejected"))
    marked = docs.withColumn(tag, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return marked.join(gone, (marked[tag] == gone[tag]) & marked[id_col].eqNullSafe(gone[twin]), "left_anti").drop(tag)


ORACLE = rf"""
WITH trusted AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
sample AS (SELECT doc_id FROM trusted WHERE h % 2 = 0 ORDER BY h, doc_id LIMIT {MAX_TRAIN_DOCS}),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS l FROM documents),
t AS (SELECT r, doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM d),
pos AS (SELECT r, doc_id, coalesce(lag(c, 2) OVER w, '') AS a, coalesce(lag(c) OVER w, '') AS b, c FROM t WINDOW w AS (PARTITION BY r ORDER BY i)),
c3 AS (SELECT a, b, c, count(*) AS n FROM pos SEMI JOIN sample USING (doc_id) GROUP BY a, b, c),
c2 AS (SELECT b, c, count(*) AS n FROM c3 GROUP BY b, c),
c1 AS (SELECT c, count(*) AS n FROM c2 GROUP BY c),
k AS (
  SELECT o, CAST(count_if(n = 1) AS DOUBLE) AS n1, CAST(count_if(n = 2) AS DOUBLE) AS n2, CAST(count_if(n = 3) AS DOUBLE) AS n3, CAST(count_if(n = 4) AS DOUBLE) AS n4
  FROM (SELECT 3 AS o, n FROM c3 UNION ALL SELECT 2, n FROM c2 UNION ALL SELECT 1, n FROM c1) GROUP BY o),
y AS (SELECT *, n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 AS fine, n1 / (n1 + 2 * n2) AS y FROM k),
cut AS (
  SELECT o, CASE WHEN fine THEN least(greatest(1 - 2 * y * n2 / n1, 0.05), 1) ELSE 0.5 END AS d1,
         CASE WHEN fine THEN least(greatest(2 - 3 * y * n3 / n2, 0.05), 2) ELSE 1.0 END AS d2,
         CASE WHEN fine THEN least(greatest(3 - 4 * y * n4 / n3, 0.05), 3) ELSE 1.5 END AS d3 FROM y),
x1 AS (SELECT c, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS cut FROM c1 JOIN cut ON o = 1),
x2 AS (SELECT b, c, n, CASE n WHEN 1 THEN 1 WHEN 2 THEN d2 ELSE d3 END AS cut FROM c2 JOIN cut ON o = 2),
x3 AS (SELECT a, b, c, n, CASE n WHEN 1 THEN 1 WHEN 2 THEN d2 ELSE d3 END AS cut FROM c3 JOIN cut ON o = 3),
s1 AS (SELECT sum(n) AS total, sum(cut) / sum(n) AS w, 1.0::DOUBLE / (count(*) + 1) AS unit FROM x1),
s2 AS (SELECT b, sum(n) AS total, sum(cut) / sum(n) AS w FROM x2 GROUP BY b),
s3 AS (SELECT a, b, sum(n) AS total, sum(cut) / sum(n) AS w FROM x3 GROUP BY a, b),
p1 AS (SELECT c, greatest(n - cut, 0) / total + w * unit AS p FROM x1, s1),
p2 AS (SELECT b, c, greatest(n - cut, 0) / total + w * p AS p FROM x2 JOIN s2 USING (b) JOIN p1 USING (c)),
p3 AS (SELECT a, b, c, greatest(n - cut, 0) / total + w * p AS p FROM x3 JOIN s3 USING (a, b) JOIN p2 USING (b, c)),
scored AS (
  SELECT r, count(*) AS n_tokens,
         -sum(ln(coalesce(p3.p, coalesce(s3.w, 1) * coalesce(p2.p, coalesce(s2.w, 1) * coalesce(p1.p, (SELECT unit * coalesce(w, 1) FROM s1)))))) / count(*) AS log_pp
  FROM pos LEFT JOIN p3 USING (a, b, c) LEFT JOIN s3 USING (a, b) LEFT JOIN p2 USING (b, c) LEFT JOIN s2 USING (b) LEFT JOIN p1 USING (c) GROUP BY r),
held AS (
  SELECT lang, ceil(log_pp * {STEP}) AS bin FROM d JOIN scored USING (r)
  WHERE doc_id IN (SELECT doc_id FROM trusted) AND doc_id NOT IN (SELECT doc_id FROM sample)),
bins AS (SELECT lang, bin, sum(count(*)) OVER (PARTITION BY lang ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY lang) AS every FROM held GROUP BY lang, bin),
each AS (SELECT lang, min(bin) / {STEP} AS own FROM bins WHERE lang IS NOT NULL AND upto >= every * {QUANTILE} AND every >= {MIN_DOCS} GROUP BY lang),
whole AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) AS upto, sum(count(*)) OVER () AS every FROM held GROUP BY bin),
pooled AS (SELECT min(bin) / {STEP} AS pooled FROM whole WHERE upto >= every * {QUANTILE}),
f AS (
  SELECT d.doc_id, d.lang, coalesce(n_tokens, 0) AS n_tokens, log_pp, coalesce(own, (SELECT pooled FROM pooled), 'inf'::DOUBLE) AS top
  FROM d LEFT JOIN scored USING (r) LEFT JOIN each USING (lang))
SELECT doc_id, lang, n_tokens, round(exp(log_pp), 4) AS perplexity, round(exp(top), 4) AS threshold,
       coalesce(ceil(log_pp * {STEP}) / {STEP} <= top, false) AS keep
FROM f
"""
