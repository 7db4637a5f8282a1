import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyloom.llm import quality as Q

GOOD = [f"the {a} {b} was seen near the {c} in the {d}." for a in ("old", "red", "big", "dry") for b in ("house", "river", "field") for c in ("wood", "mill", "town") for d in ("morning", "evening", "winter")]


def tokens(text):
    return re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text or "")


def plain_model(texts):
    """p(word | two before) by the textbook's recursion; n-grams are tuples."""
    top = Counter()
    for t in texts:
        s = ["", "", *tokens(t)]
        top.update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
    counts = {3: top}
    for n in (2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, sums, weights = {}, {}, {}
    for n, c in counts.items():
        k = [0] + [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = k[1] / (k[1] + 2 * k[2]) if all(k[1:]) else None
        d = [min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.05), i) for i in (1, 2, 3)] if y else [0.5, 1.0, 1.5]
        cuts[n] = lambda v, d=d, n=n: v if v < Q.CUTOFFS[n - 1] else d[min(v, 3) - 1]
        total, off = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            off[g[:-1]] += cuts[n](v)
        sums[n], weights[n] = total, {h: off[h] / total[h] for h in total}

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        n, h = len(g), g[:-1]
        if h not in sums[n]:
            return p(g[1:])
        v = counts[n].get(g, 0)
        return (max(v - cuts[n](v), 0) / sums[n][h] if v else 0) + weights[n][h] * p(g[1:])

    return p, [g[0] for g in counts[1]]


@pytest.mark.parametrize("broadcast_rows", [1 << 20, 0])
def test_perplexity_equals_the_recursion(spark, broadcast_rows):
    """With tables in every task, and sharded by key."""
    asked = [GOOD[0], GOOD[5] + " Never seen words, ever!", "old old the", "?", "mill in the town. " * 3000, "", None]
    fitted = Q.model(spark.createDataFrame([(t,) for t in GOOD], "text string"))
    docs = spark.createDataFrame([(i, "en", i, t) for i, t in enumerate(asked)], "doc_id long, lang string, tag long, text string")
    got = {r.doc_id: r for r in Q.log_perplexity(docs, fitted, broadcast_rows).collect()}
    p, vocabulary = plain_model(GOOD)
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        s = ["", "", *tokens(t)]
        assert got[i].n_tokens == len(s) - 2
        want = -sum(math.log(p(tuple(s[j - 2 : j + 1]))) for j in range(2, len(s))) / (len(s) - 2) if len(s) > 2 else None
        assert got[i].log_pp == (pytest.approx(want, rel=1e-9) if want is not None else None)
    for context in (("the", "old"), ("near", "the"), ("no", "such")):
        assert sum(p((*context, w)) for w in [*vocabulary, "unseen"]) == pytest.approx(1)


def test_junk_is_rejected_and_clean_text_kept(spark):
    rows = [(i, t, "en" if i % 2 else "de", 1.0) for i, t in enumerate(GOOD * 3)]
    junk = [(9000 + i, "%%$$ QQ!! ZZ## " * 20, "en", 1.0) for i in range(5)]
    odd = [(9100, None, "en", 0.0), (9101, "", None, 0.0), (None, GOOD[0], None, 0.0), (9102, " ".join(GOOD) * 100, "xx", 0.0), (9103, GOOD[2], "de", 0.0), (9103, GOOD[2], "de", 0.0)]
    docs = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(rows))] + [(9000, 0, 0), (9103, 1, 0), (9103, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels, min_docs=20, quantile=1.0).collect()
    assert len(got) == docs.count()
    kept = [r for r in got if r.keep]
    assert sum(r.doc_id is not None and r.doc_id < 9000 for r in kept) >= 0.98 * len(rows)
    assert not any(r.doc_id is not None and 9000 <= r.doc_id <= 9101 for r in kept)
    assert {r.doc_id for r in kept} >= {None, 9103} and sum(r.doc_id == 9103 for r in kept) == 2
    out = Q.kept(docs, labels, min_docs=20, quantile=1.0)
    assert out.columns == docs.columns and out.count() == len(kept)


def test_the_model_is_fitted_on_all_trusted_documents_of_its_half(spark):
    """Some 2,600 of them, each with a word of its own, where 2,000 were the most before."""
    rows = [(i, f"the w{i} was near the {'mill' if i % 3 else 'wood'}", "en") for i in range(5200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(rows))], "doc_id long, quality int, toxic int")
    half = [t for i, t, _ in rows if int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % 2 == 0]
    assert len(half) > Q.MAX_TRAIN_DOCS
    p, _ = plain_model(half)
    got = {r.doc_id: r.perplexity for r in Q.classify(docs, labels).where("doc_id < 40").collect()}
    for i, t, _ in rows[:40]:
        s = ["", "", *tokens(t)]
        assert got[i] == pytest.approx(math.exp(-sum(math.log(p(tuple(s[j - 2 : j + 1]))) for j in range(2, len(s))) / (len(s) - 2)), rel=1e-9)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.keep for r in Q.classify(docs, labels).collect()] == [True]
    assert Q.classify(docs.limit(0), labels).count() == 0


def test_single_trigrams_are_never_written(spark, monkeypatch):
    """Words in random order: nearly all trigrams are seen once, which took more disk than the texts before."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(400)) for _ in range(40)]
    sizes, write = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df, *a, **b: (sizes.append((out := write(df, *a, **b)).count()), out)[1])
    Q.model(spark.createDataFrame([(t,) for t in texts], "text string"))
    seen, pairs = Counter(), set()
    for t in texts:
        s = ["", "", *tokens(t)]
        seen.update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
        pairs |= {tuple(s[i - 1 : i + 1]) for i in range(2, len(s))}
    often = sum(n > 1 for n in seen.values())
    assert max(sizes) <= len(pairs) + often < len(seen) / 1.5


@pytest.mark.parametrize("broadcast_rows", [60, 0])
def test_slices_parts_and_rare_rows_give_the_same(spark, monkeypatch, broadcast_rows):
    """Slices of bigrams, parts of texts, tables of which some rows are frequent enough to be sent; repeated texts."""
    for name, value in (("SLICE_CHARS", 1000), ("PART_ROWS", 40), ("PARTS", 3), ("MAX_BUCKETS", 2)):
        monkeypatch.setattr(Q, name, value)
    asked = [GOOD[0], GOOD[0], GOOD[5] + " Never seen words, ever!", "old old the", "?", "mill", "the", "", None]
    fitted = Q.model(spark.createDataFrame([(t,) for t in GOOD], "text string"))
    docs = spark.createDataFrame([(i, "en", 7, t) for i, t in enumerate(asked)], "doc_id long, lang string, tag long, text string")
    got = {r.doc_id: r for r in Q.log_perplexity(docs, fitted, broadcast_rows).collect()}
    p, _ = plain_model(GOOD)
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        s = ["", "", *tokens(t)]
        want = -sum(math.log(p(tuple(s[j - 2 : j + 1]))) for j in range(2, len(s))) / (len(s) - 2) if len(s) > 2 else None
        assert got[i].n_tokens == len(s) - 2 and got[i].log_pp == (pytest.approx(want, rel=1e-9) if want is not None else None)


def test_a_table_sends_a_share_of_its_rows(spark):
    """All of 80,000 rows were sent before, up to 2^20 of each table, which the driver's memory did not hold on 0.51 GB."""
    found = spark.range(80_000).selectExpr("id k", "1D v", "0D w", "1 + id % 1000 f")
    often, others = Q._divided(found, Q.BROADCAST_ROWS)
    assert others is not None and 0 < often.count() <= 40_000 and often.count() + others.count() == 80_000
    assert often.agg({"f": "min"}).first()[0] > others.agg({"f": "max"}).first()[0]
