import math
import re
from collections import Counter

import pytest

from tallyloom.llm import lm_score as L

TEXTS = [None, "", "?!", "the cat sat on the mat", "The cat sat on a mat", "the the the the", "é l'été", "a", "the cat sat on the mat", "zzz " * 700, "the cat " * 50]


def plain(texts, order=3, backoff=0.4):
    docs = [re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    count = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [count(w) for w in docs]
    total, words = sum(own, Counter()), sum(map(len, docs))
    out = []
    for w, mine in zip(docs, own):
        s = 0.0
        for i in range(len(w)):
            f = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                c = total[g] - mine[g]
                below = total[g[:-1]] - mine[g[:-1]] if n > 1 else max(words - len(w), 1)
                if c > 0:
                    s += math.log(f * c / below)
                    break
                f *= backoff
            else:
                s += math.log(f / max(words - len(w), 1))
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 64, "shard_bytes": 32}, {"order": 2, "block_bytes": 1 << 10}])
def test_equals_brute_force(spark, options):
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in L.score(docs, **options).collect()}
    for i, (n, s) in enumerate(plain(TEXTS, options.get("order", 3))):
        assert got[i].n_words == n and got[i].score == pytest.approx(s, abs=1e-9)
        assert got[i].mean_score == (pytest.approx(s / n) if n else None)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert {round(r.score, 9) for r in L.score(docs).collect()} == {round(plain(["a b"] * 3)[0][1], 9)}
    assert L.score(docs.limit(0)).count() == 0


def test_more_shards_than_sixteen_bits_name(spark):
    """Seventeen bits of shards leave 47 to the key; a text of 70,000 words is one document."""
    words = [a + b for a in "bcdfghjk" for b in ("a", "e", "ie", "o", "u")]
    rows = [(i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(40))) for i in range(60)] + [(99, " ".join(words[k * k % len(words)] for k in range(70_000))), (None, "a b"), (None, "a b"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = {(r.doc_id, r.n_words): r.score for r in L.score(docs).collect()}
    many = {(r.doc_id, r.n_words): r.score for r in L.score(docs, shard_bytes=2).collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-6 for k in few)
