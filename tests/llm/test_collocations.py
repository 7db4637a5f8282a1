import random
import re
from collections import Counter

import pytest

from tallyloom.llm import collocations as C


def plain(rows, least, top, cover):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    many = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for (lang, *w), a in many.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * a >= cover * many[lang, *w[i:j]]:
                    gone.add((lang, *w[i:j]))
    by_lang = {}
    for (lang, *w), a in many.items():
        if (lang, *w) not in gone:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r, n[lang]))
    return [(lang, k + 1, p.decode(), -a, l, r, m, -s) for lang, found in by_lang.items() for k, (s, a, p, l, r, m) in enumerate(sorted(found)[:top])]


def corpus():
    rng = random.Random(3)
    words = ["the", "New", "york", "é", "日本", "a-b", "(x)", "of", "in", "to", "x", "x"] + [f"w{i}" for i in range(20)]
    rows = []
    for i in range(400):
        text = ""
        for _ in range(rng.randrange(1, 40)):
            text += rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!", "\r\n"])
            if rng.random() < 0.1:
                text += "in the NEW york of "
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, " .,! "), ("de", "x x x x x x x x"), ("en", "one long text " * 3000)] + [("fr", "the same row of words again")] * 30


@pytest.mark.parametrize("shape", [{}, {"cover": 60}, {"filter_bits": 1 << 16, "range_nodes": 50, "top": 7}])
def test_equals_plain_python(spark, monkeypatch, shape):
    """In one shard and range; with few filter bits, many shards, chunks and ranges; with another share."""
    if "range_nodes" in shape:
        monkeypatch.setattr(C, "CHUNK_NODES", 16)
        monkeypatch.setattr(C, "SHARD_PLACES", 100)
    rows = corpus()
    frame = spark.createDataFrame([(lang, t, "clash", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in C.mine(frame, min_count=5, **shape).collect())
    assert got == sorted(plain(rows, 5, shape.get("top", C.TOP), shape.get("cover", C.COVER))) and got


def test_empty(spark):
    assert C.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 10**12 + 7
    row = spark.createDataFrame([(big, 10**13 + 9, 10**12 + 11, 10**12 + 13)], "a long, n long, l long, r long")
    got = row.select(C._scored(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000 * big * (10**13 + 9) // ((10**12 + 11) * (10**12 + 13))
