"""The pipeline against plain Python: five stages over a small corpus with every awkward case."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from test_mixing import plain_targets
from test_quality import plain_model, tokens

import corpus_pipeline
from tallyloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, h int, copies string, tag long, row int, text_sha256 string, extra double"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = np.random.default_rng(11)
    words = [a + b for a in ("ba", "ki", "lo", "mun", "ter", "za") for b in ("da", "fi", "go", "re", "sun", "pi", "lan")]
    rows = []
    for i in range(260):
        text = " ".join(words[k] for k in rng.zipf(1.5, size=int(rng.integers(30, 120))) % len(words)) + "."
        rows.append((i, text, "en" if i % 3 else "de", f"src{i % 4}" if i % 13 else None))
    near = rows[0][1].split()
    rows += [(300 + i, " ".join(near[: len(near) - 1 - i]) + " end", "en", "src0") for i in range(4)]  # near copies of row 0
    rows += [(400 + i, rows[5][1], "en", "src1") for i in range(30)] + [(5, rows[5][1], "en", "src1")]  # exact copies, a repeated row
    rows += [(500 + i, "%%$$ QQ!! ZZ## @@ " * 30, "en", "src2") for i in range(3)]
    rows += [(600, None, "en", "src0"), (601, "", "de", "src1"), (602, " \n ", None, None), (None, rows[7][1] + " more", "en", "src3"), (None, rows[8][1], None, "src3"), (603, " ".join(r[1] for r in rows[20:60]) * 12, "de", "src3")]
    docs = [(*r, len(r[1] or ""), 1, "x", 7, 3, "y", 0.5) for r in rows]
    labels = [(i, 1, 0) for i in range(240)] + [(500, 0, 0), (None, 1, 0), (3, 1, 1), (4, 0, 0)]
    return docs, labels


def _hash(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def classified(rows, labels):
    quality_of = defaultdict(list)
    for i, q, _ in labels:
        quality_of[i].append(q)
    trusted = {i for i, q in quality_of.items() if i is not None and min(q) == 1}
    sample = set(sorted((i for i in trusted if _hash(str(i)) % 2 == 0), key=lambda i: (_hash(str(i)), i))[: quality.MAX_TRAIN_DOCS])
    p, _ = plain_model([r[1] for r in rows if r[0] in sample and r[1] is not None])

    def log_pp(text):
        s = ["", "", *tokens(text)]
        return -sum(math.log(p(tuple(s[j - 2 : j + 1]))) for j in range(2, len(s))) / (len(s) - 2) if len(s) > 2 else None

    bins = [None if x is None else math.ceil(x * quality.STEP - 1e-9) for x in map(log_pp, (r[1] for r in rows))]
    held = [(r[2], b) for r, b in zip(rows, bins) if r[0] in trusted - sample and b is not None]

    def quantile(values):
        values = sorted(values)
        return values[math.ceil(len(values) * quality.QUANTILE) - 1]

    of = {lang: quantile([b for x, b in held if x == lang]) for lang, n in Counter(x for x, _ in held).items() if lang is not None and n >= quality.MIN_DOCS}
    pooled = quantile([b for _, b in held]) if held else math.inf
    return [r for r, b in zip(rows, bins) if b is not None and b <= of.get(r[2], pooled)]


def without_copies(rows):
    best = {}
    for r in rows:
        old = best.get(r[1] or "")
        if old is None or (r[0] is not None and (old[0] is None or r[0] > old[0])):
            best[r[1] or ""] = r
    return list(best.values())


def without_near_copies(rows):
    sets = []
    for r in rows:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def mixed(rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    size_of = defaultdict(int)
    for r in rows:
        size_of[r[3]] += size(r)
    targets, out = plain_targets(size_of), []
    for source, target in targets.items():
        own = sorted((r for r in rows if r[3] == source), key=lambda r: _hash(f"{'' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}"))
        whole = math.floor(target / size_of[source]) if size_of[source] else 0
        left, spent = target - whole * size_of[source], 0
        for r in own:
            more = left > 0 and (spent + size(r) <= left or left - spent >= size(r) / 2) and spent <= left
            out += [r] * (whole + more)
            spent += size(r) if more else math.inf
    return out


@pytest.fixture
def folder(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_equal_brute_force(spark, folder):
    docs, labels = corpus()
    rows, got = docs, spark.read.parquet(f"{folder}/documents.parquet")
    columns = got.columns
    plain = [lambda r: classified(r, labels), without_copies, without_near_copies, mixed]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, plain):
        before, rows = len(rows), expected(rows)
        got = stage(spark, got, folder)
        assert got.columns == columns
        got.write.parquet(f"{folder}/{name}")
        got = spark.read.parquet(f"{folder}/{name}")
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((r[0], r[1]) for r in rows), key=str), name
        assert name == "mixing sources" or len(rows) < before
    assert corpus_pipeline.STAGES[4][0] == "best-fit packing"

    from tokenizers import Tokenizer

    from tallyloom.llm.queries import vocabulary

    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        n = len(model.encode(r[1] or "", add_special_tokens=False).ids) + 1
        first = n % 2048 or min(n, 2048)
        want.update([(r[0], 0, first)] + [(r[0], k, 2048) for k in range(1, -(-(n - first) // 2048) + 1)])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in packed) == want
    filled = defaultdict(list)
    for r in packed:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048
    total = sum(r.length for r in packed)
    assert len(filled) <= 1.1 * -(-total // 2048) + 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
