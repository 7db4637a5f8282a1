import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "hello world", "it's <|endoftext|> 1st\n\n x", "日本語 × é", "word " * 5000, "a " * 2047, "a " * 2046] + [f"n{i} " * (5 * i % 301) for i in range(250)] + ["same text"] * 20


def test_pieces_and_sequences(spark):
    docs = spark.createDataFrame([(None if i == 2 else i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int")
    rows = packing.pack(docs, PATH, shard_size=64).collect()
    model, by_doc, by_seq = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert len(by_doc) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[None if i == 2 else i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        at = 0
        for r in parts:
            assert r.start == at and r.length <= packing.CAPACITY and (r.piece == 0 or r.length == packing.CAPACITY)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    least = -(-sum(r.length for r in rows) // packing.CAPACITY)
    assert len(by_seq) <= least + 2
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 4, 4])
    assert len(packing.local_search([[0, 4], [1, 5], [2], [3]], lengths, 10)) == 3
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 60, 80)
        start = [[i] for i in range(80)]
        bins = packing.local_search([list(b) for b in start], lengths, 64)
        assert sorted(i for b in bins for i in b) == list(range(80)) and max(lengths[b].sum() for b in bins) <= 64
        assert sum(int(lengths[b].sum()) ** 2 for b in bins) >= sum(int(x) ** 2 for x in lengths) and len(bins) < 80


@pytest.mark.parametrize("tokens", [[1], [3], [5], [10], [20], [40], [1030], [1, 3, 5, 10, 40], [3, 700, 900]])
def test_many_short_equal_rows(tokens):
    """A shard of 8192 equal or few lengths: in bounded memory, and as few bins as may be."""
    lengths = np.resize(tokens, packing.SHARD)
    tracemalloc.start()
    began = time.process_time()
    bins = packing.packed(lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and time.process_time() - began < 30
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and max(lengths[b].sum() for b in bins) <= packing.CAPACITY
    if len(tokens) == 1:
        assert len(bins) == -(-len(lengths) // (packing.CAPACITY // tokens[0]))
    elif max(tokens) == 40:
        assert len(bins) == -(-int(lengths.sum()) // packing.CAPACITY)


def test_short_rows_in_spark(spark):
    docs = spark.createDataFrame([(i, "one two three four") for i in range(8192)], "doc_id long, text string")
    assert packing.pack(docs, PATH).select("sequence_id").distinct().count() <= -(-8192 * 5 // 2045)
