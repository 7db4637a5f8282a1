from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import token_count as T

PIECES = {"▁", "▁a", "a", "b", "ab", "abc", "bcd", "▁abcd", "cde", "d", "é", "▁ab", "abab", "ba"}


@settings(max_examples=300, deadline=None)
@given(st.text("abcdeéz", min_size=1, max_size=14))
def test_automaton_equals_greedy_matching(word):
    assert T.Automaton(PIECES).count(word) == T.greedy_count(PIECES, word)


def test_query_on_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(T.pieces_of(path))
    texts = [None, "", " \n", "hello world, hello!", "naïve 東京 x_y", "un" * 2000, "▁ ▁a"] + ["hello world"] * 3
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = sorted(T.count_tokens(docs, path).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    order = sorted(range(len(texts)), key=lambda i: (i != 3, i))
    for r, i in zip(rows, order):
        counts = [T.greedy_count(pieces, w) if len(w) < 500 else T.automaton(path).count(w) for w in T.WORD.findall(texts[i] or "")]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(counts), sum(c or 1 for c in counts), counts.count(None))
    assert T.count_tokens(docs.limit(0), path).count() == 0
