"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary piece that the rest of a word starts with. The automaton finds their
number in one pass over the word's characters: a trie of the vocabulary, a failure link for every node, and on each
link the number of pieces that following it completes. No piece is ever built.

A word is a run of word characters or one other character that is no white space. It is matched with the vocabulary's
word mark in front; a word with a part that no piece covers counts as one unknown token. The vocabulary is that of a
public piece model whose path is a parameter; each Python worker builds the automaton once.

Nulls: a null text has no words, a null id is passed on. Repeated rows are counted each; an empty table gives an
empty result; other columns are not read. Texts and words of any length take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.shared import own_names, spread

WORD = re.compile(r"\w+|[^\w\s]")
MARK = "▁"
#: Words whose counts a worker keeps; beyond it forgets them all and begins anew.
MEMO = 200_000
#: Characters of a word that is remembered at most, so that the memo is bounded in bytes; longer ones are counted each time.
REMEMBERED = 64
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


class Automaton:
    """``count(word)``: the number of greedy longest-match pieces of ``MARK + word``, or None if a part is not covered."""

    def __init__(self, pieces: Iterable[str]):
        self.child: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    final.append(False)
                node = nxt
            final[node] = node != 0
        #: where to go on when a node has no child for the next character, and how many pieces that completes
        self.fail: list[int | None] = [None] * len(self.child)
        self.popped = [0] * len(self.child)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for c, nxt in self.child[node].items():
                todo.append(nxt)
                if final[nxt]:
                    self.fail[nxt], self.popped[nxt] = 0, 1
                    continue
                at, popped = self.fail[node], self.popped[node]
                while at is not None and c not in self.child[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at is not None:
                    self.fail[nxt], self.popped[nxt] = self.child[at][c], popped

    def count(self, word: str) -> int | None:
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for c in MARK + word:
            while (nxt := child[node].get(c)) is None:
                total += popped[node]
                node = fail[node]
                if node is None:
                    return None
            node = nxt
        while node:
            total += popped[node]
            node = fail[node]
            if node is None:
                return None
        return total


def pieces_of(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p for i in range(model.get_piece_size()) if MARK not in (p := model.id_to_piece(i))[1:] and not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(pieces_of(path))


class _Memo(dict):
    def __init__(self, auto: Automaton):
        super().__init__()
        self.auto = auto

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self.auto.count(word)
        n = -1 if found is None else found
        if len(word) <= REMEMBERED:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens (an unknown word is one), n_unknown."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(automaton(vocabulary))
        for part in parts:
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = WORD.findall(text.as_py() or "")
                counts = list(map(memo.__getitem__, words))
                unknown = counts.count(-1)
                rows.append((doc_id, len(words), sum(counts) + 2 * unknown, unknown))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = own_names(docs, doc_id=id_col, text=text_col)
    return spread(rows.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(batches, SCHEMA)


def greedy_count(pieces: set[str], word: str) -> int | None:
    """The plain definition that the automaton must match: used by tests."""
    rest, n = MARK + word, 0
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not size:
            return None
        rest, n = rest[size:], n + 1
    return n


