"""Packing of documents into token sequences of a fixed length by swap-based local search.

1. Every document is encoded and followed by id 0. One longer than ``capacity`` is cut into full pieces, of which the
   first may be shorter. One pass over the texts writes the pieces' lengths and checksums to the shared folder.
2. Pieces are dealt into shards of about ``shard_size`` by row number, never by a key, so repeated rows spread out.
3. In a shard, pieces are put best-fit, longest first. Then the local search works on bins with room: it moves a piece,
   exchanges one for one, two for one or one for two between a fuller and an emptier bin wherever that fills the
   fuller one further, which raises the sum of squared fills, until bins run empty or nothing improves. A sweep compares
   every bin with room with the ``partners`` emptiest ones; ``sweeps`` ends a search that still improves a little. Both are
   parameters of the search, not of the result: every piece is packed either way.
4. Bins of all shards that stay under ``tight`` of the capacity are dealt out again, mixed, and packed once more.

Only lengths move between tasks, never texts or ids. Nulls: a null text is empty and so one id long; a null id is
passed on. Repeated rows are packed each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import wordhash
from tallyloom.llm.shared import own_names, spread, written

CAPACITY, SHARD, TIGHT = 2048, 8192, 0.985
#: Emptier bins that a bin is compared with in one sweep, and sweeps at most.
PARTNERS, SWEEPS = 24, 8
#: Split words whose ids a worker keeps in each of two generations, and bytes of text encoded at once.
MEMO, AT_ONCE = 150_000, 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# In texts of these characters alone, the vocabulary's splitting rule needs no Unicode tables.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡¿«»À-ÿ–—‘’“”…]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian 32-bit bytes; equal to ``tokenizers``' own, remembered by word."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        self.memo: dict[int, tuple[bytes, bytes]] = {}  # by the word's hash: its bytes, which decide, and its ids; of two generations
        self.older: dict[int, tuple[bytes, bytes]] = {}
        self.word = self._ranked(described["model"]) or self._whole

    def _ranked(self, model: dict):
        """A faster encoder of single words where the merges stand in the order of their ids, as the check confirms."""
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        made = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [vocab.get(m.replace(" ", "")) for m in made]
        if None in ids or ids != sorted(ids) or not all(c in byte_of for k in vocab for c in k):
            return None
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
        merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        return lambda w: struct.pack(f"<{len(ids := merge(w))}I", *ids)

    def _whole(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(map(self.word, _SPLIT.findall(text)))

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the n + 1 places where they begin. Rows that need Unicode tables go by :meth:`encode`."""
        starts, odd = split_bytes(data, offsets)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, "right") - 1
        plain = ~odd[row]
        starts, ends, row = starts[plain], ends[plain], row[plain]
        code, found = pd.factorize(wordhash.span_hashes(data, starts, ends, wordhash.VALUE_EXACT))
        first = np.zeros(len(found), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo, older, raw, held = self.memo, self.older, data.tobytes(), []
        for h, i in zip(found.tolist(), first.tolist()):
            word, known = raw[starts[i] : ends[i]], memo.get(h) or older.get(h)
            if known is None or known[0] != word:
                known = (word, self.word(word.decode()))
            memo[h] = known
            held.append(known[1])
        size = np.array([len(x) // 4 for x in held], np.int64)
        at = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(held), "<u4")
        n = size[code] if len(code) else np.zeros(0, np.int64)
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        ids = pool[np.repeat(at[code] - (upto - n), n) + np.arange(total)] if total else np.zeros(0, "<u4")
        per_row = np.zeros(len(offsets), np.int64)
        np.add.at(per_row, row + 1, n)
        if odd.any():
            parts, place = [], np.cumsum(per_row)
            for r in range(len(odd)):
                if odd[r]:
                    parts.append(np.frombuffer(self.encode(raw[offsets[r] : offsets[r + 1]].decode()), "<u4"))
                    per_row[r + 1] = len(parts[-1])
                else:
                    parts.append(ids[place[r] : place[r + 1]])
            ids = np.concatenate(parts)
        return ids, np.cumsum(per_row)


_SPACE, _ALPHA, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:192] = _CLASS[195] = _ALPHA
#: Bytes that the rules of :func:`split_bytes` do not cover: other controls, and all characters from U+0100 or below U+00C0.
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[127] = _ODD[192:] = True
_ODD[[9, 10, 13, 195]] = False


def split_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the vocabulary's split words begin, and which rows are beyond these rules (their words are not to be used).

    Runs of letters, digits or other characters are words, with one space before them; white space before that is a
    word, and so is a lone last white space that is no space. Contractions are left to the regular expression.
    """
    n, rows = len(data), len(offsets) - 1
    kind = _CLASS[data]
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    head = head[:n]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= head
    word = np.flatnonzero(change & (kind != _SPACE) & ~head)
    word = word[kind[word - 1] == _SPACE] if len(word) else word
    start = change.copy()
    start[word - 1] = True
    start[word[data[word - 1] == 32]] = False
    odd = _ODD[data]
    if n > 1:
        pair = data[:-1].astype(np.uint16) * 256 + data[1:]
        odd[1:] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0x3C7C) | ((data[:-1] == 39) & (kind[1:] == _ALPHA))
    where = np.flatnonzero(odd)
    marked = np.zeros(rows, bool)
    marked[np.searchsorted(offsets, where, "right") - 1] = True
    return np.flatnonzero(start), marked


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        for part in parts:
            rows, doc_ids = [], part.column(0).to_pylist()
            for top, _, data, offsets in wordhash.chunks(*wordhash.text_bytes(part.column(1)), AT_ONCE):
                ids, at = model.encode_rows(data, offsets)
                raw = memoryview(ids.tobytes())
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    n = b - a + 1  # with the closing id 0
                    start, end, k = 0, n % capacity or min(n, capacity), 0
                    while start < n:
                        crc = zlib.crc32(raw[4 * (a + start) : 4 * min(a + end, b)])
                        rows.append((doc_ids[top + r], k, start, end - start, zlib.crc32(b"\0\0\0\0", crc) if end == n else crc))
                        start, end, k = end, end + capacity, k + 1
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = own_names(docs, doc_id=id_col, text=text_col)
    return spread(rows.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(batches, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions, filled longest piece first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


class _Bin:
    """A bin's pieces by length. Bit s of ``ones`` and ``twos``: some piece, or two pieces, have that length together."""

    def __init__(self, items: list[int], lengths: list[int]):
        self.by_length: dict[int, list[int]] = {}
        for i in items:
            self.by_length.setdefault(lengths[i], []).append(i)
        self.fill = sum(lengths[i] for i in items)
        self._changed()

    def _changed(self) -> None:
        self.ones, self._twos = sum(1 << n for n in self.by_length), None

    @property
    def twos(self) -> int:
        if self._twos is None:
            self._twos = 0
            for n, held in self.by_length.items():
                self._twos |= (self.ones if len(held) > 1 else self.ones & ~(1 << n)) << n
        return self._twos

    def pair(self, total: int) -> tuple[int, int]:
        """The lengths of two pieces of that length together."""
        for n, held in self.by_length.items():
            if total - n in self.by_length and (total != 2 * n or len(held) > 1):
                return n, total - n
        raise KeyError(total)

    def taken(self, wanted: tuple[int, ...]) -> list[int]:
        out = []
        for n in wanted:
            out.append(self.by_length[n].pop())
            self.fill -= n
            if not self.by_length[n]:
                del self.by_length[n]
        self._changed()
        return out

    def put(self, items: list[int], wanted: tuple[int, ...]) -> None:
        for i, n in zip(items, wanted):
            self.by_length.setdefault(n, []).append(i)
            self.fill += n
        self._changed()


def _best_move(full: _Bin, low: _Bin, room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The largest gain up to ``room``, 0 where there is none, and the lengths that ``low`` gives for it and takes.

    A bin has at most some 60 distinct lengths and its sums lie below the capacity, so each wanted sum is looked up in bits;
    how many pieces there are does not count.
    """

    def highest(bits: int, above: int) -> int:
        """The highest sum in (above, above + room], or 0."""
        found = (bits >> (above + 1)) & ((1 << room) - 1)
        return above + found.bit_length() if found else 0

    best = (0, (), ())
    if s := highest(low.ones, 0):
        best = (s, (s,), ())
    for t in full.by_length:
        if best[0] == room:
            return best
        if (s := highest(low.ones, t)) and s - t > best[0]:
            best = (s - t, (s,), (t,))
        if (s := highest(low.twos, t)) and s - t > best[0]:
            best = (s - t, low.pair(s), (t,))
    for s in low.by_length:
        if best[0] == room:
            return best
        least = max(0, s - room)
        found = (full.twos >> least) & ((1 << (s - least)) - 1)
        if found and s - (t := least + (found & -found).bit_length() - 1) > best[0]:
            best = (s - t, (s,), full.pair(t))
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, partners: int = PARTNERS, sweeps: int = SWEEPS) -> list[list[int]]:
    lengths = lengths.tolist()
    least = -(-sum(lengths) // capacity)
    held = [_Bin(b, lengths) for b in bins if b]
    alive = len(held)
    for _ in range(sweeps):
        if alive <= least:
            break
        open_bins = sorted((b for b in held if 0 < b.fill < capacity), key=lambda b: -b.fill)
        improved = False
        for place, a in enumerate(open_bins):
            for b in open_bins[max(place + 1, len(open_bins) - partners) :][::-1]:
                while b.fill and a.fill < capacity and a.fill >= b.fill:
                    gain, given, taken = _best_move(a, b, capacity - a.fill)
                    if not gain:
                        break
                    out, back = b.taken(given), a.taken(taken)
                    a.put(out, given)
                    b.put(back, taken)
                    improved = True
                    if not b.fill:
                        alive -= 1
                if alive <= least or a.fill == capacity:
                    break
            if alive <= least:
                break
        if not improved:
            break
    return [[i for items in b.by_length.values() for i in items] for b in held if b.fill]


def packed(lengths: np.ndarray, capacity: int = CAPACITY, partners: int = PARTNERS, sweeps: int = SWEEPS) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity, partners, sweeps)


def _round(pieces: DataFrame, number: int, shard_size: int, capacity: int, partners: int, sweeps: int) -> DataFrame:
    shards = max(1, -(-pieces.count() // shard_size))
    # mixed, as the partition's number stands in the high bits of a row's
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards).cast("long")))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ignore_index=True)
        lengths = group["length"].to_numpy()
        seq, offset, fill = np.zeros(len(group), "i8"), np.zeros(len(group), "i8"), np.zeros(len(group), "i8")
        for k, b in enumerate(packed(lengths, capacity, partners, sweeps)):
            ends = np.cumsum(lengths[b])
            seq[b], offset[b], fill[b] = k, ends - lengths[b], ends[-1]
        group["sequence_id"] = seq + (number << 56) + group["shard"].to_numpy() * (1 << 24)
        group["offset"], group["fill"] = offset, fill
        return group.drop(columns="shard")

    return dealt.groupBy("shard").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long, fill long")


def pack(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_size: int = SHARD, tight: float = TIGHT, partners: int = PARTNERS, sweeps: int = SWEEPS
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut(docs, vocabulary, id_col=id_col, text_col=text_col, capacity=capacity), "pack-pieces")
    names = [x.split()[0] for x in PIECES.split(", ")]
    first = written(_round(pieces, 1, shard_size, capacity, partners, sweeps), "pack-round")
    done, loose = first.where(F.col("fill") >= tight * capacity), first.where(F.col("fill") < tight * capacity).select(names)
    again = _round(loose, 2, shard_size, capacity, partners, sweeps)
    return done.unionByName(again).select(*names, "sequence_id", "offset")
