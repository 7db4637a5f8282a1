"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (always kept once confirmed): ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19 digits that pass
Luhn), ``phone`` (international form, 10 to 15 digits). Added by the scoring method, when their score reaches
``threshold``: ``iban`` (mod 97), ``ssn`` (group rules), ``local_phone`` (national form) and ``secret`` (access keys and
assigned tokens). A span's score is its kind's prior, raised by its validator and moved by words within ``window``
characters of it.

Whole texts are read in Arrow batches; nothing is shuffled. Nulls: a null text counts as empty, a null id is passed on.
Repeated rows give repeated results, an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.shared import own_names, spread

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE = KINDS[:4]
THRESHOLD, WINDOW = 0.5, 40
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_spans long"

#: An "@" with its domain; the local part is looked up to its left, which keeps long runs of letters linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(] )(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:password|token|secret|api_key)\x20?=\x20?\"?[A-Za-z0-9_+/.-]{12,}+\"?")

PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3, "local_phone": 0.3, "secret": 0.7}
CHECKED = {"ip": 0.2, "card": 0.4, "iban": 0.5, "ssn": 0.1}
#: Words near a span that speak for its kind, in the languages of the corpus.
CONTEXT = {
    "email": "email e-mail mail contact kontakt courriel correo",
    "ip": "ip address host server adresse",
    "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon portable llame",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
    "local_phone": "phone tel call mobile fax telefon portable llame",
    "secret": "key secret token password credential",
}
#: Words near a span that speak against personal data.
AGAINST = re.compile(r"\b(?:example|sample|version|isbn|order|invoice|part)\b", re.I)
_FOR = {kind: re.compile(r"\b(?:" + "|".join(map(re.escape, words.split())) + r")\b", re.I) for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        at = begin = m.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            last = m.end()
            yield begin, last


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the confirmed base spans; failing matches are dropped without a retry."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    return round(min(1.0, max(0.0, PRIOR[kind] + CHECKED.get(kind, 0.0) + 0.2 * bool(_FOR[kind].search(near)) - 0.2 * bool(AGAINST.search(near)))), 2)


def _proposed(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _IBAN.finditer(text):
        if 15 <= len(s := m[0].replace(" ", "")) <= 34 and mod97(s):
            yield m.start(), 4, m.end()
    for m in _SSN.finditer(text):
        a, b, c = m[0].split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield m.start(), 5, m.end()
    for m in _LOCAL_PHONE.finditer(text):
        yield m.start(), 6, m.end()
    for m in _SECRET.finditer(text):
        yield m.start(), 7, m.end()


def spans(text: str, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """The base spans, and all spans with their scores. An added span yields to a base span that it overlaps."""
    base = base_spans(text)
    found = [(s, k, e, score(text, KINDS[k], s, e)) for s, k, e in base]
    starts, ends = [], []  # the base spans as runs without overlap, for a binary search
    for s, _, e in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for s, k, e in _proposed(text):
        at = bisect_left(starts, e) - 1  # the last run that begins before this span ends
        if not (at >= 0 and ends[at] > s) and (x := score(text, KINDS[k], s, e)) >= threshold:
            found.append((s, k, e, x))
    return base, sorted(found)


def _listed(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document, with ``SCHEMA``'s columns."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                base, every = spans(text.as_py() or "", threshold)
                kinds = [k for _, k, _ in base]
                rows.append(
                    (doc_id, *(kinds.count(k) for k in range(4)), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(x[:3] for x in every), ",".join(f"{x[3]:.2f}" for x in every), len(every))
                )
            columns = list(zip(*rows)) or [[]] * 9
            types = [pa.int64()] * 5 + [pa.string()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = own_names(docs, doc_id=id_col, text=text_col)
    return spread(rows.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(batches, SCHEMA)


def redact(docs: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by its kind in angle brackets; null stays null."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            if text is not None:
                at, parts = 0, []
                for s, k, e, _ in spans(text, threshold)[1]:
                    if s >= at:
                        parts += [text[at:s], f"<{KINDS[k]}>"]
                    at = max(at, e)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
