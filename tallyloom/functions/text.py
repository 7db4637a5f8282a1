"""Reference normalisation, tokens and containment, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate the parts of a reference. Fixed values.
SEPARATORS = " \t/\\-_.,;:|()[]{}'\""
_SPLIT = "[\\s" + "".join(f"\\{c}" for c in SEPARATORS if not c.isspace()) + "]+"
MIN_NORMAL = 3
DIGIT_SHARE, MIN_DIGITS = 0.40, 2


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_ref(c: Column) -> Column:
    """Separators deleted, upper case, leading zeros stripped down to one character; '' for null."""
    bare = F.upper(F.translate(text(c), SEPARATORS, ""))
    cut = F.ltrim(bare, F.lit("0"))
    return F.when((bare != "") & (cut == ""), F.lit("0")).otherwise(cut)


def split_tokens(*columns: Column) -> Column:
    return F.filter(F.split(F.concat_ws(" ", *map(text, columns)), _SPLIT), lambda t: t != "")


def ref_like(token: Column) -> Column:
    """Enough digits to be a reference rather than prose."""
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    return digits >= F.greatest(F.lit(float(MIN_DIGITS)), F.lit(DIGIT_SHARE) * F.length(token))


def ref_tokens(*columns: Column, min_len: int) -> Column:
    """Normalised reference-like tokens of free text, without repeats."""
    normal = F.transform(split_tokens(*columns), normalize_ref)
    return F.array_distinct(F.filter(normal, lambda t: (F.length(t) >= min_len) & ref_like(t)))


def ref_keys(own: list[Column], texts: list[Column], min_len: int) -> Column:
    """A row's join keys: its own references whatever they look like, and the reference-like tokens of its texts."""
    plain = F.filter(F.array(*[normalize_ref(c) for c in own]), lambda t: F.length(t) >= min_len)
    return F.array_distinct(F.concat(plain, ref_tokens(*texts, min_len=min_len)))


def contains_ref(haystack: Column, needle: Column) -> Column:
    """The needle as written or normalised; short normalised needles only as written."""
    raw, n = F.trim(F.upper(text(needle))), normalize_ref(needle)
    written = F.contains(F.upper(text(haystack)), raw)
    return (raw != "") & F.when(F.length(n) < MIN_NORMAL, written).otherwise(written | F.contains(normalize_ref(haystack), n))


def merged_description(a: Column, b: Column) -> Column:
    """The text that contains the other, else both."""
    x, y = F.trim(text(a)), F.trim(text(b))
    return F.when(F.contains(x, y), x).when(F.contains(y, x), y).otherwise(F.concat_ws(" ", x, y))


def detail(details: Column, key: str) -> Column:
    """One value of a log entry's JSON details as text; null where the text is no JSON or lacks the key."""
    return F.try_variant_get(F.try_parse_json(details), f"$.{key}", "string")


def unlike(c: Column, part: Column | str) -> Column:
    """Whether a text is there and does not hold ``part``, case aside: NOT LIKE '%part%'. An empty part is held by every text."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.coalesce(~F.contains(F.upper(c), F.upper(text(part))), F.lit(False))
