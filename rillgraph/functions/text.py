"""Text functions: keywords, n-grams, contradiction, prompt parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs of a statement and its negation, in their order. Other pairs are a parameter of `stance`.
NEGATIONS = (
    ("有效", "无效"),
    ("可以", "不可以"),
    ("应该", "不应该"),
    ("能", "不能"),
    ("会", "不会"),
    ("是", "不是"),
    ("有", "没有"),
    ("需要", "不需要"),
    ("正确", "错误"),
    ("安全", "危险"),
    ("推荐", "不推荐"),
    ("适合", "不适合"),
    ("必须", "禁止"),
)

#: Words that say little; callers extend them from a file.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was")


def round_half(value: Column, digits: int) -> Column:
    """Rounded by floor(x * 10^digits + .5), which is the same arithmetic in every engine."""
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def keywords(text: Column, least: int = 2, letters: str = "\\p{L}", drop: Sequence[str] = STOPWORDS) -> Column:
    """The distinct runs of `least` or more letters, in order, without dropped words (stop words, domain names). letters: a character class, \\p{IsHan} for Han."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"{letters}{{{least},}}"), F.lit(0)))
    return F.array_except(F.coalesce(found, _none()), F.array(*map(F.lit, drop)))


def keyword_weight(word: Column, known: Column) -> Column:
    """1.5 for known words of 4 letters or more, 1.2 for known ones of 3, else 1."""
    return F.when(known & (F.length(word) >= 4), 1.5).when(known & (F.length(word) >= 3), 1.2).otherwise(1.0)


def char_grams(text: Column, sizes: Sequence[int] = (2, 3), letters: str = "\\p{L}", drop: Sequence[str] = STOPWORDS) -> Column:
    """The distinct character n-grams within the runs of letters, stop words left out."""
    runs = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"{letters}+"), F.lit(0)), _none())
    grams = F.flatten(F.transform(runs, lambda r: F.flatten(F.array(*(_of_size(r, n) for n in sizes)))))
    return F.array_except(grams, F.array(*map(F.lit, drop)))


def _of_size(t: Column, n: int) -> Column:
    places = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.substring(t, i, F.lit(n)))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Intersection over union of two arrays of distinct values; `empty` if both are."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(empty)).otherwise(both / union)


def stance(text: Column, pairs: Sequence[tuple[str, str]] = NEGATIONS) -> Column:
    """struct<says long, denies long>: a bit per pair whose statement alone, or negation alone, the text holds.

    Where the statement is a part of its negation, a text with the negation does not hold the statement.
    """
    says, denies = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, (yes, no) in enumerate(pairs):
        has_yes, has_no = F.contains(text, F.lit(yes)), F.contains(text, F.lit(no))
        only_no = has_no if yes in no else has_no & ~has_yes
        bit = F.lit(1 << i).cast("long")
        says = says.bitwiseOR(F.when(has_yes & ~has_no, bit).otherwise(0))
        denies = denies.bitwiseOR(F.when(only_no, bit).otherwise(0))
    return F.struct(says.alias("says"), denies.alias("denies"))


def contradicts(a: Column, b: Column) -> Column:
    """Whether of two stances one says what the other denies."""
    return a["says"].bitwiseAND(b["denies"]).bitwiseOR(a["denies"].bitwiseAND(b["says"])) != 0


def estimated_tokens(text: Column) -> Column:
    """floor(.6 * length): the context's token estimate."""
    return F.floor(F.length(text) * 0.6).cast("long")


def without_marks(title: Column) -> Column:
    """A title without what stands before its first letter or digit."""
    return F.trim(F.regexp_replace(title, "^[^\\p{L}\\p{N}_]+", ""))


def timestamp_of(text: Column) -> Column:
    """An ISO 8601 time, at its offset where it has one, else in the session's zone; failing that, the same without its zone; else null."""
    bare = F.regexp_replace(text, "(Z+|\\+.*)$", "")
    return F.when(F.regexp_like(text, F.lit("^\\d{4}-\\d{2}-\\d{2}")), F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(bare)))
