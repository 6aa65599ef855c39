"""Greedy tokenizer of query texts against labels and aliases.

Runs of the greedy script (Han, as a rule) are split at negation words; a part is tried whole, as a label, as an alias, as
a label within one edit, and else read by longest match up to eight characters; characters left over side by side are
tried together within one edit, then each alone. Words of Latin letters and digits are matched whole. A match that
begins within four characters after a negation word is excluded.

What a text may match is found by joins: all its candidate strings are exploded and looked up among labels, aliases and,
within one edit, labels again, so no vocabulary goes to a worker. Only the order of the choices, which has no set form,
is an Arrow function over one query's own finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.operators.graph import fuzzy_match
from rillgraph.session import share_code

LONGEST = 8
#: Candidate strings that a task hands on at once.
BATCH = 100_000
SCOPE = 4
# The negation words.
NEGATION_WORDS = ("不是", "并非", "没有", "不会", "不能", "不要", "并非是", "不", "没", "非", "无", "别", "莫", "勿")
HAN = "[一-鿿]+"
TOKEN = "query_id long, pos int, text string, how string, label string, excluded boolean"

_NEGATION = re.compile("|".join(sorted(NEGATION_WORDS, key=len, reverse=True)))
_WORD = re.compile("[a-zA-Z0-9]+")

#: What a string may be: (how, label) in the order of preference exact, alias, fuzzy.
Finds = Mapping[str, tuple[str, str]]
Token = tuple[str, str, str | None]


def _parts(text: str, script: re.Pattern) -> list[str]:
    """The parts between negation words of all runs of the greedy script."""
    return [p for run in script.findall(text) for p in _NEGATION.split(run) if p]


def candidates(text: str | None, script: str = HAN) -> set[str]:
    """Every string of a text that a token may be."""
    parts = _parts(text or "", re.compile(script))
    whole = "".join(parts)
    short = {whole[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(whole) - n + 1)}
    return short | set(parts) | set(_WORD.findall(text or ""))


def _scan(part: str, finds: Finds) -> Iterator[Token]:
    """Longest match from the left; a character that begins none is left over."""
    at = 0
    while at < len(part):
        for n in range(min(LONGEST, len(part) - at), 0, -1):
            how, label = finds.get(part[at : at + n], ("", ""))
            if how in ("exact", "alias"):
                yield part[at : at + n], how, label
                at += n
                break
        else:
            yield part[at], "unmatched", None
            at += 1


def _combined(found: list[Token], finds: Finds) -> list[Token]:
    """Characters left over side by side: the longest, then leftmost string of them within one edit; then each alone."""
    out: list[Token] = []
    i = 0
    while i < len(found):
        j = i
        while j < len(found) and found[j][1] == "unmatched" and len(found[j][0]) == 1:
            j += 1
        left = "".join(t for t, _, _ in found[i:j])
        spans = ((a, n) for n in range(min(len(left), LONGEST), 1, -1) for a in range(len(left) - n + 1))
        hit = next(((a, n) for a, n in spans if finds.get(left[a : a + n], ("",))[0] == "fuzzy"), None)
        if hit:
            a, n = hit
            out += [*found[i : i + a], (left[a : a + n], *finds[left[a : a + n]]), *found[i + a + n : j]]
        else:
            out += found[i:j]
        if j == i:
            out.append(found[i])
            j += 1
        i = j
    alone = lambda t: (t[0], *finds[t[0]]) if t[1] == "unmatched" and finds.get(t[0], ("",))[0] == "fuzzy" else t
    return [alone(t) for t in out]


def tokens(text: str | None, finds: Finds, script: str = HAN) -> list[tuple[str, str, str | None, bool]]:
    """(text, how, label, excluded) of one query; how: exact, alias, fuzzy or unmatched."""
    text = text or ""
    found: list[Token] = []
    for part in _parts(text, re.compile(script)):
        how, label = finds.get(part, ("", None))
        if how in ("exact", "alias") or (how == "fuzzy" and 2 <= len(part) <= LONGEST):
            found.append((part, how, label))
        else:
            found += _scan(part, finds)
    found = _combined(found, finds)
    for word in _WORD.findall(text):
        how, label = finds.get(word, ("unmatched", None))
        found.append((word, how, label) if how in ("exact", "alias") else (word, "unmatched", None))
    ends = [m for w in NEGATION_WORDS for m in (x.end() for x in re.finditer(f"(?={w})", text)) for m in (m + len(w),)]
    return [(t, how, label, how != "unmatched" and any(e <= text.find(t) < e + SCOPE for e in ends)) for t, how, label in found]


def lookup(words: DataFrame, labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """word, how, label of the words (word) that match: as a label, as an alias, or within one edit of a label (label, degree)."""
    exact = labels.select(F.col("label").alias("word"), F.lit(0).alias("rank"), F.lit("exact").alias("how"), "label")
    alias = aliases.select(F.col("alias").alias("word"), F.lit(1).alias("rank"), F.lit("alias").alias("how"), "label")
    plain = words.select("word").distinct()
    known = plain.join(exact.unionAll(alias), "word").groupBy("word").agg(F.min(F.struct("rank", "how", "label")).alias("m")).select("word", "m.how", "m.label")
    near = fuzzy_match(plain.filter(F.length("word") <= LONGEST).join(known, "word", "left_anti"), labels)
    return known.unionByName(near.select("word", F.lit("fuzzy").alias("how"), "label"))


def tokenize(queries: DataFrame, labels: DataFrame, aliases: DataFrame, script: str = HAN) -> DataFrame:
    """query_id, pos, text, how, label, excluded for queries (query_id, text); labels: label, degree; aliases: alias, label.

    Repeated query ids are one query each time they come with another text. Null and empty texts have no token.
    """
    share_code(queries.sparkSession)
    # candidates travel under 128 hashed bits of their query, not with its text
    row = F.struct(F.xxhash64("query_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "query_id").alias("b"))
    rows = queries.select(F.col("query_id").cast("long"), "text").filter("text is not null").distinct().withColumn("row", row)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            at, words = [], []
            for i, text in enumerate(r.column(1).to_pylist()):
                own = candidates(text, script)
                at += [i] * len(own)
                words += own
                if len(words) >= BATCH:
                    yield pa.RecordBatch.from_arrays([r.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string())], names=["row", "word"])
                    at, words = [], []
            yield pa.RecordBatch.from_arrays([r.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string())], names=["row", "word"])

    asked = rows.select("row", "text").mapInArrow(explode, "row struct<a:long,b:long>, word string")
    finds = lookup(asked.select("word"), labels, aliases)
    of = asked.join(finds, "word").groupBy("row").agg(F.collect_list(F.struct("word", "how", "label")).alias("finds"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
        for r in batches:
            out = []
            for q, text, own in zip(*(c.to_pylist() for c in r.columns), strict=True):
                known = {f["word"]: (f["how"], f["label"]) for f in own or ()}
                out += [(q, i, *t) for i, t in enumerate(tokens(text, known, script))]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["query_id", "pos", "text", "how", "label", "excluded"])

    return rows.join(of, "row", "left").select("query_id", "text", "finds").mapInArrow(order, TOKEN)


def matched_seeds(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, label, pos: matched nodes, negated tokens and META and PERCEPTUAL nodes left out, first match per node."""
    kept = found.filter("label is not null and not excluded").join(seeds.filter(~F.col("type").isin("META", "PERCEPTUAL")).select("label"), "label", "left_semi")
    return kept.groupBy("query_id", "label").agg(F.min("pos").alias("pos"))
