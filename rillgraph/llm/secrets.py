"""Secret scan with a trigram inverted index; DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: the trigrams that every match must hold. The index
posts each document's content hash under those trigrams that some rule asks for; a rule's postings are
intersected, and only the candidates are searched with the regex. Rules without mandatory trigrams scan all texts.

The index is keyed by the text's hash: copies share one entry, and a hash collision only adds a candidate, which
the verification then rejects. Candidates are written first, so that the join with the texts is a broadcast while
their size is below autoBroadcastJoinThreshold and a sort-merge join beyond it.

Cases: a null text counts as empty and has no spans; repeated rows each get their own result; spans of different
kinds may overlap; extra columns are kept; one named found gives way to the result.
"""

from __future__ import annotations

import re._parser as sre
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm import _common


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex, and how many characters its group (0: the whole match) must have."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    base: bool = False


# The three base kinds, in their order. `+` with a least length is written as `{n,}` where the
# run is maximal anyway; assign keeps `+`, as a failing match still uses up its text.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = (
    Rule("assign", ASSIGN, 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)

#: Alternatives up to which literal strings are expanded while a query is derived.
EXPAND = 64

Query = object  # True (matches all), a trigram, ("and", frozenset) or ("or", frozenset)


def _and(parts) -> Query:
    flat = set()
    for p in parts:
        if p is True:
            continue
        flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _needs(q: Query) -> frozenset:
    return q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q])


def _or(parts) -> Query:
    parts = set(parts)
    if not parts or True in parts:
        return True
    # an alternative that asks for more than another adds nothing
    least = {p for p in parts if not any(o != p and _needs(o) < _needs(p) for o in parts)}
    return next(iter(least)) if len(least) == 1 else ("or", frozenset(least))


def _grams(strings: set[str]) -> Query:
    return _or(_and(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings that the items match, or None if unknown or many; what their matches must hold)."""
    exact: set[str] | None = {""}
    needs: list[Query] = []
    for op, arg in items:
        name = str(op)
        one: set[str] | None = None
        must: Query = True
        if name == "LITERAL":
            one = {chr(arg).lower()}
        elif name == "IN":
            chars = [chr(a).lower() for o, a in arg if str(o) == "LITERAL"]
            one = set(chars) if len(chars) == len(arg) and len(set(chars)) <= 8 else None
        elif name == "SUBPATTERN":
            one, must = _walk(arg[3])
        elif name == "BRANCH":
            got = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in got):
                one = set().union(*(s for s, _ in got))
            must = _or(_and([q, _grams(s) if s is not None else True]) for s, q in got)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            s, q = _walk(inner)
            if s is not None and low == 0 and high == 1:
                one = s | {""}
            elif low:
                must = _and([q, _grams(s) if s is not None else True])
        if one is not None and len(one) > EXPAND:
            must, one = _and([must, _grams(one)]), None
        if exact is not None and one is not None and len(exact) * len(one) <= EXPAND:
            exact = {a + b for a in exact for b in one}
            needs.append(must)
            continue
        needs += [_grams(exact) if exact else True, must]
        exact = one if one is not None and exact is not None and len(exact) * len(one) > EXPAND else None
        if exact is None:
            # what follows starts a new literal run
            exact = {""} if one is None else one
            needs.append(None)
    whole = None not in needs
    needs = [n for n in needs if n is not None]
    if not whole:
        needs.append(_grams(exact))
        return None, _and(needs)
    return exact, _and(needs)


def trigram_query(pattern: str) -> Query:
    """The trigrams, lower-cased, that every match of the pattern must hold; True if none are mandatory."""
    exact, needs = _walk(sre.parse(pattern))
    return _and([needs, _grams(exact) if exact is not None else True])


def trigrams(q: Query) -> set[str]:
    """All trigrams that a query names."""
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


def _holds(q: Query, grams: Column) -> Column:
    if isinstance(q, str):
        return F.array_contains(grams, q)
    parts = [_holds(x, grams) for x in sorted(q[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if q[0] == "and" else out | p
    return out


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def build_index(docs: DataFrame, grams: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Postings (gram string, content long) over all texts, lower-cased: of the given trigrams, or of all of them.

    All trigrams make an index that any later rule can be asked of; it takes several times the texts' bytes.
    """
    rows = docs.select(F.xxhash64(_text(F.col(text))).alias("content"), F.lower(_text(F.col(text))).alias("low"))
    if grams is None:
        return rows.select("content", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))).alias("gram"))
    found = F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    return rows.select("content", F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(content, kinds): which rules each posted text is a candidate for, by intersecting the postings."""
    per_text = index.groupBy("content").agg(F.collect_set("gram").alias("grams"))
    kinds = F.filter(
        F.array(*(F.when(_holds(trigram_query(r.pattern), F.col("grams")), F.lit(r.kind)) for r in rules if trigram_query(r.pattern) is not True)),
        lambda k: k.isNotNull(),
    )
    return per_text.select("content", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start,rank,end>> of a rule's matches, in code points: lengths of what lies between and of the matches add up."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(between, whole, value)  # its fields are 0, 1, 2
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        keep = F.length(x["2"]) >= rule.min_chars
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(keep, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """docs with found: array<struct<start long, rank int, end long>>, sorted; rank is the rule's place in rules.

    index: kept postings of docs with at least the trigrams of the rules; without one, those are posted first.
    """
    docs, back = _common.aside(docs.drop("found"), (text,))
    grams = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint>>)")
    source = docs
    if grams:
        if index is None:
            index, _ = _common.written(build_index(docs, grams, text), "secret-index")
        likely, _ = _common.written(candidates(index.filter(F.col("gram").isin(grams)), rules), "secret-candidates")
        likely = likely.select(F.col("content").alias("__content"), F.col("kinds").alias("__kinds"))
        source = docs.join(likely, F.xxhash64(_text(F.col(text))) == F.col("__content"), "left")
    parts = []
    for rank, rule in enumerate(rules):
        possible = F.col(text).rlike(rule.pattern)
        if trigram_query(rule.pattern) is not True:
            possible = F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False)) & possible
        parts.append(F.when(possible, _spans(F.col(text), rule, rank)).otherwise(none))
    found = F.array_sort(F.concat(*parts))
    return back(source.withColumn("found", found), "found")


def named(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, from scan()'s rows (doc_id, found)."""
    base = [i for i, r in enumerate(rules) if r.base]
    def of(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{rules[rank].kind}")

    counts = [of(i) for i in base]
    only = F.filter("found", lambda s: s["rank"].isin(base))
    return found.select("doc_id", *counts, F.sha2(named(only, rules), 256).alias("base_sha256"), named(F.col("found"), rules).alias("spans"))
