"""Column expressions: exact sums, clips, steps, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillgraph.config import CONFIG


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on their order: nine decimals, added as decimals."""
    return F.sum(F.round(value, 9).cast("decimal(28,9)")).cast("double")


def small_sum(value: Column) -> Column:
    """As exact_sum, over whole numbers of 1e-9 in 64 bits: for sums that stay below 9e9, such as activations, which are 2 at most each."""
    return F.sum(F.floor(value * 1e9 + 0.5)) / 1e9


def clip(weight: Column, low: float = CONFIG.weight_min, high: float = CONFIG.weight_max) -> Column:
    """Weights stay within [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), weight))


def step_weight(confidence: Column) -> Column:
    """Edge weight of an imported triple: .7, .5 or .3 from confidences of .9, .7 and .5 on; 0 drops it."""
    return F.when(confidence >= 0.9, 0.7).when(confidence >= 0.7, 0.5).when(confidence >= 0.5, 0.3).otherwise(0.0)


def related_weight(confidence: Column) -> Column:
    """Weight of a RELATED edge: .1 + .6 c for positive confidences, else .1."""
    return F.when(confidence > 0, F.lit(0.1) + 0.6 * confidence).otherwise(0.1)


def layered_weight(global_weight: Column, personal: Column, cold: Column, virtual: bool = False) -> Column:
    """Weight over the global and the personal layer; virtual runs take the global one as it is."""
    if virtual:
        return global_weight
    return global_weight * CONFIG.global_ratio + personal * CONFIG.personal_ratio * cold


def cold_factor(queries: Column) -> Column:
    """min(n / 20, 1) of a user's counted queries."""
    return F.least(queries / F.lit(float(CONFIG.cold_start_queries)), F.lit(1.0))


def domain_or(domain: Column, default: str = CONFIG.default_domain) -> Column:
    """Blank domains count as the default one."""
    return F.coalesce(F.nullif(domain, F.lit("")), F.lit(default))


def user_id(source: Column, source_id: Column) -> Column:
    """user_ and the first 8 hex digits of sha256(source:id)."""
    return F.concat(F.lit("user_"), F.substring(F.sha2(F.concat_ws(":", source, source_id), 256), 1, 8))


def goal_id(domain: Column, kind: Column, as_of: Column) -> Column:
    """goal_ and the first 6 hex digits of md5 over domain, type and the cycle's time."""
    return F.concat(F.lit("goal_"), F.substring(F.md5(F.concat_ws("|", domain, kind, as_of.cast("string"))), 1, 6))


def prefixed(label: Column, prefix: str) -> Column:
    """label with its prefix, added where it is not there."""
    return F.when(label.startswith(prefix), label).otherwise(F.concat(F.lit(prefix), label))


def clean_answer(text: Column) -> Column:
    """Model output without its thinking part and control marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"<\|[^|>]*\|>", ""))


def html_escaped(text: Column) -> Column:
    """& < > \" ' as entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def cycles_since(as_of: Column, touched: Column) -> Column:
    """Whole minutes since a goal was touched: one cycle each."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(touched)) / 60)
