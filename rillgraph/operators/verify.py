"""Verification of answers against the activated region, cross-validation between answers, and their rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.functions import text as T
from rillgraph.functions.columns import clean_answer, exact_sum
from rillgraph.session import written


def answer_keywords(answers: DataFrame, known: DataFrame, names: DataFrame | None = None, **how) -> DataFrame:
    """answer_id, word, weight, known for answers (answer_id, text); known: word. The names of domains (name), in any case, are no keywords."""
    words = answers.select("answer_id", F.explode(T.keywords(F.col("text"), **how)).alias("word"))
    if names is not None:
        words = words.join(names.select(F.lower("name").alias("word")).distinct(), "word", "left_anti")
    k = known.select(F.col("word").alias("__word")).distinct()
    is_known = F.col("__word").isNotNull()
    return words.join(k, F.col("word") == F.col("__word"), "left").select("answer_id", "word", T.keyword_weight(F.col("word"), is_known).alias("weight"), is_known.alias("known"))


def active_words(active: DataFrame, aliases: DataFrame) -> DataFrame:
    """word: the active labels (word) and every alias (alias, label) of one."""
    return active.select("word").union(aliases.join(active.select(F.col("word").alias("label")), "label", "left_semi").select("alias")).distinct()


def verify(answers: DataFrame, words: DataFrame, active: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """answer_id, n_keywords, confidence, direction, verdict. words: answer_keywords(); active: word; aliases (alias, label) of active nodes count as these do.

    confidence is the matched share of the keywords' weight; without keywords it is .5 and the verdict uncertain.
    """
    active = active if aliases is None else active_words(active, aliases)
    a = active.select(F.col("word").alias("__active")).distinct()
    hit = words.join(a, F.col("word") == F.col("__active"), "left")
    total = hit.groupBy("answer_id").agg(F.count("*").alias("n"), exact_sum(F.col("weight")).alias("all"), exact_sum(F.when(F.col("__active").isNotNull(), F.col("weight")).otherwise(0.0)).alias("hit"))
    out = answers.select("answer_id").join(total, "answer_id", "left")
    confidence = F.coalesce(T.round_half(F.col("hit") / F.col("all"), 4), F.lit(0.5))
    direction = F.when(F.col("n").isNull(), 0).when(confidence >= CONFIG.confidence_high, 1).when(confidence < CONFIG.confidence_low, -1).otherwise(0)
    verdict = F.when(direction == 1, "reinforce").when(direction == -1, "correct").otherwise("uncertain")
    return out.select("answer_id", F.coalesce("n", F.lit(0)).alias("n_keywords"), confidence.alias("confidence"), direction.cast("long").alias("direction"), verdict.alias("verdict"))


def unmatched(words: DataFrame, active: DataFrame) -> DataFrame:
    """answer_id, word: keywords that nothing active covers."""
    return words.join(active.select("word"), "word", "left_anti").select("answer_id", "word")


def references(words: DataFrame, active: DataFrame, aliases: DataFrame) -> DataFrame:
    """answer_id, word, label: keywords that are no active label; label is the active node that one is an alias of, else null (unmatched)."""
    open_ = words.select("answer_id", "word").join(active.select("word"), "word", "left_anti")
    owner = aliases.join(active.select(F.col("word").alias("label")), "label", "left_semi").select(F.col("alias").alias("word"), "label")
    return open_.join(owner, "word", "left").select("answer_id", "word", "label")


def pairs_of(answers: DataFrame) -> DataFrame:
    """group_id, a, b, jaccard, contradiction of the pairs of a group's answers (group_id, pos, text), a before b by pos.

    Each answer is read once: its n-grams become hashes and its statements two bit sets, and only those are joined.
    Groups are a query's few experts.
    """
    grams = F.transform(T.char_grams(F.col("text")), lambda g: F.xxhash64(g))
    rows = written(answers.select("group_id", "pos", grams.alias("grams"), T.stance(F.coalesce("text", F.lit(""))).alias("stance")), "answers")
    a, b = (rows.select("group_id", F.col("pos").alias(x), F.col("grams").alias(f"grams_{x}"), F.col("stance").alias(f"stance_{x}")) for x in "ab")
    both = a.join(b, "group_id").filter("a < b")
    return both.select("group_id", "a", "b", T.jaccard(F.col("grams_a"), F.col("grams_b"), 1.0).alias("jaccard"), T.contradicts(F.col("stance_a"), F.col("stance_b")).alias("contradiction"))


def cross_validate(answers: DataFrame) -> DataFrame:
    """group_id, min_jaccard, contradiction, status, factor: consistent if the least n-gram overlap is above .8 and nothing contradicts."""
    out = pairs_of(answers).groupBy("group_id").agg(F.round(F.min("jaccard"), 6).alias("min_jaccard"), F.bool_or("contradiction").alias("contradiction"))
    fine = (F.col("min_jaccard") > CONFIG.consistency) & ~F.col("contradiction")
    return out.withColumns({"status": F.when(fine, "consistent").otherwise("contested"), "factor": F.when(fine, 1.0).otherwise(CONFIG.discount)})


def merged_answers(answers: DataFrame) -> DataFrame:
    """group_id, merged: the first answer, and below it each later one that has n-grams the first lacks, marked with its name. answers: group_id, pos, name, text."""
    rows = answers.filter("text is not null").withColumn("grams", T.char_grams(F.col("text")))
    first = rows.groupBy("group_id").agg(F.min_by(F.struct("pos", "text", "grams"), "pos").alias("first"))
    later = rows.join(first, "group_id").filter((F.col("pos") > F.col("first.pos")) & (F.size(F.array_except("grams", "first.grams")) > 0))
    added = later.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.format_string("[%s补充] %s", "name", "text").alias("t")))).alias("added"))
    text = F.concat_ws("\n\n", F.col("first.text"), F.transform("added", lambda x: x["t"]))
    return first.join(added, "group_id", "left").select("group_id", text.alias("merged"))


def _ordered(items: Column, field: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(items)), lambda x: x[field])


def render_answers(scores: DataFrame, top: DataFrame, seeds: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, answer: a line per selected domain, then the most active nodes with shortened definitions, then the strongest paths."""
    lines = scores.groupBy("query_id").agg(_ordered(F.struct((-F.col("score")).alias("s"), "domain"), "domain").alias("d"))
    named = top.join(seeds.select("label", "definition"), "label", "left")
    item = F.concat("label", F.lit(": "), F.substring(F.coalesce("definition", F.lit("")), 1, 120))
    nodes = named.groupBy("query_id").agg(_ordered(F.struct("rank", item.alias("t")), "t").alias("n"))
    step = F.concat("source", F.lit(" -"), "relation", F.lit("-> "), "target")
    paths = relations.groupBy("query_id").agg(_ordered(F.struct("rank", step.alias("t")), "t").alias("p"))
    out = lines.join(nodes, "query_id", "left").join(paths, "query_id", "left")
    return out.select("query_id", F.concat_ws("\n", F.array_join("d", ", "), F.array_join("n", "\n"), F.array_join("p", "\n")).alias("answer"))


def answers_json(activated: DataFrame, scores: DataFrame, seeds: DataFrame, relations: DataFrame, matched: DataFrame) -> DataFrame:
    """query_id, answer: one JSON object per query with its most active nodes (definitions cut at 200), strongest paths, scores and counts."""
    from rillgraph.operators.ripple import selected_domains, top_seeds

    named = top_seeds(activated).join(seeds.select("label", "domain", "definition"), "label", "left")
    node = F.struct("label", F.round("activation", 4).alias("activation"), "domain", F.substring(F.coalesce("definition", F.lit("")), 1, 200).alias("definition"), "depth")
    nodes = named.groupBy("query_id").agg(_ordered(F.struct("rank", node.alias("t")), "t").alias("activated_seeds"))
    path = F.struct("source", "target", "relation", "weight", "depth")
    paths = relations.groupBy("query_id").agg(_ordered(F.struct("rank", path.alias("t")), "t").alias("paths"))
    by_domain = scores.groupBy("query_id").agg(_ordered(F.struct((-F.col("score")).alias("s"), F.struct("domain", F.round("score", 4).alias("score")).alias("t")), "t").alias("domain_scores"))
    counts = activated.groupBy("query_id").agg(F.count("*").alias("total_activated")).join(matched.groupBy("query_id").agg(F.count("*").alias("matched_seeds")), "query_id", "left")
    out = nodes.join(counts, "query_id").join(paths, "query_id", "left").join(by_domain, "query_id", "left").join(selected_domains(scores).withColumnRenamed("domains", "selected_domains"), "query_id", "left")
    fields = ("query_id", "activated_seeds", "paths", "domain_scores", "selected_domains", "matched_seeds", "total_activated")
    return out.select("query_id", F.to_json(F.struct(*fields)).alias("answer"))


def rendered(regions: DataFrame, threshold: float = CONFIG.domain_threshold) -> DataFrame:
    """query_id, answer as render_answers gives them, of ripple.regions(): queries with a domain that reaches the threshold."""
    lines = F.filter("domains", lambda x: x["s"] <= -threshold)
    nodes = F.transform("nodes", lambda x: F.concat(x["label"], F.lit(": "), F.substring(F.coalesce(x["definition"], F.lit("")), 1, 120)))
    paths = F.transform("paths", lambda x: F.concat(x["source"], F.lit(" -"), x["relation"], F.lit("-> "), x["target"]))
    steps = F.when(F.col("passed") > 0, F.array_join(paths, "\n"))
    return regions.filter(F.col("best") >= threshold).select("query_id", F.concat_ws("\n", F.array_join(F.transform(lines, lambda x: x["domain"]), ", "), F.array_join(nodes, "\n"), steps).alias("answer"))


def rendered_json(regions: DataFrame, threshold: float = CONFIG.domain_threshold) -> DataFrame:
    """query_id, answer as answers_json gives them, of ripple.regions(); what a query has none of is left out."""
    node = lambda x: F.struct(x["label"].alias("label"), F.round(x["activation"], 4).alias("activation"), x["domain"].alias("domain"), F.substring(F.coalesce(x["definition"], F.lit("")), 1, 200).alias("definition"), x["depth"].alias("depth"))
    path = lambda x: F.struct(*(x[k].alias(k) for k in ("source", "target", "relation", "weight", "depth")))
    score = lambda x: F.struct(x["domain"].alias("domain"), F.round(-x["s"], 4).alias("score"))
    chosen = F.transform(F.filter("domains", lambda x: x["s"] <= -threshold), lambda x: x["domain"])
    fields = {"activated_seeds": F.transform("nodes", node), "paths": F.when(F.col("passed") > 0, F.transform("paths", path)), "domain_scores": F.transform("domains", score), "selected_domains": F.when(F.col("best") >= threshold, chosen), "matched_seeds": F.col("matched"), "total_activated": F.col("total")}
    return regions.select("query_id", F.to_json(F.struct("query_id", *(v.alias(k) for k, v in fields.items()))).alias("answer"))


# The context's headings and what stands where a block is empty.
CONTEXT = ("## 知识上下文", "### 激活的概念", "### 概念间关系", "（无激活概念）", "（无概念间关系）")


def prompts(nodes: DataFrame, paths: DataFrame, queries: DataFrame, budget: int = CONFIG.context_tokens, chars: int = CONFIG.query_chars, system: str = "") -> DataFrame:
    """query_id, prompt, context, tokens (of the context), truncated (whether a node or path found no room).

    A block of nodes with domain and definition within 60 % of the token budget, one of paths with their weights within 40 %, and the
    query's first characters, below `system`. A line costs what it takes in full, with brackets for an empty domain and the relation's own
    name. nodes: query_id, rank, label, domain, definition; paths: query_id, rank, source, relation, target, weight; queries: query_id, text.
    """
    from rillgraph.operators.ripple import within_budget
    from rillgraph.operators.state import relation_name

    def block(rows: DataFrame, full: Column, line: Column, share: float, name: str) -> DataFrame:
        rows = rows.select("query_id", "rank", line.alias("line"), T.estimated_tokens(full).alias("cost"))
        kept = within_budget(rows, "cost", ["rank"], int(budget * share)).groupBy("query_id").agg(F.array_join(_ordered(F.struct("rank", "line"), "line"), "\n").alias(name), F.count("*").alias(f"kept_{name}"))
        return rows.groupBy("query_id").agg(F.count("*").alias(f"all_{name}")).join(kept, "query_id", "left")

    def of(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    domain, definition = of("domain"), of("definition")
    short = F.concat(F.lit("- "), "label", F.when(domain != "", F.concat(F.lit(" ["), domain, F.lit("]"))).otherwise(""), F.when(definition != "", F.concat(F.lit(": "), definition)).otherwise(""))
    n = block(nodes, F.concat(F.lit("- "), "label", F.lit(" ["), domain, F.lit("]: "), definition), short, 0.6, "n")
    step = lambda relation: F.concat(F.lit("- "), "source", F.lit(" --["), relation, F.lit("]--> "), "target", F.format_string(" (关联度: %.2f)", F.col("weight")))
    p = block(paths, step(F.col("relation")), step(relation_name(F.col("relation"))), 0.4, "p")
    out = queries.join(n, "query_id", "left").join(p, "query_id", "left")
    title, concepts, relations, no_node, no_path = map(F.lit, CONTEXT)
    context = F.concat(title, F.lit("\n\n"), concepts, F.lit("\n"), F.coalesce("n", no_node), F.lit("\n\n"), relations, F.lit("\n"), F.coalesce("p", no_path), F.lit("\n"))
    left_out = [F.coalesce(F.col(f"all_{x}"), F.lit(0)) > F.coalesce(F.col(f"kept_{x}"), F.lit(0)) for x in "np"]
    out = out.select("query_id", context.alias("context"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("asked"), (left_out[0] | left_out[1]).alias("truncated"))
    whole = F.concat(F.lit(f"{system}\n\n" if system else ""), "context", F.lit("\n"), "asked")
    return out.select("query_id", whole.alias("prompt"), "context", T.estimated_tokens(F.col("context")).alias("tokens"), "truncated")


def infer(prompts_: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]] | None = None, batch_tokens: int = 8192) -> DataFrame:
    """query_id, answer, failed: answers to prompts (query_id, prompt, context) by a model; the context is the answer of those it fails on.

    model() is called once in each Python worker and gives a function of a list of prompts. It is asked in batches of at most
    batch_tokens estimated tokens, a longer prompt alone. Where a batch raises an error, gives another number of answers or a null, its
    prompts, or that one, fall back; the job goes on. Without a model all contexts are answers, none of them failed.
    """
    if model is None:
        return prompts_.select("query_id", F.col("context").alias("answer"), F.lit(False).alias("failed"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = model()
        for rows in parts:
            out, at, texts = [], 0, [x or "" for x in rows["prompt"]]
            while at < len(texts):
                end, used = at, 0
                while end < len(texts) and (end == at or used + int(len(texts[end]) * 0.6) <= batch_tokens):
                    used += int(len(texts[end]) * 0.6)
                    end += 1
                try:
                    made = answer(texts[at:end])
                    ok = len(made) == end - at
                except Exception:  # whatever a model does, its batch falls back
                    ok = False
                out += made if ok else [None] * (end - at)
                at = end
            yield pd.DataFrame({"query_id": rows["query_id"], "made": pd.Series(out, index=rows.index, dtype=object), "context": rows["context"]})

    out = prompts_.select("query_id", "prompt", "context").mapInPandas(run, "query_id long, made string, context string")
    return out.select("query_id", F.coalesce(clean_answer(F.col("made")), "context").alias("answer"), F.isnull("made").alias("failed"))
