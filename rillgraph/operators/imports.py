"""Imports with new endpoints, title and content imports, single lookups, and chained domain inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.functions.columns import step_weight
from rillgraph.functions.text import without_marks
from rillgraph.operators.graph import category_domain, infer_domains, keyword_domain

EDGE = ["source", "target", "relation"]
#: Relations that the second import layer takes.
LAYER2 = ("RELATED", "CAUSE", "PART_OF", "COOCCURS_WITH")


def edges_of(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """keys (source, target, relation) with the weight of that edge, null where there is none."""
    return keys.join(edges.select(*EDGE, "weight"), EDGE, "left")


def weighted_triples(triples: DataFrame, edges: DataFrame, seeds: DataFrame, relations: tuple[str, ...] = LAYER2) -> tuple[DataFrame, DataFrame]:
    """(new edges, new nodes) of triples (s, relation, o, c): weights by steps, dropped at 0; known edges stay as they are; unknown endpoints become nodes."""
    t = triples.filter(F.col("relation").isin(*relations)).select(F.col("s").alias("source"), F.col("o").alias("target"), "relation", step_weight(F.col("c")).alias("weight"))
    best = t.filter("weight > 0").groupBy(*EDGE).agg(F.max("weight").alias("weight"))
    ends = best.select(F.col("source").alias("label")).union(best.select("target")).distinct()
    return best.join(edges.select(*EDGE), EDGE, "left_anti"), ends.join(seeds.select("label"), "label", "left_anti")


def titled(articles: DataFrame, seeds: DataFrame) -> DataFrame:
    """label, definition, id after articles (title, content): a definition is replaced where it is empty or shorter, other titles are inserted with ids dd_.

    Titles lose what stands before their first letter; of several articles of a title the longest content counts.
    """
    a = articles.select(without_marks(F.col("title")).alias("label"), F.coalesce("content", F.lit("")).alias("content")).filter("label <> ''")
    a = a.groupBy("label").agg(F.max(F.struct(F.length("content"), F.col("content"))).alias("m")).select("label", F.col("m.content").alias("__new"))
    out = seeds.select("label", "definition", F.col("label").alias("__old")).join(a, "label", "full_outer")
    better = F.col("__new").isNotNull() & (F.length(F.coalesce("definition", F.lit(""))) < F.length("__new"))
    made = F.concat(F.lit("dd_"), F.substring(F.md5("label"), 1, 12))
    return out.select("label", F.when(better, F.col("__new")).otherwise(F.coalesce("definition", F.lit(""))).alias("definition"), F.when(F.col("__old").isNull(), made).alias("id"))


def chained_domains(seeds: DataFrame, edges: DataFrame, words: DataFrame | None = None, categories: DataFrame | None = None, depth: int = CONFIG.isa_depth, ascent: DataFrame | None = None) -> DataFrame:
    """label, inferred, method: of each blank node by its nearest ancestor, else its dictionary text, else its categories, else the default.
    An ascent that meets a node twice (cycle) ends at the default.

    words and categories are (texts, keywords) as keyword_domain and category_domain take them, with id = label; a
    source that is not there is skipped. ascent: infer_domains' result, if it is there already.
    """
    out = (infer_domains(seeds, edges, depth) if ascent is None else ascent).select("label", F.when(F.col("method") == "is_a", F.col("inferred")).alias("is_a"), F.when(F.col("method") == "cycle", CONFIG.default_domain).alias("cycle"))
    methods = ["is_a", "cycle"]
    for name, given, rule in (("dictionary", words, keyword_domain), ("category", categories, category_domain)):
        if given is not None:
            out = out.join(rule(*given).select(F.col("id").alias("label"), F.col("domain").alias(name)), "label", "left")
            methods.append(name)
    which = F.coalesce(*(F.when(F.col(m).isNotNull(), F.lit(m)) for m in methods), F.lit("fallback"))
    return out.select("label", F.coalesce(*methods, F.lit(CONFIG.default_domain)).alias("inferred"), which.alias("method"))


def inference_report(seeds: DataFrame, inferred: DataFrame) -> DataFrame:
    """part, name, n: of an inference (label, method) over seeds (label, domain), the nodes by method, those without domain before, those with the
    default (fallback and cycle), and the nodes with a domain after it."""
    by = inferred.groupBy("method").agg(F.count("*").alias("n")).select(F.lit("method").alias("part"), F.col("method").alias("name"), "n")
    common = F.col("method").isin("fallback", "cycle")
    sums = inferred.agg(F.count("*").alias("empty"), F.count_if(common).alias("common"), F.count_if(F.col("method") == "cycle").alias("cycles"))
    sums = sums.select(F.expr("stack(3, 'empty', empty, 'default', common, 'cycles', cycles) as (name, n)")).select(F.lit("total").alias("part"), "name", "n")
    done = seeds.filter("domain <> ''").select("label").union(inferred.select("label")).distinct().agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit("with domain").alias("name"), "n")
    return by.unionByName(sums).unionByName(done)
