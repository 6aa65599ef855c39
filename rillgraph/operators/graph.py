"""Graph operators other than activation: statistics, inference along IS_A, distances, neighbourhoods, lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillgraph.config import CONFIG
from rillgraph.functions.columns import domain_or
from rillgraph.session import Scratch, written


def alias_index(seeds: DataFrame) -> DataFrame:
    """alias, label: the first node in (ord) order owns an alias. seeds: label, aliases array<string>, ord."""
    return seeds.select("label", "ord", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.min_by("label", F.struct("ord", "label")).alias("label"))


def lookup(names: DataFrame, seeds: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, label, how: a node by its label, else by its alias, else null and 'miss'."""
    by_label = seeds.select(F.col("label").alias("l")).distinct()
    by_alias = aliases.select(F.col("alias").alias("a"), F.col("label").alias("owner"))
    out = names.join(by_label, names["name"] == F.col("l"), "left").join(by_alias, names["name"] == F.col("a"), "left")
    how = F.when(F.col("l").isNotNull(), "exact").when(F.col("owner").isNotNull(), "alias").otherwise("miss")
    return out.select("name", F.coalesce("l", "owner").alias("label"), how.alias("how"))


def merge_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """label, aliases: the union of old and new aliases (label, aliases), sorted."""
    both = old.select("label", "aliases").unionByName(new.select("label", "aliases"))
    return both.select("label", F.explode_outer("aliases").alias("a")).groupBy("label").agg(F.array_sort(F.collect_set("a")).alias("aliases"))


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """old and those rows of new whose key is not there yet; the first in order wins within new."""
    first = new.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def fill_definitions(seeds: DataFrame, dictionary: DataFrame, longer: bool = False) -> DataFrame:
    """label, definition, domain after a dictionary (word, definition, definitions, domain): filled, replaced where longer, or inserted."""
    given = F.coalesce(F.nullif("definition", F.lit("")), F.array_join("definitions", "; "))
    d = dictionary.select(F.col("word").alias("label"), given.alias("__def"), F.col("domain").alias("__dom")).filter(F.col("__def") != "")
    out = seeds.join(d, "label", "full_outer")
    own = F.coalesce("definition", F.lit(""))
    better = F.col("__def").isNotNull() & ((own == "") | (F.lit(longer) & (F.length("__def") > F.length(own))))
    return out.select("label", F.when(better, F.col("__def")).otherwise(own).alias("definition"), F.coalesce("domain", "__dom", F.lit("")).alias("domain"))


#: Characters that no imported title may hold.
TITLE_MARKS = "[{}\\[\\]<>|\\\\/\"'+=&%$#@!~`^*]"


def new_titles(titles: DataFrame, seeds: DataFrame) -> DataFrame:
    """title: distinct titles of two or more characters, without marks, that no node has yet."""
    good = titles.filter((F.length("title") >= 2) & ~F.col("title").rlike(TITLE_MARKS)).select("title").distinct()
    return good.join(seeds.select(F.col("label").alias("title")), "title", "left_anti")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source").alias("label")).agg(F.count("*").alias("degree"))


def hottest(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n sources with most outgoing weight."""
    total = F.sum(F.round("weight", 9).cast("decimal(28,9)")).cast("double")
    return edges.groupBy(F.col("source").alias("label")).agg(total.alias("total"), F.count("*").alias("degree")).orderBy(F.desc("total"), "label").limit(n)


def coldest(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n sources with least outgoing weight; nodes without edges do not count."""
    total = F.sum(F.round("weight", 9).cast("decimal(28,9)")).cast("double")
    return edges.groupBy(F.col("source").alias("label")).agg(total.alias("total"), F.count("*").alias("degree")).orderBy("total", "label").limit(n)


def heaviest(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n edges with most weight."""
    return edges.orderBy(F.desc("weight"), "source", "target", "relation").limit(n)


def _avg(column: str = "weight"):
    return F.round(F.sum(F.round(column, 9).cast("decimal(28,9)")).cast("double") / F.count("*"), 4)


def domain_density(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """domain, density, edges: the mean weight of the edges that leave each domain's nodes, all domains in one pass."""
    named = edges.join(seeds.select(F.col("label").alias("source"), "domain"), "source")
    return named.groupBy(domain_or(F.col("domain"), CONFIG.unclassified).alias("domain")).agg(_avg().alias("density"), F.count("*").alias("edges"))


def relation_quality(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(_avg().alias("quality"), F.count("*").alias("edges"))


def core_seeds(seeds: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """domain, label, degree, rank: each domain's n nodes with the highest out-degree, nodes without edges included."""
    degree = seeds.join(out_degree(edges), "label", "left").select("domain", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    order = W.partitionBy("domain").orderBy(F.desc("degree"), "label")
    return degree.filter("domain <> ''").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def orphans(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, users aside, that no edge leaves or reaches."""
    ends = edges.select(F.col("source").alias("label")).unionAll(edges.select(F.col("target").alias("label")))
    return seeds.filter("type <> 'USER'").join(ends, "label", "left_anti").select("label", "type", "domain")


def missing_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Of pairs (a, b), those without an edge either way."""
    known = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")


def associations(activated: DataFrame, edges: DataFrame | None = None, threshold: float = 0.1, reach: int = 4, checks: int = 50) -> DataFrame:
    """query_id, a, b: unlinked pairs among each query's nodes at or above the threshold, up to `reach` places apart in rank; `checks` pairs at most.

    What links them is read from `linked`, the sources of edges that reach a node (ripple.activated with links), or else looked up in edges:
    then each pair is sent to them.
    """
    if "linked" not in activated.columns:
        pairs = associations(activated.withColumn("linked", F.array().cast("array<string>")), None, threshold, reach, checks)
        known = edges.select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).distinct()
        return pairs.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(known, ["x", "y"], "left_anti").select("query_id", "a", "b")
    order = W.partitionBy("query_id").orderBy(F.desc("activation"), "label")
    ranked = activated.filter(F.col("activation") >= threshold).select("query_id", "label", "activation", "linked")
    after = F.filter(F.array(*(F.lead(F.struct("label", "linked"), d).over(order) for d in range(1, reach + 1))), lambda b: b.isNotNull())
    ranked = ranked.withColumn("after", after)
    before = F.coalesce(F.sum(F.size("after")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.lit(checks) - before).cast("int")
    pairs = ranked.withColumn("after", F.slice("after", F.lit(1), room)).select("query_id", F.col("label").alias("a"), F.col("linked").alias("to_a"), F.explode("after").alias("b"))
    return pairs.filter(~F.array_contains("to_a", F.col("b.label")) & ~F.array_contains("b.linked", F.col("a"))).select("query_id", "a", "b.label").toDF("query_id", "a", "b")


def infer_domains(seeds: DataFrame, edges: DataFrame, depth: int = CONFIG.isa_depth) -> DataFrame:
    """label, inferred, method, hops: each blank node's domain from its nearest ancestor along IS_A (is_a); else the default.

    method tells why there is none: cycle, if the ascent meets a node twice, else fallback. Ties of the nearest level go to the smaller
    domain. What an ascent has found within m steps is joined with what those m steps away have found, so the steps double and
    `depth` of them take log2(depth) rounds. A round carries, for nodes still open, the nodes exactly m steps up and the least label on
    the way. An ascent without a fork meets a node twice on a ring only: the ring whose least node comes upon itself (`_rings`). All nodes that an
    ascent met are carried for those alone that a fork is above or below of (`_tangled`).
    """
    spark = seeds.sparkSession
    with Scratch(spark) as scratch:
        put = scratch.put
        nodes = put(seeds.select("label", F.nullif("domain", F.lit("")).alias("domain")), "nodes")
        blank = nodes.filter("domain is null").select("label").distinct()
        isa = edges.filter("relation = 'IS_A'").select(F.col("source").alias("label"), F.col("target").alias("at")).distinct()
        up = put(isa.join(blank, "label", "left_semi").join(nodes.groupBy(F.col("label").alias("at")).agg(F.min("domain").alias("domain")), "at", "left"), "isa")
        # found: the nearest domain within m steps; jumps: who is 1, 2, 4 ... steps up of nodes open until then
        found = put(up.filter("domain is not null").groupBy("label").agg(F.min("domain").alias("domain")).withColumn("hops", F.lit(1).cast("long")), "isa-found")
        low = F.struct(F.col("at").alias("label"), F.lit(1).cast("long").alias("hops")).alias("low")
        jumps = [put(up.filter("domain is null").select("label", "at", low).join(found, "label", "left_anti"), "isa-exact")]
        m = 1
        while m < depth and not jumps[-1].isEmpty():
            exact = jumps[-1]
            far = exact.join(found.withColumnRenamed("label", "at"), "at").withColumn("hops", F.col("hops") + m).filter(F.col("hops") <= depth)
            new = put(far.groupBy("label").agg(F.min(F.struct("hops", "domain")).alias("n")).select("label", "n.domain", "n.hops"), "isa-found")
            next_ = exact.select(F.col("label").alias("at"), F.col("at").alias("to"), F.struct(F.col("low.label"), (F.col("low.hops") + m).alias("hops")).alias("far"))
            open_ = exact.join(new, "label", "left_anti").join(next_, "at").groupBy("label", F.col("to").alias("at")).agg(F.min(F.least("low", "far")).alias("low"))
            jumps.append(put(open_, "isa-exact"))
            found = found.unionByName(new)
            m *= 2
        forks = put(up.groupBy("label").agg(F.count("*").alias("parents")).filter("parents > 1").select("label"), "isa-forks")
        near = forks if forks.isEmpty() else _near_forks(up, forks, depth, put)
        again = _rings(jumps, near, depth, put)
        if near is not forks:
            again = again.unionByName(_tangled(up, jumps, near, depth, put))
        out = blank.join(found, "label", "left").join(again.withColumn("__again", F.lit(True)), "label", "left")
        method = F.when(F.col("domain").isNotNull(), "is_a").when(F.col("__again"), "cycle").otherwise("fallback")
        return written(out.select("label", F.coalesce("domain", F.lit(CONFIG.default_domain)).alias("inferred"), method.alias("method"), "hops"), "inferred")


def _rings(jumps: list[DataFrame], near: DataFrame, depth: int, put: Callable) -> DataFrame:
    """label: nodes, those near forks left out, that are on a ring or below one and meet a node twice within `depth` steps.

    Of a ring, the least node is the one that is the least of its own way; its first return gives the ring's size. The ring is walked from there, and the
    way to it measured, by doubling steps.
    """
    if 2 ** (len(jumps) - 1) < depth or jumps[-1].isEmpty():
        return near.limit(0)
    single = [j.join(near, "label", "left_anti") for j in jumps]
    on = single[-1].filter((F.col("low.label") == F.col("label")) & (F.col("low.hops") <= depth)).select("label", F.col("low.hops").alias("size"))
    met = put(on.distinct(), "isa-rings")
    longest = met.agg(F.max("size")).first()[0]
    if longest is None:
        return near.limit(0)
    for i, jump in enumerate(single):
        if 2**i >= longest:
            break
        met = put(met.unionByName(met.join(jump, "label").select(F.col("at").alias("label"), "size")).distinct(), "isa-rings")
    if single[-1].join(met, "label", "left_anti").isEmpty():
        return met.select("label")
    met = met.withColumn("way", F.lit(0).cast("long"))
    for i, jump in enumerate(single):
        further = jump.join(met.withColumnRenamed("label", "at"), "at").join(met.select("label"), "label", "left_anti")
        further = put(further.select("label", "size", (F.col("way") + 2**i).alias("way")).filter(F.col("way") + F.col("size") <= depth), "isa-below")
        met = met.unionByName(further)
    return met.select("label")


def _near_forks(up: DataFrame, forks: DataFrame, depth: int, put: Callable) -> DataFrame:
    """label: forks and all nodes within `depth` steps above or below one, and maybe some more."""
    above = below = forks
    jump, m = up.select("label", "at"), 1
    while True:
        above = put(above.union(jump.join(above, "label", "left_semi").select("at")).distinct(), "isa-above")
        below = put(below.union(jump.join(below.withColumnRenamed("label", "at"), "at", "left_semi").select("label")).distinct(), "isa-below")
        m *= 2
        if m > depth:
            return put(above.union(below).distinct(), "isa-near")
        jump = put(jump.join(jump.select(F.col("label").alias("at"), F.col("at").alias("to")), "at").select("label", F.col("to").alias("at")).distinct(), "isa-jumps")


def _tangled(up: DataFrame, jumps: list[DataFrame], near: DataFrame, depth: int, put: Callable) -> DataFrame:
    """label: those of near whose ascent of `depth` steps meets a node twice; near holds what their ascents meet."""
    met, m = put(jumps[0].join(near, "label", "left_semi").select("label", "at", F.lit(1).cast("long").alias("hops")), "isa-met"), 1
    for jump in jumps[:-1]:
        more = jump.join(near, "label", "left_semi").join(met.select(F.col("label").alias("at"), F.col("at").alias("to"), "hops"), "at")
        more = more.select("label", F.col("to").alias("at"), (F.col("hops") + m).alias("hops")).filter(F.col("hops") <= depth)
        met = put(met.unionByName(more).groupBy("label", "at").agg(F.min("hops").alias("hops")), "isa-met")
        m *= 2
    # an ascent is a tree if each parent that it comes upon is a new one
    parents = put(up.groupBy(F.col("label").alias("at")).agg(F.count("*").alias("parents")), "isa-parents")
    seen = met.filter("label <> at").groupBy("label").agg(F.count("*").alias("seen"))
    upon = met.filter((F.col("hops") < depth) & (F.col("label") != F.col("at"))).join(parents, "at").groupBy("label").agg(F.sum("parents").alias("more"))
    again = seen.join(upon, "label", "left").unionByName(met.filter("label = at").select("label", F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("more")))
    again = again.groupBy("label").agg(F.sum("seen").alias("seen"), F.sum("more").alias("more")).join(parents.withColumnRenamed("at", "label"), "label")
    return again.filter(F.col("parents") + F.coalesce("more", F.lit(0)) > F.col("seen")).select("label")


#: Keywords that are broadcast and tried on each text; more are looked up by the text's pieces.
FEW_KEYWORDS = 1000


def holding(texts: DataFrame, column: str, keywords: DataFrame, few: int = FEW_KEYWORDS) -> DataFrame:
    """texts with each keyword that the column holds; an empty keyword and a null text hold nothing.

    Up to `few` keywords are broadcast. More are met by an equi-join of 64-bit hashes: those of the keywords and those of the text's distinct
    pieces of the keywords' lengths, which travel under 128 hashed bits of the text and not with it. What met is looked for in the text itself,
    so no hash decides.
    """
    words, c = keywords.filter("keyword <> ''"), F.col(column)
    if words.limit(few + 1).count() <= few:
        return texts.join(F.broadcast(words), F.contains(c, F.col("keyword")))
    lengths = sorted(r[0] for r in words.select(F.length("keyword")).distinct().collect())

    def pieces(n: int) -> F.Column:
        every = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.xxhash64(F.substring(c, i, F.lit(n))))
        return F.when(F.length(c) >= n, every).otherwise(F.array().cast("array<bigint>"))

    key = F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))
    posted = texts.filter(c.isNotNull()).select(key.alias("__key"), F.explode(F.array_distinct(F.flatten(F.array(*map(pieces, lengths))))).alias("__piece"))
    met = posted.join(words.select(F.xxhash64("keyword").alias("__piece"), F.col("keyword").alias("__keyword")).distinct(), "__piece").select("__key", "__keyword").distinct()
    held = texts.withColumn("__key", key).join(met, "__key").filter(F.contains(c, F.col("__keyword")))
    return held.join(words, F.col("__keyword") == F.col("keyword")).drop("__key", "__keyword")


def keyword_domain(texts: DataFrame, keywords: DataFrame, few: int = FEW_KEYWORDS) -> DataFrame:
    """id, domain: the longest keyword (keyword, domain) that the lower-cased text holds names the domain."""
    held = holding(texts.select("id", F.lower("text").alias("text")), "text", keywords, few)
    return held.groupBy("id").agg(F.max_by("domain", F.struct(F.length("keyword"), "keyword")).alias("domain"))


def category_domain(categories: DataFrame, keywords: DataFrame, few: int = FEW_KEYWORDS) -> DataFrame:
    """id, domain: the first category that holds a keyword, then the first keyword. categories: id, pos, category; keywords: pos, keyword, domain."""
    held = holding(categories.select("id", "pos", "category"), "category", keywords.withColumnRenamed("pos", "kw_pos"), few)
    return held.groupBy("id").agg(F.min_by("domain", F.struct("pos", "kw_pos")).alias("domain"))


def domain_coverage(seeds: DataFrame) -> DataFrame:
    """seeds, with_domain, percent."""
    n = F.count_if(F.coalesce("domain", F.lit("")) != "")
    return seeds.agg(F.count("*").alias("seeds"), n.alias("with_domain"), F.round(n * 100 / F.count("*"), 4).alias("percent"))


def domain_distance(seeds: DataFrame, edges: DataFrame, depth: int = CONFIG.distance_depth) -> DataFrame:
    """origin, target, hops: the least number of edges from any node of one domain to any of another, up to depth.

    The frontier of a level holds only (origin, node) pairs not met before.
    """
    named = written(seeds.filter("domain <> ''").select("label", "domain"), "named")
    open_ = named.select(F.col("domain").alias("origin"), "label").distinct()
    hops = written(edges.select(F.col("source").alias("label"), F.col("target").alias("next")).distinct(), "hops")
    met, found = open_, None
    for hop in range(1, depth + 1):
        new = open_.join(hops, "label").select("origin", F.col("next").alias("label")).distinct().join(met, ["origin", "label"], "left_anti")
        open_ = written(new, "distance-level")
        hit = open_.join(named, "label").filter("origin <> domain").select("origin", F.col("domain").alias("target"), F.lit(hop).cast("long").alias("hops")).distinct()
        found = hit if found is None else found.unionByName(hit)
        if open_.isEmpty():
            break
        met = met.unionByName(open_)
    return found.groupBy("origin", "target").agg(F.min("hops").alias("hops"))


def neighbour_jaccard(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, jaccard of the undirected one-hop neighbourhoods; two empty ones: 0. One shared-neighbour join, no sets are collected."""
    near = edges.select(F.col("source").alias("x"), F.col("target").alias("n")).union(edges.select(F.col("target"), F.col("source"))).distinct()
    size = near.groupBy("x").agg(F.count("*").alias("size"))
    shared = pairs.join(near.withColumnsRenamed({"x": "a"}), "a").join(near.withColumnsRenamed({"x": "b"}), ["b", "n"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = pairs.join(shared, ["a", "b"], "left").join(size.withColumnsRenamed({"x": "a", "size": "sa"}), "a", "left").join(size.withColumnsRenamed({"x": "b", "size": "sb"}), "b", "left")
    both = F.coalesce("shared", F.lit(0))
    union = F.coalesce("sa", F.lit(0)) + F.coalesce("sb", F.lit(0)) - both
    return out.select("a", "b", F.round(F.coalesce(both / F.nullif(union, F.lit(0)), F.lit(0.0)), 6).alias("jaccard"))


def fuzzy_match(words: DataFrame, labels: DataFrame, distance: int = 1) -> DataFrame:
    """word, label, distance: the label within `distance` edits; nearest first, then the highest degree, then the label.

    Two strings within d edits share a piece when one is cut into d + 1 pieces; here each string is posted under its
    deletion neighbourhood's first and second halves, so the join is on equal keys and never on all pairs.
    """

    def halves(name: str) -> F.Column:
        c = F.col(name)
        n = F.length(c)
        half = F.floor(n / 2).cast("int")
        return F.array(
            F.concat(F.lit("p"), F.substring(c, F.lit(1), half)), F.concat(F.lit("s"), F.substring(c, half + 1, n)),
            F.concat(F.lit("p"), F.substring(c, F.lit(1), half + 1)), F.concat(F.lit("s"), F.substring(c, half + 2, n)),
            F.concat(F.lit("p"), F.substring(c, F.lit(1), F.greatest(half - 1, F.lit(0)))), F.concat(F.lit("s"), F.substring(c, F.greatest(half, F.lit(1)), n)),
        )

    w = words.select("word").distinct().withColumn("k", F.explode(F.array_distinct(halves("word"))))
    t = labels.select("label", "degree").withColumn("k", F.explode(F.array_distinct(halves("label"))))
    near = w.join(t, "k").withColumn("d", F.levenshtein("word", "label", distance)).filter("d >= 0").select("word", "label", "degree", "d").distinct()
    best = near.groupBy("word").agg(F.min_by(F.struct("label", "d"), F.struct("d", -F.col("degree"), "label")).alias("b"))
    return best.select("word", "b.label", F.col("b.d").cast("long").alias("distance"))
