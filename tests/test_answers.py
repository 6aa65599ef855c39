"""Prompts, models that fail, verification with aliases: worked examples."""

import pytest
from pyspark.sql import functions as F

from rillgraph.operators import verify as V

NODES = "query_id long, rank int, label string, domain string, definition string"
PATHS = "query_id long, rank int, source string, relation string, target string, weight double"


@pytest.fixture(scope="module")
def parts(spark):
    nodes = [(1, 1, "sea", "nature", "salt water"), (1, 2, "ship", "", "floats"), (1, 3, "sail", "tool", None), (1, 4, "mast", None, ""), (2, 1, "rill", "", "")]
    paths = [(1, 1, "sea", "COOCCURS_WITH", "ship", 0.854), (1, 2, "ship", "CARRIES", "sail", 0.5)]
    asked = [(1, "why do ships sail"), (2, None), (3, "nothing")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(paths, PATHS), spark.createDataFrame(asked, "query_id long, text string")


def test_prompt_lines(spark, parts):
    """Lines with and without domain and definition; empty blocks; the system's part first."""
    got = {r.query_id: r for r in V.prompts(*parts, budget=200, chars=6, system="Answer.").collect()}
    context = "## 知识上下文\n\n### 激活的概念\n- sea [nature]: salt water\n- ship: floats\n- sail [tool]\n- mast\n\n### 概念间关系\n- sea --[常与...共现]--> ship (关联度: 0.85)\n- ship --[CARRIES]--> sail (关联度: 0.50)\n"
    assert got[1].context == context and got[1].prompt == f"Answer.\n\n{context}\nwhy do" and got[1].tokens == int(len(context) * 0.6) and not got[1].truncated
    empty = "## 知识上下文\n\n### 激活的概念\n（无激活概念）\n\n### 概念间关系\n（无概念间关系）\n"
    assert got[3].context == empty and got[3].prompt.endswith("\nnothin") and not got[3].truncated
    assert got[2].context == empty.replace("（无激活概念）", "- rill") and got[2].prompt.endswith("\n\n")


@pytest.mark.parametrize("budget, nodes, paths", [(30, 1, 0), (43, 2, 0), (62, 3, 0), (70, 4, 1)])
def test_prompt_budget(spark, parts, budget, nodes, paths):
    """Lines cost what they take in full, definition and weight included; the first without room ends its block."""
    full = ["- sea [nature]: salt water", "- ship []: floats", "- sail [tool]: ", "- mast []: "]
    steps = ["- sea --[COOCCURS_WITH]--> ship (关联度: 0.85)", "- ship --[CARRIES]--> sail (关联度: 0.50)"]

    def fits(lines, most):
        used = n = 0
        for line in lines:
            used += int(len(line) * 0.6)
            if used > most:
                break
            n += 1
        return n

    assert (fits(full, int(budget * 0.6)), fits(steps, int(budget * 0.4))) == (nodes, paths)
    r = V.prompts(*parts, budget=budget).filter("query_id = 1").first()
    assert (r.context.count("\n- s") + r.context.count("\n- m"), r.truncated) == (nodes + paths, True)


def model(name):
    """A model that raises on batches with 'boom', answers short on 'few', and else repeats the prompt's first word."""

    def start():
        def answer(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("out of memory")
            if any("few" in p for p in prompts):
                return []
            return [None if "null" in p else f"<think>hm</think>{name} {p.split()[0]}" for p in prompts]

        return answer

    return start


def test_infer(spark):
    """A failing batch falls back to its contexts, the others are answered; batches hold what their tokens allow."""
    rows = [(i, t, f"context {i}") for i, t in enumerate(["sea one", "boom", "few", "null here", "ship two", "", None, "x" * 500])]
    df = spark.createDataFrame(rows, "query_id long, prompt string, context string").coalesce(1)
    got = {r.query_id: (r.answer, r.failed) for r in V.infer(df.filter("query_id not in (5, 6)"), model("m"), batch_tokens=1).collect()}
    assert got == {0: ("m sea", False), 1: ("context 1", True), 2: ("context 2", True), 3: ("context 3", True), 4: ("m ship", False), 7: ("m " + "x" * 500, False)}
    together = {r.query_id: r.failed for r in V.infer(df, model("m"), batch_tokens=10_000).collect()}
    assert set(together.values()) == {True}, "one batch, which raises"
    assert {r.failed for r in V.infer(df).collect()} == {False}


def test_answers_of_several_models(spark):
    """Models' answers to a query, one of them fallen back, are cross-validated."""
    df = spark.createDataFrame([(1, "sea water", "context"), (2, "ship boom", "elsewhere entirely")], "query_id long, prompt string, context string")
    answers = None
    for pos, (name, batch) in enumerate((("same", 1), ("same", 1))):
        one = V.infer(df, model(name), batch).select(F.col("query_id").alias("group_id"), F.lit(pos).alias("pos"), F.col("answer").alias("text"))
        answers = one if answers is None else answers.unionAll(one)
    other = V.infer(df, model("quite another"), 1).select("query_id", F.lit(2), "answer")
    assert {r.group_id: r.status for r in V.cross_validate(answers).collect()} == {1: "consistent", 2: "consistent"}
    assert {r.group_id: r.status for r in V.cross_validate(answers.unionAll(other)).collect()} == {1: "contested", 2: "consistent"}


def test_verify_with_aliases(spark):
    """Aliases of active nodes count as these; those of others do not."""
    answers = spark.createDataFrame([(1, "the ocean and boats"), (2, "trees")], "answer_id long, text string")
    known = spark.createDataFrame([("sea",)], "word string")
    words = V.answer_keywords(answers, known)
    active = spark.createDataFrame([("sea",)], "word string")
    aliases = spark.createDataFrame([("ocean", "sea"), ("trees", "forest")], "alias string, label string")
    of = lambda df: {r.answer_id: (r.confidence, r.direction) for r in df.collect()}
    assert of(V.verify(answers, words, active)) == {1: (0.0, -1), 2: (0.0, -1)}
    assert of(V.verify(answers, words, active, aliases)) == {1: (0.5, 0), 2: (0.0, -1)}
