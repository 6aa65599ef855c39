"""Divergence, decontamination and filter interactions against brute force, with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from rillgraph.llm import _common, decontaminate, divergence, interactions, linededup, mixing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string, same string, part string, hash string, `a.b` string, `m` map<string,int>, __content string, __source string, __row string, n string, block string"
EXTRA = (None, "x", "y", "z", "w", "dot", {"k": 1}, "c", "s", "r", "n", "b")
CLASH = ["a.b", "m", "__content", "__source", "__row"]


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns of clashing names, dots and a map."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


WORDS = ["the", "Sea", "of", "rills", "Éa", "éa", "run", "9nine", "x", "stone", "water", "löß"]


def texts(seed, n, low=0, high=40):
    rnd = random.Random(seed)
    gaps = [" ", ", ", "\n", "--", "\t"]
    return ["".join(rnd.choice(WORDS) + rnd.choice(gaps) for _ in range(rnd.randint(low, high))) for _ in range(n)]


ODD = [(901, None, None, None), (902, "", "en", None), (None, "the Sea of rills", None, "a"), (903, " \n$", "en", "a"), (903, " \n$", "en", "a"), (904, "LOUD " * 30000, "en", "b")]


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


# 11
def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def divergence_brute(rows, least, top):
    from collections import Counter, defaultdict

    rows = [(t or "", a or "", s or "") for _, t, a, s in rows]
    seen, n = defaultdict(Counter), defaultdict(Counter)
    for t, a, s in rows:
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
        seen[a].update(set(own))
        n[a, s].update(own)
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, k in seen[lang].items() if k >= least)
        v, sources = len(kept), sorted({r[2] for r in rows if r[1] == lang}, key=lambda s: s.encode())

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        q = shares(sum((n[lang, s] for s in sources), Counter()))
        p = {s: shares(n[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -x, i + 1) for i, (x, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -x, i + 1) for i, (x, _, t) in enumerate(terms[:top])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("sizes", [(2048, 8, 32), (3, 2, 2), (1, 1, 1)])
def test_divergence(spark, sizes):
    rnd = random.Random(3)
    rows = [(i, t, rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "c", "d", "é", None])) for i, t in enumerate(texts(1, 120))]
    rows += ODD + [(950, "rare words only", "fr", "a"), (951, "", "fr", "b"), (952, None, "it", "a")]
    chunk, span, block = sizes
    assert rows_of(divergence.divergence(docs(spark, rows), 10, 3, chunk, span, block)) == divergence_brute(rows, 10, 3)


def test_divergence_empty(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0


def test_shares():
    """Long division agrees with Python's integers, for large counts too."""
    rnd = random.Random(1)
    total = np.array([[rnd.randint(10, 10**15)] for _ in range(200)], np.int64)
    counts = np.array([[rnd.randint(0, int(t[0]) - 4)] for t in total], np.int64)
    assert divergence._shares(counts, total)[:, 0].tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(counts[:, 0], total[:, 0], strict=True)]


def test_divergence_flush(spark, monkeypatch):
    """Counts handed on in portions add up."""
    monkeypatch.setattr(divergence, "HELD", 3)
    batches = list(divergence._count(iter([_batch([("en", "a", "b c d e f"), ("en", "a", "b c"), ("en", "b", None)])])))
    got = {}
    for b in batches:
        for lang, source, term, seen, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            old = got.get((source, term), (0, 0))
            got[source, term] = (old[0] + seen, old[1] + n)
    assert len(batches) > 2 and got[("a", b"b")] == (2, 2) and got[("a", b"e")] == (1, 1) and got[("b", b"")] == (0, 0)


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])


# 12
def contamination_brute(rows, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, t, *_ in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= {str(x) for x in windows[tuple(w[i : i + n])] if x is not None}
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("size, k", [(10, 5), (4, 2), (3, 3), (3, 1)])
def test_decontamination(spark, size, k):
    """Every shared span of `size` words is found, spans in runs of equal words and items shorter than a window too."""
    rnd = random.Random(size)
    pieces = texts(5, 60, 1, 25)
    items = [(i, p) for i, p in enumerate(pieces[:40])] + [(7, pieces[50]), (None, pieces[51]), (41, None), (42, " -- "), (43, "same same same same same same same same same same same same"), (44, "Éa x"), (45, "the")]
    rows = [(i, t + rnd.choice(pieces) + rnd.choice(texts(i, 1)), "en", "a") for i, t in enumerate(texts(6, 80, 0, 15))]
    rows += [*ODD, (905, "same " * 3000, "en", "b"), (906, "no.hit-here2", "en", None)] + rows[:3]
    bench = spark.createDataFrame([(*r, "x", {"k": 1}) for r in items], "item_id long, text string, `a.b` string, set map<string,int>")
    assert rows_of(decontaminate.contamination(docs(spark, rows), bench, size, k)) == contamination_brute(rows, items, size)
    without = [(i, t) for i, t in items if len(re.findall(r"\w+", t or "")) >= size]
    bench = spark.createDataFrame(without, "item_id long, text string")
    assert rows_of(decontaminate.contamination(docs(spark, rows), bench, size, k)) == contamination_brute(rows, without, size)


def test_decontamination_empty(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, ODD), nothing).collect()
    assert len(got) == len(ODD) and not any(r.contaminated or r.n_items for r in got)
    assert decontaminate.contamination(docs(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_decontamination_joined(spark):
    """The same rows where no side may be broadcast."""
    rows = [(i, t, "en", "a") for i, t in enumerate(texts(8, 40))] * 2
    items = [(i, t) for i, (_, t, _, _) in enumerate(rows[:20])]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))) == contamination_brute(rows, items, 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# 13
def interactions_brute(rows, marks):
    first = {}
    for doc, t, *_ in rows:
        if doc is not None:
            first[t or ""] = min(first.get(t or "", doc), doc)
    seen = []
    for doc, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc is not None and doc > first[t]}
        seen.append((lang or "", {f for f, x in fails.items() if x}, any(d == doc and q == 1 for d, q, _ in marks if d is not None), any(d == doc and x == 1 for d, _, x in marks if d is not None)))
    out = []
    for part in {r[0] for r in seen}:
        mine = [r for r in seen if r[0] == part]
        made = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                made.append((part, "".join(order), i + 1, len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        for r in made:
            out.append((*r[:9], sum(x[4] for x in made if x[9] == r[9])))
    return sorted(map(repr, out))


def test_interactions(spark):
    rnd = random.Random(9)
    rows = [(i, t * rnd.choice([1, 1, 6]) + rnd.choice(["", "#", "ABCDEFGH " * 20]), rnd.choice(["en", "de", None, ""]), "a") for i, t in enumerate(texts(10, 60))]
    rows += ODD + [(200 + i, rows[i % 5][1], "en", "b") for i in range(20)] + rows[:2]
    marks = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert rows_of(interactions.steps(interactions.flagged(docs(spark, rows), labels), "ABCDE")) == interactions_brute(rows, marks)


def test_interactions_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.steps(interactions.flagged(docs(spark, []), labels), "ABCDE").count() == 0
    with pytest.raises(ValueError):
        interactions.steps(docs(spark, []), "")


# names
def _stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


NAMED = {
    "secrets": lambda s, d: secrets.scan(d).drop("found"),
    "repeat": lambda s, d: mixing.repeat(d, (1,), 2.0, 2.0),
    "lines": lambda s, d: linededup.dedup_lines(d).drop("n_lines", "n_dropped", "kept"),
    "lines_joined": lambda s, d: linededup.dedup_lines(d, broadcast_bytes=0).drop("n_lines", "n_dropped", "kept"),
    "line_stage": lambda s, d: _stage("line_dedup")(s, d, ""),
    "near_stage": lambda s, d: _stage("near_dedup")(s, d, ""),
    "mixing_stage": lambda s, d: _stage("mixing")(s, d, ""),
}


@pytest.mark.parametrize("name", sorted(NAMED))
def test_any_names(spark, name):
    """Columns with dots, of maps, and with names that operators use inside pass through as they are."""
    rows = [(i, t, "en", "a") for i, t in enumerate(["one two three four five six seven", "a secret: token=abcdef123", "lines\nof\nwater", None, "one two three four five six seven"])]
    df = docs(spark, rows)
    got = NAMED[name](spark, df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.select(*(f"`{c}`" for c in CLASH if c != "m")).collect()} == {("dot", "c", "s", "r")}
    assert {r[0]["k"] for r in got.select("m").collect()} == {1} and got.count() == {"near_stage": 4, "repeat": 10}.get(name, got.count()) > 0
