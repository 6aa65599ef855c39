"""The ten operators and the pipeline on small tables: nulls, empty and long texts, ties, repeats, extra columns; brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph.llm import hamming, langid, linededup, mixing, neardup, packing, quality, queries, secrets, vectors, warc
from rillgraph.llm import _common

TABLES = "documents embeddings pages labels conversations benchmark".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string, length string, key string, node string"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns of clashing names."""
    return spark.createDataFrame([(*r, None, "x", "y", "z", "w") for r in rows], DOCS)


LONG = "lorem ipsum dolor " * 6000
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", "b"), (5, LONG, "en", "b"), (6, LONG, "en", None), (6, LONG, "en", None), (None, "no id here", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})")
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, cur.fetchall()))


# 1
def scan_brute(text):
    out = []
    for kind, pattern, group, least in (("assign", "((?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + "))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets(spark, odd, empty):
    texts = ["é password: token: abcdefgh", "PASSWORD='abcdef' 😀 token=x api_key = 0123456789abcdef01234567", "AKIA" + "A" * 16 + " " + "f" * 23, "secret=short secret=longer.one", "passwd:" * 3 + "abcdefg"]
    df = docs(spark, [(50 + i, t, None, None) for i, t in enumerate(texts)]).unionAll(odd)
    for r in secrets.digest(secrets.scan(df.select("doc_id", "text", "length"))).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.base_sha256 == hashlib.sha256(scan_brute(r.text).encode()).hexdigest(), r
    assert secrets.scan(empty).count() == 0
    assert secrets.trigram_query("[0-9a-f]{24,}") is True
    assert secrets.trigrams(secrets.trigram_query("AKIA[A-Z]+")) == {"aki", "kia"}


# 2
def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 8))
    x = np.concatenate([base, base + 0.1 * rng.standard_normal((30, 8)), base[:5]])
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(100, None, "x"), (101, [0.0] * 8, "x"), (102, [float("nan")] + [1.0] * 7, "x"), (103, [], "x"), (104, [1.0, None] + [1.0] * 6, "x"), (105, [1.0, 2.0], "x")]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert {i: got[i].n_links for i in range(len(u))} == dict(enumerate(hit.sum(1).tolist()))
    root = list(range(len(u)))
    for _ in range(len(u)):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(hit[i]))]) for i in range(len(u))]
    assert [got[i].component_id for i in range(len(u))] == root
    assert all(got[i].n_links == 0 and got[i].kept for i in range(100, 106))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_recall(spark):
    """With many cells, pairs at .9 and above are found; measured against brute force."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    x[1000:] = x[:1000] + rng.uniform(0.05, 0.47, (1000, 1)) * rng.standard_normal((1000, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in vectors.near_vectors(df, cell=20).collect())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = int(((u @ u.T >= 0.9).sum() - len(u)))
    assert got <= want and got >= 0.98 * want


@pytest.mark.parametrize("region", [vectors.REGION, 500])
def test_vectors_dense_group(spark, region):
    """Every link of a dense group among thousands of others is found, in one region and in many."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64))
    x[::3] = 8 * rng.standard_normal(64) / 8**0.5 + 0.82 * rng.standard_normal((2000, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, cell=20, region=region).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert want[::3].mean() > 1000 and [got[i][0] for i in range(len(u))] == want.tolist()
    assert [got[i][1] for i in range(len(u))] == [0 if i % 3 == 0 else i for i in range(len(u))]


def test_vectors_lengths(spark):
    """One vector of another length, and one without an id, leave the cells of the others as they are."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x[1500:] = x[:1500] + 0.2 * rng.standard_normal((1500, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, [1.0, 2.0]), (None, [float(v) for v in x[0]])]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=10, region=300).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    want = (hit.sum(1) - 1 + hit[:, 0]).tolist()
    assert [got[i] for i in range(3000)] == want and got[9000] == 0 and got[None] == want[0]


def test_vectors_products():
    """Cells leave a small part of all pairs of clustered vectors to compare, and lose none that links; in random directions all remain."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(40, 32))
    x = (centre[:, None] + 0.12 * rng.normal(size=(40, 50, 32))).reshape(-1, 32)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(2000)]
    c = vectors.centres(x, 40)
    home = (x @ c.T).argmax(1)
    met = np.zeros((2000, 2000), np.int8)
    for rows, side in vectors.products(x, home, home, c, 0.9, 128):
        assert len(rows) <= 128 and len(side) <= 128
        met[np.ix_(rows, side)] += 1
    assert met.max() == 1 and (met[(x @ x.T) >= 0.9] == 1).all()
    assert met.sum() < 0.1 * met.size
    whole = sum(len(a) * len(b) for a, b in vectors.products(x, home, np.zeros(2000, int), None, 0.9, 128))
    assert whole == met.size
    assert list(vectors.products(x[:0], home[:0], home, c, 0.9)) == []


def test_vectors_visits():
    """No pair at the threshold lies in regions that do not meet, and groups far apart do not meet."""
    rng = np.random.default_rng(4)
    groups = 3 * np.eye(64)[np.arange(3000) % 30] + 0.1 * rng.standard_normal((3000, 64))
    u = groups / np.linalg.norm(groups, axis=1)[:, None]
    c = vectors.centres(u, 30)
    own, met = vectors.regions_met(u, c, np.arange(30), 0.9)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    assert (met[i, own[j]] | met[j, own[i]]).all() and not (met[i, own[j]] & met[j, own[i]])[own[i] != own[j]].any()
    assert met.mean() < 0.2


# 3
def test_mixing(spark, odd, empty):
    out = mixing.mix(odd).collect()
    assert len(out) == len(ODD) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert mixing.mix(empty).count() == 0
    many = docs(spark, [(i, "w " * (1 + i % 9), None, f"s{i % 4}" if i % 4 else None) for i in range(800)])
    got = mixing.mix(many).collect()
    by = {}
    for r in got:
        by.setdefault((r.source, r.source_size, r.target), []).append(r.taken)
    total = sum(s for _, s, _ in by)
    assert sum(t for *_, t in by) == pytest.approx(1.5 * total)
    assert all(abs(sum(v) - t) <= 9 for (_, _, t), v in by.items())
    assert mixing.repeat(many).count() == sum(1 for r in got for _ in range(r.taken // max(r["size"], 1)))
    assert mixing.repeat(many).columns == many.columns


@pytest.mark.parametrize("window", [mixing.WINDOW, 10])
def test_mixing_ties(spark, window):
    """Equal rows and null ids come near their target too."""
    d = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 600, "x").otherwise("y").alias("source"))
    got = mixing.mix(d, window=window).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(got) == 2 and all(abs(r.t - r.target) <= 4 for r in got)


def test_quality_votes():
    """The vote against brute force, ties by the sample's order."""
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcdeXYZ!"), 5)) for _ in range(30)) for _ in range(60)]
    texts += [texts[0]] * 40
    labels = np.array([i % 2 for i in range(100)])
    model = quality.train(np.sqrt(np.array([quality.terms(t) for t in texts])), labels, 8)
    x = np.array([quality.terms(t) for t in texts[:20]])
    got = quality.votes(model, x)
    for i in range(20):
        v = np.sqrt(x[i]) * model.idf
        v = (v / np.linalg.norm(v)) @ model.projection
        v /= np.linalg.norm(v)
        cos = [round(float(c), 6) for c in model.vectors @ v]
        near = sorted(range(100), key=lambda j: (-cos[j], j))[: quality.NEIGHBOURS]
        w = [max(cos[j], 0) ** quality.SHARPNESS for j in near]
        assert got[i] == pytest.approx(sum(a * labels[j] for a, j in zip(w, near, strict=True)) / sum(w), abs=1e-4)
    assert quality.votes(model, np.zeros((1, quality.TERMS)))[0] == 0


def test_langid_kernel():
    """Kernel, landmarks and ridge regression written out on a tiny corpus; ties go to the first language."""
    texts = ["aba abba", "abab aab", "xyx yxx", "xyyx xx", "aab xy", "bba yx"]
    langs = ["a", "a", "b", "b", "a", "b"]
    sets = [langid.grams(t) for t in texts]
    model = langid.train(sets, langs, landmarks=2)
    kernel = lambda p, q: len(set(p.tolist()) & set(q.tolist())) / np.sqrt(len(p) * len(q))
    marks = [sets[0], sets[1], sets[2], sets[3]]
    own = np.array([[kernel(p, q) for q in marks] for p in marks])
    value, vector = np.linalg.eigh(own)
    whiten = vector / np.sqrt(value)
    features = np.array([[kernel(p, q) for q in marks] for p in sets]) @ whiten
    y = np.array([[lang == n for n in "ab"] for lang in langs], float)
    w = (y / y.sum(0)).sum(1)
    solved = np.linalg.solve(features.T @ (features * w[:, None]) + langid.RIDGE * w.mean() * np.eye(4), features.T @ (y * w[:, None]))
    assert model.languages == ["a", "b"]
    assert np.allclose(langid.values(model, texts), features @ solved, atol=1e-4)


# 4, 5
def test_classifiers(spark, odd, empty):
    sf = "/root/testdata/sf0.01"  # the smallest tables have 19 held-out labels
    d, labels = _common.table(spark, sf, "documents"), _common.table(spark, sf, "labels")
    out = quality.classify(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.0}
    model = quality.fit(d, labels)
    assert [r.score for r in quality.score(odd, model).filter("doc_id in (1, 2)").collect()] == [0.0, 0.0]
    pred = {r.doc_id: r.lang_pred for r in langid.predict(odd, langid.fit(d)).collect()}
    assert pred[1] == pred[2] == pred[3] == "und" and pred[4] != "und"
    assert langid.identify(empty).count() == 0 and quality.classify(empty, labels).count() == 0


# 6
def test_warc(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u 2", None), (4, None, ""), (5, "u5", "é" * 50000), (6, "u6", "same"), (6, "u6", "same"), (None, "n", "other")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = _common.fresh_path(spark, "test-warc")
    warc.write(pages, folder, roll_bytes=200)
    got = warc.read(spark, folder).collect()
    assert sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got)) == [(0, 5, "response", 0), (1, 4, "response", 0), (2, 0, "response", 0), (3, 4, "revisit", 1), (4, 0, "revisit", 2), (5, 100000, "response", 0), (6, 4, "revisit", 1), (6, 4, "revisit", 1)]
    assert {bytes(r.payload) for r in got if r.page_id == 5} == {("é" * 50000).encode()}
    small = _common.fresh_path(spark, "test-warc")
    warc.write(pages, small, min_bytes=100)
    assert {r.record_type for r in warc.read(spark, small).collect()} == {"response"}
    none = _common.fresh_path(spark, "test-warc")
    warc.write(pages.limit(0), none)
    assert warc.read(spark, none).count() == 0


def test_warc_twice(spark):
    """Two runs are equal byte by byte, whatever the partitions; record ids differ, ids may repeat."""
    import pathlib

    rows = [(i % 90, f"u{i}", f"page {i % 40} " * 9000) for i in range(200)] + [(7, "u", "same")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def files(df):
        folder = _common.fresh_path(spark, "test-warc")
        warc.write(df, folder, roll_bytes=4000)
        return {p.name: p.read_bytes() for p in pathlib.Path(folder.removeprefix("file://")).glob("*.warc.gz")}, folder

    one, folder = files(pages.repartition(3))
    two, _ = files(pages.orderBy(F.desc("url")).coalesce(1))
    assert one == two and len({n.split("-")[1] for n in one}) > 1
    assert warc.read(spark, folder).count() == 203
    ids = [line for c in one.values() for line in __import__("gzip").decompress(c).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == 203


# 7
def test_hamming(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 64))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(1000, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    got = {}
    for r in hamming.top_k(df, df.filter("vec_id % 50 = 0"), 7, shard=150).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    bits = x > 0
    for q in range(0, 600, 50):
        d = (bits != bits[q]).sum(1)
        want = sorted((int(v), i) for i, v in enumerate(d))[:7]
        assert [(d_, i) for _, d_, i in sorted(got[q])] == want
    assert hamming.top_k(df.limit(0), df.limit(0)).count() == hamming.top_k(df, df.limit(0)).count() == hamming.top_k(df.limit(0), df).count() == 0
    wide = spark.createDataFrame([(i, [1.0] * 64 + [1.0 if b == i else -1.0 for b in range(8)]) for i in range(5)] + [(9, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.distance) for r in hamming.top_k(wide, wide.filter("vec_id = 3"), 6).collect()} == {(3, 0), (9, 1), (0, 2), (1, 2), (2, 2), (4, 2)}


# 8
def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["The CAT'S sat.", "naïve café — “quotes” … 东京 don't", "a b\x1cc d", "<|endoftext|> x <|ENDOFTEXT|>", "x-. y.'s 3.14!", "É" * 3 + " é", "word, word; word's (word)"]
    df = docs(spark, [(10 + i, x, None, None) for i, x in enumerate(texts)]).unionAll(odd.filter("doc_id is not null and doc_id <> 6"))
    want = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in df.select("doc_id", "text").collect()}
    rows = packing.pack(df, packing.public_words(), size=64, open_windows=3).collect()
    for doc, ids in want.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and at & (at - 1) == 0
    assert packing.pack(empty, packing.public_words()).count() == 0
    assert packing.pack(odd, packing.public_words()).filter("doc_id = 6").select("sequence_id").distinct().count() > 1


# 9
def test_near_duplicates(spark, odd, empty):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for g in range(12):
        base = list(rng.choice(words, 40 + 10 * g))
        for c in range(8):
            copy = list(base)
            for _ in range(c):
                copy[rng.integers(len(copy))] = words[rng.integers(400)]
            rows.append((len(rows), " ".join(copy), None, None))
    rows.append((len(rows), " ".join(base).upper(), None, None))
    n = 3
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, rows), n=n).collect()}

    def grams(text):
        w = text.lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))
    hit = [[j for j in range(len(rows)) if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(rows))]
    for _ in range(20):
        root = [min([root[i], *(root[j] for j in hit[i])]) for i in range(len(rows))]
    assert [got[i].component_id for i in range(len(rows))] == root
    assert [got[i].n_shingles for i in range(len(rows))] == [len(s) for s in sets]
    odd_got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(odd, n=2).collect()}
    assert odd_got[1] == (0, 1) and odd_got[3] == (0, 3) and odd_got[4] == (1, 4) and odd_got[6] == (3, 5)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_null_ids(spark):
    base = [f"w{i}" for i in range(50)]
    rows = [(3, " ".join(base), None, None), (None, " ".join([*base, "more"]), None, None), (None, "alone here now", None, None), (8, "x", None, None)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows), n=2).collect()}
    assert got == {(3, 49): (3, True), (None, 50): (3, False), (None, 2): (None, True), (8, 1): (8, True)}


def test_near_duplicates_large_groups(spark, monkeypatch):
    """Blocks and families smaller than the groups give the same components."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "CHUNK", 3)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 300, 60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(int(rng.integers(0, 6))):
            copy[rng.integers(60)] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(copy), None, None))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), n=2).collect()}
    sets = [{*zip(r[1].split(), r[1].split()[1:], strict=False)} for r in rows]
    root = list(range(60))
    for _ in range(30):
        root = [min(root[j] for j in range(60) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(60)]
    assert [got[i] for i in range(60)] == root


# 10
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup(spark, odd, empty, limit):
    rows = [(i, f"Shared line \nown {i}\n\n\tSHARED LINE" if i % 2 else f"own {i}", None, None) for i in range(10)]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in linededup.dedup_lines(df, min_docs=5, broadcast_bytes=limit).collect()}
    assert all(got[i].kept == (f"own {i}\n" if i % 2 else f"own {i}") and got[i].n_dropped == (2 if i % 2 else 0) for i in range(10))
    assert [(r.doc_id, r.n_lines) for r in linededup.dedup_lines(odd, broadcast_bytes=limit).filter("doc_id in (1, 2)").orderBy("doc_id").collect()] == [(1, 1), (2, 1)]
    assert linededup.dedup_lines(empty, broadcast_bytes=limit).count() == 0


def test_line_runs(spark):
    runs = linededup.LineRuns(spark, fan_in=2)
    for b in range(5):
        batch = docs(spark, [(b, f"line {b}\nline {b + 1}", None, None)])
        keys = linededup.line_keys(batch.select(F.lit(0).alias("batch"), "text"))
        assert runs.unseen(keys).count() == (2 if b == 0 else 1)
        assert runs.unseen(keys, "left_semi").count() == (0 if b == 0 else 1)
        runs.add(batch)
    assert sum(map(len, runs.levels)) == 2 and runs.all().agg(F.sum("docs")).first()[0] == 10
    assert runs.frequent(2).count() == 4 and runs.frequent(3).count() == 0


@pytest.mark.parametrize("batches", [2, 4])
def test_line_batches(spark, sf, batches):
    """Several batches give what one gives."""
    d = _common.table(spark, sf, "documents").select("doc_id", "text")
    of = lambda n: sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(d, min_docs=5, batches=n, fan_in=2).collect())
    assert of(batches) == of(1)


# the pipeline
def test_pipeline(spark, sf):
    import corpus_pipeline

    d = _common.table(spark, sf, "documents")
    columns = d.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d, _ = _common.written(stage(spark, d, sf), f"test-{name}")
        assert d.columns == columns, name
        kept.append(d)
    labels = {r.doc_id: r.quality for r in _common.table(spark, sf, "labels").collect()}
    good, lines, near, mixed = kept
    ids = {r.doc_id for r in good.collect()}
    assert sum(labels[i] == 1 for i in ids if i in labels) >= 0.95 * sum(labels.values())
    assert lines.count() == len(ids)
    keys = {}
    for r in good.collect():
        for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in r.text.split("\n")} - {""}:
            keys[k] = keys.get(k, 0) + 1
    for r in lines.collect():
        assert all(keys.get(x.strip(" \t\n\x0b\x0c\r").lower(), 0) < 10 for x in r.text.split("\n") if x.strip())
    assert near.count() == near.select("doc_id").distinct().count() <= len(ids)
    assert set(r.doc_id for r in mixed.collect()) <= set(r.doc_id for r in near.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, mixed, sf)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).join(mixed.groupBy("doc_id").count(), "doc_id")
    assert whole.filter("n <> t * count").count() == 0
    assert corpus_pipeline.near_stage(spark, docs(spark, ODD), sf).count() < len(ODD)


def test_stage_columns(spark, sf):
    """Columns that have the names of an operator's results pass through the stages."""
    import corpus_pipeline

    d = _common.table(spark, sf, "documents")
    for name in ("score", "predicted", "kept", "n_lines", "n_dropped", "row", "found", "key"):
        d = d.withColumn(name, F.col("doc_id") + 1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d, _ = _common.written(stage(spark, d, sf), f"test-{name}")
    assert d.count() > 0 and d.filter("kept <> doc_id + 1 or score <> doc_id + 1").count() == 0


def test_near_stage_rows(spark, sf):
    """One row of each group stays, whatever the ids: repeated with other texts, or null."""
    import corpus_pipeline

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(5, a, "en", "x"), (5, b, "en", "x"), (3, b, "en", "x"), (None, c, "en", "x"), (None, c, "en", "x"), (None, c + " more", "en", "x"), (7, d, "en", "x"), (None, d, "en", "x")]
    rows += [(9, e, "en", s) for s in "stuv"] + [(9, "", "en", "x"), (8, None, "en", "x"), (None, "", "en", "x")]
    df = docs(spark, rows)

    def kept(table):
        return sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.near_stage(spark, table, sf).collect()), key=repr)

    one = kept(df.repartition(1))
    assert one == kept(df.orderBy(F.desc("source"), F.desc("text")).coalesce(1)) == kept(df.repartition(5))
    known = [r for r in one if r[1] not in (e, c, c + " more")]
    assert known == sorted([(5, a, "x"), (3, b, "x"), (7, d, "x"), (9, "", "x"), (8, None, "x"), (None, "", "x")], key=repr)
    assert sum(r[1] == e for r in one) == 1 and sum(r[1] in (c, c + " more") for r in one) == 1
