"""Joins, neighbour graphs and the pipeline, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraloom.llm import ngram_join, nn_descent, packing, pii, quality
from terraloom.llm.common import components, written

SF = "/root/testdata/sf0.001"


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        parent[root(a)] = root(b)
    return root


def brute_groups(docs, k, num, den):
    """docs: (id, text) rows -> list of (id, set size, component)."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    where = defaultdict(list)
    links = []
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in where[g])
        links += [(i, j) for j, n in common.items() if den * n >= num * (len(s) + len(sets[j]) - n)]
        for g in s:
            where[g].append(i)
    root = union(links, range(len(docs)))
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [(key, len(sets[i]), (least.get(root(i)) if sets[i] else key)) for i, (key, _) in enumerate(docs)]


def corpus(rng, groups=(30, 12, 5, 2, 2), alone=60):
    """Near copies with many borderline similarities, shared passages, odd documents."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for size in groups:
        base = [word() for _ in range(rng.randrange(80, 260))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    for _ in range(alone):
        w = [word() for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + passage + w[at:]) if rng.random() < 0.6 else "\n".join(w))
    texts += texts[:6] + [None, "", " \n", "one", "One", "one two", None, texts[0].upper()]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True))
    return docs + [docs[0], (None, texts[0]), (None, "alone without an id " * 3), (docs[3][0], "another text under a used id")]


def frame(spark, docs):
    """With clashing extra columns, over several partitions."""
    return spark.createDataFrame([(i, t, None, 7, "a") for i, t in docs], "doc_id long, text string, fp long, n int, token string").repartition(5)


def test_jaccard_groups_match_brute_force(spark):
    for seed, (k, num, den) in enumerate([(3, 90, 100), (5, 80, 100), (3, 70, 100)]):
        docs = corpus(random.Random(seed))
        got = sorted((map(tuple, ngram_join.jaccard_groups(frame(spark, docs), words=k, num=num, den=den).collect())), key=str)
        assert got == sorted(brute_groups(docs, k, num, den), key=str), (k, num)


def test_jaccard_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 500)
    docs = corpus(random.Random(11), groups=(60, 25))
    got = sorted(map(tuple, ngram_join.jaccard_groups(frame(spark, docs), words=3, num=90, den=100).collect()), key=str)
    assert got == sorted(brute_groups(docs, 3, 90, 100), key=str)


def test_jaccard_empty_and_driver_tables(spark):
    assert ngram_join.jaccard_groups(frame(spark, [(1, "x")]).limit(0)).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, ngram_join.op7_ngram_join(spark, SF).collect()))
    assert got == sorted(brute_groups(docs, 3, 90, 100))


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + i, 5000 + rng.randrange(200)) for i in range(200)]
    pairs += pairs[:50] + [(3, 3), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    nodes = {x for p in real for x in p}
    root = union(real, nodes)
    least = {}
    for n in nodes:
        least[root(n)] = min(least.get(root(n), n), n)
    assert got == {n: least[root(n)] for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 16))
    dense = base[0] + 0.25 * rng.normal(size=(90, 16))  # a region with cosines around the threshold
    chain = np.stack([base[1] * np.cos(a) + base[2] * np.sin(a) for a in np.linspace(0, 1.2, 9)])
    x = np.concatenate([base, dense, chain, base[5:8] + 0.02, base[:3], 1e20 * base[9:10], np.zeros((1, 16))]).astype("float32")
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None], 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [1.0, 2.0], 1), (n + 5, [2.0, 4.0], 1), (3, rows[3][1], 1), (None, rows[4][1], 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int").repartition(4)
    got = nn_descent.near_duplicates(df).collect()
    vec = [(i, None if v is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, "float32").astype(float)) for i, v, _ in rows]
    links, degree = [], [0] * len(vec)
    for a in range(len(vec)):
        for b in range(a):
            u, v = vec[a][1], vec[b][1]
            if u is not None and v is not None and len(u) == len(v) and (u / abs(u).max()) @ (v / abs(v).max()) >= 0.9 * np.linalg.norm(u / abs(u).max()) * np.linalg.norm(v / abs(v).max()):
                links.append((a, b))
                degree[a] += 1
                degree[b] += 1
    root = union(links, range(len(vec)))
    least = {}
    for a, (key, _) in enumerate(vec):
        if key is not None:
            least[root(a)] = min(least.get(root(a), key), key)
    want = [(key, degree[a], least.get(root(a)), key is not None and least[root(a)] == key) for a, (key, _) in enumerate(vec)]
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert got[0]["audit_recall"] >= 0.9
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0
    assert nn_descent.near_duplicates(df.filter("vec_id = 3")).first()["n_links"] == 1


def linked_groups(rng, pairs, size=20, width=64):
    """Pairs of groups of close copies (cosines about 0.999) whose cross cosines are 0.92 to 0.93."""
    out = []
    for _ in range(pairs):
        q, _ = np.linalg.qr(rng.normal(size=(width, 2)))
        for at in (0.0, np.arccos(0.926)):
            x = q[:, 0] * np.cos(at) + q[:, 1] * np.sin(at)
            out.append(x + 0.003 * rng.normal(size=(size, width)) / np.sqrt(width) * 8)
    return np.concatenate(out)


def brute_vectors(x):
    """(links, component) of each row, by all pairs."""
    u = x.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    root = union(zip(*map(list, np.nonzero(hit)), strict=True), range(len(x)))
    least = {}
    for i in range(len(x)):
        least[root(i)] = min(least.get(root(i), i), i)
    return {i: (int(hit[i].sum()), least[root(i)]) for i in range(len(x))}


def near(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype("float32"))], "vec_id long, embedding array<float>").repartition(4)
    return nn_descent.near_duplicates(df).collect()


def test_near_duplicates_beyond_full_lists(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "AUDIT", 4)  # the audit alone does not find the links
    rng = np.random.default_rng(4)
    x = np.concatenate([linked_groups(rng, 30), rng.normal(size=(300, 64))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near(spark, x)}
    want = brute_vectors(x)
    assert want[0] == (39, 0) and want[20] == (39, 0)
    assert got == want


def test_audit_counts_true_links_and_adds_none(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base, base[:12] + 0.05 * rng.normal(size=(12, 32))])  # sparse copies
    want = brute_vectors(x)
    monkeypatch.setattr(nn_descent, "AUDIT", 20)
    df = spark.createDataFrame([(i, v.astype("float32").tobytes()) for i, v in enumerate(x)], "node long, vec binary")
    assert nn_descent._audit(df, "<f4", 0.9).count() >= 20
    got = near(spark, x)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and got[0]["audit_recall"] == 1.0
    monkeypatch.setattr(nn_descent, "ASKED", 64)
    assert nn_descent._audit(df, "<f4", 0.9).select("node").distinct().count() <= 64


def test_near_duplicates_when_the_graph_finds_nothing(spark, monkeypatch):
    """The exact way after the last attempt: all nodes in blocks, here of few rows."""
    rng = np.random.default_rng(8)
    x = np.concatenate([linked_groups(rng, 8), rng.normal(size=(200, 64))])
    monkeypatch.setattr(nn_descent, "ATTEMPTS", 1)
    monkeypatch.setattr(nn_descent, "BLOCK", 32)

    def nothing(nodes, *_):
        none = written(nodes.sparkSession.createDataFrame([], nn_descent.EDGE))
        return none, written(none)

    monkeypatch.setattr(nn_descent, "_start", nothing)
    got = near(spark, x)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_vectors(x) and got[0]["audit_recall"] == 1.0


@pytest.mark.parametrize("block", [16, 1024])
def test_near_duplicates_of_thousands_with_many_links(spark, monkeypatch, block):
    """Chains, dense groups and pairs: 2,600 vectors and thousands of links; the audit sees
    one of them, regions are dealt to few or many blocks."""
    monkeypatch.setattr(nn_descent, "AUDIT", 1)
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rng = np.random.default_rng(9)
    turn, _ = np.linalg.qr(rng.normal(size=(32, 32)))
    chain = []
    for k in range(0, 30, 2):  # a long chain that turns from axis to axis
        for a in np.linspace(0, np.pi / 2, 30)[:-1]:
            chain.append(turn[k] * np.cos(a) + turn[k + 1] * np.sin(a))
        for a in np.linspace(0, np.pi / 2, 30)[:-1]:
            chain.append(turn[k + 1] * np.cos(a) + turn[(k + 2) % 32] * np.sin(a))
    base = rng.normal(size=(1300, 32))
    dense = base[0] + 0.2 * rng.normal(size=(200, 32))
    x = np.concatenate([base, dense, chain, base[5:80] + 0.1 * rng.normal(size=(75, 32)), base[100:160]])
    want = brute_vectors(x)
    assert sum(n for n, _ in want.values()) > 10_000
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near(spark, x)}
    assert got == want


def test_pipeline_stages_match_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, t, "en", "s", len(t or "")) for i, t in corpus(rng, alone=30)]
    docs += [(900, "mail a@b.co and 1.2.3.4 " + " ".join(f"w{i}" for i in range(80)), None, None, None), (901, "spam " * 100, "en", "s", 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    (_, rules), (_, near), (_, mask), (_, pack) = corpus_pipeline.STAGES

    kept = written(rules(spark, df, SF))
    trees = quality.train(df, spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = Counter((r["doc_id"], r["n_words"]) for r in quality.rate(df, trees).filter("kept").collect())
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in kept.collect()) == verdict
    assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.filter("doc_id = 901").count() == 0 and kept.filter("doc_id = 900").count() == 1

    one = written(near(spark, kept, SF))
    groups = brute_groups([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80, 100)
    stays = {g for k, _, g in groups if k is not None}
    assert {r["doc_id"] for r in one.collect() if r["doc_id"] is not None} == stays
    assert one.groupBy("doc_id", "text").count().filter("length(trim(text)) > 0 AND count > 1").count() == 0
    assert one.columns == list(corpus_pipeline.COLUMNS)

    clean = written(mask(spark, one, SF))
    assert clean.count() == one.count() and clean.columns == list(corpus_pipeline.COLUMNS)
    assert pii.detect(clean).filter(F.size("pii") > 0).count() == 0
    assert clean.filter("doc_id = 900 AND text LIKE 'mail <EMAIL> and <IP> w0%' AND n_chars = length(text)").count() == 1
    assert clean.join(one, ["doc_id", "text"]).count() >= one.filter("doc_id IS NOT NULL").count() - 1

    packed = pack(spark, clean, SF)
    assert packed.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count()
    assert packed.agg(F.sum("length")).first()[0] == packing.pack(clean.repartition(1)).agg(F.sum("length")).first()[0]


def test_near_duplicates_are_told_apart_by_id_and_text(spark):
    words = [f"w{i}" for i in range(60)]
    a, near, other, third = " ".join(words), " ".join([*words, "x"]), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    texts = [(1, a), (1, a), (2, near), (2, other), (3, near), (None, a), (None, third), (None, third), (None, None), (4, None), (5, " "), (5, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a), (2, other), (None, third), (None, None), (4, None), (5, " "), (5, " ")], key=str)


def test_pipeline_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
    assert docs.count() == 0
