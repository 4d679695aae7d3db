"""Operators 4 and 8, and connected components, against brute force."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ngram_join, pq_dedup, queries
from pagewright.llm.components import components

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
key = lambda rows: sorted(map(tuple, rows), key=repr)


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(60))] + [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 520)] + [(None, 3), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {n for e in real for n in e}
    assert {r["node"]: r["component"] for r in got} == roots(nodes, real) and len(got) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(docs, threshold=0.8):
    sets = {}
    for doc, text in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, bool(w)))}
    ids = sorted(sets)
    by = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    pairs = {(a, b) for own in by.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    classes = roots(ids, links)
    n = {d: 0 for d in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return [(d, n[d], classes[d]) for d in ids]


def test_ngram_join(spark):
    got = queries.op4_ngram_join(spark, MORE).select("doc_id", "n_links", "class_id").collect()
    want = near(duckdb.sql(f"SELECT doc_id, text FROM '{MORE}/documents.parquet'").fetchall())
    assert key(got) == key(want) and sum(w[1] > 0 for w in want) > 20


def test_ngram_join_groups(spark, monkeypatch):
    """A large group of near copies, worked on in many blocks; copies; short, empty and null texts."""
    monkeypatch.setattr(ngram_join, "CHUNK_MEMBERS", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(1000)}" for _ in range(60)]
    docs = []
    for k in range(120):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(60)] = f"x{k}"
        docs.append((k, " ".join(own)))
    docs += [(200 + k, "one two") for k in range(5)] + [(300, "One, two!"), (301, "two one"), (302, ""), (303, None), (304, "..."), (305, "solo")]
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, band string")
    want = near(docs)
    assert key(ngram_join.links(frame).select("doc_id", "n_links", "class_id").collect()) == key(want)
    kept = {r["doc_id"] for r in ngram_join.deduplicate(frame).collect()}
    assert kept == {d for d, _, c in want if d == c}
    odd = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    assert key(ngram_join.links(odd).collect()) == key([(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (None, 0, None, None), (None, 0, None, None)])
    mixed = spark.createDataFrame([(5, "a b c"), (5, "x y z"), (4, "x, y z"), (4, "x, y z"), (6, "A b c"), (None, "a b c"), (7, None), (7, None)], "doc_id long, text string").withColumn("key", F.lit("k"))
    assert key(ngram_join.links(mixed).collect()) == key([(5, 1, 5, 5), (5, 1, 4, 4), (4, 1, 4, 4), (4, 1, 4, 4), (6, 1, 5, 5), (None, 0, None, None), (7, 0, 7, 7), (7, 0, 7, 7)])
    assert key((r["doc_id"], (r["text"] or "")[:1].lower()) for r in ngram_join.deduplicate(mixed).collect()) == key([(5, "a"), (4, "x"), (None, "a"), (7, ""), (7, "")])
    assert ngram_join.links(frame.limit(0)).count() == 0 and ngram_join.deduplicate(odd).count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_balls(spark, monkeypatch, seed):
    """Near copies of which most lie in a ball around the smallest, some on its edge, some out of it, and some between two balls."""
    monkeypatch.setattr(ngram_join, "CHUNK_MEMBERS", 16)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    other = [w if k % 45 else f"z{k}" for k, w in enumerate(base)]  # five words changed: near the base, and with near copies of its own
    docs = []
    for k in range(260):
        own = list(rng.choice((base, base, other)))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6, 9))):
            own[rng.randrange(200)] = rng.choice((f"x{k}", "x"))
        docs.append((rng.randrange(10**6) * 1000 + k, " ".join(own)))
    docs += [(k, " ".join(base)) for k in (5, 6)] if seed == 1 else []
    want = near(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert key(ngram_join.links(frame).select("doc_id", "n_links", "class_id").collect()) == key(want)


def test_banding():
    """Bands and rows follow from the recall and from the share of unlike pairs that may meet."""
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.9), (0.5, 0.99), (0.95, 0.999), (1.0, 0.99)):
        bands, rows = ngram_join.banding(threshold, recall)
        meet = lambda s, b, r: 1 - (1 - s**r) ** b
        assert meet(threshold, bands, rows) >= recall - 1e-12 and meet(threshold / 2, bands, rows) <= ngram_join.UNLIKE
        assert bands == 1 or meet(threshold, bands - 1, rows) < recall
        assert rows == 1 or meet(threshold / 2, math.ceil(math.log1p(-recall) / math.log1p(-min(threshold ** (rows - 1), 1 - 1e-12))), rows - 1) > ngram_join.UNLIKE
    assert ngram_join.banding(0.8, 0.9999) == (24, 5)


def test_ngrams():
    texts = ["a b c d e f", "", None, "b c d e f", "A  b", "ab", "a b c d e a b c d e", "é ü, ß!"]
    gram, own = ngram_join.ngrams(texts)
    sets = [set(gram[own == k].tolist()) for k in range(len(texts))]
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 1, 5, 1] and sets[3] < sets[0] and len(set().union(*sets)) == 9
    alone = [ngram_join.ngrams([t])[0].tolist() for t in texts]
    assert [sorted(s) for s in sets] == alone


def cosine_links(rows, threshold=0.93):
    sound = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float) / max(map(abs, v))
        sound.append((i, x / np.sqrt((x**2).sum()), label))
    links = []
    for label in {s[2] for s in sound}:
        own = [s for s in sound if s[2] == label]
        m = np.stack([s[1] for s in own])
        for a, b in zip(*np.nonzero(m @ m.T >= threshold)):
            if a < b:
                links.append((own[a][0], own[b][0]))
    ids = [r[0] for r in rows if r[0] is not None]
    classes, n = roots(ids, links), dict.fromkeys(ids, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return [(i, n[i], classes[i], i == classes[i]) for i in ids]


def clustered(rng, groups, each, noise):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=24)
        rows += [(centre + noise * rng.normal(size=24)).tolist() for _ in range(each)]
    return [(k, v, k % 3) for k, v in enumerate(rows)]


@pytest.mark.parametrize("chunk", [8, 2048])
def test_pq(spark, monkeypatch, chunk):
    monkeypatch.setattr(pq_dedup, "CHUNK", chunk)
    rows = clustered(np.random.default_rng(4), 12, 30, 0.25)
    rows += [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [None, *[1.0] * 23], 1), (1004, [1.0] * 24, None), (1005, [1e200] * 24, 2), (1006, [1e-200] * 24, 2), (1007, [], 1), (1008, [float("inf")] * 24, 1)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, list int")
    got = {r["vec_id"]: tuple(r) for r in pq_dedup.links(frame).collect()}
    want = cosine_links([r if r[1] else (r[0], None, r[2]) for r in rows])
    assert len(got) == len(want)
    found, real = sum(r[1] for r in got.values()), sum(w[1] for w in want)
    assert real > 500 and 0.9 * real <= found <= real and all(got[w[0]][1] <= w[1] for w in want)
    assert sum(got[w[0]] == tuple(w) for w in want) >= 0.9 * len(want)
    assert got[1005][1] == 1 and got[1006][2] == 1005
    odd = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert key(pq_dedup.links(odd).collect()) == key([(None, 0, None, None), (1, 0, 1, True), (1, 0, 1, True)])
    odd = spark.createDataFrame([(3, [1.0, 0.0], "x"), (3, [0.0, 1.0], "x"), (2, [0.0, 1.0], "x"), (2, [0.0, 1.0], "x"), (1, [0.0, 1.1], "y"), (4, [1.0, 0.1], "x"), (4, None, "x"), (None, [0.0, 1.0], "x")], "vec_id long, embedding array<float>, label string")
    assert key(pq_dedup.links(odd).collect()) == key([(3, 1, 3, True), (3, 1, 2, False), (2, 1, 2, True), (2, 1, 2, True), (1, 0, 1, True), (4, 1, 3, False), (4, 0, 4, True), (None, 0, None, None)])
    assert pq_dedup.links(frame.limit(0)).count() == 0


def test_pq_recall(spark):
    """The whole table of the largest scale, and the same with a planted neighbour of each vector at cosines from the threshold on."""
    path = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{path}/embeddings.parquet'").fetchall()
    rng = np.random.default_rng(11)
    x = pq_dedup.unit(np.array([r[1] for r in rows], float))
    side = rng.normal(size=x.shape)
    side = pq_dedup.unit(side - (side * x).sum(1, keepdims=True) * x)
    cosine = rng.uniform(0.931, 0.96, (len(x), 1))
    more = [*((r[0], v.tolist(), r[2]) for r, v in zip(rows, x)), *((100_000 + k, v.tolist(), r[2]) for k, (r, v) in enumerate(zip(rows, cosine * x + np.sqrt(1 - cosine**2) * side)))]
    for made, links in ((rows, queries.op8_pq_dedup(spark, path)), (more, pq_dedup.links(spark.createDataFrame(more, "vec_id long, embedding array<double>, label int")))):
        got = {r["vec_id"]: tuple(r) for r in links.collect()}
        want = cosine_links(made)
        found, real = sum(r[1] for r in got.values()), sum(w[1] for w in want)
        assert len(got) == len(made) and (made is rows or real > 3_000) and 0.98 * real <= found <= real and all(got[w[0]][1] <= w[1] for w in want)
        assert sum(got[w[0]] == tuple(w) for w in want) >= 0.98 * len(want)


def planted(rng, n, copies, noise=0.0):
    """n unit vectors of 64 dimensions, of which the first are copies of one vector, and the last 200 lie at cosines of 0.931 to 0.99 to it."""
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hot = x[0].copy()
    x[1:copies] = hot + noise * x[1:copies]
    side = x[-200:] - (x[-200:] @ hot)[:, None] * hot
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.99, (200, 1))
    x[-200:] = cosine * hot + np.sqrt(1 - cosine**2) * side
    order = rng.permutation(n)
    return x[order] / np.linalg.norm(x[order], axis=1, keepdims=True), order


def met(index, x, order, copies):
    """Share of the pairs of a planted neighbour and a copy of which one probes the other's list."""
    own = pq_dedup.nearest(x, index.centres)
    probes = index.probes(x, own)
    near, hot = np.flatnonzero(order >= len(x) - 200), np.flatnonzero(order < copies)
    there = (probes[near][:, :, None] == own[hot][None, None, :]).any(1)
    back = (probes[hot][:, :, None] == own[near][None, None, :]).any(1)
    return (there | back.T).mean()


@pytest.mark.parametrize("noise", [0.0, 0.1])
def test_pq_hot_group(noise):
    """A third of the rows are equal, or near: lists stay for the others, and all have members."""
    x, order = planted(np.random.default_rng(1), 6_000, 2_000, noise)
    index = pq_dedup.Index(x, 38)
    assert len(np.unique(pq_dedup.nearest(x, index.centres))) == len(index.centres) >= 30
    assert met(index, x, order, 2_000) >= 0.97


def test_pq_hot_links(spark):
    x, order = planted(np.random.default_rng(2), 3_000, 1_000)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.links(frame).collect()}
    want = {w[0]: w[1] for w in cosine_links(rows)}
    near = [k for k in range(3_000) if order[k] >= 2_800]
    assert sum(got[k] for k in near) >= 0.97 * sum(want[k] for k in near)
    assert all(got[k] <= n for k, n in want.items())


@pytest.mark.parametrize("lists", [22, 158, 500, 4_096])
def test_pq_probes_grow(lists):
    """Pairs at the threshold, of isotropic vectors, are met whatever the number of lists."""
    rng = np.random.default_rng(3)
    unit = pq_dedup.unit
    centres = unit(rng.normal(size=(max(2_000, 4 * lists), 64)))
    index = pq_dedup.Index.__new__(pq_dedup.Index)
    index.centres = pq_dedup.kmeans(centres, lists, 3)
    index.width = index.tuned(unit(rng.normal(size=(1_000, 64))), 0.93)
    a, side = unit(rng.normal(size=(1_000, 64))), rng.normal(size=(1_000, 64))
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side
    own = [pq_dedup.nearest(x, index.centres) for x in (a, b)]
    there, back = (index.probes(x, own[k]) == own[1 - k][:, None] for k, x in enumerate((a, b)))
    assert (there.any(1) | back.any(1)).mean() >= 0.97


def test_pq_lengths(spark):
    """Vectors of each length link among themselves, those of a rarer length and of a single pair too."""
    rng = np.random.default_rng(6)
    rows = clustered(rng, 4, 20, 0.1) + [(100 + k, (v[:10] if k % 2 else v[:10] + [0.0]), k % 2) for k, (_, v, _) in enumerate(clustered(rng, 2, 16, 0.1))]
    rows += [(300, [1.0, 2.0], 1), (301, [2.0, 4.1], 1), (302, [3.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.links(frame).collect()}
    want = {w[0]: w[1] for size in {len(r[1]) for r in rows} for w in cosine_links([r for r in rows if len(r[1]) == size])}
    assert len(got) == len(want) and all(got[k] <= n for k, n in want.items())
    for low, high in ((0, 99), (100, 199), (300, 399)):
        own = [k for k in want if low <= k <= high]
        assert sum(want[k] for k in own) > 0 and sum(got[k] for k in own) >= 0.95 * sum(want[k] for k in own)
