"""Jaccard join, near vectors, components."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import graph, jaccard_join, near_vectors, packs


def prose(rng, n, vocabulary=400):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    rows, shared = [], prose(rng, 40)
    for k in range(120):
        rows.append(prose(rng, rng.choice([1, 2, 3, 4, 6, 9, 30, 120])))
    base = prose(rng, 150)
    for k in range(60):  # near copies of one text, at all distances
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"new{rng.random()}"
        rows.append(copy)
    for k in range(40):  # a passage that many texts share
        rows.append(prose(rng, 30) + shared + prose(rng, 30))
    rows += [rows[3], rows[130], rows[130], []]
    texts = [" ".join(x) for x in rows] + ["  ", "One two\tthree four\nfive", "one TWO three FOUR five"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("percent", "n"), [(85, 4), (80, 5)])
def test_jaccard_equals_brute_force(docs, near_rows, percent, n):
    got = jaccard_join.joined(docs(near_rows), percent, n).collect()
    want = brute.jaccard(near_rows, percent, n)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want
    assert len(got) == len(near_rows)


def test_jaccard_every_boundary(docs, near_rows, monkeypatch):
    """Subsets alone, lists alone, and a boundary within the sizes find the same links."""
    want = brute.jaccard(near_rows)
    for border in (0, 100, 10**6):
        monkeypatch.setattr(jaccard_join, "_boundary", lambda sets, percent, border=border: border)
        got = jaccard_join.joined(docs(near_rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want


def test_jaccard_blocks(docs, near_rows, monkeypatch):
    """A cluster cut into many blocks gives the same links."""
    monkeypatch.setattr(jaccard_join, "BLOCK_LEAST", 7)
    got = jaccard_join.joined(docs(near_rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute.jaccard(near_rows)


def test_jaccard_odd_rows(spark, docs):
    text = " ".join(f"x{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, text), (7, text), (5, text), (5, text), (None, None), (9, "a")]
    got = jaccard_join.joined(docs(rows).withColumn("n_shingles", F.lit("clash")).withColumn("pack", F.lit(1)))
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.n_links) for r in got.collect() if r.doc_id != None or r.n_shingles)  # noqa: E711
    assert found == [(-1, 49_997, 5, 3), (1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (5, 49_997, 5, 3), (5, 49_997, 5, 3), (7, 49_997, 5, 3), (9, 1, 9, 0)]
    assert jaccard_join.joined(docs([])).collect() == []


def test_jaccard_one_id_on_two_texts(docs):
    """Classes of rows that share their least id stay apart."""
    rng = random.Random(8)
    a, b = prose(rng, 200), prose(rng, 200)
    near_a, near_b = [*a[:-2], "tail"], [*b[:-2], "end"]
    rows = [(1, a), (1, b), (2, near_b), (3, near_a)]
    got = jaccard_join.joined(docs([(i, " ".join(w)) for i, w in rows])).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_jaccard_keys_grow_with_the_sets(docs):
    """A group of long near copies beside longer texts takes list entries and not the square of them."""
    rng = random.Random(9)
    base = prose(rng, 200, 10**6)
    near = [[*base[:k], f"new{k}", *base[k + 1 :]] for k in range(0, 200, 2)]
    long = [prose(rng, 250, 3000) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(near + long)]
    sets = jaccard_join.described(docs(rows)).where("tokens IS NOT NULL").selectExpr("n", "n - ceil(n * 0.85) + 1 - lone AS first")
    assert jaccard_join._boundary(sets, 85) < 100


def test_tally_beyond_32_bits(docs):
    rows, n = packs.packed(docs([(i, f"text {i}") for i in range(40)]))
    held = rows.select("pack").distinct().count()
    key = lambda table: (np.array([5], np.uint64), np.array([5_000_000_000]))
    blobs = packs.tally(rows, n, key).toArrow()
    got = packs.counts_in_order(blobs)
    assert held > 1 and got.tolist() == [held * 5_000_000_000] * held


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    from collections import defaultdict

    links = defaultdict(set)
    for a, b in edges:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.id, r.component) for r in got) == sorted(brute.components(list(links), links).items())


def test_vectors_equal_brute_force(spark):
    random_ = np.random.default_rng(2)
    base = random_.standard_normal((60, 32))
    rows = [base[i % 60] + 0.25 * random_.standard_normal(32) * random_.random() * np.linalg.norm(base[i % 60]) / 4 for i in range(400)]
    rows += [3 * rows[0], rows[1], rows[1]]
    rows = [np.float32(r).tolist() for r in rows]
    unit = np.array(rows, np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    links = {i: {int(j) for j in np.flatnonzero(cosine[i] >= 0.9) if j != i} for i in range(len(rows))}
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_vectors.linked(df).collect()}
    found, all_ = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert found >= 0.99 * all_ and all_ > 500
    least = brute.components(list(links), links)
    assert sum(got[i].component_id == least[i] for i in links) >= 0.99 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vector_recall_near_the_threshold():
    code = near_vectors.ProductCodes(48, 12).fit(0.9)
    random_ = np.random.default_rng(9)
    x, y = random_.standard_normal((2, 3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = (set(zip(*map(np.ndarray.tolist, code.decode(v)), strict=True)) for v in (x, y))
    assert len({row for row, _ in a & b}) >= 0.985 * 3000


def test_vectors_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, n_links string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [nan, 1.0], "x")]
    rows += [(6, [inf, 1.0], "x"), (7, [None, 1.0], "x"), (8, [1.0], "x"), (None, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x")]
    got = near_vectors.linked(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True),
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True),
    ]
    assert near_vectors.linked(spark.createDataFrame([], schema)).collect() == []


def test_vectors_of_every_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (6, [1e200, 1e200]), (7, [1.0, 1.0])]
    rows += [(8, [2.0, 4.0, 6.1]), (9, [1e-200, 0.0]), (10, [3.0]), (11, [5.0]), (12, [-5.0]), (13, []), (14, [1.0, 2.0, 3.0, 4.0])]
    got = near_vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (1, 6), 7: (1, 6), 8: (2, 4), 9: (2, 1),
        10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (0, 13), 14: (0, 14),
    }
