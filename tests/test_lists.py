"""Inverted lists: training against plain Python, recall against brute force, and what a search costs."""

import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopscope.functions import vectors
from loopscope.operators import lists


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def clustered(n, centres, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dims))
    return np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 6)


def test_training_equals_plain(spark):
    x = clustered(300, 12)
    order = sorted(range(300), key=lambda i: (hashlib.md5(f"19|{i}".encode()).hexdigest(), i))
    c = x[order[:20]]
    for _ in range(3):
        near = np.round(x @ c.T, 9).argmax(1)
        new = c.copy()
        for k in range(20):
            if (near == k).any():
                s = x[near == k].sum(0)
                new[k] = np.round(s / np.linalg.norm(s), 6)
        c = new
    assert np.allclose(lists.train(frame(spark, x), 20, 3), c, atol=2e-6)


def test_recall_and_cost(spark):
    x = clustered(4000, 60, seed=1)
    df = frame(spark, x)
    index, centroids = lists.build(df, 64)
    queries = df.where("vec_id % 80 = 0")
    got = lists.search(index, centroids, queries, 10, 6).collect()
    found, cost = {}, {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        cost[r["query_id"]] = r["n_scanned"]
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-8)
    hits = 0
    for q in range(0, 4000, 80):
        s = x @ x[q]
        s[q] = -9
        hits += len(found[q] & set(np.argsort(-s)[:10].tolist()))
    assert hits / (10 * len(found)) >= 0.9 and np.mean(list(cost.values())) < 0.25 * len(x)
    whole = lists.search(index, centroids, queries.limit(3), 10, 64).collect()
    assert {r["n_scanned"] for r in whole} == {4000}


def test_number_of_lists_grows_with_the_table():
    assert [lists.n_lists(n) for n in (0, 1, 500, 2000, 10**6, 10**10, 10**12)] == [1, 1, 90, 179, 4000, 65536, 65536]


def test_samples_nulls_ties_and_empty(spark, monkeypatch):
    monkeypatch.setattr(lists, "TRAINED", 4)
    assert lists.train(frame(spark, clustered(400, 5)), 10, 2).shape == (10, 16)
    none = frame(spark, np.zeros((0, 4)))
    assert lists.search(*lists.build(none), none, 3).collect() == []
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    index, c = lists.build(df)
    got = sorted((r["query_id"], r["vec_id"], r["rank"]) for r in lists.search(index, c, df, 1).collect())
    assert got == [(1, 2, 1), (2, 1, 1), (4, 1, 1)]


def test_inner_products_are_held_a_block_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    e, c = rng.normal(size=(4000, 8)), np.round(rng.normal(size=(1000, 8)), 1)
    c[500] = c[3]  # equal products go to the first
    dots = np.round(e @ c.T, 9)
    monkeypatch.setattr(lists, "AT_ONCE", 100_000, raising=False)
    for k, want in ((1, dots.argmax(1)[:, None]), (7, np.argsort(-dots, axis=1, kind="stable")[:, :7]), (2000, np.argsort(-dots, axis=1, kind="stable"))):
        tracemalloc.start()
        got = lists.nearest(e, c, k)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got == want).all() and most < got.nbytes + 16_000_000 < 2 * dots.nbytes
    assert lists.nearest(e[:0], c, 3).shape == (0, 3)


def test_a_search_makes_no_row_of_each_pair(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = [[float(c) for c in r] for r in np.round(np.concatenate([np.repeat(clustered(1, 1, 8), 600, 0), clustered(600, 9, 8)]), 3)]
    x[50], x[700], x[701] = None, [None] + x[700][1:], [float("nan")] + x[701][1:]
    df = spark.createDataFrame([(int(i), v) for i, v in zip(rng.permutation(len(x)), x)], "vec_id long, embedding array<double>")
    index, c = lists.build(df, 12)
    queries = df.where("vec_id % 30 = 0")
    pairs = lists.probes(queries, c, 4).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "list").join(index, "list").where("query_id <> vec_id")
    scored = pairs.select("query_id", "vec_id", F.round(vectors.dot(F.col("q"), F.col("embedding")), 9).alias("score"))
    want = sorted(map(str, lists.top_k(scored, ["query_id"], 5).select("query_id", "vec_id", "score", "rank").collect()))
    made, real = [], lists.top_k
    monkeypatch.setattr(lists, "top_k", lambda s, *a: (made.append(s.count()), real(s, *a))[1])
    for block, at_once in ((4096, 1_000_000), (100, 1000)):
        monkeypatch.setattr(lists, "BLOCK", block)
        monkeypatch.setattr(lists, "AT_ONCE", at_once)
        got = lists.search(index, c, queries, 5, 4).select("query_id", "vec_id", "score", "rank")
        assert sorted(map(str, got.collect())) == want
    assert made[0] < 0.2 * scored.count()
