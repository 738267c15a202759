import os

import numpy as np
import pandas as pd
import pytest

from loopscope.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    c = rng.standard_normal((10, 24))
    x = (c[rng.integers(0, 10, 3000)] * 0.8 + rng.standard_normal((3000, 24))).astype("f4")
    x[500:1500] = x[500]  # one vector that a third of the rows hold
    v = table(spark, [(i, r.tolist()) for i, r in enumerate(x)])
    got = neighbours.nearest(v, v.where("vec_id % 100 = 0")).collect()
    y, hit = x.astype("f8"), 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12) for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(want))
        if q == 600:
            assert [r["vec_id"] for r in mine] == want
    assert hit / 300 >= 0.9


def test_descent_and_ascent_against_every_string(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 8))
    plan = neighbours.fit(x, 5, 20, 3)
    f = neighbours.Forest(np.arange(700), x, plan)
    strings = neighbours.hashes(f.x, plan)
    for q in rng.standard_normal((20, 8)):
        code = neighbours.hashes(q[None], plan)[0]
        common = np.array([[next((k for k in range(16) if (int(a) ^ int(b)) >> (19 - k)), 16) for a, b in zip(r, code)] for r in strings])
        assert f.longest(code) == common.max()
        for enough in (1, 30, 300, 700):
            votes, level = f.ascend(code, enough)
            assert ((common >= level).any(1)).sum() >= enough and (level == common.max() or (common >= level + 1).any(1).sum() < enough)
            assert (votes == np.maximum(common - (level - 1), 0).sum(1)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_recall_at_real_size(spark):
    """Vectors of the driver's table (unstructured: the worst case), one block, fewer vectors measured than there are."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").coalesce(1)
    rows = v.toArrow()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy(zero_copy_only=False)).astype("f8")
    got = neighbours.nearest(v, v.where("vec_id % 50 = 0")).toPandas()
    hit = 0
    for q, mine in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = np.lexsort((ids, d))
        hit += len(set(mine["vec_id"]) & set(ids[order[ids[order] != q][:10]].tolist()))
        assert mine["measured"].nunique() == 1 and mine["measured"].iloc[0] < len(ids)
    assert hit / (10 * got["query_id"].nunique()) >= 0.9


def test_many_passes_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PASS_QUERIES", 7)
    rng = np.random.default_rng(0)
    v = table(spark, [(i, r.tolist()) for i, r in enumerate(rng.standard_normal((200, 4)).astype("f4"))])
    one = sorted(map(tuple, neighbours.nearest(v, v.where("vec_id % 5 = 0")).collect()))
    wide = v.selectExpr("*", "vec_id as query_id", "1 as rank", "2 as score", "3 as e", "4 as measured")
    monkeypatch.setattr(neighbours, "PASS_QUERIES", 16_384)
    assert one == sorted(map(tuple, neighbours.nearest(wide, wide.where("vec_id % 5 = 0")).collect())) and len(one) == 400


def test_odd_rows_take_no_part(spark):
    good = [(i, [1.0, float(i)]) for i in range(4)]
    odd = [(10, None), (11, [0.0, 0.0]), (12, [1.0, None]), (13, [float("nan"), 1.0]), (14, [float("inf"), 1.0]), (15, []), (16, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    v = table(spark, good + odd + good[:1])
    got = neighbours.nearest(v, v).collect()
    assert {r["query_id"] for r in got} == {0, 1, 2, 3} and len(got) == 12
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 1), key=lambda r: r["rank"])] == [0, 2, 3]


def test_nothing(spark):
    v = table(spark, [])
    assert neighbours.nearest(v, v).collect() == []
    v = table(spark, [(1, [0.0])])
    assert neighbours.nearest(v, v).collect() == []


def test_repeated_rows_take_no_slots(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 6)).astype("f4")
    many = [(i, r.tolist()) for i, r in enumerate(x) for _ in range(2)] + [(1, x[1].tolist())] * 30
    many += [(100, (x[0] + 0.001 * j).tolist()) for j in range(1, 40)]  # one id with many vectors
    v = table(spark, many).coalesce(1)
    got = neighbours.nearest(v, v.where("vec_id < 3")).collect()
    ids, y = np.array([i for i, _ in many]), np.array([r for _, r in many], "f4").astype("f8")
    for q in range(3):
        d = np.sqrt(((y - y[ids == q][0]) ** 2).sum(1))
        want = sorted((d[ids == i].min(), i) for i in set(ids.tolist()) if i != q)[:10]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in want]


def test_few_vectors_among_many_rows_without(spark):
    rows = [(i, [float(i), 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").unionByName(spark.range(100, 60_100).selectExpr("id as vec_id", "if(id % 2 = 0, null, array(0.0d, 0.0d)) as embedding"))
    got = neighbours.nearest(df, df.where("vec_id < 4")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)] and len(got) == 12


def test_of_several_vectors_of_a_query_the_smallest_asks(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)]
    twice = [(99, [2.0, 1.0]), (99, [28.0, 1.0]), (99, [2.0, 5.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for own in (twice, twice[::-1], twice[1:] + twice[:1]):
        got = neighbours.nearest(v, spark.createDataFrame(own, v.schema), k=2).collect()
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 1]


def test_recall_does_not_fall_with_the_table(spark, monkeypatch):
    """Blocks are searched alike, however many there are: 40 small ones of vectors without structure."""
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 1000)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40_000, 32)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x.tolist())}), "vec_id long, embedding array<float>").repartition(40)
    got = neighbours.nearest(df, df.where("vec_id % 2000 = 0"), least=100, share=0.3)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert r["measured"] < 0.45 * len(x)
    hits = 0
    for q in found:
        d = ((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1)
        d[q] = 9
        hits += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 20 and hits >= 0.9 * 200
