"""Least squares with a bootstrap over rows against numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.operators import regression

SF = "/root/testdata/sf0.001"


def test_weights_of_many_rows_at_once_equal_the_columns(spark):
    keys = [0, 7, 123456789, -5, 2**62, None, *range(1000, 1040)]
    text = [*(None if k is None else str(k) for k in keys), "x" * 60, "é"]
    df = spark.createDataFrame([(k,) for k in text], "k string").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(1003))))
    want = {(r["k"], r["r"]): r["w"] for r in df.withColumn("w", stats.poisson_weight(F.lit(43), F.col("k"), F.col("r"))).collect()}
    got = regression.drawn_weights(text, 1003, 43)
    assert (got[:, 0] == 1).all() and all(got[i, r] == want[k, r] for i, k in enumerate(text) for r in range(1, 1004))


def test_replicates_are_no_rows(spark):
    """A row is hashed where it lies: no plan makes rows x replicates rows."""
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(50)], "row_id long, y double, a double")
    plan = regression.cross_sums(df, ["a"], 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def weight(seed, row, rep):
    u = (int(hashlib.md5(f"{seed}|{row}|{rep}".encode()).hexdigest()[:7], 16) + 0.5) / 2**28
    return sum(u > round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 12) for k in range(8))


def plain(ids, x, y, replicates, seed):
    point = np.linalg.lstsq(x, y, rcond=None)[0]
    draws = []
    for r in range(1, replicates + 1):
        at = np.repeat(np.arange(len(ids)), [weight(seed, i, r) for i in ids])
        draws.append(np.linalg.lstsq(x[at], y[at], rcond=None)[0])
    return point, np.array(draws)


def test_coefficients_and_intervals_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(80), rng.normal(size=(80, 3))]
    y = x @ [0.5, 1.0, -2.0, 0.0] + 0.1 * rng.normal(size=80)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(80)] + [(99, None, 1.0, 1.0, 1.0, 1.0)], "row_id long, y double, a double, b double, c double, d double")
    got = {r["term"]: r for r in regression.bootstrap_ols(df, names, 60, 5).collect()}
    point, draws = plain(range(80), x, y, 60, 5)
    for i, c in enumerate(names):
        want = [point[i], *np.percentile(draws[:, i], [2.5, 97.5]), 2 * min((draws[:, i] > 0).mean(), (draws[:, i] < 0).mean())]
        assert [got[c][k] for k in ("coefficient", "lo", "hi", "p_value")] == pytest.approx(want, abs=1e-8) and got[c]["n"] == 80
    assert regression.bootstrap_ols(df.limit(0), names, 3).collect() == []


def test_the_eleven_columns_of_documents(spark):
    rows = regression.regression_rows(spark, SF).toPandas()
    x, y = rows[regression.COLUMNS].to_numpy(float), rows["y"].to_numpy(float)
    assert x.shape[1] == 11 and rows[regression.DIMENSIONS].min().min() >= 1 and rows[regression.DIMENSIONS].max().max() <= 5
    got = regression.bootstrap_ols(regression.regression_rows(spark, SF), regression.COLUMNS, 15).toPandas()
    point, draws = plain(rows["row_id"], x, y, 15, regression.SEED)
    assert got["coefficient"].to_numpy() == pytest.approx(point, abs=1e-6)
    assert got["lo"].to_numpy() == pytest.approx(np.percentile(draws, 2.5, axis=0), abs=1e-5)


def test_dependent_columns_have_the_least_norm(spark):
    x = np.c_[np.ones(20), np.arange(20.0), 2 * np.arange(20.0)]
    y = 3 + x[:, 1]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(20)], "row_id long, y double, a double, b double, c double")
    got = regression.bootstrap_ols(df, ["a", "b", "c"], 2).collect()
    assert [r["coefficient"] for r in got] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-6)
