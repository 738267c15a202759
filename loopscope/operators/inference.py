"""Regression sums, bootstrap, agreement, leaderboards, histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.plans import views as V
from loopscope.plans.registry import n, query, r6

_X = "x AS (SELECT doc_id // 40 AS cluster, CAST(quality AS DOUBLE) AS y, 1.0::DOUBLE AS x0, CAST(toxic AS DOUBLE) AS x1, ln(1 + n_chars) AS x2 FROM documents JOIN labels USING (doc_id))"
COLS = ["x0", "x1", "x2"]


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(V.table(spark, sf_dir, "labels"), "doc_id")
    return d.selectExpr("doc_id div 40 as cluster", "cast(quality as double) as y", "1.0d as x0", "cast(toxic as double) as x1", "ln(1 + n_chars) as x2")


def cross_sums(x: DataFrame) -> DataFrame:
    """X'X and X'y in one pass: everything least squares needs, whatever the number of rows."""
    return x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(COLS) for b in [*COLS[i:], "y"]], F.count(F.lit(1)).alias("n"))


def solve(x: DataFrame) -> np.ndarray:
    """Least-squares coefficients from the sums."""
    r = cross_sums(x).first()
    a = np.array([[r[f"{min(p, q)}_{max(p, q)}"] for q in COLS] for p in COLS], float)
    return np.linalg.lstsq(a, np.array([r[f"{p}_y"] for p in COLS], float), rcond=None)[0]


@query(f"WITH {_X} SELECT " + ", ".join(f"round(sum({a} * {b}), 6) AS {a}_{b}" for i, a in enumerate(COLS) for b in [*COLS[i:], "y"]) + ", count(*) AS n FROM x")
def normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cross_sums(design(spark, sf_dir))
    return s.select(*[r6(c, c) for c in s.columns if c != "n"], n(F.col("n"), "n"))


@query(f"WITH {_X}, b AS (SELECT regr_slope(y, x2) AS s, regr_intercept(y, x2) AS i FROM x) SELECT cluster, round(sum(y - i - s * x2), 6) AS score0, round(sum(x2 * (y - i - s * x2)), 6) AS score1 FROM x, b GROUP BY 1")
def cluster_scores_cr0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-cluster score sums of a one-covariate fit: the middle of the cluster-robust sandwich."""
    x = design(spark, sf_dir)
    b = F.broadcast(x.agg(F.regr_slope("y", "x2").alias("s"), F.regr_intercept("y", "x2").alias("i")))  # one row
    e = x.crossJoin(b).withColumn("e", F.col("y") - F.col("i") - F.col("s") * F.col("x2"))
    return e.groupBy("cluster").agg(r6(F.sum("e"), "score0"), r6(F.sum(F.col("x2") * F.col("e")), "score1"))


def _sandwich(*i: str) -> str:
    """i M i' for a row of the inverse and the symmetric middle m00, m01, ..., m22."""
    terms = [f"{i[j]} * {i[k]} * m{min(j, k)}{max(j, k)}" for j in range(3) for k in range(3)]
    return f"sqrt(greatest({' + '.join(terms)}, 0))"


_CR0 = (
    f"{_X}, s AS (SELECT sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x0 * x2) AS c, sum(x1 * x1) AS d, sum(x1 * x2) AS e, sum(x2 * x2) AS f, sum(x0 * y) AS p, sum(x1 * y) AS q, sum(x2 * y) AS r FROM x), "
    "det AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS z FROM s), "
    "inv AS (SELECT p, q, r, (d * f - e * e) / z AS i00, (c * e - b * f) / z AS i01, (b * e - c * d) / z AS i02, (a * f - c * c) / z AS i11, (b * c - a * e) / z AS i12, (a * d - b * b) / z AS i22 FROM det), "
    "fit AS (SELECT *, i00 * p + i01 * q + i02 * r AS b0, i01 * p + i11 * q + i12 * r AS b1, i02 * p + i12 * q + i22 * r AS b2 FROM inv), "
    "res AS (SELECT cluster, x0, x1, x2, y - b0 * x0 - b1 * x1 - b2 * x2 AS u FROM x, fit), g AS (SELECT sum(x0 * u) AS g0, sum(x1 * u) AS g1, sum(x2 * u) AS g2 FROM res GROUP BY cluster), "
    "m AS (SELECT sum(g0 * g0) AS m00, sum(g0 * g1) AS m01, sum(g0 * g2) AS m02, sum(g1 * g1) AS m11, sum(g1 * g2) AS m12, sum(g2 * g2) AS m22 FROM g)"
)


@query(f"WITH {_CR0} " + " UNION ALL ".join(f"SELECT 'x{k}' AS term, round(b{k}, 6) AS coefficient, round({_sandwich(*(f'i{min(k, j)}{max(k, j)}' for j in range(3)))}, 6) AS cr0_error FROM fit, m" for k in range(3)))
def cluster_robust_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients with cluster-robust (CR0) errors: two passes of sums, a 3 x 3 solve on the driver."""
    x = design(spark, sf_dir)
    beta = solve(x)
    r = cross_sums(x).first()
    a = np.linalg.pinv(np.array([[r[f"{min(p, q)}_{max(p, q)}"] for q in COLS] for p in COLS], float))
    e = x.withColumn("e", F.col("y") - sum(F.col(c) * float(b) for c, b in zip(COLS, beta)))
    g = e.groupBy("cluster").agg(*[F.sum(F.col(c) * F.col("e")).alias(c) for c in COLS])
    m = g.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for i, p in enumerate(COLS) for q in COLS[i:]]).first()
    meat = np.array([[m[f"{min(p, q)}_{max(p, q)}"] for q in COLS] for p in COLS], float)
    se = np.sqrt(np.maximum(np.diag(a @ meat @ a), 0))
    return spark.createDataFrame([(c, round(float(b), 6), round(float(s), 6)) for c, b, s in zip(COLS, beta, se)], "term string, coefficient double, cr0_error double")


_BOOT = f"{_X}, per AS (SELECT cluster, sum(CASE WHEN x1 = 0 THEN y ELSE 0 END) AS s0, sum(CASE WHEN x1 = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN x1 = 1 THEN y ELSE 0 END) AS s1, sum(CASE WHEN x1 = 1 THEN 1 ELSE 0 END) AS n1 FROM x GROUP BY 1), r AS (SELECT *, unnest(range(1, 1001)) AS rep FROM per), u AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', 9, cluster, rep)), 1, 7) AS BIGINT) + 0.5) / 268435456.0 AS u FROM r), w AS (SELECT *, list_sum([CASE WHEN u > c THEN 1 ELSE 0 END for c in [{', '.join(f'{c:.12f}' for c in stats.POISSON)}]]) AS w FROM u), d AS (SELECT sum(s1 * w) / nullif(sum(n1 * w), 0) - sum(s0 * w) / nullif(sum(n0 * w), 0) AS d FROM w GROUP BY rep), o AS (SELECT avg(d) AS m, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg(CASE WHEN d IS NULL THEN NULL WHEN d > 0 THEN 1.0 ELSE 0 END) AS p FROM d)"


@query(f"WITH {_BOOT} SELECT round(m, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(2 * least(p, 1 - p), 6) AS p_value, CASE WHEN lo > 0 OR hi < 0 THEN 'yes' ELSE 'no' END AS significant FROM o")
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference in mean quality between toxic and other documents with a cluster bootstrap interval.

    Clusters are first summed to one row each; a replicate draws each cluster Poisson(1) times by a keyed hash, so
    replicates are sums of weighted rows and need neither a shuffle of data nor the driver.
    """
    per = design(spark, sf_dir).groupBy("cluster").agg(*[F.sum(F.when(F.col("x1") == t, F.col(c)).otherwise(0.0)).alias(f"{name}{t}") for t in (0, 1) for c, name in (("y", "s"), ("x0", "n"))])
    rep = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(1000)))).withColumn("w", stats.poisson_weight(F.lit(9), F.col("cluster"), F.col("rep")))
    d = rep.groupBy("rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("s0", "n0", "s1", "n1")]).withColumn("d", F.try_divide("s1", "n1") - F.try_divide("s0", "n0"))
    out = d.agg(F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), F.avg((F.col("d") > 0).cast("double")).alias("p"))
    return out.select(r6("mean", "mean"), r6("lo", "lo"), r6("hi", "hi"), r6(2 * F.least("p", 1 - F.col("p")), "p_value"), stats.significance(F.col("lo"), F.col("hi")).alias("significant"))


_ANN = "a AS (SELECT doc_id, quality = 1 AS a, n_chars > 600 AS b, source, lang FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_ANN}, g AS (SELECT lang, count(*) FILTER (a AND b) AS tp, count(*) FILTER (b AND NOT a) AS fp, count(*) FILTER (a AND NOT b) AS fn, count(*) FILTER (a = b) AS exact, count(*) AS n FROM a GROUP BY GROUPING SETS ((lang), ())) SELECT coalesce(lang, 'all') AS grp, tp, fp, fn, round(1.0 * tp / nullif(tp + fp, 0), 6) AS precision, round(1.0 * tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(1.0 * exact / n, 6) AS exact_rate FROM g")
def annotation_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of one annotator against another, by group and for all."""
    a = _annotated(spark, sf_dir)
    c = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    A, B = F.col("a"), F.col("b")
    g = a.groupingSets([["lang"], []], "lang").agg(c(A & B, "tp"), c(B & ~A, "fp"), c(A & ~B, "fn"), c(A == B, "ex"), F.count(F.lit(1)).alias("n"))
    d = lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(F.coalesce("lang", F.lit("all")).alias("grp"), "tp", "fp", "fn", r6(d(tp, tp + fp), "precision"), r6(d(tp, tp + fn), "recall"), r6(d(2 * tp, 2 * tp + fp + fn), "f1"), r6(d(F.col("ex"), F.col("n")), "exact_rate"))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(V.table(spark, sf_dir, "labels"), "doc_id")
    return d.select("lang", (F.col("quality") == 1).alias("a"), (F.col("n_chars") > 600).alias("b"))


@query(f"WITH {_ANN}, k AS (SELECT count(*) * 1.0::DOUBLE AS n, count(*) FILTER (a = b) AS po, count(*) FILTER (a) AS ya, count(*) FILTER (b) AS yb FROM a) SELECT round((po / n - (ya / n * yb / n + (1 - ya / n) * (1 - yb / n))) / (1 - (ya / n * yb / n + (1 - ya / n) * (1 - yb / n))), 6) AS kappa, CAST(n AS BIGINT) AS n FROM k")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda cond: F.sum(cond.cast("int"))
    k = _annotated(spark, sf_dir).agg(c(F.col("a") == F.col("b")).alias("po"), c(F.col("a")).alias("ya"), c(F.col("b")).alias("yb"), F.count(F.lit(1)).alias("n"))
    return k.select(r6(stats.kappa(F.col("po"), F.col("ya"), F.col("yb"), F.col("n")), "kappa"), n(F.col("n"), "n"))


@query("SELECT o_orderpriority AS candidate, round(avg(o_totalprice), 4) AS avg_anti_collapse, round(avg(o_custkey), 4) AS avg_quality, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with evaluations enough, best first."""
    g = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("candidate")).agg(F.round(F.avg("o_totalprice"), 4).alias("avg_anti_collapse"), F.round(F.avg("o_custkey"), 4).alias("avg_quality"), n(F.count(F.lit(1)), "n"))
    return g.where("n >= 5").orderBy(F.desc("avg_anti_collapse"), F.desc("avg_quality"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(props AS JSON) IS NOT NULL AS parsed FROM events")
def json_best_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").withColumn("j", T.best_effort_json(F.col("props")))
    return e.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.col("j").isNotNull().alias("parsed"))


@query("WITH b AS (SELECT least(CAST(floor(least(greatest(l_discount * 10, 0), 1) * 40) AS BIGINT), 39) AS bin FROM lineitem) SELECT bin, count(*) AS n FROM b GROUP BY 1")
def histogram_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty equal bins over 0..1, the last one closed."""
    x = F.least(F.greatest(F.col("l_discount") * 10, F.lit(0)), F.lit(1))
    return V.table(spark, sf_dir, "lineitem").groupBy(F.least(F.floor(x * 40).cast("long"), F.lit(39)).alias("bin")).agg(n(F.count(F.lit(1)), "n"))


@query("WITH p AS (SELECT toxic = 1 AS t, least(n_chars / 4000.0, 1) >= 0.5 AS h FROM documents JOIN labels USING (doc_id)) SELECT count(*) FILTER (t AND h) AS tp, count(*) FILTER (NOT t AND h) AS fp, count(*) FILTER (t AND NOT h) AS fn, count(*) FILTER (NOT t AND NOT h) AS tn, round(1.0 * count(*) FILTER (t = h) / count(*), 6) AS accuracy FROM p")
def detector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of a thresholded score."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(V.table(spark, sf_dir, "labels"), "doc_id")
    d = d.select((F.col("toxic") == 1).alias("t"), (F.least(F.col("n_chars") / 4000.0, F.lit(1.0)) >= 0.5).alias("h"))
    c = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    t, h = F.col("t"), F.col("h")
    return d.agg(c(t & h, "tp"), c(~t & h, "fp"), c(t & ~h, "fn"), c(~t & ~h, "tn"), r6(F.avg((t == h).cast("double")), "accuracy"))
