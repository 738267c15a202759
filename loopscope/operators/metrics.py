"""Similarity, diversity and collapse metrics of answers within a question and round."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats, vectors
from loopscope.functions import text as T
from loopscope.plans import views as V
from loopscope.plans.registry import n, query, r6

CELL = ["question_id", "iteration_number"]


def pair_stats(groups: DataFrame, scored: DataFrame, keys: list[str], score: str, prefix: str) -> DataFrame:
    """Mean, max, min and population deviation of pair scores of every group; groups without pairs get 0."""
    agg = scored.groupBy(*keys).agg(F.avg(score).alias("m"), F.max(score).alias("x"), F.min(score).alias("i"), F.stddev_pop(score).alias("s"))
    out = groups.join(agg, keys, "left")
    return out.select(*keys, *[r6(F.coalesce(c, F.lit(0.0)), f"{prefix}_{name}") for c, name in (("m", "mean"), ("x", "max"), ("i", "min"), ("s", "std"))])


def _sql_pairs(view: str, expr: str, prefix: str, group: str = "question_id, iteration_number", by: str = "run_idx", base: str = "runs") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in group.split(","))
    cols = ", ".join(f"g.{k.strip()}" for k in group.split(","))
    using = " AND ".join(f"g.{k.strip()} = s.{k.strip()}" for k in group.split(","))
    return f"""{view}, p AS (SELECT {", ".join("a." + k.strip() for k in group.split(","))}, {expr} AS score FROM {base} a JOIN {base} b ON {on} AND a.{by} < b.{by}),
s AS (SELECT {group}, avg(score) AS m, max(score) AS x, min(score) AS i, stddev_pop(score) AS s FROM p GROUP BY ALL), g AS (SELECT DISTINCT {group} FROM {base})
SELECT {cols}, round(coalesce(m, 0), 6) AS {prefix}_mean, round(coalesce(x, 0), 6) AS {prefix}_max, round(coalesce(i, 0), 6) AS {prefix}_min, round(coalesce(s.s, 0), 6) AS {prefix}_std FROM g LEFT JOIN s ON {using}"""


@query(f"WITH {V.DOCS} SELECT question_id, iteration_number, round(avg(CASE WHEN is_ai THEN 1.0 ELSE 0.0 END), 6) AS ai_share, count(*) AS n_docs FROM docs GROUP BY ALL")
def ai_share_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.context_docs(spark, sf_dir)
    return d.groupBy(*CELL).agg(r6(F.avg(F.col("doc_id").startswith("gen").cast("double")), "ai_share"), n(F.count(F.lit(1)), "n_docs"))


@query(f"WITH {V.RUNS}, w AS (SELECT question_id, iteration_number, unnest({V.sql_words('answer')}) AS w FROM runs), g AS (SELECT DISTINCT question_id, iteration_number FROM runs) SELECT g.question_id, g.iteration_number, count(DISTINCT w) AS unique_words FROM g LEFT JOIN w USING (question_id, iteration_number) GROUP BY ALL")
def unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.runs(spark, sf_dir).select(*CELL, F.explode_outer(T.words(F.col("answer"))).alias("w"))
    return w.groupBy(*CELL).agg(n(F.countDistinct("w"), "unique_words"))


@query(_sql_pairs(f"WITH {V.GIVEN}, r AS (SELECT question_id, iteration_number, run_idx, {V.sql_tokens('answer')} AS t FROM runs)", "coalesce(len(list_intersect(a.t, b.t)) / nullif(sqrt(CAST(len(a.t) AS DOUBLE) * len(b.t)), 0), 0)", "cosine", base="r"))
def pairwise_token_set_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.given(spark, sf_dir).select(*CELL, "run_idx", T.token_set(F.col("answer")).alias("t"))
    scored = V.pairs(r, *CELL).withColumn("score", T.set_cosine(F.col("t_a"), F.col("t_b")))
    return pair_stats(r.select(*CELL).distinct(), scored, CELL, "score", "cosine")


@query(_sql_pairs("WITH v AS (SELECT vec_id // 10 AS group_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)", "list_inner_product(a.e, b.e)", "dot", "group_id", "vec_id", "v"))
def pairwise_embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.table(spark, sf_dir, "embeddings").selectExpr("vec_id div 10 as group_id", "vec_id", "embedding as e")
    scored = V.pairs(v, "group_id", by="vec_id").withColumn("score", vectors.dot(F.col("e_a"), F.col("e_b")))
    return pair_stats(v.select("group_id").distinct(), scored, ["group_id"], "score", "dot")


_GRAMS = "regexp_extract_all(lower(answer), '[a-z0-9]+')"
_SHARED = "list_sum(list_transform(list_distinct({x}), lambda t: least(len(list_filter({x}, lambda u: u = t)), len(list_filter({y}, lambda u: u = t)))))"


def _sql_rouge(k: str) -> str:
    return f"coalesce(2.0 * {_SHARED.format(x=f'a.{k}', y=f'b.{k}')} / nullif(len(a.{k}) + len(b.{k}), 0), 0)"


@query(
    f"WITH {V.GIVEN}, t AS (SELECT *, {_GRAMS} AS g1 FROM runs), r AS (SELECT question_id, iteration_number, run_idx, g1, CASE WHEN len(g1) > 1 THEN list_transform(range(1, len(g1)), lambda i: g1[i] || ' ' || g1[i + 1]) ELSE [] END AS g2 FROM t), "
    f"p AS (SELECT a.question_id, a.iteration_number, {_sql_rouge('g1')} AS r1, {_sql_rouge('g2')} AS r2 FROM r a JOIN r b ON a.question_id = b.question_id AND a.iteration_number = b.iteration_number AND a.run_idx < b.run_idx), "
    "s AS (SELECT question_id, iteration_number, avg(r1) AS m1, stddev_pop(r1) AS s1, avg(r2) AS m2, stddev_pop(r2) AS s2 FROM p GROUP BY ALL), g AS (SELECT DISTINCT question_id, iteration_number FROM runs) "
    "SELECT g.question_id, g.iteration_number, round(coalesce(m1, 0), 6) AS rouge1_mean, round(coalesce(s1, 0), 6) AS rouge1_std, round(coalesce(m2, 0), 6) AS rouge2_mean, round(coalesce(s2, 0), 6) AS rouge2_std FROM g LEFT JOIN s USING (question_id, iteration_number)"
)
def rouge12_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams are counted once a run; pairs meet under the grams they share, so no pair looks at the others' tokens."""
    r = V.given(spark, sf_dir).select(*CELL, "run_idx", T.rouge_tokens(F.col("answer")).alias("g1"))
    r = r.withColumn("g2", T.ngrams(F.col("g1"), 2))
    kind = lambda k: F.transform(f"g{k}", lambda g: F.struct(F.lit(k).alias("k"), g.alias("g")))
    kinds = F.array(kind(1), kind(2))
    count = r.select(*CELL, "run_idx", F.explode(F.flatten(kinds)).alias("x")).groupBy(*CELL, "run_idx", "x").agg(F.count(F.lit(1)).alias("c"))
    a, b = (count.select(*CELL, "x", F.col("run_idx").alias(f"run_idx_{s}"), F.col("c").alias(f"c_{s}")) for s in "ab")
    least = F.least("c_a", "c_b")
    both = a.join(b, [*CELL, "x"]).where("run_idx_a < run_idx_b").groupBy(*CELL, "run_idx_a", "run_idx_b").agg(*[F.sum(F.when(F.col("x.k") == k, least)).alias(f"s{k}") for k in (1, 2)])
    pairs = V.pairs(r.select(*CELL, "run_idx", F.size("g1").alias("n1"), F.size("g2").alias("n2")), *CELL)
    f = lambda k: T.share(2 * F.coalesce(f"s{k}", F.lit(0)), F.col(f"n{k}_a") + F.col(f"n{k}_b"))
    scored = pairs.join(both, [*CELL, "run_idx_a", "run_idx_b"], "left").select(*CELL, f(1).alias("r1"), f(2).alias("r2"))
    agg = scored.groupBy(*CELL).agg(F.avg("r1").alias("m1"), F.stddev_pop("r1").alias("s1"), F.avg("r2").alias("m2"), F.stddev_pop("r2").alias("s2"))
    out = r.select(*CELL).distinct().join(agg, CELL, "left")
    return out.select(*CELL, *[r6(F.coalesce(c, F.lit(0.0)), name) for c, name in (("m1", "rouge1_mean"), ("s1", "rouge1_std"), ("m2", "rouge2_mean"), ("s2", "rouge2_std"))])


def lcs_size(x: list[str], y: list[str]) -> int:
    """Longest common subsequence with a row of the table in the bits of one integer."""
    where: dict[str, int] = {}
    for i, t in enumerate(x):
        where[t] = where.get(t, 0) | (1 << i)
    row = 0
    for t in y:
        both = row | where.get(t, 0)
        row = both & ~(both - ((row << 1) | 1))
    return row.bit_count()


def rouge_l_udf() -> Column:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([2.0 * lcs_size(list(x), list(y)) / (len(x) + len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b)], dtype="float64")

    return score


@query()
def rouge_l_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.given(spark, sf_dir).select(*CELL, "run_idx", T.rouge_tokens(F.col("answer")).alias("t"))
    scored = V.pairs(r, *CELL).withColumn("score", rouge_l_udf()(F.col("t_a"), F.col("t_b")))
    return pair_stats(r.select(*CELL).distinct(), scored, CELL, "score", "rouge_l")


@query()
def temporal_sentence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of aligned sentences, all runs of a round cut to the shortest one's number of sentences."""
    r = V.given(spark, sf_dir).select(*CELL, "run_idx", T.sentences(F.col("answer")).alias("s"))
    r = r.withColumn("k", F.min(F.size("s")).over(Window.partitionBy(*CELL))).withColumn("s", F.slice("s", F.lit(1), F.col("k")))
    r = r.select(*CELL, "run_idx", F.transform("s", lambda x: vectors.hashed_embedding(T.words(x), 32)).alias("e"))
    aligned = F.zip_with("e_a", "e_b", lambda x, y: vectors.dot(x, y))
    scored = V.pairs(r, *CELL).withColumn("score", T.share(F.aggregate(aligned, F.lit(0.0), lambda s, x: s + x), F.size(aligned)))
    return pair_stats(r.select(*CELL).distinct(), scored, CELL, "score", "tes")


@query(f"WITH {V.ENTS}, x AS (SELECT question_id, iteration_number, unnest(ents) AS e FROM ents), g AS (SELECT DISTINCT question_id, iteration_number FROM runs) SELECT g.question_id, g.iteration_number, count(DISTINCT e) AS unique_entities FROM g LEFT JOIN x USING (question_id, iteration_number) GROUP BY ALL")
def entity_unique_per_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.entities(spark, sf_dir).select(*CELL, F.explode_outer("ents").alias("e"))
    return e.groupBy(*CELL).agg(n(F.countDistinct("e"), "unique_entities"))


@query(_sql_pairs(f"WITH {V.ENTS}", "coalesce(len(list_intersect(a.ents, b.ents)) / nullif(sqrt(CAST(len(a.ents) AS DOUBLE) * len(b.ents)), 0), 0)", "entity", base="ents"))
def entity_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.entities(spark, sf_dir)
    scored = V.pairs(e, *CELL).withColumn("score", T.set_cosine(F.col("ents_a"), F.col("ents_b")))
    return pair_stats(e.select(*CELL).distinct(), scored, CELL, "score", "entity")


_COLLAPSED = "c AS (SELECT question_id, iteration_number, count(DISTINCT list_sort(ents)) = 1 AS collapsed FROM ents GROUP BY ALL)"


def collapsed(e: DataFrame) -> DataFrame:
    """Whether all runs of a round share one entity set."""
    return e.groupBy(*CELL).agg((F.countDistinct(F.array_sort("ents")) == 1).alias("collapsed"))


@query(f"WITH {V.ENTS}, {_COLLAPSED} SELECT question_id, iteration_number, CAST(collapsed AS BIGINT) AS collapsed FROM c")
def collapse_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(V.entities(spark, sf_dir)).select(*CELL, n(F.col("collapsed").cast("int"), "collapsed"))


_W = stats.Z95


@query(
    f"WITH {V.ENTS}, {_COLLAPSED}, q AS (SELECT question_id, arg_min(collapsed, iteration_number) AS f, arg_max(collapsed, iteration_number) AS l FROM c GROUP BY 1), "
    "k AS (SELECT 'first' AS point, sum(CAST(f AS INT)) AS x, count(*) AS n FROM q UNION ALL SELECT 'last', sum(CAST(l AS INT)), count(*) FROM q UNION ALL SELECT 'pooled', sum(CAST(collapsed AS INT)), count(*) FROM c), "
    f"w AS (SELECT *, (1.0 * x / n + {_W * _W} / (2 * n)) / (1 + {_W * _W} / n) AS mid, {_W}::DOUBLE * sqrt(1.0 * x / n * (1 - 1.0 * x / n) / n + {_W * _W} / (4.0 * n * n)) / (1 + {_W * _W}::DOUBLE / n) AS half FROM k) "
    "SELECT point, CAST(x AS BIGINT) AS collapsed, n AS total, round(100.0 * x / n, 6) AS rate, round(100 * greatest(mid - half, 0), 6) AS lo, round(100 * least(mid + half, 1), 6) AS hi FROM w"
)
def collapse_rates_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = collapsed(V.entities(spark, sf_dir))
    q = c.groupBy("question_id").agg(F.min_by("collapsed", "iteration_number").alias("f"), F.max_by("collapsed", "iteration_number").alias("l"))
    points = q.select(F.lit("first").alias("point"), F.col("f").alias("v")).union(q.select(F.lit("last"), "l")).union(c.select(F.lit("pooled"), "collapsed"))
    k = points.groupBy("point").agg(F.sum(F.col("v").cast("int")).alias("x"), F.count(F.lit(1)).alias("n"))
    lo, hi = stats.wilson(F.col("x"), F.col("n"))
    return k.select("point", n(F.col("x"), "collapsed"), n(F.col("n"), "total"), r6(100.0 * F.col("x") / F.col("n"), "rate"), r6(lo, "lo"), r6(hi, "hi"))


_WORDS_PER = f"{V.RUNS}, m AS (SELECT question_id, iteration_number, avg(len({V.sql_tokens('answer')})) AS v FROM runs GROUP BY ALL), pos AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY iteration_number) AS position, iteration_number, CASE WHEN v >= 10 THEN v END AS v FROM m)"


def _metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.runs(spark, sf_dir).groupBy(*CELL).agg(F.avg(F.size(T.token_set(F.col("answer")))).alias("v"))
    return m.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("iteration_number"))).withColumn("v", F.when(F.col("v") >= 10, F.col("v")))


@query(f"WITH {_WORDS_PER} SELECT iteration_number, round(avg(v), 6) AS mean, count(v) AS n FROM pos GROUP BY 1")
def per_round_mean_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By round number, rounds without the metric left out."""
    return _metric(spark, sf_dir).groupBy("iteration_number").agg(r6(F.avg("v"), "mean"), n(F.count("v"), "n"))


@query(f"WITH {_WORDS_PER} SELECT position, round(avg(coalesce(v, 0)), 6) AS mean, count(*) AS n FROM pos GROUP BY 1")
def per_round_mean_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By position in the question's rounds, a missing metric counted as 0."""
    return _metric(spark, sf_dir).groupBy(F.col("position").cast("long").alias("position")).agg(r6(F.avg(F.coalesce("v", F.lit(0.0))), "mean"), n(F.count(F.lit(1)), "n"))


@query(f"WITH {V.RUNS}, p AS (SELECT a.question_id, a.iteration_number, a.run_idx AS ra, b.run_idx AS rb, {V.sql_norm('a.answer')} = {V.sql_norm('b.answer')} AS same, row_number() OVER (PARTITION BY a.question_id, a.iteration_number ORDER BY md5(concat_ws('|', a.question_id, a.iteration_number, a.run_idx, b.run_idx)), a.run_idx, b.run_idx) AS k FROM runs a JOIN runs b ON a.question_id = b.question_id AND a.iteration_number = b.iteration_number AND a.run_idx < b.run_idx) SELECT question_id, iteration_number, round(100 * avg(CAST(same AS DOUBLE)), 6) AS same_percent, count(*) AS n_pairs FROM p WHERE k <= 10 GROUP BY ALL")
def same_answer_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of at most ten pairs a round, drawn by hash, the share whose answers read alike."""
    r = V.runs(spark, sf_dir).select(*CELL, "run_idx", T.normalize(F.col("answer")).alias("t"))
    p = V.pairs(r, *CELL)
    w = Window.partitionBy(*CELL).orderBy(stats.keyed_order(*[F.col(c) for c in (*CELL, "run_idx_a", "run_idx_b")]), "run_idx_a", "run_idx_b")
    p = p.withColumn("k", F.row_number().over(w)).where("k <= 10")
    return p.groupBy(*CELL).agg(r6(100 * F.avg((F.col("t_a") == F.col("t_b")).cast("double")), "same_percent"), n(F.count(F.lit(1)), "n_pairs"))
