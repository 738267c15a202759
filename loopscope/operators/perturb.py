"""Controlled changes of contexts: substitutes, distractor slots, realised status, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.plans import views as V
from loopscope.plans.registry import n, query

_CAND = V.CANDIDATES


def substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid wrong answers of every question, in order of appearance: not the gold answer, nor within it or around it, nor in the question."""
    found = F.regexp_extract_all("answer", F.lit(V.ENTITY), F.lit(0))
    e = V.runs(spark, sf_dir).select("question_id", "iteration_number", "run_idx", F.posexplode(F.transform(found, F.lower)).alias("p", "candidate"))
    c = e.groupBy("question_id", "candidate").agg(F.min(F.col("iteration_number") * 10000000 + F.col("run_idx") * 1000000 + F.col("p")).alias("pos"))
    c = c.join(V.gold(spark, sf_dir), "question_id").join(V.questions(spark, sf_dir), "question_id")
    return c.where(T.valid_substitute(F.col("candidate"), F.col("gold"), F.col("question_text")))


def ranked_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutes of every question, numbered in order of appearance."""
    w = Window.partitionBy("question_id").orderBy("pos", "candidate")
    return substitutes(spark, sf_dir).withColumn("rank", F.row_number().over(w))


@query(f"WITH {_CAND}, r AS (SELECT question_id, candidate, row_number() OVER (PARTITION BY question_id ORDER BY pos, candidate) AS rank FROM ok) SELECT question_id, candidate, rank FROM r WHERE rank <= 4")
def distinct_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_substitutes(spark, sf_dir).where("rank <= 4").select("question_id", "candidate", n(F.col("rank"), "rank"))


_SLOTS = f"{V.DOCS}, {V.GOLD}, b AS (SELECT question_id, iteration_number, slot, row_id, coalesce({V.sql_contains('text', 'gold')}, false) AS bearing, md5(concat_ws('|', 5, row_id)) AS h, count(*) OVER (PARTITION BY question_id, iteration_number) AS k FROM docs LEFT JOIN gold USING (question_id)), s AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY bearing DESC, h, row_id) AS pick FROM b)"


def distractor_slots(spark: SparkSession, sf_dir: str, fraction: float = 0.3, avoid_gold: bool = False) -> DataFrame:
    """Slots to corrupt: half-even rounded fraction of a round's documents, those that bear the gold answer first (or never), then by hash."""
    d = V.context_docs(spark, sf_dir).join(V.gold(spark, sf_dir), "question_id", "left")
    d = d.withColumn("bearing", F.coalesce(T.contains_entity(F.col("text"), F.col("gold")), F.lit(False))).select("question_id", "iteration_number", "slot", "row_id", "bearing")
    w = Window.partitionBy("question_id", "iteration_number")
    d = d.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("pick", F.row_number().over(w.orderBy(F.desc("bearing"), stats.keyed_order(F.lit(5), F.col("row_id")), "row_id")))
    if avoid_gold:
        d = d.where("not bearing").withColumn("pick", F.row_number().over(w.orderBy(stats.keyed_order(F.lit(5), F.col("row_id")), "row_id")))
    return d.where(F.col("pick") <= T.n_to_corrupt(F.lit(fraction), F.col("k")))


@query(f"WITH {_SLOTS} SELECT question_id, iteration_number, slot, CAST(bearing AS BIGINT) AS gold_bearing FROM s WHERE pick <= round_even(0.3 * k, 0)")
def select_distractor_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distractor_slots(spark, sf_dir).select("question_id", "iteration_number", "slot", n(F.col("bearing").cast("int"), "gold_bearing"))


_AVOID = f"{_SLOTS}, av AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY h, row_id) AS pick2 FROM b WHERE NOT bearing)"


@query(f"WITH {_AVOID} SELECT question_id, iteration_number, slot FROM av WHERE pick2 <= round_even(0.5 * k, 0)")
def avoid_gold_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots to corrupt when documents that bear the gold answer are never touched."""
    return distractor_slots(spark, sf_dir, 0.5, avoid_gold=True).select("question_id", "iteration_number", "slot")


@query(f"WITH {_SLOTS}, p AS (SELECT *, sum(CAST(bearing AS INT)) OVER (PARTITION BY question_id, iteration_number) AS every FROM s), c AS (SELECT *, sum(CAST(bearing AS INT)) OVER (PARTITION BY question_id, iteration_number) AS chosen, max(CASE WHEN bearing THEN slot END) OVER (PARTITION BY question_id, iteration_number) AS last FROM p WHERE pick <= round_even(0.8 * k, 0)) SELECT question_id, iteration_number, slot, CAST(bearing AS BIGINT) AS gold_bearing FROM c WHERE every = 0 OR chosen < every OR slot <> last")
def gold_preserving_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots to corrupt, less the last gold-bearing one where all gold-bearing documents would go."""
    w = Window.partitionBy("question_id", "iteration_number")
    every = V.context_docs(spark, sf_dir).join(V.gold(spark, sf_dir), "question_id").where(T.contains_entity(F.col("text"), F.col("gold"))).groupBy("question_id", "iteration_number").agg(F.count(F.lit(1)).alias("every"))
    p = distractor_slots(spark, sf_dir, 0.8).join(every, ["question_id", "iteration_number"], "left")
    p = p.withColumns({"chosen": F.sum(F.col("bearing").cast("int")).over(w), "last": F.max(F.when(F.col("bearing"), F.col("slot"))).over(w)})
    return p.where("every is null or chosen < every or slot <> last").select("question_id", "iteration_number", "slot", n(F.col("bearing").cast("int"), "gold_bearing"))


@query(f"WITH {_AVOID}, p AS (SELECT * FROM av WHERE pick2 <= round_even(0.8 * k, 0)), o AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) - 1 AS i, count(*) OVER (PARTITION BY question_id, iteration_number) // 2 AS topics FROM p) SELECT question_id, iteration_number, slot, i // 2 AS topic FROM o WHERE i < topics * 2")
def equal_topic_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without gold dealt to as many topics of two documents as fit; what is left over is not used."""
    return topics(distractor_slots(spark, sf_dir, 0.8, avoid_gold=True)).select("question_id", "iteration_number", "slot", F.expr("i div 2").alias("topic"))


def topics(slots: DataFrame, docs: int = 2) -> DataFrame:
    """Slots in order with their place i, as far as they fill topics of `docs` documents."""
    w = Window.partitionBy("question_id", "iteration_number")
    p = slots.withColumn("i", F.row_number().over(w.orderBy("slot")) - 1).withColumn("t", F.count(F.lit(1)).over(w))
    return p.where(F.expr(f"i < (t div {docs}) * {docs}"))


@query(f"WITH {V.RUNS}, {V.GOLD}, t AS (SELECT CASE WHEN NOT {V.sql_contains('answer', "'data'")} THEN 'not_realized' WHEN {V.sql_contains('answer', 'gold')} THEN 'leaky_gold' ELSE 'ok' END AS status FROM runs JOIN gold USING (question_id)) SELECT status, count(*) AS n FROM t GROUP BY 1")
def realized_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.runs(spark, sf_dir).join(V.gold(spark, sf_dir), "question_id").select(T.realized_status(F.col("answer"), F.col("gold"), F.lit("data")).alias("status"))
    return t.groupBy("status").agg(n(F.count(F.lit(1)), "n"))


@query(f"WITH {V.RUNS}, {V.GOLD} SELECT question_id, iteration_number, run_idx, CAST(len(regexp_extract_all(answer, '(?i)\\b' || gold || '\\b')) AS BIGINT) AS n, md5(regexp_replace(answer, '(?i)\\b' || gold || '\\b', 'X$1', 'g')) AS digest FROM runs JOIN gold USING (question_id) WHERE gold <> ''")
def substitute_in_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers replaced in the answers as whole words, with their number."""
    r = V.runs(spark, sf_dir).join(V.gold(spark, sf_dir), "question_id").where("gold <> ''")
    changed, k = T.substitute(F.col("answer"), F.col("gold"), F.lit("X$1"))
    return r.select("question_id", "iteration_number", "run_idx", n(k, "n"), F.md5(changed).alias("digest"))


@query(f"WITH {V.RUNS}, {_SLOTS.split(', b AS')[0]}, d AS (SELECT question_id, iteration_number, row_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY question_id, iteration_number) AS k FROM docs WHERE is_ai WINDOW w AS (PARTITION BY question_id, iteration_number ORDER BY slot)) SELECT r.question_id, r.iteration_number, r.run_idx, row_id FROM runs r JOIN d ON r.question_id = d.question_id AND r.iteration_number = d.iteration_number AND r.run_idx % k = i")
def distractor_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin: run r sees distractor r mod D."""
    w = Window.partitionBy("question_id", "iteration_number")
    d = V.context_docs(spark, sf_dir).where("is_ai").select("question_id", "iteration_number", "row_id", "slot").withColumn("i", F.row_number().over(w.orderBy("slot")) - 1).withColumn("k", F.count(F.lit(1)).over(w))
    return V.runs(spark, sf_dir).join(d, ["question_id", "iteration_number"]).where("run_idx % k = i").select("question_id", "iteration_number", "run_idx", "row_id")
