"""Which documents answers rest on: overlap, leave-one-out, over-citation, novelty, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import text as T
from loopscope.operators import reruns
from loopscope.plans import views as V
from loopscope.plans.lineage import stored
from loopscope.plans.registry import n, query, r6

CELL = ["question_id", "iteration_number"]
RUN = [*CELL, "run_idx"]
_RANK = f"{V.OVERLAPS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number, run_idx ORDER BY round(overlap, 9) DESC, slot) AS k FROM ovl)"


def ranked(spark: SparkSession, sf_dir: str, answers: DataFrame | None = None) -> DataFrame:
    """Context documents of each run by overlap with the answer; equal ones in slot order."""
    w = Window.partitionBy(*RUN).orderBy(F.desc(F.round("overlap", 9)), "slot")
    return V.overlaps(spark, sf_dir, answers).withColumn("k", F.row_number().over(w))


@query(f"WITH {_RANK} SELECT question_id, iteration_number, run_idx, doc_id, round(overlap, 6) AS overlap, k AS rank FROM ranked WHERE k <= 4")
def overlap_top_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).where("k <= 4").select(*RUN, "doc_id", r6("overlap", "overlap"), n(F.col("k"), "rank"))


#: a, ovl, ranked: as above, of the generated answers; c: changes of the answer without each candidate; cited: citations.
_LOO = (
    f"{V.DOCS}, {V.QUESTIONS}, {reruns.SAID}, a AS (SELECT question_id, iteration_number, run_idx, {V.sql_tokens('answer')} AS a_set FROM said WHERE removed IS NULL), d AS (SELECT question_id, iteration_number, slot, doc_id, is_ai, {V.sql_tokens('text')} AS d_set FROM docs), "
    f"ovl AS (SELECT a.question_id, a.iteration_number, run_idx, a_set, slot, doc_id, is_ai, {V.sql_overlap('a_set', 'd_set')} AS overlap FROM a JOIN d USING (question_id, iteration_number)), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number, run_idx ORDER BY round(overlap, 9) DESC, slot) AS k FROM ovl), "
    f"c AS (SELECT r.question_id, r.iteration_number, r.run_idx, r.slot, r.doc_id, r.is_ai, r.k, 1 - {V.sql_overlap('r.a_set', V.sql_tokens('x.answer'))} AS change FROM ranked r JOIN said x ON x.question_id = r.question_id AND x.iteration_number = r.iteration_number AND x.removed = r.doc_id WHERE k <= 4 AND x.answer <> ''), "
    "t AS (SELECT *, change >= 0.18 AS strong, sum(CASE WHEN change >= 0.18 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, iteration_number, run_idx) AS n_strong, row_number() OVER (PARTITION BY question_id, iteration_number, run_idx ORDER BY change DESC, k) AS by_change FROM c), "
    "cited AS (SELECT * FROM t WHERE strong OR (n_strong = 0 AND change > 0 AND by_change <= 2))"
)


def answered(spark: SparkSession, sf_dir: str, generate: reruns.Generator = reruns.grounded) -> DataFrame:
    """The answers that leave-one-out explains: generated from each round's context."""
    return reruns.answers(reruns.contexts(spark, sf_dir), generate)


def citations(spark: SparkSession, sf_dir: str, threshold: float = 0.18, m: int = 4, most: int = 6, generate: reruns.Generator = reruns.grounded, cache: reruns.Reruns | None = None) -> DataFrame:
    """Leave-one-out citations: the first `most` candidates without which the answer changes enough; if there is none, the two that change it most.

    A run's candidates are the `m` documents (one at least) with most overlap with its answer. Each is left out of the
    context and the generator asked again, once for all runs of a round and never for what the cache holds. Candidates
    with an empty rerun are skipped.
    """
    rounds = stored(reruns.contexts(spark, sf_dir))
    r = stored(ranked(spark, sf_dir, reruns.answers(rounds, generate)).where(F.col("k") <= max(1, m)))
    again = (cache or reruns.Reruns(spark)).ask(rounds, r, generate).where("answer <> ''").select(*CELL, "doc_id", T.token_set(F.col("answer")).alias("other"))
    c = r.join(again, [*CELL, "doc_id"]).withColumn("change", T.answer_change(F.col("a_set"), F.col("other")))
    w = Window.partitionBy(*RUN)
    strong = F.col("change") >= threshold
    c = c.withColumn("n_strong", F.sum(strong.cast("int")).over(w)).withColumn("by_change", F.row_number().over(w.orderBy(F.desc("change"), "k")))
    c = c.withColumn("place", F.sum(strong.cast("int")).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return c.where((strong & (F.col("place") <= most)) | ((F.col("n_strong") == 0) & (F.col("change") > 0) & (F.col("by_change") <= min(2, most))))


@query(f"WITH {_LOO} SELECT question_id, iteration_number, run_idx, doc_id, round(change, 6) AS change FROM cited")
def loo_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations(spark, sf_dir).select(*RUN, "doc_id", r6("change", "change"))


_SIDECAR = f"{_LOO}, side AS (SELECT question_id, iteration_number, run_idx, doc_id FROM cited UNION ALL SELECT question_id, iteration_number, run_idx, CASE WHEN iteration_number % 2 = 1 THEN 'gen_0_99' ELSE 'corpus_7' END FROM said WHERE removed IS NULL AND run_idx = 0), meta AS (SELECT DISTINCT question_id, iteration_number, doc_id, is_ai FROM docs), x AS (SELECT iteration_number, coalesce(m.is_ai, starts_with(s.doc_id, 'gen_')) AS ai FROM side s LEFT JOIN meta m USING (question_id, iteration_number, doc_id))"


@query(f"WITH {_SIDECAR}, ctx AS (SELECT coalesce(CAST(iteration_number AS VARCHAR), 'pooled') AS round, avg(CAST(is_ai AS INT)) AS share FROM meta GROUP BY GROUPING SETS ((iteration_number), ())), cit AS (SELECT coalesce(CAST(iteration_number AS VARCHAR), 'pooled') AS round, avg(CAST(ai AS INT)) AS share, count(*) AS n FROM x GROUP BY GROUPING SETS ((iteration_number), ())) SELECT round, round(ctx.share, 6) AS context_share, round(cit.share, 6) AS citation_share, round(cit.share / nullif(ctx.share, 0), 6) AS ratio, n FROM ctx JOIN cit USING (round)")
def overcitation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of AI documents among citations over their share in the context, by round and pooled.

    Cited ids that the round's context does not hold are told by their prefix alone, and count.
    """
    known = citations(spark, sf_dir).select(*RUN, "doc_id")
    strange = answered(spark, sf_dir).where("run_idx = 0").select(*RUN, F.when(F.col("iteration_number") % 2 == 1, "gen_0_99").otherwise("corpus_7").alias("doc_id"))
    meta = V.context_docs(spark, sf_dir).select(*CELL, "doc_id", "is_ai").distinct()
    cited = known.unionByName(strange).join(meta, [*CELL, "doc_id"], "left").select("iteration_number", F.coalesce("is_ai", F.col("doc_id").startswith("gen_")).alias("is_ai"))
    by = lambda d, *cols: d.groupingSets([["iteration_number"], []], "iteration_number").agg(F.avg(F.col("is_ai").cast("int")).alias("share"), *cols).withColumn("round", F.coalesce(F.col("iteration_number").cast("string"), F.lit("pooled"))).drop("iteration_number")
    ctx, cit = by(meta), by(cited, n(F.count(F.lit(1)), "n"))
    return ctx.withColumnRenamed("share", "a").join(cit.withColumnRenamed("share", "b"), "round").select("round", r6("a", "context_share"), r6("b", "citation_share"), r6(F.try_divide("b", "a"), "ratio"), "n")


@query(f"WITH {_LOO}, u AS (SELECT o.iteration_number, o.is_ai, c.doc_id IS NOT NULL AS cited FROM ovl o LEFT JOIN cited c USING (question_id, iteration_number, run_idx, doc_id)) SELECT coalesce(CAST(iteration_number AS VARCHAR), 'all') AS round, round(avg(CAST(cited AS INT)) FILTER (is_ai), 6) AS ai_rate, round(avg(CAST(cited AS INT)) FILTER (NOT is_ai), 6) AS other_rate, count(*) AS n FROM u GROUP BY GROUPING SETS ((iteration_number), ())")
def citation_rate_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of offered documents that are cited, generated ones and others, by round and pooled."""
    u = V.overlaps(spark, sf_dir, answered(spark, sf_dir)).select(*RUN, "doc_id", "is_ai").join(citations(spark, sf_dir).select(*RUN, "doc_id", F.lit(1).alias("c")), [*RUN, "doc_id"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    g = u.groupingSets([["iteration_number"], []], "iteration_number").agg(F.avg(F.when(F.col("is_ai"), F.col("c"))).alias("a"), F.avg(F.when(~F.col("is_ai"), F.col("c"))).alias("b"), n(F.count(F.lit(1)), "n"))
    return g.select(F.coalesce(F.col("iteration_number").cast("string"), F.lit("all")).alias("round"), r6("a", "ai_rate"), r6("b", "other_rate"), "n")


@query(f"WITH {_RANK}, m(m) AS (VALUES (1), (2), (4), (8), (1000)), t AS (SELECT m, iteration_number, avg(CAST(is_ai AS INT)) AS top_share FROM ranked JOIN m ON k <= m GROUP BY ALL), c AS (SELECT iteration_number, avg(CAST(is_ai AS INT)) AS share FROM ranked GROUP BY 1) SELECT CAST(m AS BIGINT) AS m, iteration_number, round(top_share, 6) AS top_share, round(share, 6) AS context_share, round(top_share / nullif(share, 0), 6) AS amplification FROM t JOIN c USING (iteration_number)")
def prefilter_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much commoner AI documents are among the top M by overlap than in the context, for several M."""
    r = ranked(spark, sf_dir).groupBy("iteration_number", "k").agg(F.sum(F.col("is_ai").cast("int")).alias("ai"), F.count(F.lit(1)).alias("c"))  # a few rows; all widths come from them
    share = F.sum("ai") / F.sum("c")
    widths = F.explode(F.filter(F.array(*[F.lit(m) for m in (1, 2, 4, 8, 1000)]), lambda m: m >= F.col("k")))
    t = r.withColumn("m", widths).groupBy("m", "iteration_number").agg(share.alias("t"))
    c = F.sum(F.when(F.col("m") == 1000, F.col("t"))).over(Window.partitionBy("iteration_number"))  # the widest holds all
    return t.withColumn("c", c).select(n(F.col("m"), "m"), "iteration_number", r6("t", "top_share"), r6("c", "context_share"), r6(F.try_divide("t", "c"), "amplification"))


_KEY = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_PROV = f"k AS (SELECT page_id, {_KEY} AS key FROM pages), det AS (SELECT key, max(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END) AS ai FROM k WHERE page_id % 2 = 0 GROUP BY 1), p AS (SELECT page_id, k.key, CASE WHEN ai IS NULL THEN 'unknown' WHEN ai = 1 THEN 'ai' ELSE 'human' END AS provenance FROM k LEFT JOIN det ON k.key = det.key)"


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages labelled through a detector's table of normalised urls; unlisted ones are unknown."""
    k = V.table(spark, sf_dir, "pages").select("page_id", T.url_key(F.col("url")).alias("key"))
    det = k.where("page_id % 2 = 0").groupBy("key").agg(F.max((F.col("page_id") % 3 == 0).cast("int")).alias("ai"))
    return k.join(det, "key", "left").select("page_id", "key", F.when(F.col("ai").isNull(), "unknown").when(F.col("ai") == 1, "ai").otherwise("human").alias("provenance"))


@query(f"WITH {_PROV} SELECT page_id, key, provenance FROM p")
def url_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(spark, sf_dir)
