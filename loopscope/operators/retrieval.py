"""Chunking, vector top-k, merging, re-ranking and context building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import stats, vectors
from loopscope.functions import text as T
from loopscope.plans import views as V
from loopscope.plans.registry import n, query, r6

CELL = ["question_id", "iteration_number"]
#: Documents of a stratified sample.
SAMPLED = 100
_V = "v AS (SELECT vec_id // 100 AS question_id, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT question_id, arg_min(e, vec_id) AS qe, min(vec_id) AS query_id FROM v GROUP BY 1), s AS (SELECT v.question_id, query_id, vec_id, label, list_cosine_similarity(e, qe) AS score FROM v JOIN q USING (question_id) WHERE vec_id <> query_id)"


def top_k(scored: DataFrame, keys: list[str], k: int, score: str = "score", tie: str = "vec_id") -> DataFrame:
    """The k best rows of every key with their rank; equal scores by the tie column. Spark prunes to k a partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every candidate with its question's query (the smallest vec_id): an equi-join by question, never all against all."""
    v = V.vectors(spark, sf_dir)
    q = v.groupBy("question_id").agg(F.min_by("embedding", "vec_id").alias("qe"), F.min("vec_id").alias("query_id"))
    return v.join(q, "question_id").where("vec_id <> query_id").withColumn("score", F.round(vectors.cosine(F.col("embedding"), F.col("qe")), 9))


@query(f"WITH {_V} SELECT question_id, query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scored_vectors(spark, sf_dir), ["question_id"], 10).select("question_id", "query_id", "vec_id", r6("score", "score"), n(F.col("rank"), "rank"))


@query(f"WITH {_V}, u AS (SELECT question_id, vec_id % 25 AS doc, vec_id, score FROM s WHERE vec_id % 2 = 0 UNION ALL SELECT question_id, vec_id % 25, vec_id, score FROM s WHERE vec_id % 2 = 1), d AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc ORDER BY round(score, 9) DESC, vec_id) AS k FROM u), t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM d WHERE k = 1) SELECT question_id, doc, vec_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10")
def merged_topk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached and generated candidates in one list, the best of each document, then the top."""
    s = scored_vectors(spark, sf_dir).withColumn("doc", F.col("vec_id") % 25)
    u = s.where("vec_id % 2 = 0").unionByName(s.where("vec_id % 2 = 1"))
    best = top_k(u, ["question_id", "doc"], 1).drop("rank")
    return top_k(best, ["question_id"], 10).select("question_id", "doc", "vec_id", r6("score", "score"), n(F.col("rank"), "rank"))


def within(score: Column, lo: Column, hi: Column, p_ai: Column, strength: float) -> Column:
    """Score between lo and hi as 0 to 1 (1 where these are equal) less its share for AI text."""
    return F.when(hi - lo <= 1e-9, 1.0).otherwise((score - lo) / (hi - lo)) * (1 - strength * p_ai)


def penalized(score: Column, p_ai: Column, by: list[str], strength: float) -> Column:
    """Min-max normalised score (1 where all are equal) less its share for AI text."""
    w = Window.partitionBy(*by)
    return within(score, F.min(score).over(w), F.max(score).over(w), p_ai, strength)


@query(f"WITH {_V}, f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, vec_id) AS k FROM s), m AS (SELECT *, min(round(score, 9)) OVER (PARTITION BY question_id) AS lo, max(round(score, 9)) OVER (PARTITION BY question_id) AS hi FROM f WHERE k <= 20), p AS (SELECT question_id, vec_id, round(CASE WHEN hi - lo <= 1e-9 THEN 1 ELSE (round(score, 9) - lo) / (hi - lo) END * (1 - 0.7 * CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END), 9) AS penalized FROM m) SELECT question_id, vec_id, round(penalized, 6) AS penalized, row_number() OVER (PARTITION BY question_id ORDER BY penalized DESC, vec_id) AS rank FROM p QUALIFY rank <= 10")
def penalized_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = top_k(scored_vectors(spark, sf_dir), ["question_id"], 20).drop("rank")
    p = fetched.withColumn("penalized", F.round(penalized(F.col("score"), F.when(F.col("label") % 3 == 0, 1.0).otherwise(0.0), ["question_id"], 0.7), 9))
    return top_k(p, ["question_id"], 10, "penalized").select("question_id", "vec_id", r6("penalized", "penalized"), n(F.col("rank"), "rank"))


@query(r"WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 500) / 450.0)) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0), t AS (SELECT doc_id, k, regexp_replace(substring(text, k * 450 + 1, 500), '^\s+|\s+$', '', 'g') AS t FROM c) SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(t)) AS BIGINT) AS n_chars, md5(string_agg(md5(t), '' ORDER BY k)) AS digest FROM t WHERE t <> '' GROUP BY 1")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents, told by their number, length and a digest of all in order."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c"))
    g = d.groupBy("doc_id").agg(n(F.count(F.lit(1)), "n_chunks"), n(F.sum(F.length("c.text")), "n_chars"), F.array_sort(F.collect_list(F.struct("c.chunk_index", F.md5("c.text").alias("m")))).alias("l"))
    return g.select("doc_id", "n_chunks", "n_chars", F.md5(F.array_join(F.transform("l", lambda x: x["m"]), "")).alias("digest"))


@query(f"WITH {V.DOCS}, o AS (SELECT question_id, iteration_number, row_number() OVER (PARTITION BY question_id, iteration_number ORDER BY slot) AS pos, is_ai, text FROM docs) SELECT question_id, iteration_number, count(*) AS n_docs, md5(string_agg('Context ' || pos || CASE WHEN is_ai THEN ' - 100% AI-Generated' ELSE ' - 0% AI-Generated' END || chr(10) || text, chr(10) || chr(10) ORDER BY pos) FILTER (text <> '')) AS digest FROM o GROUP BY ALL")
def context_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt's context: documents numbered by position, empty ones left out but counted."""
    d = V.context_docs(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy(*CELL).orderBy("slot")))
    label = F.concat(F.lit("Context "), F.col("pos").cast("string"), F.lit(" - "), F.bround(F.when(F.col("is_ai"), 100.0).otherwise(0.0), 0).cast("int").cast("string"), F.lit("% AI-Generated\n"), F.col("text"))
    g = d.groupBy(*CELL).agg(n(F.count(F.lit(1)), "n_docs"), F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", label.alias("t"))))).alias("l"))
    return g.select(*CELL, "n_docs", F.md5(F.array_join(F.transform("l", lambda x: x["t"]), "\n\n")).alias("digest"))


@query(f"WITH {V.DOCS}, g AS (SELECT *, row_number() OVER (PARTITION BY question_id, is_ai ORDER BY iteration_number DESC, slot) AS k FROM docs) SELECT question_id, doc_id, row_id FROM g WHERE (is_ai AND k <= 5) OR (NOT is_ai AND k <= 3)")
def hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next context: the five newest generated documents and three references."""
    w = Window.partitionBy("question_id", "is_ai").orderBy(F.desc("iteration_number"), "slot")
    g = V.context_docs(spark, sf_dir).withColumn("k", F.row_number().over(w))
    return g.where("(is_ai and k <= 5) or (not is_ai and k <= 3)").select("question_id", "doc_id", "row_id")


@query(f"WITH {V.DOCS}, r AS (SELECT question_id, iteration_number AS round, unnest(range(0, 10)) AS slot FROM (SELECT DISTINCT question_id, iteration_number FROM docs)), d AS (SELECT question_id, slot, iteration_number, row_id FROM docs WHERE is_ai) SELECT r.question_id, r.round, r.slot, max(row_id) AS row_id FROM r JOIN d ON r.question_id = d.question_id AND r.slot = d.slot AND d.iteration_number <= r.round GROUP BY ALL")
def replace_one_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot's content at each round is the newest generated document for that slot: a running maximum, without a loop."""
    d = V.context_docs(spark, sf_dir)
    r = d.select("question_id", F.col("iteration_number").alias("round")).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("slot", F.col("slot").cast("long"))
    g = d.where("is_ai").groupBy("question_id", F.col("iteration_number").alias("round"), "slot").agg(F.max("row_id").alias("row_id"))
    w = Window.partitionBy("question_id", "slot").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.join(g, ["question_id", "round", "slot"], "left").withColumn("row_id", F.max("row_id").over(w)).where("row_id is not null").select("question_id", "round", "slot", "row_id")


@query(f"WITH {V.RUNS}, s AS (SELECT question_id, iteration_number, list_sort(list(length(answer))) AS sig FROM runs GROUP BY ALL), f AS (SELECT question_id, iteration_number, sig = lag(sig, 1) OVER w AND sig = lag(sig, 2) OVER w AND sig = lag(sig, 3) OVER w AS stop FROM s WINDOW w AS (PARTITION BY question_id ORDER BY iteration_number)) SELECT question_id, min(iteration_number) FILTER (stop) AS converged_at FROM f GROUP BY 1")
def convergence_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First round that ends four in a row with equal sorted answer lengths; null where none does."""
    s = V.runs(spark, sf_dir).groupBy(*CELL).agg(F.array_sort(F.collect_list(F.length("answer"))).alias("sig"))
    last = Window.partitionBy("question_id").orderBy("iteration_number").rowsBetween(-3, Window.currentRow)
    s = s.withColumn("same", F.size(F.collect_set("sig").over(last)) == 1).withColumn("rounds", F.count(F.lit(1)).over(last))
    return s.groupBy("question_id").agg(F.min(F.when(F.col("same") & (F.col("rounds") == 4), F.col("iteration_number"))).alias("converged_at"))


_STRATA = "k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 7, doc_id)), doc_id) AS k FROM documents)"


@query(f"WITH {_STRATA} SELECT doc_id, source, k AS rank FROM k WHERE k <= (SELECT greatest(1, {SAMPLED} // count(DISTINCT coalesce(source, ''))) FROM documents)")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAMPLED documents over all sources, as many of each as go into it evenly (one at least), drawn by hash."""
    w = Window.partitionBy("source").orderBy(stats.keyed_order(F.lit(7), F.col("doc_id")), "doc_id")
    d = V.table(spark, sf_dir, "documents").select("doc_id", "source")
    cap = F.broadcast(d.agg(F.greatest(F.lit(1), F.floor(F.lit(SAMPLED) / F.countDistinct(F.coalesce("source", F.lit(""))))).alias("cap")))  # one row
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SAMPLED).crossJoin(cap).where("rank <= cap").select("doc_id", "source", n(F.col("rank"), "rank"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', 3, doc_id)), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= CAST(floor(n * 0.6) AS BIGINT) THEN 'train' WHEN k <= CAST(floor(n * 0.6) AS BIGINT) + CAST(floor(n * 0.2) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM r")
def split_60_20_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 / 20 / 20 by rank in hash order: ranks are counted inside hash buckets, whose offsets are a table of 4,096 rows, so nothing is sorted in one task."""
    h = stats.keyed_order(F.lit(3), F.col("doc_id"))
    d = V.table(spark, sf_dir, "documents").select("doc_id", h.alias("h")).withColumn("b", F.substring("h", 1, 3))
    c = d.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({"off": F.coalesce(F.sum("c").over(before), F.lit(0)), "n": F.sum("c").over(Window.partitionBy())})
    d = d.join(F.broadcast(c), "b").withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("h", "doc_id")) + F.col("off"))
    train, val = F.floor(F.col("n") * 0.6), F.floor(F.col("n") * 0.2)
    return d.select("doc_id", F.when(F.col("k") <= train, "train").when(F.col("k") <= train + val, "val").otherwise("test").alias("split"))
