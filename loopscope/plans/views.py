"""Canonical views over the driver's tables: runs, questions, context documents, entities, gold answers, vectors, citations.

Each is a whole table seen under the names of a feedback experiment: groups of ten conversations ask one question in
ten runs; forty documents are a question's context of four rounds with ten slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.functions import text as T

#: A capitalised word of four ASCII letters or more; no word boundaries, since engines differ on them beside other letters.
ENTITY = r"[A-Z][a-z]{3,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.selectExpr("conv_id div 10 as question_id", "(turn + 1) div 2 as iteration_number", "conv_id % 10 as run_idx", "text as answer")


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as text metrics read them: an answer that is null or empty is a fixed phrase."""
    return runs(spark, sf_dir).withColumn("answer", T.answer_or_default(F.col("answer")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.groupBy(F.expr("conv_id div 10").alias("question_id")).agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.struct("conv_id", F.col("turn").isNull(), "turn"))).alias("question_text"))


def context_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id div 40 as question_id", "(doc_id div 10) % 4 + 1 as iteration_number", "doc_id % 10 as slot", "doc_id as row_id", "doc_id % 3 = 0 as is_ai", "source", "text")
    return d.withColumn("doc_id", F.concat_ws("_", F.when(F.col("is_ai"), "gen").otherwise("ref"), F.col("iteration_number"), F.col("slot")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of four letters or more stand in for a run's entities."""
    e = F.array_distinct(F.regexp_extract_all("answer", F.lit(ENTITY), F.lit(0)))
    return runs(spark, sf_dir).select("question_id", "iteration_number", "run_idx", F.transform(e, F.lower).alias("ents"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's gold answer: the first word of four letters or more of its benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.lower(F.regexp_extract("text", r"[A-Za-z]{4,}", 0)).alias("gold"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id div 100 as question_id", "vec_id", "label", "embedding")


def overlaps(spark: SparkSession, sf_dir: str, answers: DataFrame | None = None) -> DataFrame:
    """Every answer (the recorded ones unless given) against every context document of its question and round: an equi-join, token sets made once a side."""
    a = (runs(spark, sf_dir) if answers is None else answers).withColumn("a_set", T.token_set(F.col("answer"))).select("question_id", "iteration_number", "run_idx", "a_set")
    d = context_docs(spark, sf_dir).withColumn("d_set", T.token_set(F.col("text"))).select("question_id", "iteration_number", "slot", "doc_id", "is_ai", "d_set")
    return a.join(d, ["question_id", "iteration_number"]).withColumn("overlap", T.overlap(F.col("a_set"), F.col("d_set"))).drop("d_set")


def pairs(df: DataFrame, *keys: str, by: str = "run_idx") -> DataFrame:
    """Unordered pairs of rows with equal keys; the other columns come twice, ending in _a and _b."""
    rest = [c for c in df.columns if c not in keys]
    a = df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in rest])
    b = df.select(*keys, *[F.col(c).alias(f"{c}_b") for c in rest])
    return a.join(b, list(keys)).where(F.col(f"{by}_a") < F.col(f"{by}_b"))


# -- the same views for the oracle engine ---------------------------------------------------------------------------

RUNS = "runs AS (SELECT conv_id // 10 AS question_id, (turn + 1) // 2 AS iteration_number, conv_id % 10 AS run_idx, text AS answer FROM conversations WHERE role = 'assistant')"
GIVEN = RUNS.replace("text AS answer", f"CASE WHEN text IS NULL OR text = '' THEN '{T.NO_ANSWER}' ELSE text END AS answer")
QUESTIONS = "questions AS (SELECT conv_id // 10 AS question_id, arg_min(text, (conv_id, turn)) AS question_text FROM conversations WHERE role = 'user' GROUP BY 1)"
DOCS = (
    "docs AS (SELECT doc_id // 40 AS question_id, (doc_id // 10) % 4 + 1 AS iteration_number, doc_id % 10 AS slot, doc_id AS row_id, doc_id % 3 = 0 AS is_ai, source, text, "
    "concat_ws('_', CASE WHEN doc_id % 3 = 0 THEN 'gen' ELSE 'ref' END, (doc_id // 10) % 4 + 1, doc_id % 10) AS doc_id FROM documents)"
)
ENTS = RUNS + r", ents AS (SELECT question_id, iteration_number, run_idx, list_distinct(list_transform(regexp_extract_all(answer, '[A-Z][a-z]{3,}'), lambda x: lower(x))) AS ents FROM runs)"
GOLD = "gold AS (SELECT item_id AS question_id, lower(regexp_extract(text, '[A-Za-z]{4,}')) AS gold FROM benchmark)"


def sql_words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9'']+'), lambda t: lower(t))"


def sql_tokens(x: str) -> str:
    return f"list_distinct(list_filter({sql_words(x)}, lambda t: length(t) >= 4))"


def sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(translate(regexp_replace(lower({x}), '\b(a|an|the)\b', ' ', 'g'), '{T.PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '\s+', ' ', 'g'))"


def sql_contains(x: str, entity: str) -> str:
    n = sql_norm(entity)
    return f"({n} <> '' AND contains(' ' || {sql_norm(x)} || ' ', ' ' || {n} || ' '))"


def sql_share(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


def sql_overlap(a: str, d: str) -> str:
    return sql_share(f"len(list_intersect({a}, {d}))", f"len({a})")


OVERLAPS = (
    f"{RUNS}, {DOCS}, a AS (SELECT question_id, iteration_number, run_idx, {sql_tokens('answer')} AS a_set FROM runs), "
    f"d AS (SELECT question_id, iteration_number, slot, doc_id, is_ai, {sql_tokens('text')} AS d_set FROM docs), "
    f"ovl AS (SELECT a.question_id, a.iteration_number, run_idx, a_set, slot, doc_id, is_ai, {sql_overlap('a_set', 'd_set')} AS overlap FROM a JOIN d USING (question_id, iteration_number))"
)

#: Valid substitutes of every question in order of appearance (ok), and what an injection plants (injected).
CANDIDATES = f"{ENTS}, {QUESTIONS}, {GOLD}, l AS (SELECT *, list_transform(regexp_extract_all(answer, '[A-Z][a-z]{{3,}}'), lambda x: lower(x)) AS l FROM runs), cand AS (SELECT question_id, min(iteration_number * 10000000 + run_idx * 1000000 + pos) AS pos, e AS candidate FROM (SELECT question_id, iteration_number, run_idx, unnest(l) AS e, unnest(range(0, len(l))) AS pos FROM l) GROUP BY question_id, e), ok AS (SELECT question_id, pos, candidate, gold FROM cand JOIN gold USING (question_id) JOIN questions USING (question_id) WHERE {sql_norm('candidate')} <> '' AND NOT contains({sql_norm('candidate')}, {sql_norm('gold')}) AND NOT contains({sql_norm('gold')}, {sql_norm('candidate')}) AND NOT {sql_contains('question_text', 'candidate')}), sub AS (SELECT question_id, candidate, row_number() OVER (PARTITION BY question_id ORDER BY pos, candidate) AS rank FROM ok)"
TARGETS = f"{CANDIDATES}, injected AS (SELECT question_id, gold, max(CASE WHEN rank = 1 THEN candidate END) AS target, max(CASE WHEN rank = 2 THEN candidate END) AS implied FROM gold LEFT JOIN sub USING (question_id) WHERE gold <> '' GROUP BY 1, 2)"
