"""Answers generated from contexts, and the same with one document left out, kept in a table so that no rerun is asked for twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.functions import text as T
from loopscope.plans import views as V
from loopscope.plans.lineage import folder

CELL = ["question_id", "iteration_number"]
#: A generator turns (question_id, run_idx, question_text, context array<string>) and whatever else into the same columns and `answer`.
Generator = Callable[[DataFrame], DataFrame]
#: Runs that answer from one context; documents that all of a question's answers prefer.
RUNS, SHARED = 10, 3
#: What a document says first, up to its first full stop, exclamation or question mark.
LEAD = "^[^.!?]*"


def grounded(rows: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model, which other engines can repeat: the first sentences of three documents that the question's hash prefers and of one that the run's prefers, in the order of the context.

    So runs differ a little, and an answer changes where a document that it rests on is left out. No context gives an
    empty answer; null texts say nothing.
    """
    parts = "_parts"
    return _picked(rows, parts).withColumn("answer", F.array_join(F.transform(parts, lambda x: x["s"]), " ")).drop(parts)


def citing(rows: DataFrame) -> DataFrame:
    """The same answers, each followed by the places in the context (from 1) of the documents that it takes its sentences from: what a model says that is asked for its sources."""
    parts = "_parts"
    places = F.array_join(F.transform(parts, lambda x: (x["i"] + 1).cast("string")), ", ")
    return _picked(rows, parts).withColumn("answer", F.concat(F.array_join(F.transform(parts, lambda x: x["s"]), " "), F.lit("\nCITED: ["), places, F.lit("]"))).drop(parts)


def _picked(rows: DataFrame, name: str) -> DataFrame:
    """rows and the chosen documents' places and first sentences, in the order of the context."""
    leads = F.transform("context", lambda t, i: F.struct(i.alias("i"), F.regexp_extract(F.coalesce(t, F.lit("")), LEAD, 0).alias("s")))
    by = lambda *keys: F.array_sort(F.transform("_leads", lambda x: F.struct(stats.keyed_order(*keys, x["s"]).alias("h"), x["i"].alias("i"), x["s"].alias("s"))))
    chosen = F.concat(F.slice(by(F.lit(31), F.col("question_id")), 1, SHARED), F.slice(by(F.lit(37), F.col("question_id"), F.col("run_idx")), 1, 1))
    parts = F.array_sort(F.array_distinct(F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))))
    return rows.withColumn("_leads", leads).withColumn(name, parts).drop("_leads")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, iteration_number, question_text, docs (slot, doc_id, text) of every round whose question has a text."""
    docs = V.context_docs(spark, sf_dir).groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("slot", "doc_id", "text"))).alias("docs"))
    return docs.join(V.questions(spark, sf_dir), "question_id").select(*CELL, "question_text", "docs")


def answers(rounds: DataFrame, generate: Generator = grounded, runs: int = RUNS) -> DataFrame:
    """question_id, iteration_number, run_idx, answer of `runs` runs over each round's whole context."""
    rows = rounds.select(*CELL, "question_text", F.transform("docs", lambda d: d["text"]).alias("context"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))).alias("run_idx"))
    return generate(rows).select(*CELL, "run_idx", "answer")


def elicited(rounds: DataFrame, generate: Generator = citing, runs: int = RUNS) -> DataFrame:
    """question_id, iteration_number, run_idx, doc_id: the documents that answers name themselves, by the last CITED list of each; places that the context lacks are dropped, repeated ones count once."""
    said = answers(rounds, generate, runs).select(*CELL, "run_idx", F.explode(F.array_distinct(T.cited_ids(F.col("answer")))).alias("place"))
    docs = rounds.select(*CELL, F.posexplode("docs").alias("i", "d")).select(*CELL, (F.col("i") + 1).alias("place"), "d.doc_id")
    return said.join(docs, [*CELL, "place"]).select(*CELL, "run_idx", "doc_id")


class Reruns:
    """A table of answers with one document left out, under (question, round, left-out document); it is appended to and never rewritten."""

    SCHEMA = "question_id long, iteration_number long, doc_id string, answer string"
    KEYS = [*CELL, "doc_id"]

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{folder(spark)}/loopscope/reruns-{uuid.uuid4().hex}"

    def known(self) -> DataFrame:
        """What is there; nothing before the first rerun."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def ask(self, rounds: DataFrame, keys: DataFrame, generate: Generator = grounded) -> DataFrame:
        """The reruns of all keys (question_id, iteration_number, doc_id): equal keys run once, those already there not at all.

        A key is answered from its round's context without the document (every one of that id), by one run. Keys without a round or without a
        document left over have no rerun. An append is committed whole or not at all, and what is missing is found
        anew each time, so a job that failed can be run again.
        """
        missing = keys.select(*self.KEYS).distinct().join(self.known(), self.KEYS, "left_anti")
        rows = rounds.join(missing, CELL).withColumn("docs", F.filter("docs", lambda d: ~d["doc_id"].eqNullSafe(F.col("doc_id")))).where(F.size("docs") > 0)
        rows = rows.select(*self.KEYS, "question_text", F.transform("docs", lambda d: d["text"]).alias("context"), F.lit(0).cast("long").alias("run_idx"))
        generate(rows).select(*CELL, "doc_id", "answer").write.mode("append").parquet(self.path)
        return self.known().join(keys.select(*self.KEYS).distinct(), self.KEYS, "left_semi")


# -- the same for the oracle engine -----------------------------------------------------------------------------------

#: said: answers of every round (removed null) and its reruns; lead: what each document says first.
SAID = (
    f"lead AS (SELECT d.question_id, iteration_number, slot, doc_id, regexp_extract(coalesce(text, ''), '{LEAD}') AS s FROM docs d SEMI JOIN questions USING (question_id)), "
    "gone AS (SELECT question_id, iteration_number, slot, s, NULL AS removed FROM lead UNION ALL SELECT l.question_id, l.iteration_number, l.slot, l.s, r.doc_id FROM lead l JOIN lead r USING (question_id, iteration_number) WHERE l.doc_id <> r.doc_id), "
    f"asked AS (SELECT *, unnest(CASE WHEN removed IS NULL THEN range(0, {RUNS}) ELSE [0] END) AS run_idx FROM gone), "
    "picked AS (SELECT *, row_number() OVER (PARTITION BY question_id, iteration_number, removed, run_idx ORDER BY md5(concat_ws('|', 31, question_id, s)), slot) AS k, row_number() OVER (PARTITION BY question_id, iteration_number, removed, run_idx ORDER BY md5(concat_ws('|', 37, question_id, run_idx, s)), slot) AS own FROM asked), "
    f"said AS (SELECT question_id, iteration_number, removed, run_idx, string_agg(s, ' ' ORDER BY slot) AS answer FROM picked WHERE k <= {SHARED} OR own = 1 GROUP BY ALL)"
)
