"""Tables replayed as streams: what the streams give equals what the whole tables say."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.plans import views as V
from loopscope.plans.lineage import folder
from loopscope.plans.registry import n, query
from loopscope.streaming import rounds

CELL = ["question_id", "iteration_number"]
#: Files of answers a batch.
FILES = 8


def _base(spark: SparkSession) -> str:
    return f"{folder(spark)}/loopscope/stream-{uuid.uuid4().hex}"


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of events by hour and type from a stream of the events' table; every batch writes all windows as they stand."""
    base = _base(spark)
    events = V.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value"))
    events.write.parquet(f"{base}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/events")
    counts = rounds.windowed_counts(stream)
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/out")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{base}/out")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", n(F.col("n"), "n"), F.round("total", 4).alias("total"))


@query(f"WITH {V.RUNS}, w AS (SELECT question_id, iteration_number, unnest({V.sql_words('answer')}) AS w FROM runs), g AS (SELECT question_id, iteration_number, count(DISTINCT run_idx) AS n_runs FROM runs GROUP BY ALL) SELECT g.question_id, g.iteration_number, count(DISTINCT w) AS unique_words, any_value(n_runs) AS n_runs FROM g LEFT JOIN w USING (question_id, iteration_number) GROUP BY 1, 2")
def streamed_round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique words and runs of each round from a stream of answers' files, some files a batch; a question's round lies in one file."""
    base = _base(spark)
    runs = V.runs(spark, sf_dir)
    runs.repartition(*CELL).write.parquet(f"{base}/answers")  # many tasks write, and none reads a round whole
    stream = rounds.answer_stream(spark, f"{base}/answers", runs.schema, FILES)
    rounds.start_round_metrics(stream, f"{base}/out", f"{base}/state").awaitTermination()
    got = spark.read.schema("question_id long, iteration_number long, unique_words long, n_runs long, epoch int").parquet(f"{base}/out")
    return got.select("question_id", "iteration_number", "unique_words", "n_runs")
