"""Round metrics over a stream of answers: each micro-batch updates the rounds it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loopscope.functions import text as T


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def answer_stream(spark: SparkSession, path: str, schema: str | StructType, files: int | None = None) -> DataFrame:
    """Answers as their files arrive, `files` a batch or all that are there."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def start_round_metrics(answers: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append unique words and answers of every micro-batch's rounds; a batch that runs again overwrites its own folder.

    Answers meet by question and round with their own different words, so a task holds its share of the rounds and no more.
    """
    cell = ["question_id", "iteration_number"]
    parts = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def metrics(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(*cell, "run_idx", F.array_distinct(T.words(F.col("answer"))).alias("w")).repartition(parts, *cell)  # a number, else few tasks hold what words unfold to
        words = rows.select(*cell, F.explode_outer("w").alias("w")).distinct().groupBy(*cell).agg(F.count("w").alias("unique_words"))
        runs = rows.select(*cell, "run_idx").distinct().groupBy(*cell).agg(F.count("run_idx").alias("n_runs"))
        m = words.withColumnsRenamed({c: f"_{c}" for c in cell}).join(runs, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in cell]).select(*cell, "unique_words", "n_runs")
        m.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return answers.writeStream.foreachBatch(metrics).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
