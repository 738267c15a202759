"""Sinks: nested experiment JSON, metric tables, manifests, append with resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(rounds: DataFrame) -> DataFrame:
    """One row a question with its rounds in order, as the experiment files have them."""
    i = F.struct("iteration_number", "documents", "runs")
    return rounds.groupBy("question_id", "question_text").agg(F.array_sort(F.collect_list(i)).alias("iterations"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table at path does not have yet; how many there were."""
    from pyspark.errors import AnalysisException

    try:
        new = df.join(df.sparkSession.read.schema(df.schema).parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException:
        new = df
    new = new.select(*df.columns).persist()
    count = new.count()
    if count:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return count


def candidate_id(prompt: str) -> Column:
    """Short stable id of a prompt."""
    return F.concat(F.lit("c_"), F.substring(F.sha2(F.col(prompt), 256), 1, 8))
