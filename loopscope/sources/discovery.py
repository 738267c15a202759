"""Files as data: what lies under a folder, what its paths say, and whether it is whole, told by its ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file's head and tail that are read.
HEAD, TAIL = 8192, 256
# Variants by what a file's name holds, the first that fits, with their method and configuration.
VARIANTS = [
    ("hybrid_paraphrased", "hybrid_paraphrase", "paraphrase", "hybrid"),
    ("replace_one_paraphrased", "replace_one_paraphrase", "paraphrase", "replace_one"),
    ("search_paraphrased", "search_paraphrase", "paraphrase", "search"),
    ("rerank", "rerank", "rerank", None),
    ("agentic_rag", "agentic_rag", "agentic_rag", None),
    ("replace_all", "replace_all", "baseline", "replace_all"),
    ("replace_one", "replace_one", "baseline", "replace_one"),
    ("search", "search", "baseline", "search"),
]


def found(spark: SparkSession, root: str, *patterns: str) -> DataFrame:
    """path, length, modified of all files under a folder, at any depth, whose path fits the first pattern that any path fits (all files without patterns).

    Contents are not read: only the columns that listing gives are asked for. Spark's file sources pass over files without a byte.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    if not patterns:
        return files
    fits = files.withColumn("fit", F.coalesce(*[F.when(F.col("path").rlike(p), i) for i, p in enumerate(patterns)])).where("fit is not null")
    first = F.broadcast(fits.agg(F.min("fit").alias("fit")))  # one row
    return fits.join(first, "fit").drop("fit")


def classified(files: DataFrame, path: str = "path") -> DataFrame:
    """variant, method, config by the last two parts of the path, and the benchmark by the whole of it."""
    low, parts = F.lower(path), F.split(F.lower(path), "/")
    name = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")

    def first(at: int, other: str | None) -> Column:
        out = F.lit(other)
        for v in reversed(VARIANTS):
            out = F.when(F.contains(name, F.lit(v[0])), F.lit(v[at])).otherwise(out)
        return out

    return files.withColumns({"variant": first(1, "misc"), "method": first(2, "misc"), "config": first(3, None), "benchmark": F.when(F.contains(low, F.lit("hotpot")), "hotpotqa").otherwise("other")})


def ends(files: DataFrame, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """path, length, head, tail, bytes_read: the first and last bytes of each file, as text; no file is read between them.

    Files are opened where tasks run, through Arrow's file system for their URI. Bytes that are no UTF-8 are replaced. A file that is gone has null ends.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            out = []
            for uri, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    system, at = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                    with system.open_input_file(at) as f:
                        first = f.read_at(min(head, size), 0)
                        last = f.read_at(min(tail, size), max(0, size - tail))
                    out.append((first.decode("utf-8", "replace"), last.decode("utf-8", "replace"), len(first) + len(last)))
                except FileNotFoundError:
                    out.append((None, None, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=["path", "length", "head", "tail", "bytes_read"])

    return files.select("path", "length").repartition("path").mapInArrow(read, "path string, length long, head string, tail string, bytes_read long")


def line_counts(spark: SparkSession, root: str, **needles: str) -> DataFrame:
    """path and, for each needle, how many lines of the file hold it: lines are counted where they are read, in splits."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).select("value", F.col("_metadata.file_path").alias("path"))
    return lines.groupBy("path").agg(*[F.count(F.when(F.contains("value", F.lit(x)), 1)).alias(k) for k, x in needles.items()])


def validated(spark: SparkSession, root: str, rounds: dict[str, int], runs: int, most_empty: float = 0.1) -> DataFrame:
    """path, variant, method, config, questions, empty_rate, bytes_read, problems of every file of runs.

    The head says how many rounds and runs there are, the tail whether the file was written to its end, and lines how many
    questions and empty answers. A file without answers has only empty ones.
    """
    files = classified(found(spark, root))
    e = ends(files)
    counts = line_counts(spark, root, questions='"question_id"', answers='"answer": "', empty='"answer": ""')
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  the two sources write local paths in two ways
    d = files.withColumn("key", plain("path")).join(e.select(plain("path").alias("key"), "head", "tail", "bytes_read"), "key").join(counts.select(plain("path").alias("key"), "questions", "answers", "empty"), "key", "left").na.fill(0, ["questions", "answers", "empty"])
    number = lambda name: F.nullif(F.regexp_extract("head", rf'"{name}":\s*(\d+)', 1), F.lit("")).cast("int")
    want = F.create_map(*[F.lit(x) for kv in rounds.items() for x in kv])[F.col("variant")]
    rate = F.coalesce(F.try_divide(F.col("empty").cast("double"), F.col("answers")), F.lit(1.0))
    problems = F.array_compact(F.array(
        F.when(~number("num_iterations").eqNullSafe(want), "rounds"),
        F.when(~number("num_runs_per_iteration").eqNullSafe(F.lit(runs)), "runs"),
        F.when(~F.coalesce(F.rtrim(F.regexp_replace("tail", r"\s+$", "")).endswith("}"), F.lit(False)), "truncated"),
        F.when(rate > most_empty, "empty answers"),
    ))
    return d.select("path", "variant", "method", "config", "questions", rate.alias("empty_rate"), "length", "bytes_read", problems.alias("problems"))
