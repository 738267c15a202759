"""What several training-data operators share: staged tables, ordered buckets, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

#: Words of a text: everything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where it is unset, one of our own, which only a local master can share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="loopscope-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000
#: Folders of staged tables that are still there.
_MADE: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/loopscope/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables are staged: what comes after can be dropped with drop_staged()."""
    return len(_MADE)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever the session's file systems reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete the staged tables from `since` on; only for when what was made of them has been written."""
    while len(_MADE) > since:
        drop(spark, _MADE.pop())


def unused(columns: list[str], name: str) -> str:
    """A name that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def aside(df: DataFrame, column: str, rest: list[str]) -> tuple[DataFrame, list[StructField]]:
    """One column first and the rest after it under names of our own, which clash with none; and the fields of the rest."""
    small_batches(df.sparkSession)
    rows = df.select(named(column).alias("first"), *[named(c).alias(f"c{i}") for i, c in enumerate(rest)])
    return rows, [StructField(c, f.dataType) for c, f in zip(rest, rows.schema.fields[1:])]


def fold(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def small_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch, where the session does not say: texts are long, and a batch is held by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own default
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def bounds_tree(value: Column, bounds: list, base: int = 0) -> Column:
    """Number of bounds (ascending) at or below value, as a balanced CASE tree: log2(len) comparisons a row, JVM-side."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(value >= F.lit(bounds[mid]), bounds_tree(value, bounds[mid + 1 :], base + mid + 1)).otherwise(bounds_tree(value, bounds[:mid], base))


def quantile_bounds(df: DataFrame, col: str, rows_per_bucket: int, most: int = 256) -> list:
    """Distinct ascending bounds that cut col into buckets of about rows_per_bucket rows; at most `most` of them.

    Reads one narrow column; what reaches the driver is the list itself.
    """
    n = df.where(F.col(col).isNotNull()).count()
    parts = min(most, -(-n // rows_per_bucket))
    if parts < 2:
        return []
    qs = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(col, qs, 20 * parts).alias("b")).first()["b"]
    return sorted(set(got or []))
