"""The corpus pipeline: language ID, toxicity, near duplicates, mixing, token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.llm import jaccard, langid, mixing, pieces, toxicity
from loopscope.llm.shared import drop, drop_staged, fold, mark, named, shared_dir, staged, unused


def hidden(docs: DataFrame, names: tuple[str, ...]) -> dict[str, str]:
    """Other names for columns of docs that an operator would replace."""
    return {c: unused([*docs.columns, *names], f"_{c}") for c in docs.columns if c in names}


def shown(kept: DataFrame, docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The columns of docs again, in order and under their names."""
    rest = [c for c in kept.columns if c not in names]
    return kept.select(*[named(k).alias(c) for k, c in zip(rest, docs.columns)])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language ID rejects: no letters, or unlike every language learned from docs' own lang column.

    Counts, bounds and scale come from every row with a language and a text, whatever its id: nothing is held out here, unlike in op3. Null, empty
    and letterless texts are rejected. Columns and rows are otherwise untouched, whatever repeats; without anything to
    learn from all are rejected. An empty table stays empty.
    """
    kept = langid.identify(docs.withColumnsRenamed(hidden(docs, langid.ADDED)), langid.train(docs))
    return shown(kept.where(~F.col("rejected")), docs, langid.ADDED)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is 0.7 or more; the field learns from the labels of documents that are still there.

    Null and wordless texts have no toxic words and stay, and so does all where there is nothing to learn from. Rows and
    columns are otherwise untouched.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = toxicity.tag(docs.withColumnsRenamed(hidden(docs, toxicity.ADDED)), toxicity.train(docs, labels, fold("doc_id", 3) != 1))
    return shown(kept.where(F.col("toxicity") < 0.7), docs, toxicity.ADDED)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links join, keep the one with the smallest doc_id (none: last; of equals, the first row).

    Every row is a document of its own, whatever ids repeat or lack, and equal texts link. Null texts and texts
    without words link with nothing and stay. An empty table stays empty; all columns are kept as they are.
    """
    row = unused(docs.columns, "_row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-rows")
    found = jaccard.near_components(rows, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    first = rows.select(row, "doc_id").join(found, row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("kept"))).alias("s"))
    return rows.join(first.select(F.col("s.kept").alias(row)), row, "left_semi").select(*map(named, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: whole copies, 0 to 2.

    Rows are units of their own, whatever ids repeat or lack; null and wordless texts have size 0 and take part; a null
    source is one of its own. An empty table stays empty; all columns are kept as they are.
    """
    row = unused(docs.columns, "_row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    mixed = mixing.mix(rows, row=row).where("copies > 0").select(F.col(row), F.sequence(F.lit(1), F.col("copies")).alias(unused([row], "_times")))
    copies = mixed.columns[1]
    return rows.join(mixed, row).select(*map(named, docs.columns), F.explode(copies).alias(unused(docs.columns, "_copy"))).select(*map(named, docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text that is left, whole; null and empty texts have the begin and end ids alone. Row by row, whatever repeats."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), most=REMEMBERED)


#: Segments and pairs that a worker of the last stage remembers: fewer than the operator's own default, as executors also hold what the stages before have left.
REMEMBERED = 60_000

STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Trained models and sampling are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage leaves in the shared folder goes as soon as the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/loopscope/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        since, path = mark(), f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_staged(spark, since)
        if before:
            drop(spark, before)
        before = path
    return docs
