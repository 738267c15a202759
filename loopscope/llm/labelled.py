"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents of each class that a classifier is fitted on, and bytes of their texts at most.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 32_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = SAMPLE_DOCS, seed: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """text and y (0 or 1) of about `most` labelled documents of each class, and how many labelled ids each class has.

    Ids are drawn by hash, so reruns agree. Labels that are null or no number from {0, 1} and null ids are left out;
    an id with several labels counts with the larger one, and of the texts of a repeated id the one with the smallest
    hash is taken. The drawn ids (at most about 2 x `most`) are broadcast, so only their texts are shuffled. In the
    order of another hash, documents are taken whole as long as SAMPLE_BYTES of their class are not exceeded.
    """
    own = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    sizes = {int(r["y"]): r["count"] for r in own.groupBy("y").count().collect()}
    if not sizes:
        return docs.select("text", F.lit(0).alias("y")).limit(0), sizes
    odds = F.create_map(*[F.lit(x) for y, c in sizes.items() for x in (y, min(1.0, most / c))])[F.col("y")]
    ids = own.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < odds * 1_000_000)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")
    texts = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    size = F.sum(F.octet_length("t.text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    return texts.withColumn("size", size).where(F.col("size") <= SAMPLE_BYTES).select("t.text", "y"), sizes


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, y), by Newton's method on the weighted likelihood with a weak prior."""
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = x.T @ (weight * (y - p)) - np.array([1e-2 * a, 1e-2 * b])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2
        da, db = np.linalg.solve(h, g)
        size = max(1.0, abs(da) / 2, abs(db) / 2)
        a, b = a + da / size, b + db / size
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)
