"""Importance resampling towards a target: documents drawn by how much likelier their hashed word n-grams are under the target than under the corpus."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopscope.plans.places import numbered

from .bytescan import buffers, lower_az, slices, spans
from .chunking import chunked, is_long, letters_and_digits
from .shared import named, small_batches, staged

#: Buckets of features, words of the longest one, and the seed of the draw.
BUCKETS, N, SEED = 10_000, 2, 7
#: Percent of the documents with at least LEAST_WORDS words that are drawn.
SHARE, LEAST_WORDS = 25, 20
#: Words up to this many bytes go through tables, longer ones one by one.
TABLE_BYTES = 32


@lru_cache(1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of crc32, and what 0 to TABLE_BYTES zero bytes make of each byte of a register (lowest first)."""
    t = np.arange(256, dtype="u4")
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype("u4")
    now = np.stack([np.arange(256, dtype="u4") << np.uint32(8 * k) for k in range(4)])
    zeros = [now]
    for _ in range(TABLE_BYTES):
        now = t[now & 255] ^ (now >> np.uint32(8))
        zeros.append(now)
    return t, np.stack(zeros)


def crc_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of byte ranges, a byte of all of them at a time."""
    t, _ = _crc_tables()
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, size = start[order], size[order]
    ones = np.uint32(0xFFFFFFFF)
    crc = np.full(len(at), ones, "u4")
    for i in range(min(int(size[0]), TABLE_BYTES) if len(size) else 0):
        k = int(np.searchsorted(-size, -i, side="left"))  # those with more than i bytes
        crc[:k] = t[(crc[:k] ^ data[at[:k] + i]) & 255] ^ (crc[:k] >> np.uint32(8))
    crc ^= ones
    for i in range(int(np.searchsorted(-size, -TABLE_BYTES, side="left"))):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def joined(a: np.ndarray, b: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of what a is the crc32 of, a space, and the byte ranges, whose own crc32 is b: crc32 is linear, so a is moved over the range's length."""
    t, zeros = _crc_tables()
    a = ~a
    a = ~(t[(a ^ np.uint32(32)) & 255] ^ (a >> np.uint32(8)))
    size = end - start
    k = np.minimum(size, TABLE_BYTES)
    out = b.copy()
    for byte in range(4):
        out ^= zeros[k, byte, (a >> np.uint32(8 * byte)) & 255]
    for i in np.flatnonzero(size > TABLE_BYTES):
        out[i] = zlib.crc32(data[start[i] : end[i]], int(a[i]))
    return out


def features(texts: pa.Array, owned: np.ndarray | None = None, n: int = N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to n words that begins with one of a text's first `owned` words (all without owned), and each text's number of such words."""
    data, off = buffers(texts)
    data = lower_az()[data]
    start, end, doc = spans(data, off, letters_and_digits())
    words = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), "i8")
    own = words if owned is None else np.minimum(words, owned)
    first = np.cumsum(words) - words
    place = np.arange(len(doc)) - first[doc]
    one = crc_words(data, start, end)
    mine, run, out, of = place < own[doc], one, [], []
    for k in range(1, n + 1):
        if k > 1:  # runs of k words from those of k - 1
            tail = np.arange(len(run) - 1) + k - 1
            run = joined(run[:-1], one[tail], data, start[tail], end[tail]) if len(run) > 1 else run[:0]
        keep = mine[: len(run)] & (doc[: len(run)] == doc[k - 1 :]) if len(run) else mine[:0]
        out.append((run[keep] % np.uint32(buckets)).astype("i8"))
        of.append(doc[: len(run)][keep])
    return np.concatenate(out), np.concatenate(of), own


def _dealt(docs: DataFrame, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Short texts where they are, long ones as chunks of their own, dealt out evenly; both with `owned`."""
    long = chunked(docs.where(is_long(text)), text, letters_and_digits(), n - 1)
    return docs.where(~is_long(text)), long.hint("rebalance")


def bucket_counts(docs: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket; a task sums its own before anything is shuffled."""
    small_batches(docs.sparkSession)
    short, long = _dealt(docs.select(named(text).alias("text")), "text", n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for part in slices(batch, 0):
                owned = part.column(1).fill_null(1 << 60).to_numpy()
                total += np.bincount(features(part.column(0), owned, n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    both = short.select("text", F.lit(None).cast("long").alias("owned")).unionByName(long.select("text", "owned"))
    return both.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Of every bucket a thousand times the logarithm of its smoothed share of the target's features over that of the corpus, floored."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, x in ((s, docs), (t, target)):
        got = bucket_counts(x, "text", n, buckets).toArrow()  # a row a bucket at most
        counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()])


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """doc_id, n_words, n_features, gained (the sum of its features' gains) of every row; chunks are summed by document."""
    small_batches(docs.sparkSession)
    buckets, sent = len(gain), docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                owned = part.column(1).fill_null(1 << 60).to_numpy()
                bucket, of, words = features(part.column(0), owned, n, buckets)
                total = np.zeros(len(part), "i8")
                np.add.at(total, of, sent.value[bucket])
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(words.astype("i8")), pa.array(np.bincount(of, minlength=len(part)).astype("i8")), pa.array(total)], names=["row", "doc_id", "n_words", "n_features", "gained"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_words long, n_features long, gained long"
    rows = docs.select(named(text).alias("text"), named(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    short, long = _dealt(rows, "text", n)
    whole = short.select("text", F.lit(None).cast("long").alias("owned"), "row", "doc_id").mapInArrow(weigh, schema).drop("row")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "gained")]
    parts = long.select("text", "owned", "row", "doc_id").mapInArrow(weigh, schema).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums).drop("row")
    return whole.unionByName(parts)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; the rows with a rank are the draw.

    Words are runs of ASCII letters (lower-cased) and digits and of all other characters beyond ASCII; features are runs of 1 to
    n of them, by the crc32 of their bytes in `buckets` buckets. weight is the floored mean of a document's gains towards
    the texts of `target`; score adds Gumbel noise keyed by seed and doc_id, so the highest scores are a draw without
    replacement by weight, and reruns agree. Of the documents with at least `least` words share percent are drawn; rank
    counts from 1 in descending score, ties to the smaller doc_id (none: last).

    Texts over a chunk's size are split at word boundaries with n - 1 words carried, chunks are dealt over all tasks and their
    counts and weights summed by document. To the driver come counts of buckets alone. Ranks come from range
    partitions, so no task holds all rows. Null, empty and wordless texts have no features, weight 0 and no rank. Rows
    are documents of their own: repeated ids have their own rows with equal noise, and equal rows may swap ranks.
    Columns besides doc_id and text are ignored in both tables. Without documents there are no rows; an empty target
    weighs as its smoothing says.
    """
    docs = docs.select(named(doc_id).alias("doc_id"), "text")
    gain = gains(docs, target.select("text"), n, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    weight = F.when(F.col("n_features") > 0, F.expr("(gained - pmod(gained, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = staged(weights(docs, gain, n=n).withColumn("weight", weight).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "scored")
    enough = scored.where(F.col("n_words") >= least)
    drawn = enough.count() * share // 100
    placed = numbered(enough, F.desc("score"), F.asc_nulls_last("doc_id"), F.xxhash64("n_words", "n_features"), F.rand(seed), keep=lambda x: staged(x, "ranks"))
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return ranked.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, ranked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id has a rank, with all their columns; rows without an id are not among them."""
    ids = ranked.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, named(doc_id) == F.col("_drawn"), "left_semi")
