"""Inverted lists over vectors: trained centroids, rows in the list of their nearest one, searches that look into a few lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.functions import stats
from loopscope.operators.retrieval import top_k
from loopscope.plans import views as V
from loopscope.plans.lineage import stored
from loopscope.plans.registry import n, query, r6

#: Lists for each square root of the rows, and at most; rows a list that centroids are trained on; rounds of training.
LISTS_PER_ROOT, MOST_LISTS, TRAINED, ROUNDS = 4, 65_536, 256, 4
#: Lists that a search looks into.
PROBES = 64
#: Inner products that a task holds at once, whatever the rows of a batch and the lists.
AT_ONCE = 1_000_000
#: Rows of a list, and queries that look into it, that meet in one group.
BLOCK = 4096


def n_lists(rows: int) -> int:
    """How many lists a table of so many rows gets: a list and the centroids both grow with the root of the table."""
    return max(1, min(MOST_LISTS, rows, math.ceil(LISTS_PER_ROOT * math.sqrt(rows))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def nearest(e: np.ndarray, centroids: np.ndarray, k: int = 1) -> np.ndarray:
    """Rows x k: the centroids with the largest inner products (to nine places), equal ones in order; AT_ONCE products at a time."""
    out, rows = np.empty((len(e), min(k, len(centroids))), "i8"), max(1, AT_ONCE // max(1, len(centroids)))
    for i in range(0, len(e), rows):
        dots = e[i : i + rows] @ centroids.T
        np.round(dots, 9, out=dots)
        out[i : i + rows] = dots.argmax(1)[:, None] if k == 1 else np.argsort(np.negative(dots, out=dots), axis=1, kind="stable")[:, :k]
    return out


def train(rows: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length, by `rounds` rounds of spherical k-means from the `lists` rows that come first by hash.

    Trained on about TRAINED rows a list, drawn by hash; a smaller table is used whole. Each round, a task sums its rows by centroid;
    what is shuffled and reaches the driver is centroids, at most MOST_LISTS. A centroid without rows stays.
    """
    rows = rows.select(F.col("vec_id"), F.col("embedding")).where("embedding is not null")
    total = rows.count()
    if total > TRAINED * lists:
        rows = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * TRAINED * lists / total))
    first = rows.orderBy(stats.keyed_order(F.lit(19), F.col("vec_id")), "vec_id").limit(lists).select("embedding").collect()
    if not first:
        return np.zeros((0, 0))
    c = np.array([r[0] for r in first], "f8")
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(c)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            at = sent.value
            total, count = np.zeros(at.shape), np.zeros(len(at), "i8")
            for b in batches:
                if len(b):
                    e = _matrix(b.column(0))
                    near = nearest(e, at)[:, 0]
                    np.add.at(total, near, e)
                    count += np.bincount(near, minlength=len(at))
            some = np.flatnonzero(count)
            place = np.tile(np.arange(at.shape[1], dtype="i4"), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, at.shape[1])), pa.array(place), pa.array(total[some].ravel())], names=["list", "place", "x"])

        got = rows.select("embedding").mapInArrow(sums, "list long, place int, x double").groupBy("list", "place").agg(F.sum("x").alias("x")).toArrow()
        new = np.zeros_like(c)
        new[got["list"].to_numpy(), got["place"].to_numpy()] = got["x"].to_numpy()
        size = np.sqrt((new * new).sum(1))
        c = np.where(size[:, None] > 0, np.round(new / np.where(size > 0, size, 1)[:, None], 6), c)
    return c


def probes(rows: DataFrame, centroids: np.ndarray, k: int) -> DataFrame:
    """rows (vec_id, embedding) and `list`, once for each of the k lists whose centroids are nearest."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for b in batches:
            if len(b):
                near = nearest(_matrix(b.column(1)), at, min(k, len(at)))
                of = pa.array(np.repeat(np.arange(len(b)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(near.ravel().astype("i8"))], names=["vec_id", "embedding", "list"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", "embedding").where("embedding is not null").mapInArrow(assign, f"vec_id long, embedding {kind}, list long")


def build(rows: DataFrame, lists: int | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The table of lists, written in the order of its lists, and the centroids."""
    centroids = train(rows, lists or n_lists(rows.count()), rounds)
    if not len(centroids):
        return rows.select("vec_id", "embedding", F.lit(0).cast("long").alias("list")).limit(0), centroids
    return stored(probes(rows, centroids, 1).repartitionByRange("list").sortWithinPartitions("list")), centroids


def best_of(q: np.ndarray, e: np.ndarray, itself: np.ndarray, null: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of queries x rows, but for pairs that `itself` marks: query, row and inner product (summed in order; masked where null) of all pairs that can be among a query's k best once products are rounded to nine places.

    Pairs that `null` marks have no product and come last.
    A matrix product draws the line, with a margin for the rounding and for its own order of summing. Of pairs of one query with equal products only
    the k first by vec_id are given, so copies do not add up.
    """
    with np.errstate(all="ignore"):
        dots = np.where(itself | null, -np.inf, np.nan_to_num(q @ e.T, nan=np.inf, posinf=np.inf, neginf=-np.inf))  # NaN is the largest, as in Spark
        size = lambda x: np.sqrt((np.where(np.isfinite(x), x, 0) ** 2).sum(1))
        margin = 2e-9 + 4 * q.shape[1] * np.finfo("f8").eps * size(q) * size(e).max(initial=0)
        least = np.partition(dots, -k, axis=1)[:, -k] if len(e) > k else np.full(len(q), -np.inf)
        of, at = np.nonzero((dots >= np.where(np.isfinite(least), least - margin, least)[:, None]) & ~itself)
        x = np.zeros(len(of))
        for i in range(q.shape[1]):
            x += q[of, i] * e[at, i]
    none = null[of, at]
    x[none] = 0
    same = np.stack([of, none, x.view("i8")])
    order = np.lexsort((vec_id[at], *same[::-1]))
    fresh = np.flatnonzero(np.r_[True, (same[:, order[1:]] != same[:, order[:-1]]).any(0)][: len(of)])
    order = order[np.arange(len(of)) - np.repeat(fresh, np.diff(np.r_[fresh, len(of)])) < k]
    return of[order], at[order], np.ma.array(x, mask=none)[order]


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, looked: int = PROBES) -> DataFrame:
    """query_id, vec_id, score (inner product), rank, n_scanned: each query's k best rows in its `looked` nearest lists, but itself.

    A list meets the queries that look into it as one matrix product, AT_ONCE products at a time; long lists, and those that many queries look into, are
    dealt out in blocks of about BLOCK a side. A query costs the rows of its lists, which n_scanned counts. Equal scores in order of
    vec_id. Rows without a vector take no part; a query whose lists hold no other row has no result.
    """
    if not len(centroids):
        return index.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("n_scanned")).limit(0)
    q = probes(queries, centroids, looked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "list")
    held = index.groupBy("list").agg(F.count(F.lit(1)).alias("c"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = F.broadcast(held.join(q.groupBy("list").agg(F.count(F.lit(1)).alias("a")), "list").select("list", blocks("c").alias("held"), blocks("a").alias("asked")))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = q.where("query_id is not null").join(sizes, "list").select("list", block("query_id", "asked").alias("i"), every("held").alias("j"), "query_id", "q")
    rows = index.where("vec_id is not null").join(sizes, "list").select("list", every("asked").alias("i"), block("vec_id", "held").alias("j"), "vec_id", "embedding")

    def meet(asking: pa.Table, rows: pa.Table) -> pa.Table:
        of, at, x = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.ma.array(np.zeros(0))]
        query, vec = (t.column(c).to_numpy() for t, c in ((asking, "query_id"), (rows, "vec_id")))
        if len(query) and len(vec):
            left, right = (t.column(c).combine_chunks() for t, c in ((asking, "q"), (rows, "embedding")))
            null = [v.flatten().is_null().to_numpy(False).reshape(len(v), -1).any(1) for v in (left, right)]
            left, right = _matrix(left), _matrix(right)
            step = max(1, AT_ONCE // len(vec))
            for i in range(0, len(query), step):
                a, b, s = best_of(left[i : i + step], right, query[i : i + step, None] == vec, null[0][i : i + step, None] | null[1], vec, k)
                of.append(a + i)
                at.append(b)
                x.append(s)
        return pa.table({"query_id": query[np.concatenate(of)], "vec_id": vec[np.concatenate(at)], "score": pa.array(np.ma.concatenate(x))})

    keys = ["list", "i", "j"]
    s = asking.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double").withColumn("score", F.round("score", 9))
    cost = q.select("query_id", "list").join(F.broadcast(held), "list").groupBy("query_id").agg(F.sum("c").alias("n_scanned"))
    return top_k(s, ["query_id"], k).join(cost, "query_id").select("query_id", "vec_id", "score", "rank", "n_scanned")


# -- the query --------------------------------------------------------------------------------------------------------


def _trained(rounds: int) -> str:
    """Centroids and their lists as SQL: v (vec_id, e), c<rounds> (c, ce)."""
    sql = f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), many AS (SELECT greatest(1, least(count(*), CAST(ceil({LISTS_PER_ROOT} * sqrt(count(*))) AS BIGINT))) AS k FROM v), c0 AS (SELECT c, ce FROM (SELECT row_number() OVER (ORDER BY md5(concat_ws('|', 19, vec_id)), vec_id) - 1 AS c, e AS ce FROM v), many WHERE c < k)"
    for i in range(rounds):
        sql += f", n{i} AS (SELECT vec_id, any_value(e) AS e, arg_min(c, (-round(list_inner_product(e, ce), 9), c)) AS c FROM v, c{i} GROUP BY vec_id), s{i} AS (SELECT c, i, sum(e[i]) AS x FROM (SELECT c, e, unnest(range(1, len(e) + 1)) AS i FROM n{i}) GROUP BY ALL), l{i} AS (SELECT c, list(x ORDER BY i) AS m, sqrt(sum(x * x)) AS z FROM s{i} GROUP BY c)"
        sql += f", c{i + 1} AS (SELECT c, CASE WHEN z > 0 THEN list_transform(m, lambda x: round(x / z, 6)) ELSE ce END AS ce FROM c{i} LEFT JOIN l{i} USING (c))"
    return sql


_IVF = f"{_trained(ROUNDS)}, near AS (SELECT vec_id, e, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(e, ce), 9) DESC, c) AS k FROM v, c{ROUNDS}), sizes AS (SELECT c, count(*) AS n FROM near WHERE k = 1 GROUP BY c), cost AS (SELECT vec_id AS query_id, sum(n) AS n_scanned FROM near JOIN sizes USING (c) WHERE k <= {PROBES} GROUP BY 1)"


@query(f"WITH {_IVF}, s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_inner_product(q.e, d.e), 9) AS score FROM near q JOIN near d ON d.c = q.c AND d.k = 1 WHERE q.k <= {PROBES} AND q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, CAST(n_scanned AS BIGINT) AS n_scanned FROM s JOIN cost USING (query_id) QUALIFY rank <= 5")
def inverted_lists_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner-product search over trained inverted lists, their number growing with the root of the table: five best of every fiftieth row, and what it cost."""
    v = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    got = search(*build(v), v.where("vec_id % 50 = 0"), 5)
    return got.select("query_id", "vec_id", r6("score", "score"), n(F.col("rank"), "rank"), n(F.col("n_scanned"), "n_scanned"))
