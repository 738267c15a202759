"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import named, staged

#: Rows the medians and the dimension are taken from; every row is indexed.
SAMPLE_ROWS = 4096
#: Rows of one forest, and queries of one pass over the index.
BLOCK_ROWS, PASS_QUERIES = 65_536, 16_384
#: Trees, and bits of their hash strings; both together fill the 64-bit entries of one sorted array.
TREES, BITS = 64, 57
#: Bits of a longest prefix that are told apart.
MATCH = 16
#: A query measures at least LEAST vectors of a block and SHARE of it, out of REACH times as many that the trees bring up.
LEAST, SHARE, REACH = 1024, 0.16, 5.6
OUT = "query_id long, vec_id long, score double, measured long"


def _matrix(ids: pa.ChunkedArray, vecs: pa.ChunkedArray, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part: not null, of the dimension, without null or non-finite components, not all zero."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    size = vecs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(np.bincount(size[size > 0]).argmax()) if (size > 0).any() else 0
    ok = (size == dim) & ids.is_valid().to_numpy(zero_copy_only=False) & (dim > 0)
    at = pa.array(np.flatnonzero(ok))
    flat = vecs.take(at).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype("f8").reshape(-1, max(dim, 1))  # null components turn into nan
    good = np.isfinite(x).all(1) & x.any(1)
    return ids.take(at).to_numpy(zero_copy_only=False).astype("i8")[good], x[good]


class Forest:
    """Trees of sorted hash strings over the distinct vectors of one block, all in one array: a tree's number, then the string.

    A string has one bit per random direction: on which side of the sample's median a vector's projection lies.
    A query descends every tree at once to its longest prefix match, by binary search. From the longest of all, trees
    ascend together, a bit at a time: each step widens every tree's range to the strings that share one bit less with
    the query, until the ranges hold enough different vectors. Of these the ones that share the longest prefixes in
    most trees are measured.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, plan: dict):
        order = np.lexsort((ids,))
        ids, x = ids[order], np.ascontiguousarray(x[order])
        keyed = x + 0.0  # -0.0 and 0.0 are one value
        _, first, same = np.unique(keyed.view(np.dtype((np.void, keyed.dtype.itemsize * keyed.shape[1]))).ravel(), return_index=True, return_inverse=True)
        rank = np.argsort(first)  # distinct vectors by their smallest id
        back = np.empty_like(rank)
        back[rank] = np.arange(len(rank))
        member = back[same.ravel()]
        self.members = np.argsort(member, kind="stable")
        m, i = member[self.members], ids[self.members]
        self.members = self.members[np.r_[True, (m[1:] != m[:-1]) | (i[1:] != i[:-1])]]  # repeated rows of one id are one
        m = member[self.members]
        self.starts = np.r_[np.searchsorted(m, np.arange(len(rank))), len(m)]
        self.ids, self.x = ids, x[first[rank]]
        self.match = (MATCH - np.ceil(np.log2(np.arange(1 << MATCH) + 1))).astype("i8")  # xor of two strings' first bits -> length of their common prefix
        self.drop = np.uint64(plan["bits"] - MATCH)
        self.bits = plan["bits"]
        code = hashes(self.x, plan)
        order = np.argsort(code, axis=0, kind="stable")
        self.order = order.T.ravel().astype("i4")
        self.sorted = np.take_along_axis(code, order, 0).T.ravel()

    def longest(self, code: np.ndarray) -> int:
        """Length of the longest prefix that a string of any tree shares with the query's, MATCH at most: a neighbour in the sorted array has it."""
        at = np.searchsorted(self.sorted, code)
        apart = np.minimum(self.sorted[np.minimum(at, len(self.sorted) - 1)] ^ code, self.sorted[np.maximum(at, 1) - 1] ^ code)
        return int(self.match[(np.minimum(apart, np.uint64((1 << self.bits) - 1)) >> self.drop).astype("i8")].max())

    def ascend(self, code: np.ndarray, enough: int) -> tuple[np.ndarray, int]:
        """Votes of each vector, one for every tree and level from its longest common prefix up to the level reached, and that level."""
        level = self.longest(code)
        while True:
            drop = np.uint64(self.bits - level)
            low = (code >> drop) << drop
            begin = np.searchsorted(self.sorted, low)
            size = np.searchsorted(self.sorted, low + (np.uint64(1) << drop)) - begin
            if size.sum() >= enough or not level:
                here = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                common = self.match[((self.sorted[here] ^ np.repeat(code, size)) >> self.drop).astype("i8")]
                votes = np.bincount(self.order[here], common - (level - 1), len(self.x))
                if np.count_nonzero(votes) >= enough or not level:
                    return votes, level
            level -= 1

    def search(self, q: np.ndarray, code: np.ndarray, k: int, want: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Up to k different ids other than `own`, and distances, nearest first, ties to smaller ids; and how many vectors were measured."""
        n = len(self.x)
        if n <= want:
            pick = np.arange(n)
        else:
            votes, _ = self.ascend(code, min(int(REACH * want), n))
            pick = np.sort(np.argpartition(-votes, want - 1)[:want])
        ids, dist = self._best(q, pick, k, own)
        if len(ids) < k and len(pick) < n:  # the candidates are rows of a few ids
            pick = np.arange(n)
            ids, dist = self._best(q, pick, k, own)
        return ids, dist, len(pick)

    def _best(self, q: np.ndarray, pick: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Of the vectors at pick, measured exactly; more of them are looked at until there are k ids."""
        d = np.sqrt(((self.x[pick] - q) ** 2).sum(1))
        sort = np.sort(d)
        most = k + 1
        while True:
            near = pick if len(pick) <= most else pick[d <= sort[most - 1]]  # keep ties at the edge
            far = np.sqrt(((self.x[near] - q) ** 2).sum(1))
            held = [self.ids[self.members[self.starts[r] : min(self.starts[r + 1], self.starts[r] + k + 1)]] for r in near]
            ids, dist = np.concatenate(held), np.repeat(far, [len(h) for h in held])
            order = np.lexsort((ids, dist))
            order = order[ids[order] != own] if own is not None else order
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
            if len(order) >= k or len(near) == len(pick):
                return ids[order[:k]], dist[order[:k]]
            most *= 4


def hashes(x: np.ndarray, plan: dict) -> np.ndarray:
    """rows x trees: the tree's number, then `bits` bits, first direction first."""
    out = np.tile(np.arange(plan["trees"], dtype="u8"), (len(x), 1))
    for b in range(plan["bits"]):
        out = (out << np.uint64(1)) | (x @ plan["dirs"][b] > plan["mid"][b])
    return out


def fit(sample: np.ndarray, trees: int, bits: int, seed: int) -> dict:
    if bits < MATCH or bits + max(1, (trees - 1).bit_length()) > 63:
        raise ValueError("trees and strings must fit 63 bits")
    rng = np.random.default_rng(seed)
    dirs = rng.standard_normal((bits, sample.shape[1], trees))
    return {"trees": trees, "bits": bits, "dirs": dirs, "mid": np.stack([np.median(sample @ d, axis=0) for d in dirs])}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, bits: int = BITS, share: float = SHARE, least: int = LEAST, seed: int = 11, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, measured: the k nearest found of each query, by Euclidean distance in double precision, and how many vectors were measured for it.

    Directions and medians come from a bounded sample (about SAMPLE_ROWS by hash of the rows that take part); every row is indexed. Partitions
    of `vectors` are read in place in blocks of BLOCK_ROWS rows, without a shuffle; each block builds its forest and
    answers all queries of a pass: it brings up REACH times the vectors that are then measured exactly, at least
    `least` and `share` of a block, alike at every size of the table: share = 1 measures all, which is exact, and where
    vectors have structure a smaller share finds as much. Queries go out
    PASS_QUERIES at a time, so what is broadcast is bounded however many there are, and each pass's answers (k rows a
    query and block) are written before the next, so plans stay as long as one pass.

    A query's own row is no candidate of it. Ties go to the smaller vec_id; equal vectors are kept once a block with
    their smallest ids, so a vector that a third of the rows hold crowds nothing out. Vectors null, zero, of another
    dimension than most of the sample, or with null or non-finite components take no part, nor do rows without id;
    a query that takes no part has no result. With fewer than k candidates all are returned. Repeated rows of one id
    are one candidate; of several vectors of one query id the smallest, component by component, asks. Empty tables give
    an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(named(vec_id).cast("long").alias("vec_id"), named(embedding).alias("e"))
    qs = queries.select(named(vec_id).cast("long").alias("vec_id"), named(embedding).alias("e")).where("vec_id is not null and e is not null")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, measured long")
    fit_rows = v.where("vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)")
    n = fit_rows.count()
    if not n:
        return empty
    odds = min(1.0, SAMPLE_ROWS / n)
    got = fit_rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < int(odds * 1_000_000) + 1).limit(4 * SAMPLE_ROWS).toArrow()
    _, sample = _matrix(got["vec_id"], got["e"], None)
    if not len(sample):
        return empty
    plan = fit(sample, trees, bits, seed)
    dim = sample.shape[1]
    passes = max(1, -(-qs.count() // PASS_QUERIES))
    found = None
    for i in range(passes):
        some = qs if passes == 1 else qs.where(F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(passes)) == i)
        got = some.toArrow()
        qid, q = _matrix(got["vec_id"], got["e"], dim)
        if not len(qid):
            continue
        order = np.lexsort((*q.T[::-1], qid))
        qid, at = np.unique(qid[order], return_index=True)
        at = order[at]
        sent = spark.sparkContext.broadcast((qid, q[at], plan))

        def answer(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q, plan = sent.value
            code = hashes(q, plan)
            for ids, x in _blocks(batches, q.shape[1]):
                forest = Forest(ids, x, plan)
                want = max(least, int(share * len(forest.x)))
                cols: tuple[list, ...] = ([], [], [], [])
                for j in range(len(qid)):
                    near, dist, measured = forest.search(q[j], code[j], k, want, qid[j])
                    cols[0].append(np.full(len(near) + 1, qid[j]))
                    cols[1].append(np.append(near, -1))
                    cols[2].append(np.append(dist, np.inf))
                    cols[3].append(np.append(np.zeros(len(near), "i8"), measured))
                whole = [np.concatenate(c) for c in cols]
                last = np.isinf(whole[2])  # a row for the count alone
                yield pa.RecordBatch.from_arrays([pa.array(whole[0]), pa.array(whole[1], mask=last), pa.array(whole[2], mask=last), pa.array(whole[3])], names=["query_id", "vec_id", "score", "measured"])

        part = v.mapInArrow(answer, OUT)
        if passes > 1:
            part = staged(part, "neighbours")
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.sum("measured").alias("measured"))
    w = Window.partitionBy("query_id")
    found = found.withColumn("rank", F.row_number().over(w.orderBy(F.asc_nulls_last("score"), "vec_id"))).withColumn("measured", F.sum("measured").over(w))
    return found.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "measured")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for b in batches:
        ids, x = _matrix(b.column(0), b.column(1), dim)
        held.append((ids, x))
        count += len(ids)
        if count >= BLOCK_ROWS:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, count = [], 0
    if count:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
