"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import itertools
import math
import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, named, staged

#: Units that one flight task takes at a time.
GROUP_UNITS = 4096
#: A table of sources is broadcast up to this many rows.
BROADCAST_SOURCES = 10_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: share x all sizes split by the repeating weights, in code-point order (null last).

    A target stops at `most` times its source's size; the excess goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out, left, open_ = {}, share * sum(size.values()), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * size[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def flight(size: list[int], p: list[float], rng: random.Random) -> list[int]:
    """Move p in place inside the null space of (size, 1): sums of size*p and of p stay; returns what is still fractional (at most 2).

    Three units are active at a time. The null vector of their 2 x 3 constraint matrix is the cross product of its
    rows; a step along it goes to one of the two faces of the unit cube, with odds that keep every expectation.
    """
    eps = 1e-9
    live: list[int] = []
    rest = iter(i for i, x in enumerate(p) if eps < x < 1 - eps)
    while True:
        for i in rest:
            live.append(i)
            if len(live) == 3:
                break
        if len(live) < 2:
            return live
        if len(live) == 3:
            a, b, c = (size[i] for i in live)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1, -1, 0)
        elif size[live[0]] == size[live[1]]:
            u = (1, -1)
        else:
            return live
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(live, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(live, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(live, u):
            p[i] += step * d
            if p[i] < eps:
                p[i] = 0.0
            elif p[i] > 1 - eps:
                p[i] = 1.0
        live = [i for i in live if 0.0 < p[i] < 1.0]


def landing(size: list[int], p: list[float], live: list[int], rng: random.Random) -> None:
    """Settle the few units left: the 0/1 choice with the least token error, then the least document error."""
    want, docs = sum(size[i] * p[i] for i in live), sum(p[i] for i in live)
    best = min(itertools.product((0.0, 1.0), repeat=len(live)), key=lambda c: (abs(sum(size[i] * x for i, x in zip(live, c)) - want), abs(sum(c) - docs), rng.random()))
    for i, x in zip(live, best):
        p[i] = x


def _fly(seed: int, last: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_h", "ascending"), ("_size", "ascending"), ("_unit", "ascending")])
        size, p = t["_size"].to_pylist(), t["_p"].to_pylist()
        rng = random.Random(f"{seed}|{t['_source'][0].as_py()!r}|{t['_group'][0].as_py()}|{last}")
        live = flight(size, p, rng)
        if last:
            landing(size, p, live, rng)
        return t.set_column(t.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target and copies (0, 1, 2, ...) of every row of docs.

    A source with target = r x size takes each document floor(r) times and once more with probability r - floor(r).
    The cube method draws these last copies. Rows of a source are dealt by hash to groups of about GROUP_UNITS; a
    flight in each group leaves at most two fractional units, which meet in new groups, level by level, until one
    group a source is left, whose landing settles the last two. So a source with a third of all rows is as many
    bounded tasks as its rows ask for, and the token error of a source stays near one document's size. Units that
    are alike in source, doc_id and size are told apart by a number (or by `row`), so an id that a third of the rows
    hold, or none, is dealt out like any other.

    One row per source reaches the driver (sources are the mix's configuration, not data). Draws depend on the seed
    and the rows' values alone, so reruns agree. Null texts and texts without words have size 0 and take part (0
    words whatever is drawn); a null source is a source of its own, after all others; null and repeated doc_ids and
    repeated rows are units of their own; an empty table gives an empty result; other columns are ignored, except
    that `row`, a key of the single rows, is carried along and comes last.
    """
    key = [row] if row else []
    rows = docs.select(*map(named, key), named(doc_id).alias("_unit"), named(source).alias("_source"), F.coalesce(F.regexp_count(named(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    rows = staged(rows, "mix-sizes")
    totals = [tuple(r) for r in rows.groupBy("_source").agg(F.sum("_size"), F.count(F.lit(1))).collect()]
    goal = targets([(s, n) for s, n, _ in totals], weights, share, most)
    book = []
    for s, n, c in totals:
        r = goal[s] / n if n else 0.0
        whole = math.floor(r + 1e-12)
        book.append((s, n, float(goal[s]), whole, max(0.0, r - whole), -(-c // GROUP_UNITS)))
    spark = docs.sparkSession
    book_df = spark.createDataFrame(book, "_s string, source_size long, target double, _whole int, _frac double, _groups int")
    if len(book) <= BROADCAST_SOURCES:
        book_df = F.broadcast(book_df)
    number = F.col(row) if row else F.col("_number")
    if not row:  # alike rows are counted and made again with numbers, a bounded lot of them at a time
        alike = rows.groupBy("_source", "_unit", "_size").agg(F.count(F.lit(1)).alias("_c"))
        lots = alike.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_c - 1) div {GROUP_UNITS}"))))
        lots = lots.repartition(F.col("_unit"), F.col("_size"), F.col("_lot"))
        own = F.least(F.col("_c") - F.col("_lot") * GROUP_UNITS, F.lit(GROUP_UNITS))
        rows = lots.withColumn("_number", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), own - 1), lambda i: i + F.col("_lot") * GROUP_UNITS))).drop("_c", "_lot")
    h = F.xxhash64("_unit", "_size", number)
    units = rows.join(book_df, F.col("_source").eqNullSafe(F.col("_s")), "left").select(*key, "_source", "_unit", "_size", h.alias("_h"), F.pmod(h, F.col("_groups").cast("long")).alias("_group"), F.col("_frac").alias("_p"))
    done, level = [], units
    groups = max((b[5] for b in book), default=1)
    while True:
        level = level.groupBy("_source", "_group").applyInArrow(_fly(seed, groups == 1), units.schema)
        if groups > 1:
            level = staged(level, "mix-flight")
        done.append(level if groups == 1 else level.where("_p = 0 or _p = 1"))
        if groups == 1:
            break
        level = level.where("_p > 0 and _p < 1").withColumn("_group", F.floor(F.col("_group") / (GROUP_UNITS // 2)).cast("long"))
        groups = -(-groups // (GROUP_UNITS // 2))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.join(book_df, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return out.select(F.col("_unit").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (F.col("_whole") + F.col("_p").cast("int")).alias("copies"), *key)
