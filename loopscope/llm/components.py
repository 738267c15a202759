"""Connected components of a link table, without collecting anything: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links(a, b).

    A round hooks every larger neighbour to the smallest one (large-star), then every node's smaller neighbours to
    the smallest of them (small-star), until each component is a star around its smallest id. A node's minimum is
    an aggregate with map-side combine, and neighbours are never gathered, so hubs cost no more than their edges.
    Null ends and self-links are dropped; repeated links count once; no links give no rows.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    e = staged(e, "links")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("s")).select(F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct()
        e = staged(e, "stars")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
