"""Places of rows in a total order, for any number of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopscope.plans.lineage import stored

#: Rows of a partition are numbered from its own id times 2 to this power.
ROW_BITS = 33


def numbered(df: DataFrame, *order: Column, name: str = "place", keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """df and each row's place in the order, from 1: sorted range partitions, counted, each offset by those before it.

    No window over the table: a partition numbers its own rows, and what is summed in one place is a row a partition.
    `keep` writes the sorted rows down, so that counting and numbering see the same ones. Rows that are equal in the order
    share a partition; give a last key that tells them apart where they may be many. No rows give no rows.
    """
    at, part, before, first = (f"_{name}_{x}" for x in ("at", "part", "before", "n"))
    rows = keep(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, ROW_BITS))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias(first))
    sums = sizes.select(part, F.coalesce(F.sum(first).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    place = F.col(at).bitwiseAND((1 << ROW_BITS) - 1) + F.col(before) + 1
    return rows.join(F.broadcast(sums), part).withColumn(name, place).drop(at, part, before)
