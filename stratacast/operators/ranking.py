"""Places in a total order, without a window over all rows.

Rows are dealt into ranges of the order and sorted inside each range; a row's
number in its range comes with it, and the ranges' sizes, a row for each range
and group, are summed up in front of it.  So no key, group or table, however
large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def in_ranges(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``df``, written in ranges of ``by`` and then ``order``, with ``_range`` and ``_at``, which ascends within a range.

    Ranges ascend as their numbers do.  Nulls come first.
    """
    keys = [*(by or []), *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = dealt.withColumn("_id", F.monotonically_increasing_id())  # range in the upper bits, number of the row in the lower 33
    return written(placed.withColumns({"_range": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "ranges")


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """``df`` with each row's place from 0 in ``order`` within its group of ``by`` (null is a group) as ``name``.

    Rows that are equal in ``order`` get places of their own, in any order; give further
    columns where that matters.  The result rests on a written table, so reading it twice
    gives the same places.  Columns must not be called ``_range``, ``_at``, ``_g0``, ``_g1``, and so on.
    """
    by = by or []
    rows = in_ranges(df, order, by)
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    held = rows.groupBy(F.col("_range").alias("_r"), *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))  # a row for each range
    sums = held.withColumn("_before", F.coalesce(F.sum("_n").over(before.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = written(sums.select("_r", *names, (F.col("_before") - F.col("_first")).alias("_shift")), "offsets")
    match = F.col("_range") == F.col("_r")
    for c, g in zip(by, names, strict=True):
        match &= rows[c].eqNullSafe(sums[g])
    return rows.join(sums, match).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
