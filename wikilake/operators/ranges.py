"""Positions of rows in their group without a window over the group.

Rows are dealt by ranges of (group, order), numbered inside their range, and each range gets
the number of the group's rows in the ranges before it. A group may hold any share of the
table: it is many ranges, and only one row per (range, group) is ever put in order at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged

ROWS_PER_RANGE = 500_000


def numbered(rows: DataFrame, group: list[str], order: list[str], n_rows: int, out: str = "pos") -> DataFrame:
    """``rows`` with ``out`` (0, 1, ... in each group by ``order``, nulls first). ``rows``
    should be a stored table, for it is read twice; equal rows are numbered in any order."""
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-n_rows // ROWS_PER_RANGE))
    by = [F.col(c).asc_nulls_first() for c in group + order]
    dealt = staged(rows.repartitionByRange(width, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    in_range = F.shiftright("_at", 33)  # the upper bits are the partition
    counts = dealt.groupBy(*group, in_range.alias("_range")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))  # rows: ranges
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    shifts = staged(counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_range", shift.alias("_shift")))
    same = F.col("_range") == in_range
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return dealt.join(shifts, same).withColumn(out, F.col("_at") + F.col("_shift")).select(*rows.columns, out)


def last_before(rows: DataFrame, group: list[str], order: list[str], value: str, n_rows: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the last ``value`` that is not null at the row or before it in
    its group (by ``order``, nulls first; ``order`` must tell the rows of a group apart)."""
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-n_rows // ROWS_PER_RANGE))
    by = [F.col(c).asc_nulls_first() for c in group + order]
    dealt = staged(rows.repartitionByRange(width, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))
    place = F.struct(*order)
    ends = dealt.filter(F.col(value).isNotNull()).groupBy(*group, "_range").agg(F.max_by(value, place).alias("_end"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = dealt.select(*group, "_range").distinct().join(ends, [*group, "_range"], "left")
    carried = staged(every.select(*group, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")))
    inside = Window.partitionBy(*group, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    return here.join(carried, [*group, "_range"], "left").withColumn(out, F.coalesce(out, "_carried")).select(*rows.columns, out)


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], value: str, n_rows: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the row and those before it in its
    group (by ``order``, nulls first; ``order`` must tell the rows of a group apart)."""
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-n_rows // ROWS_PER_RANGE))
    by = [F.col(c).asc_nulls_first() for c in group + order]
    dealt = staged(rows.repartitionByRange(width, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = staged(sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"),
                                 F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried")))
    inside = Window.partitionBy(*group, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumn(out, F.sum(value).over(inside))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return here.join(carried, same).withColumn(out, F.col(out) + F.col("_carried")).select(*rows.columns, out)
