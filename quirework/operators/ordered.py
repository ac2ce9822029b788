"""Running sums and neighbours over a distributed order.

Rows are dealt into ranges of the order, whose cut points Spark samples. Every range is handled alone and
then shifted by what lies before it: one row per range, however many rows share a group, a bucket of values
or a narrow band of them.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions.common import materialize

RANGES_PER_PARTITION = 4


def _fresh(name: str, df: DataFrame) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name += "_"
    return name


def in_ranges(rows: DataFrame, order: Sequence[Column], name: str, ranges: int | None = None) -> tuple[DataFrame, str]:
    """The rows, written once, with the number of the range each lies in; equal order values share a range."""
    part = _fresh("range_no", rows)
    ranges = ranges or RANGES_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()), name), part


def running_sums(
    rows: DataFrame,
    sums: Mapping[str, str],
    order: Sequence[Column],
    group: Sequence[str] = (),
    name: str = "running",
    ranges: int | None = None,
) -> DataFrame:
    """Add, for each ``new: column`` of ``sums``, the sum of ``column`` over the rows of the same group
    that come earlier in ``order``; 0 for the first one.

    ``order`` should leave no ties, or rows that tie get their sums in any sequence. Null groups are
    groups of their own; a null to be added counts 0. An empty frame stays empty.
    """
    placed, part = in_ranges(rows, [*(F.col(g) for g in group), *order], name, ranges)
    part_before = _fresh("range_before", placed)
    before = {out: _fresh(f"before_{out}", placed) for out in sums}
    totals = placed.groupBy(F.col(part).alias(part_before), *group).agg(*(F.sum(c).alias(before[out]) for out, c in sums.items()))
    earlier_ranges = Window.partitionBy(*group).orderBy(part_before).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        part_before,
        *(F.col(g).alias(f"{part_before}_{i}") for i, g in enumerate(group)),
        *(F.coalesce(F.sum(b).over(earlier_ranges), F.lit(0)).alias(b) for b in before.values()),
    )
    same = F.col(part) == F.col(part_before)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"{part_before}_{i}"))
    earlier = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(out) for out, c in sums.items()))
    return inside.join(offsets, same).select(
        *rows.columns, *((F.col(out) + F.col(before[out])).alias(out) for out in sums)
    )


def with_following(rows: DataFrame, value: str, new: str, name: str = "following", ranges: int | None = None) -> DataFrame:
    """Add ``new``, the value that follows a row's value in ascending order, null for the last; values are
    distinct and not null."""
    placed, part = in_ranges(rows, [F.col(value)], name, ranges)
    part_before, first = _fresh("range_before", placed), _fresh("range_first", placed)
    firsts = placed.groupBy(F.col(part).alias(part_before)).agg(F.min(value).alias("first_here"))
    later = firsts.select(part_before, F.lead("first_here").over(Window.orderBy(part_before)).alias(first))
    inside = Window.partitionBy(part).orderBy(value)
    return (
        placed.withColumn(new, F.lead(value).over(inside))
        .join(later, F.col(part) == F.col(part_before))
        .select(*rows.columns, F.coalesce(F.col(new), F.col(first)).alias(new))
    )
