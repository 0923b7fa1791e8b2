"""Dense numbering in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandplan.plans.session import written


def _dealt(df: DataFrame, *order) -> DataFrame:
    """``df`` written in ranges of an order: ``_part`` is the range, ``_at`` the place in it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % F.lit(1 << 33)}), "numbered")


def sums_before(df: DataFrame, value: str | dict[str, str], *order, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before, 0 for the first, in an order that is total.

    ``value`` may be a dict of several columns and the names of their sums. Sums run inside ranges of the order,
    side by side; only one total a range meets in a window.
    """
    sums = value if isinstance(value, dict) else {value: name}
    placed = _dealt(df, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_n{k}") for k, v in enumerate(sums)])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_n{k}").over(before), F.lit(0)).alias(f"_first{k}") for k in range(len(sums))])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({f"_inside{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in enumerate(sums)})
    joined = placed.join(F.broadcast(totals), "_part")  # a row a range
    joined = joined.withColumns({n: F.col(f"_first{k}") + F.col(f"_inside{k}") for k, n in enumerate(sums.values())})
    return joined.drop("_part", "_at", *[f"_{x}{k}" for x in ("first", "inside") for k in range(len(sums))])


def dense_ids(df: DataFrame, *order, name: str = "id", start: int = 0) -> DataFrame:
    """``df`` with ``name``: consecutive numbers from ``start`` in the given order.

    Rows are dealt by ranges of the order and sorted inside them; a row's number is its place in its range plus
    the rows of the ranges before. Only one count a range meets in a window. The order should be total: rows
    that tie are numbered either way.
    """
    placed = _dealt(df, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.join(F.broadcast(ranges.select("_part", "_first")), "_part")  # a row a partition
    return joined.withColumn(name, F.col("_first") + F.col("_at") + start).drop("_part", "_at", "_first")


def places_in(df: DataFrame, group: str, *order, name: str = "place") -> DataFrame:
    """``df`` with ``name``: each row's place, from 1, among the rows of its ``group`` (never null) in a total order.

    Rows are dealt by ranges of group and order, so a group of any size is spread over tasks; a row's place is
    its distance from the group's first row of the range plus the group's rows of the ranges before.
    """
    placed = _dealt(df, F.col(group), *order)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy(group, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.join(spans.select(group, "_part", "_from", "_first"), [group, "_part"])
    return joined.withColumn(name, F.col("_first") + F.col("_at") - F.col("_from") + 1).drop("_part", "_at", "_from", "_first")
