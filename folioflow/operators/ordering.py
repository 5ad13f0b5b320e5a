"""Order-dependent operators that no single task has to hold a group for.

Rows are range-partitioned by group and order, sorted within partitions and numbered; what the partitions before
hold is added from a table with one row per partition. A group with a third of all rows is spread over
a third of the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import bounded_broadcast, cut

_IN_PARTITION = (1 << 33) - 1


def sequenced(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``seq``, the row's number from 1 in the given order, and ``part``, its range.

    The order should be total; rows that tie in all of it get numbers in any order. The result is materialised, because ranges
    are drawn from a sample and must not change between two reads.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("_row")))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return numbered.join(bounded_broadcast(before), "part").withColumn("seq", F.col("_before") + F.col("_row") + 1).drop("_before", "_row")


def running(rows: DataFrame, value: Column, name: str, kind: str = "sum") -> DataFrame:
    """Sequenced ``rows`` with the running ``sum`` or ``max`` of a value up to and with the row; null counts as nothing."""
    combine = F.sum if kind == "sum" else F.max
    valued = rows.withColumn(name, value)
    totals = valued.groupBy("part").agg(combine(name).alias("_total"))  # a row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", combine("_total").over(earlier).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # a range of rows, not a group
    own = combine(name).over(inside)
    joined = valued.withColumn(name, own).join(bounded_broadcast(before), "part")
    both = F.coalesce(F.col(name) + F.col("_before"), F.col(name), F.col("_before")) if kind == "sum" else F.greatest(F.col(name), F.col("_before"))
    return joined.withColumn(name, both).drop("_before")


def ranked(df: DataFrame, group: str, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the row's number within its group in the given order; null groups count as one group."""
    rows = sequenced(df, F.col(group), *order)
    first = rows.groupBy(F.col(group).alias("_g")).agg((F.min("seq") - 1).alias("_first"))
    return rows.join(bounded_broadcast(first), F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("seq") - F.col("_first")).drop("_g", "_first", "seq", "part")


def with_previous(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Sequenced ``rows`` with ``previous_<column>`` of the row before in the same group; null for a group's first row, and for rows of no group.

    The row before lies in the same range, or is the last one of the range before, of which there is one per range: no row is joined with another.
    """
    picked = F.struct(F.col(group).alias("_g"), *[F.col(c).alias(c) for c in columns])
    inside = Window.partitionBy("part").orderBy("seq")  # a range of rows, not a group
    last = rows.groupBy("part").agg(F.max_by(picked, "seq").alias("_last"))
    edges = last.select("part", F.lag("_last").over(Window.orderBy("part")).alias("_edge"))  # a row per range
    joined = rows.withColumn("_before", F.lag(picked).over(inside)).join(bounded_broadcast(edges), "part", "left")
    both = joined.withColumn("_before", F.coalesce("_before", "_edge"))
    same = F.col(group) == F.col("_before")["_g"]
    return both.withColumns({f"previous_{c}": F.when(same, F.col("_before")[c]) for c in columns}).drop("_before", "_edge")
