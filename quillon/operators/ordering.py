"""Ranks and running sums over a whole table without gathering it in one task.

Rows are range-partitioned and sorted, each partition numbers its own, and the totals of
the partitions (one row each) give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.holding import held


def _spread(df: DataFrame, order: list) -> DataFrame:
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # held: the bounds of a range partitioning are sampled, so they must not be drawn twice
    return held(ordered.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))


def running_sums(df: DataFrame, order: list, **values) -> DataFrame:
    """For each ``name=value``, the sum of ``value`` over all rows up to and including each, as column ``name``."""
    rows = _spread(df.withColumns({f"__v_{n}": v for n, v in values.items()}), order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values))
    offsets = totals.select("__part", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values))
    upto = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(offsets), "__part")  # one row a partition
    return rows.select(*df.columns, *((F.sum(f"__v_{n}").over(upto) + F.col(f"__b_{n}")).alias(n) for n in values))


def running_sum(df: DataFrame, value: str, order: list, name: str = "used") -> DataFrame:
    """Sum of ``value`` over all rows up to and including each."""
    return running_sums(df, order, **{name: F.col(value)})


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Position of each row from 1 in the whole order, as a long."""
    rows = _spread(df, order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__total"), F.min("__at").alias("__first"))
    offsets = totals.select("__part", (F.coalesce(F.sum("__total").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    rows = rows.join(F.broadcast(offsets), "__part")  # one row a partition
    return rows.select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))


def dealt(df: DataFrame, key: str, of: DataFrame, units: list[tuple[Column, int]]) -> DataFrame:
    """``df``, made of ``of``, dealt by ``key`` to so many tasks that each has about the stated number of every unit of ``of`` at most; a key stays whole.

    Left to itself Spark would join small shuffle blocks, by bytes that say little of what windows over them hold.
    """
    told = of.agg(*(F.sum(c).alias(f"u{i}") for i, (c, _) in enumerate(units))).first()
    need = max(-(-int(told[f"u{i}"] or 0) // most) for i, (_, most) in enumerate(units))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, need), key)
