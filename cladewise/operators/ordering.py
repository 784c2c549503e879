"""Row numbers and running sums over whole tables, without a task that sees all rows."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions import storage


def running(rows: DataFrame, order: list[Column | str], amount: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of `amount` over all rows before it in order.

    Rows go to range partitions; each sums up within itself, and on top come the sums of
    the partitions before it, one row for each partition. Equal rows in one order may
    come in any order. Partitions with their sums are written to the shared folder first:
    computed twice, a range partition need not hold the same rows.
    """
    keyed = rows.withColumn("_amount", amount)
    dealt = keyed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    placed = storage.materialised(placed, "running")
    sums = placed.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_part", F.coalesce(F.sum("_sum").over(every), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn(name, (F.col("_base") + F.col("_before")).cast("long")).drop("_part", "_before", "_base", "_amount")


def numbered_within(rows: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """rows with their number within their group, from 0; a group of any size is spread over many tasks."""
    every = numbered(rows, [group, *order], "_every")
    first = every.groupBy(F.col(group).alias("_group")).agg(F.min("_every").alias("_first"))
    return every.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_every") - F.col("_first")).drop("_every", "_group", "_first")


def numbered(rows: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """rows with their number in order, from 0."""
    return running(rows, order, F.lit(1), name)
