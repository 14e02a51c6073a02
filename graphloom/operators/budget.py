"""Budgeted selections in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hard_prefix(rows: DataFrame, group: list[str], order: list, length: Column, budget: int) -> DataFrame:
    """Rows before the first one with which the running length exceeds the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(length).over(w)).filter(F.col("running") <= budget)


def soft_prefix(rows: DataFrame, group: list[str], order: list, length: Column, budget: int) -> DataFrame:
    """Rows for which the length before them is below the budget; the last one may exceed it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(length).over(w), F.lit(0))).filter(F.col("before") < budget)


def skip_fold(items: Column, budget: int) -> Column:
    """Ids of an ordered array of (id, n) that fit: one that does not is passed over, later ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))
    fits = lambda a, x: a.used + x.n <= budget
    step = lambda a, x: F.when(fits(a, x), F.struct((a.used + x.n).alias("used"), F.array_append(a.ids, x.id).alias("ids"))).otherwise(a)
    return F.aggregate(items, start, step, lambda a: a.ids)
