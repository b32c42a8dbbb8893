"""Places and runs in an order, for groups of any size.

A window over a group is one task's work. Here rows are range-partitioned by group and order and kept as a table; windows run inside its parts, and parts are compared by a summary that has
one row for each group and part, so a group that holds a third of all rows is spread over tasks like any other rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislegrid.sources.shared import settled


def parted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows as a table with the number of their range of (keys, order) as `part`; rows that are equal in both share a part."""
    return settled(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "parts")


def _with(rows: DataFrame, summary: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """rows with columns of the summary; null keys are equal."""
    its = summary.select(*[F.col(k).alias(f"its_{k}") for k in keys], *columns)
    same = reduce(Column.__and__, [rows[k].eqNullSafe(its[f"its_{k}"]) for k in keys])
    return rows.join(its, same).drop(*[f"its_{k}" for k in keys])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place (from 1) among those of equal keys, in the order of `order`, which must tell the rows of a group apart. No keys: among all rows."""
    there = parted(rows, keys, order)
    at = ["part", *keys]
    sizes = there.groupBy(*at).agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*at).orderBy(*order)) + F.col("ahead")
    return _with(there, sizes, at, "ahead").withColumn(name, place).drop("part", "ahead")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """rows with the number (from 0) of their run: rows of equal keys that follow each other in `order` with the same value share one. Nulls are equal; `order` must tell the rows of a group apart."""
    there = parted(rows, keys, order)
    at = ["part", *keys]
    w = Window.partitionBy(*at).orderBy(*order)
    changed = (F.row_number().over(w) > 1) & ~F.lag(value).over(w).eqNullSafe(F.col(value))
    there = there.withColumn("changed", changed.cast("int"))
    place, its = F.struct(*order), F.struct(value)
    ends = there.groupBy(*at).agg(F.min_by(its, place).alias("first"), F.max_by(its, place).alias("last"), F.sum("changed").alias("changes"))
    parts = Window.partitionBy(*keys).orderBy("part")
    joint = F.lag("last").over(parts).isNotNull() & ~F.lag("last").over(parts).eqNullSafe(F.col("first"))
    ends = ends.withColumn("joint", joint.cast("int"))
    until, before = parts.rowsBetween(Window.unboundedPreceding, 0), parts.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("ahead", F.sum("joint").over(until) + F.coalesce(F.sum("changes").over(before), F.lit(0)))
    inside = F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _with(there, ends, at, "ahead").withColumn(name, inside + F.col("ahead")).drop("part", "changed", "ahead")
