"""Profiles along an order: climb, cumulative distance, runs of equal value, clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.operators.skew import OrderedScan


def consecutive(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Pairs of neighbouring values: ``keys..., order..., value, next``."""
    return OrderedScan(df, keys, order).lead("next", F.col(value)).frame().where("next is not null").select(*keys, *order, value, "next")


def total_climb(df: DataFrame, keys: Sequence[str], order: Sequence[str], ele: Column) -> DataFrame:
    """Sum of the rises per key."""
    rows = OrderedScan(df.withColumn("_e", ele), keys, order).lag("_p", F.col("_e")).frame()
    rise = F.greatest(F.col("_e") - F.col("_p"), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(rise), F.lit(0.0)).alias("climb"))


def extremes(df: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in columns.items()])


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column, name: str = "total") -> DataFrame:
    return OrderedScan(df, keys, order).running_sum(name, step).frame()


def runs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Stretches of equal value: ``keys..., first, last, value``; neighbours share their boundary row.

    A change on the very last row closes the stretch before it and opens none.
    """
    scan = OrderedScan(df.select(*keys, order, value), keys, [order]).lag("_p", F.col(value))
    rows = scan.frame()
    ends = df.groupBy(*keys).agg(F.max(order).alias("_end"), F.count("*").alias("_n"))
    starts = rows.where(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")
    cut = OrderedScan(starts, keys, [order]).lead("_next", F.col(order)).frame().join(ends, list(keys))
    last = F.coalesce("_next", "_end")
    return cut.where((F.col(order) != F.col("_end")) | (F.col("_n") == 1)).select(
        *keys, F.col(order).alias("first"), last.alias("last"), value)


def between_marks(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Rows from the first start mark up to, but without, the first end mark after it."""
    rows = df.withColumns({"_s": start.cast("int"), "_e": end.cast("int")})
    rows = OrderedScan(rows, keys, order).running_max("_on", F.col("_s")).frame()
    rows = rows.withColumn("_x", F.when(F.col("_on") == 1, F.col("_e")).otherwise(0))
    rows = OrderedScan(rows, keys, order).running_max("_off", F.col("_x")).frame()
    return rows.where("_on = 1 and _off = 0").drop("_s", "_e", "_on", "_x", "_off")
