"""Next departure after a label, per pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.operators.skew import OrderedScan, hot_row_limit, rows_and_bound


def next_departure(labels: DataFrame, departures: DataFrame, pattern: Sequence[str]) -> DataFrame:
    """First departure at or after ``ready`` per label and pattern of its stop.

    ``labels(label_id, stop_id, ready)``, ``departures(stop_id, pattern..., time, seq, trip_id)``.
    Labels and departures of one stop and pattern are put in one time order, labels first at equal
    times, and each label takes the departure that follows it, so no label meets all departures.
    """
    keys = ["stop_id", *pattern]
    served = departures.select(*keys).distinct()
    asks = labels.join(served, "stop_id").select(
        *keys, F.col("ready").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("label_id").alias("a"),
        F.lit(0).cast("long").alias("b"), F.lit(None).cast("struct<time:bigint,seq:bigint,trip_id:bigint>").alias("dep"))
    buses = departures.select(
        *keys, F.col("time").cast("double").alias("at"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("a"),
        F.col("trip_id").cast("long").alias("b"),
        F.struct(*[F.col(c).cast("long").alias(c) for c in ("time", "seq", "trip_id")]).alias("dep"))
    # No key has more rows than its stop has labels and it has departures itself, which are counted before they meet.
    most = rows_and_bound(labels, ["stop_id"])[1] + rows_and_bound(departures, keys)[1]
    blocked = False if most <= hot_row_limit(labels.sparkSession) else None
    scan = OrderedScan(asks.unionByName(buses), keys, ["at", "kind", "a", "b"], blocked).fill_next("next", F.col("dep"))
    return scan.frame().where("kind = 0 and next is not null").select(
        F.col("a").alias("label_id"), *keys, "next.time", "next.seq", "next.trip_id")


def downstream_stops(boards: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stops after the boarding one: ``boards(trip_id, board_seq, ...)`` with ``seq, stop_id, arrival``."""
    return boards.join(stop_times.select("trip_id", "seq", "stop_id", "arrival"), "trip_id").where("seq > board_seq")
