"""Linking, splitting, checking and merging of feed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.operators.skew import OrderedScan, in_pieces, last_per_key, salted_join
from reachlake.sources.feed import DAYS, Feed


def agency_key(agency: DataFrame) -> DataFrame:
    """Agencies with ``agency``: the id, or the name where the feed gives no id."""
    return agency.withColumn("agency", F.coalesce("agency_id", "agency_name"))


def split_by_agency(feed: Feed) -> Feed:
    """Feed tables with the owning ``agency``, following routes, trips and their children.

    A feed of one agency keeps everything under it. An agency with any stop time without arrival is
    left out. Rows used by several agencies appear once for each. Routes that name no agency of the
    feed, and so belong to none, are in the table ``unassigned_routes``.
    """
    agencies = agency_key(feed["agency"]).select("agency")
    if agencies.count() <= 1:
        only = agencies.first()
        name = F.lit(only[0] if only else None)
        return feed.replace(**{t: d.withColumn("agency", name) for t, d in feed.tables.items() if t != "agency"})
    routes = feed["routes"].withColumn("agency", F.col("agency_id")).join(agencies, "agency", "left_semi")
    trips = feed["trips"].join(routes.select("route_id", "agency"), "route_id")
    of_trip = trips.select("trip_id", "agency")
    times = salted_join(feed["stop_times"], of_trip, ["trip_id"], ["stop_sequence"])
    broken = times.groupBy("agency").agg(F.bool_or(F.col("arrival_time").isNull()).alias("bad")).where("bad")

    def keep(df: DataFrame) -> DataFrame:
        # One row per agency of the feed at most; the agencies file is a list of operators.
        return df.join(broken.select("agency"), "agency", "left_anti")

    def children(df: DataFrame, key: str, parents: DataFrame) -> DataFrame:
        return keep(df.join(parents, key))

    services = trips.select("service_id", "agency").distinct()
    shapes = trips.select("shape_id", "agency").where("shape_id is not null").distinct()
    stops = times.select("stop_id", "agency").distinct()
    return feed.replace(
        unassigned_routes=feed["routes"].join(agencies, F.col("agency_id") == F.col("agency"), "left_anti"),
        routes=keep(routes), trips=keep(trips), stop_times=keep(times),
        stops=children(feed["stops"], "stop_id", stops),
        calendar=children(feed["calendar"], "service_id", services),
        calendar_dates=children(feed["calendar_dates"], "service_id", services),
        shapes=children(feed["shapes"], "shape_id", shapes),
    )


# Child table and column that must exist in the parent table.
REFERENCES = [
    ("stop_times", "trip_id", "trips", "trip_id"), ("stop_times", "stop_id", "stops", "stop_id"),
    ("frequencies", "trip_id", "trips", "trip_id"), ("transfers", "from_stop_id", "stops", "stop_id"),
    ("transfers", "to_stop_id", "stops", "stop_id"), ("pathways", "from_stop_id", "stops", "stop_id"),
    ("pathways", "to_stop_id", "stops", "stop_id"),
]


def reference_violations(feed: Feed) -> DataFrame:
    """Rows per rule and missing key: ``child, column, missing, rows``."""
    found = []
    for child, column, parent, key in REFERENCES:
        used = feed[child].groupBy(F.col(column).alias("missing")).agg(F.count("*").alias("rows"))
        known = feed[parent].select(F.col(key).alias("missing"))
        found.append(
            used.join(known, "missing", "left_anti").select(
                F.lit(child).alias("child"), F.lit(column).alias("column"), "missing", "rows"
            )
        )
    return reduce(DataFrame.unionByName, found)


class BrokenReference(ValueError):
    pass


def require_references(feed: Feed) -> Feed:
    bad = reference_violations(feed).first()
    if bad is not None:
        raise BrokenReference(f"{bad['child']}.{bad['column']} names unknown {bad['missing']}")
    return feed


def linked_stop_times(feed: Feed) -> DataFrame:
    """Stop times with trip and stop columns."""
    trips = feed["trips"].select("trip_id", "route_id", "service_id", "shape_id", "trip_headsign", "direction_id", "block_id")
    stops = feed["stops"].select("stop_id", "stop_name", "stop_lon", "stop_lat")
    return feed["stop_times"].join(trips, "trip_id").join(stops, "stop_id")


def stops_with_transfers(feed: Feed) -> DataFrame:
    """Stops with pieces of their outgoing transfers and pathways, in order of the target stop."""
    moves = (
        feed["transfers"].select(
            F.col("from_stop_id").alias("stop_id"), F.lit("transfer").alias("kind"), "to_stop_id",
            F.col("transfer_type").alias("mode"), F.col("min_transfer_time").alias("seconds"))
        .unionByName(feed["pathways"].select(
            F.col("from_stop_id").alias("stop_id"), F.lit("pathway").alias("kind"), "to_stop_id",
            F.col("pathway_mode").alias("mode"), F.col("traversal_time").alias("seconds")))
    )
    item = F.struct("kind", "to_stop_id", "mode", "seconds")
    nested = in_pieces(moves, ["stop_id"], ["kind", "to_stop_id", "mode", "seconds"], item, name="moves")
    return feed["stops"].select("stop_id").join(nested, "stop_id", "left")


def lookup(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in the one-column table ``values``."""
    return df.join(values.select(F.col(values.columns[0]).alias(key)).distinct(), key, "left_semi")


def agencies_by_name(agency: DataFrame, names: DataFrame) -> DataFrame:
    """Keys of the named agencies; unknown names drop out."""
    return names.join(agency_key(agency).select("agency_name", "agency"), "agency_name")


def with_stop_index(stop_times: DataFrame) -> DataFrame:
    """0-based index of each stop within its trip."""
    return OrderedScan(stop_times, ["trip_id"], ["stop_sequence"]).index("stop_index").frame()


def shape_segments(points: DataFrame) -> DataFrame:
    """Consecutive points of each ``shape_id`` as segments ``seg, x1, y1, x2, y2``.

    ``points(shape_id, seq, x, y)``; segments are numbered from 0 in order of ``seq``.
    """
    scan = OrderedScan(points, ["shape_id"], ["seq"]).index("seg")
    scan.lead("x2", F.col("x")).lead("y2", F.col("y"))
    return scan.frame().where(F.col("x2").isNotNull()).select(
        "shape_id", "seg", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2"
    )


def shape_points(feed: Feed) -> DataFrame:
    return feed["shapes"].select(
        "shape_id", F.col("shape_pt_sequence").alias("seq"), F.col("shape_pt_lon").alias("x"),
        F.col("shape_pt_lat").alias("y"),
    )


def generated_shapes(feed: Feed) -> DataFrame:
    """Stops in order as the shape of each trip without one; the trip id names it."""
    bare = feed["trips"].where("shape_id is null").select("trip_id")
    rows = feed["stop_times"].join(bare, "trip_id", "left_semi").join(
        feed["stops"].select("stop_id", "stop_lon", "stop_lat"), "stop_id")
    return (
        OrderedScan(rows, ["trip_id"], ["stop_sequence"]).index("seq").frame()
        .select(F.col("trip_id").alias("shape_id"), "seq", F.col("stop_lon").alias("x"), F.col("stop_lat").alias("y"))
    )


def trip_shape(trips: DataFrame) -> DataFrame:
    return trips.withColumn("shape_id", F.coalesce("shape_id", "trip_id"))


def pattern_key() -> list[Column]:
    """What makes two trips the same pattern; direction may be missing."""
    return [F.col("route_id"), F.coalesce("shape_id", "trip_id").alias("shape_id"),
            F.xxhash64("trip_headsign").alias("headsign"), F.col("direction_id")]


def departure_board(feed: Feed) -> DataFrame:
    """Distinct departures per stop and pattern."""
    trips = feed["trips"].select("trip_id", *pattern_key())
    times = feed["stop_times"].where(F.col("arrival_time").isNotNull())
    return (
        times.select("stop_id", "trip_id", F.col("stop_sequence").alias("seq"), F.col("arrival_time").alias("time"))
        .join(trips, "trip_id")
        .distinct()
    )


def merge_feeds(left: Feed, right: Feed, keys: dict[str, list[str]]) -> Feed:
    """Union of two feeds of one city; on equal keys the right one wins."""
    both = left["agency"], right["agency"]
    cities = [{r["city"] for r in d.select("city").distinct().limit(2).collect()} for d in both if "city" in d.columns]
    if len(cities) == 2 and cities[0] != cities[1]:
        raise ValueError("feeds belong to different cities")
    out = {}
    for name, key in keys.items():
        rows = left[name].withColumn("_side", F.lit(0)).unionByName(right[name].withColumn("_side", F.lit(1)))
        rest = [c for c in rows.columns if c not in key]
        out[name] = last_per_key(rows, key, ["_side", *[c for c in rest if c != "_side"]]).drop("_side")
    return Feed(out)


def weekday_flag(date: Column) -> Column:
    """Calendar flag of the weekday of ``date``."""
    day = F.weekday(date)
    out = F.lit(False)
    for i, name in enumerate(DAYS):
        out = F.when(day == i, F.col(name)).otherwise(out)
    return out


def service_days(calendar: DataFrame, calendar_dates: DataFrame, since: Column | None = None) -> DataFrame:
    """Dates each service runs: its weekdays inside its range, less removed, plus added dates."""
    day = F.explode(F.sequence("start_date", "end_date")).alias("date")
    regular = calendar.where("start_date <= end_date").select("*", day).where(weekday_flag(F.col("date"))).select("service_id", "date")
    changes = calendar_dates.select("service_id", "date", "exception_type").distinct()
    removed = changes.where("exception_type = 2").select("service_id", "date")
    added = changes.where("exception_type = 1").select("service_id", "date")
    days = regular.join(removed, ["service_id", "date"], "left_anti").unionByName(added).distinct()
    return days if since is None else days.where(F.col("date") >= since)


def running_services(
    services: DataFrame, calendar: DataFrame, calendar_dates: DataFrame, date: Column, mode: str = "correct"
) -> DataFrame:
    """``services(service_id)`` that run on ``date``.

    ``correct`` uses range, weekday and exceptions. ``weekday_only`` looks at the weekday alone, and
    a service absent from the calendar always runs.
    """
    if mode == "weekday_only":
        flags = calendar.select("service_id", weekday_flag(date).alias("runs"))
        out = services.join(flags, "service_id", "left")
        return out.where(F.coalesce("runs", F.lit(True))).drop("runs")
    in_range = calendar.where((F.col("start_date") <= date) & (F.col("end_date") >= date) & weekday_flag(date))
    today = calendar_dates.where(F.col("date") == date)
    removed = today.where("exception_type = 2").select("service_id")
    added = today.where("exception_type = 1").select("service_id")
    runs = in_range.select("service_id").join(removed, "service_id", "left_anti").unionByName(added).distinct()
    return services.join(runs, "service_id", "left_semi")
