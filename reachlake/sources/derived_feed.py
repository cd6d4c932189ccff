"""A schedule feed in text form derived from the input tables, with the oddities real feeds have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.session import new_table_path
from reachlake.sources import derived as D

# Route type codes cycled over the routes, one of them outside every range.
ROUTE_TYPES = [0, 1, 2, 3, 4, 5, 6, 7, 100, 200, 401, 700, 800, 900, 1000, 1100, 1200, 1300, 1400, 1500, 1702, 11]
COLOR_TEXTS = ["", "ff8800", "0A0B0C", "GG0000"]
_PATHS: dict[tuple[str, str], str] = {}


def _pick(texts: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), index.cast("int") + 1)


def _clock(secs: Column, padded: Column) -> Column:
    h = F.floor(secs / 3600).cast("int")
    tail = F.format_string(":%02d:%02d", F.floor(secs % 3600 / 60).cast("int"), (secs % 60).cast("int"))
    return F.concat(F.when(padded, F.format_string("%02d", h)).otherwise(h.cast("string")), tail)


def _degrees(whole: str, micro: Column) -> Column:
    return F.concat(F.lit(whole + "."), F.lpad(micro.cast("string"), 6, "0"))


def text_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda name: D.table(spark, sf_dir, name)
    s = lambda c: c.cast("string")
    out: dict[str, DataFrame] = {}
    rk = F.col("r_regionkey")
    out["agency"] = t("region").select(
        F.concat(F.lit("A"), s(rk)).alias("agency_id"), F.col("r_name").alias("agency_name"),
        F.lit("http://example.org").alias("agency_url"), F.lit("UTC").alias("agency_timezone"),
    )
    k = F.col("stop_id")
    out["stops"] = D.stops(spark, sf_dir).select(
        s(k).alias("stop_id"), "stop_name",
        F.when(k % 6 == 0, "").otherwise(s(k % 6)).alias("location_type"),
        F.when(k % 5 == 0, "").otherwise(s(k - 1)).alias("parent_station"),
        _degrees("-79", F.col("x") * 12).alias("stop_lon"), _degrees("43", F.col("y") * 9).alias("stop_lat"),
        s(k % 4).alias("wheelchair_boarding"),
    )
    k = F.col("c_custkey")
    out["routes"] = t("customer").select(
        s(k).alias("route_id"), F.concat(F.lit("A"), s(k % 5)).alias("agency_id"),
        F.col("c_name").alias("route_short_name"), F.lit("").alias("route_long_name"),
        F.concat(F.lit('The "'), "c_mktsegment", F.lit('" line, daily'), F.when(k % 2 == 0, "\n").otherwise(""), F.lit("to "), "c_name").alias("route_desc"),
        s(_pick(ROUTE_TYPES, k % len(ROUTE_TYPES))).alias("route_type"),
        _pick(COLOR_TEXTS, k % len(COLOR_TEXTS)).alias("route_color"),
        F.when(k % 3 == 0, "").otherwise("00ff00").alias("route_text_color"),
    )
    k, r = F.col("o_orderkey"), F.col("o_custkey")
    out["trips"] = t("orders").select(
        s(k).alias("trip_id"), F.col("o_orderpriority").alias("service_id"), s(r).alias("route_id"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("S"), s(k))).alias("shape_id"),
        F.concat(F.lit("to "), s(r % 10)).alias("trip_headsign"), s(k % 2).alias("direction_id"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("B"), s(F.expr("o_orderkey div 3")))).alias("block_id"),
        s(k % 4).alias("wheelchair_accessible"), s(k % 3).alias("bikes_allowed"),
    )
    st = D.stop_times(spark, sf_dir)
    at = F.col("arrival") + F.col("trip_id") % 7 * 3600
    blank = (F.col("trip_id") + F.col("seq")) % 11 == 0
    even = F.col("trip_id") % 2 == 0
    out["stop_times"] = st.select(
        s(F.col("trip_id")).alias("trip_id"),
        F.when(blank, "").otherwise(_clock(at, even)).alias("arrival_time"),
        F.when(blank, "").otherwise(_clock(at + 30, ~even)).alias("departure_time"),
        s(F.col("stop_id")).alias("stop_id"), s(F.col("seq")).alias("stop_sequence"),
        _pick(["", "0", "1", "2", "7"], F.col("seq") % 5).alias("pickup_type"),
        _pick(["", "0", "1"], F.col("seq") % 3).alias("timepoint"),
    )
    orders = t("orders")
    bits = F.substring("o_orderpriority", 1, 1).cast("int") * 37
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    out["calendar"] = orders.groupBy("o_orderpriority").agg(
        F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")
    ).select(
        F.col("o_orderpriority").alias("service_id"),
        *[s(F.floor(bits / 2**i).cast("int") % 2).alias(d) for i, d in enumerate(days)],
        F.date_format("lo", "yyyyMMdd").alias("start_date"), F.date_format("hi", "yyyyMMdd").alias("end_date"),
    )
    # A range that ends before it starts holds no day.
    turned = out["calendar"].where("service_id like '1%'")
    out["calendar"] = out["calendar"].unionByName(turned.select(
        F.lit("9-TURNED").alias("service_id"), *days, F.col("end_date").alias("start_date"), F.col("start_date").alias("end_date")))
    services = orders.groupBy("o_orderpriority").agg(F.min("o_orderdate").cast("date").alias("lo"))
    services = services.withColumn("n", F.substring("o_orderpriority", 1, 1).cast("long"))
    ev = t("events").select("event_id", (F.col("user_id") % 5 + 1).alias("n"))
    out["calendar_dates"] = ev.join(services, "n").select(
        F.col("o_orderpriority").alias("service_id"),
        F.date_format(F.date_add("lo", (F.col("event_id") * 7 % 2000).cast("int")), "yyyyMMdd").alias("date"),
        s(1 + F.col("event_id") % 2).alias("exception_type"), "event_id",
    ).repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id")
    with_xy = st.where(F.col("trip_id") % 3 != 0).join(D.stops(spark, sf_dir), "stop_id")
    out["shapes"] = with_xy.select(
        F.concat(F.lit("S"), s(F.col("trip_id"))).alias("shape_id"),
        _degrees("43", F.col("y") * 9 + 333).alias("shape_pt_lat"),
        _degrees("-79", F.col("x") * 12 + F.col("seq") * 50).alias("shape_pt_lon"),
        s(F.col("seq") * 10).alias("shape_pt_sequence"),
    )
    k = F.col("p_partkey")
    out["fare_attributes"] = t("part").select(
        s(k).alias("fare_id"), F.concat(s(F.col("p_size")), F.lit(".50")).alias("price"),
        F.lit("USD").alias("currency_type"), s(k % 2).alias("payment_method"),
        _pick(["", "0", "1", "2", "5"], k % 5).alias("transfers"),
    )
    k = F.col("o_orderkey")
    out["frequencies"] = t("orders").select(
        s(k).alias("trip_id"), _clock(18000 + k * 60 % 36000, F.lit(False)).alias("start_time"),
        _clock(60000 + k * 60 % 36000, F.lit(True)).alias("end_time"), s(300 + k % 9 * 60).alias("headway_secs"),
        _pick(["", "0", "1"], k % 3).alias("exact_times"),
    )
    k = F.col("s_suppkey")
    sup = t("supplier")
    out["transfers"] = sup.select(
        s(k).alias("from_stop_id"), s(k + 1).alias("to_stop_id"),
        _pick(["", "1", "2", "3"], k % 4).alias("transfer_type"), s(k % 5 * 60).alias("min_transfer_time"),
    )
    out["pathways"] = sup.select(
        F.concat(F.lit("P"), s(k)).alias("pathway_id"), s(k).alias("from_stop_id"),
        s(F.greatest(k - 1, F.lit(0))).alias("to_stop_id"), s(1 + k % 7).alias("pathway_mode"),
        s(k % 2).alias("is_bidirectional"), s(k % 50).alias("length"),
    )
    out["feed_info"] = orders.agg(
        F.lit("example").alias("feed_publisher_name"), F.lit("http://example.org").alias("feed_publisher_url"),
        F.lit("en").alias("feed_lang"), F.date_format(F.min("o_orderdate"), "yyyyMMdd").alias("feed_start_date"),
        F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("feed_end_date"),
    )
    return out


def feed_path(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    """Directory with the asked text files, written on first use in this session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PATHS:
        _PATHS[key] = new_table_path(spark, "feed")
    path = _PATHS[key]
    made = None
    for name in tables:
        if (key + (name,)) not in _PATHS:
            made = made or text_tables(spark, sf_dir)
            made[name].write.csv(f"{path}/{name}.txt", header=True, emptyValue="", escape='"')
            _PATHS[key + (name,)] = path
    return path
