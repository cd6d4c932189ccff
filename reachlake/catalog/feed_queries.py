"""Registered feed queries: text files written from the input tables, read back and processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlake.catalog.registry import query
from reachlake.functions import codes, text
from reachlake.operators import feed_ops as O
from reachlake.operators.skew import OrderedScan, last_per_key
from reachlake.session import new_table_path
from reachlake.sources import derived as D
from reachlake.sources import feed as R
from reachlake.sources.derived_feed import feed_path

ALL = tuple(R.SCHEMAS)


def read(spark, sf_dir, *tables) -> R.Feed:
    return R.read_feed(spark, feed_path(spark, sf_dir, tables), tables)


# The same feed as SQL over the input tables, already typed.
FEED_SQL = {
    "f_agency": "select 'A'||r_regionkey agency_id, r_name agency_name from region",
    "f_stops": """select cast(stop_id as varchar) stop_id, stop_name, cast(stop_id%6 as int) location_type,
        case when stop_id%5=0 then null else cast(stop_id-1 as varchar) end parent_station,
        cast('-79.'||lpad(cast(x*12 as varchar),6,'0') as double) stop_lon,
        cast('43.'||lpad(cast(y*9 as varchar),6,'0') as double) stop_lat, cast(stop_id%4 as int) wheelchair_boarding from stops""",
    "f_routes": """select cast(c_custkey as varchar) route_id, 'A'||c_custkey%5 agency_id, c_name route_short_name,
        ([0,1,2,3,4,5,6,7,100,200,401,700,800,900,1000,1100,1200,1300,1400,1500,1702,11])[c_custkey%22+1] route_type,
        'The "'||c_mktsegment||'" line, daily'||case when c_custkey%2=0 then chr(10) else '' end||'to '||c_name route_desc,
        case c_custkey%4 when 0 then 'FFFFFF' when 1 then 'FF8800' when 2 then '0A0B0C' end route_color,
        case when c_custkey%3=0 then '000000' else '00FF00' end route_text_color from customer""",
    "f_trips": """select cast(o_orderkey as varchar) trip_id, o_orderpriority service_id, cast(o_custkey as varchar) route_id,
        case when o_orderkey%3<>0 then 'S'||o_orderkey end shape_id, 'to '||o_custkey%10 trip_headsign,
        cast(o_orderkey%2 as int) direction_id, case when o_orderkey%2<>0 then 'B'||(o_orderkey//3) end block_id,
        cast(o_orderkey%4 as int) wheelchair_accessible, cast(o_orderkey%3 as int) bikes_allowed from orders""",
    "f_stop_times": """select cast(trip_id as varchar) trip_id, cast(stop_id as varchar) stop_id, cast(seq as int) stop_sequence,
        cast(case when (trip_id+seq)%11<>0 then arrival+trip_id%7*3600 end as int) arrival_time,
        cast(case when (trip_id+seq)%11<>0 then arrival+trip_id%7*3600+30 end as int) departure_time,
        cast(([0,0,1,2,7])[seq%5+1] as int) pickup_type, cast(([1,0,1])[seq%3+1] as int) timepoint from stop_times""",
    "f_calendar": """select * from f_calendar_ahead
        union all select '9-TURNED', bits, end_date, start_date from f_calendar_ahead where bits=37""",
    "f_calendar_ahead": """select o_orderpriority service_id, cast(substr(o_orderpriority,1,1) as int)*37 bits,
        cast(min(o_orderdate) as date) start_date, cast(max(o_orderdate) as date) end_date from orders group by 1,2""",
    "f_calendar_dates": """select service_id, start_date + cast(event_id*7%2000 as int) as date,
        cast(1+event_id%2 as int) exception_type, event_id from events join f_calendar_ahead on user_id%5+1=bits//37""",
    "f_shapes": """select 'S'||trip_id shape_id, cast('43.'||lpad(cast(y*9+333 as varchar),6,'0') as double) y,
        cast('-79.'||lpad(cast(x*12+seq*50 as varchar),6,'0') as double) x, cast(seq*10 as int) seq
        from stop_times join stops using (stop_id) where trip_id%3<>0""",
    "f_fares": """select cast(p_partkey as varchar) fare_id, p_size||'.50' price, cast(p_partkey%2 as int) payment_method,
        ([null,0,1,2,5])[p_partkey%5+1] transfers from part""",
    "f_frequencies": """select cast(o_orderkey as varchar) trip_id, cast(18000+o_orderkey*60%36000 as int) start_time,
        cast(60000+o_orderkey*60%36000 as int) end_time, cast(300+o_orderkey%9*60 as int) headway_secs,
        cast(([0,0,1])[o_orderkey%3+1] as int) exact_times from orders""",
    "f_transfers": """select cast(s_suppkey as varchar) from_stop_id, cast(s_suppkey+1 as varchar) to_stop_id,
        cast(s_suppkey%4 as int) transfer_type, cast(s_suppkey%5*60 as int) min_transfer_time from supplier""",
    "f_pathways": """select 'P'||s_suppkey pathway_id, cast(s_suppkey as varchar) from_stop_id,
        cast(greatest(s_suppkey-1,0) as varchar) to_stop_id, cast(1+s_suppkey%7 as int) pathway_mode,
        cast(s_suppkey%2 as int) is_bidirectional, cast(s_suppkey%50 as double) length from supplier""",
}
_FEED_NEEDS = {"f_stops": ["stops"], "f_stop_times": ["stop_times"], "f_calendar": ["f_calendar_ahead"], "f_calendar_dates": ["f_calendar_ahead"],
               "f_shapes": ["stop_times", "stops"]}
D.SQL.update(FEED_SQL)
D._NEEDS.update(_FEED_NEEDS)
FLAG_SQL = "((bits // {p}) % 2 = 1)"
DAY_FLAGS = ", ".join(f"{FLAG_SQL.format(p=2**i)} {d}" for i, d in enumerate(R.DAYS))
RUNS = "(bits // cast(pow(2, isodow(d)-1) as int)) % 2 = 1"


def case(kind: str, c: str) -> str:
    """SQL CASE of a code list."""
    whens = " ".join(f"when {c}={k} then '{v}'" for k, v in codes.CODES[kind].labels.items())
    if kind == "transfers":
        return f"case when {c} is null then 'unlimited' {whens} else 'other' end"
    return f"case {whens} when {c} is not null then 'unknown' end"


ROUTE_CASE = """case when t=0 or h=9 then 'tramway' when t=1 or h=4 then 'subway' when t=2 or h=1 then 'rail'
    when t=3 or h in (7,8) then 'bus' when t=4 or h in (10,12) then 'ferry' when t=5 then 'cable_car'
    when t=6 or h=13 then 'gondola' when t=7 or h=14 then 'funicular' when h=2 then 'coach' when h=11 then 'air'
    when h=15 then 'taxi' else 'other' end"""
_FILES = [("agency", "f_agency"), ("stops", "f_stops"), ("routes", "f_routes"), ("trips", "f_trips"),
          ("stop_times", "f_stop_times"), ("calendar", "f_calendar"), ("calendar_dates", "f_calendar_dates"),
          ("shapes", "f_shapes"), ("fare_attributes", "f_fares"), ("frequencies", "f_frequencies"),
          ("transfers", "f_transfers"), ("pathways", "f_pathways")]


@query("feed_statistics", D.with_views(
    [v for _, v in _FILES],
    " union all ".join(f"""select '{t}' as "table", count(*) as "rows" from {v}""" for t, v in _FILES)
    + """ union all select 'feed_info', 1"""))
def feed_statistics(spark, sf_dir):
    return R.statistics(read(spark, sf_dir, *ALL))


@query("feed_stop_times", D.with_views(["f_stop_times"], "select * from f_stop_times"))
def feed_stop_times(spark, sf_dir):
    return read(spark, sf_dir, "stop_times")["stop_times"].select(
        "trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time", "pickup_type", "timepoint")


@query("feed_stops", D.with_views(["f_stops"], "select * from f_stops"))
def feed_stops(spark, sf_dir):
    return read(spark, sf_dir, "stops")["stops"].select(
        "stop_id", "stop_name", "location_type", "parent_station", "stop_lon", "stop_lat", "wheelchair_boarding")


@query("feed_routes", D.with_views(["f_routes"], f"""select route_id, agency_id, route_short_name, route_desc, route_type,
    {ROUTE_CASE} route_kind, route_color, route_text_color from (select *, route_type t, route_type//100 h from f_routes)"""))
def feed_routes(spark, sf_dir):
    return read(spark, sf_dir, "routes")["routes"].select(
        "route_id", "agency_id", "route_short_name", "route_desc", "route_type",
        codes.route_type_label(F.col("route_type")).alias("route_kind"), "route_color", "route_text_color")


@query("feed_calendar", D.with_views(["f_calendar"], f"select service_id, start_date, end_date, {DAY_FLAGS} from f_calendar"))
def feed_calendar(spark, sf_dir):
    return read(spark, sf_dir, "calendar")["calendar"]


@query("feed_enum_labels", D.with_views(
    ["f_stops", "f_stop_times", "f_trips", "f_fares", "f_frequencies", "f_transfers", "f_pathways", "f_calendar_dates"],
    " union all ".join(
        f"select '{n}' field, label, count(*) n from (select {case(k, c)} label from {v}) group by label"
        for n, k, c, v in [
            ("location", "location_type", "location_type", "f_stops"),
            ("wheelchair", "availability", "wheelchair_boarding", "f_stops"),
            ("pickup", "pickup_drop_off", "pickup_type", "f_stop_times"),
            ("continuous", "continuous", "1", "f_stop_times"),
            ("timepoint", "timepoint", "timepoint", "f_stop_times"),
            ("bikes", "bikes_allowed", "bikes_allowed", "f_trips"),
            ("direction", "direction", "direction_id", "f_trips"),
            ("payment", "payment_method", "payment_method", "f_fares"),
            ("transfers", "transfers", "transfers", "f_fares"),
            ("exact", "exact_times", "exact_times", "f_frequencies"),
            ("transfer_type", "transfer_type", "transfer_type", "f_transfers"),
            ("pathway_mode", "pathway_mode", "pathway_mode", "f_pathways"),
            ("pathway_direction", "pathway_direction", "is_bidirectional", "f_pathways"),
            ("exception", "exception_type", "exception_type", "f_calendar_dates")])))
def feed_enum_labels(spark, sf_dir):
    feed = read(spark, sf_dir, "stops", "stop_times", "trips", "fare_attributes", "frequencies", "transfers",
                "pathways", "calendar_dates")
    fields = [("location", "location_type", "location_type", "stops"),
              ("wheelchair", "availability", "wheelchair_boarding", "stops"),
              ("pickup", "pickup_drop_off", "pickup_type", "stop_times"),
              ("continuous", "continuous", "continuous_pickup", "stop_times"),
              ("timepoint", "timepoint", "timepoint", "stop_times"),
              ("bikes", "bikes_allowed", "bikes_allowed", "trips"),
              ("direction", "direction", "direction_id", "trips"),
              ("payment", "payment_method", "payment_method", "fare_attributes"),
              ("transfers", "transfers", "transfers", "fare_attributes"),
              ("exact", "exact_times", "exact_times", "frequencies"),
              ("transfer_type", "transfer_type", "transfer_type", "transfers"),
              ("pathway_mode", "pathway_mode", "pathway_mode", "pathways"),
              ("pathway_direction", "pathway_direction", "is_bidirectional", "pathways"),
              ("exception", "exception_type", "exception_type", "calendar_dates")]
    out = None
    for name, kind, column, table in fields:
        part = feed[table].groupBy(codes.label_of(F.col(column), kind).alias("label")).agg(F.count("*").alias("n"))
        part = part.select(F.lit(name).alias("field"), "label", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("feed_unknown_to_default", D.with_views(["f_stops", "f_stop_times"], """
    select 'location_type' field, case when location_type>4 then 0 else location_type end code, count(*) n from f_stops group by 2
    union all select 'wheelchair_boarding', case when wheelchair_boarding>2 then 0 else wheelchair_boarding end, count(*) from f_stops group by 2
    union all select 'pickup_type', case when pickup_type>3 then 0 else pickup_type end, count(*) from f_stop_times group by 2"""))
def feed_unknown_to_default(spark, sf_dir):
    feed = R.unknown_to_default(read(spark, sf_dir, "stops", "stop_times"))
    parts = [feed[t].groupBy(F.col(c).alias("code")).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "code", "n")
             for t, c in [("stops", "location_type"), ("stops", "wheelchair_boarding"), ("stop_times", "pickup_type")]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("feed_rejects", """select 'routes' as "table", 'route_color' as "column", 'GG0000' as value, count(*) n
    from customer where c_custkey%4=3 having count(*)>0""")
def feed_rejects(spark, sf_dir):
    raw = R.read_raw(spark, feed_path(spark, sf_dir, ("routes",)), "routes")
    return R.rejects(raw, "routes").groupBy("table", "column", "value").agg(F.count("*").alias("n"))


@query("feed_manifest")
def feed_manifest(spark, sf_dir):
    return R.manifest(spark, feed_path(spark, sf_dir, ("agency", "stops", "routes")))


@query("feed_many_cities", D.with_views(["f_stops", "f_agency"], """
    select city, 'stops' as "table", count(*) as "rows" from f_stops, (values ('north'),('south')) c(city) group by 1
    union all select city, 'agency', count(*) from f_agency, (values ('north'),('south')) c(city) group by 1"""))
def feed_many_cities(spark, sf_dir):
    path = feed_path(spark, sf_dir, ("agency", "stops"))
    feed = R.read_feeds(spark, [(path, "north"), (path, "south")], ("agency", "stops"))
    parts = [feed[t].groupBy("city").agg(F.count("*").alias("rows")).select("city", F.lit(t).alias("table"), "rows")
             for t in ("stops", "agency")]
    return parts[0].unionByName(parts[1])


@query("feed_snapshot_round_trip", D.with_views(["f_trips", "f_routes"], """
    select agency_id agency, count(*) n, count(distinct route_id) routes from f_trips join f_routes using (route_id) group by 1"""))
def feed_snapshot_round_trip(spark, sf_dir):
    feed = O.split_by_agency(_no_blank(read(spark, sf_dir, "agency", "routes", "trips", "stop_times", "stops", "calendar",
                                            "calendar_dates", "shapes")))
    path = new_table_path(spark, "snapshot")
    R.write_snapshot(R.Feed({"trips": feed["trips"]}), path, ("agency",))
    back = R.read_snapshot(spark, path, ("trips",))
    return back["trips"].groupBy("agency").agg(F.count("*").alias("n"), F.count_distinct("route_id").alias("routes"))


@query("feed_write_round_trip_text", D.with_views(["f_routes"], "select route_id, agency_id, route_short_name, route_desc from f_routes"))
def feed_write_round_trip_text(spark, sf_dir):
    """Text with quotes, commas and line breaks survives writing and reading."""
    path = new_table_path(spark, "feed-out")
    R.write_feed(read(spark, sf_dir, "routes"), path)
    return R.read_feed(spark, path, ("routes",))["routes"].select("route_id", "agency_id", "route_short_name", "route_desc")


@query("feed_write_round_trip", D.with_views(["f_stop_times"], """
    select trip_id, stop_id, stop_sequence, arrival_time, departure_time from f_stop_times"""))
def feed_write_round_trip(spark, sf_dir):
    feed = read(spark, sf_dir, "stop_times")
    path = new_table_path(spark, "feed-out")
    R.write_feed(feed, path)
    return R.read_feed(spark, path, ("stop_times",))["stop_times"].select(
        "trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time")


def _no_blank(feed):
    return feed.replace(stop_times=feed["stop_times"].where("arrival_time is not null"))


_SPLIT = ("agency", "routes", "trips", "stop_times", "stops", "calendar", "calendar_dates", "shapes")


@query("split_by_agency", D.with_views(["f_trips", "f_routes", "f_stop_times", "f_shapes", "f_stops", "f_calendar"], """
    with t as (select * from f_trips join f_routes using (route_id)),
         st as (select agency_id, s.* from f_stop_times s join t using (trip_id) where arrival_time is not null)
    select agency_id agency, 'routes' as "table", count(*) n from f_routes group by 1
    union all select agency_id, 'trips', count(*) from t group by 1
    union all select agency_id, 'stop_times', count(*) from st group by 1
    union all select agency_id, 'stops', count(distinct stop_id) from st join f_stops using (stop_id) group by 1
    union all select agency_id, 'calendar', count(distinct service_id) from t join f_calendar using (service_id) group by 1
    union all select agency_id, 'shapes', count(*) from t join f_shapes using (shape_id) group by 1"""))
def split_by_agency(spark, sf_dir):
    feed = O.split_by_agency(_no_blank(read(spark, sf_dir, *_SPLIT)))
    parts = [feed[t].groupBy("agency").agg(F.count("*").alias("n")).select("agency", F.lit(t).alias("table"), "n")
             for t in ("routes", "trips", "stop_times", "stops", "calendar", "shapes")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("split_skips_agency_without_arrivals", D.with_views(["f_trips", "f_routes", "f_stop_times"], """
    with st as (select agency_id, arrival_time from f_stop_times join f_trips using (trip_id) join f_routes using (route_id)
                where agency_id<>'A1' or arrival_time is not null)
    select agency_id agency, count(*) n from st group by 1 having count(*)=count(arrival_time)"""))
def split_skips(spark, sf_dir):
    feed = read(spark, sf_dir, *_SPLIT)
    a1 = feed["routes"].where("agency_id = 'A1'").select("route_id")
    of_a1 = feed["trips"].join(a1, "route_id", "left_semi").select("trip_id", F.lit(True).alias("a1"))
    times = feed["stop_times"].join(of_a1, "trip_id", "left").where("arrival_time is not null or a1 is null").drop("a1")
    out = O.split_by_agency(feed.replace(stop_times=times))
    return out["stop_times"].groupBy("agency").agg(F.count("*").alias("n"))


@query("reference_violations", D.with_views(["f_transfers", "f_stops"], """
    select 'transfers' child, 'to_stop_id' as "column", to_stop_id missing, count(*) as "rows" from f_transfers
    where to_stop_id not in (select stop_id from f_stops) group by 3"""))
def reference_violations(spark, sf_dir):
    return O.reference_violations(read(spark, sf_dir, "stop_times", "trips", "stops", "frequencies", "transfers", "pathways"))


@query("linked_stop_times", D.with_views(["f_stop_times", "f_trips", "f_stops"], """
    select route_id, direction_id, count(*) n, count(distinct stop_name) stops, min(arrival_time) first_arrival
    from f_stop_times join f_trips using (trip_id) join f_stops using (stop_id) group by 1,2"""))
def linked_stop_times(spark, sf_dir):
    rows = O.linked_stop_times(read(spark, sf_dir, "stop_times", "trips", "stops"))
    return rows.groupBy("route_id", "direction_id").agg(
        F.count("*").alias("n"), F.count_distinct("stop_name").alias("stops"), F.min("arrival_time").alias("first_arrival"))


@query("stops_with_transfers", D.with_views(["f_transfers", "f_pathways", "f_stops"], """
    with m as (select from_stop_id stop_id, 'transfer' kind, to_stop_id from f_transfers
               union all select from_stop_id, 'pathway', to_stop_id from f_pathways)
    select stop_id, string_agg(kind||'>'||to_stop_id, ';' order by kind, to_stop_id) moves
    from f_stops left join m using (stop_id) group by 1"""))
def stops_with_transfers(spark, sf_dir):
    rows = O.stops_with_transfers(read(spark, sf_dir, "stops", "transfers", "pathways"))
    shown = F.transform("moves", lambda m: F.concat(m["kind"], F.lit(">"), m["to_stop_id"]))
    return rows.select("stop_id", F.array_join(shown, ";").alias("moves"))


@query("lookup_trips_of_routes", D.with_views(["f_trips"], """
    select trip_id, route_id from f_trips where route_id in (select cast(max(c_custkey) as varchar) from customer group by c_nationkey)"""))
def lookup_trips(spark, sf_dir):
    wanted = D.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").cast("string").alias("k"))
    return O.lookup(read(spark, sf_dir, "trips")["trips"], "route_id", wanted.select("k")).select("trip_id", "route_id")


@query("agencies_by_name", """select agency_name, 'A'||r_regionkey agency from region
    join (select distinct upper(c_mktsegment) agency_name from customer union select r_name from region) on agency_name=r_name""")
def agencies_by_name(spark, sf_dir):
    seg = D.table(spark, sf_dir, "customer").select(F.upper("c_mktsegment").alias("agency_name")).distinct()
    names = seg.union(D.table(spark, sf_dir, "region").select("r_name")).distinct()
    return O.agencies_by_name(read(spark, sf_dir, "agency")["agency"], names)


@query("last_row_per_key", D.with_views(["f_calendar_dates"], """
    select service_id, date, arg_max(exception_type, event_id) exception_type from f_calendar_dates group by 1,2"""))
def last_row_per_key(spark, sf_dir):
    raw = R.read_raw(spark, feed_path(spark, sf_dir, ("calendar_dates",)), "calendar_dates")
    return R.last_rows(raw, "calendar_dates", ["service_id", "date"]).select("service_id", "date", "exception_type")


@query("stop_index_in_trip", D.with_views(["f_stop_times"], """
    select trip_id, stop_sequence, cast(row_number() over (partition by trip_id order by stop_sequence)-1 as bigint) stop_index from f_stop_times"""))
def stop_index(spark, sf_dir):
    return O.with_stop_index(read(spark, sf_dir, "stop_times")["stop_times"]).select("trip_id", "stop_sequence", "stop_index")


@query("shape_segments", D.with_views(["f_shapes"], """
    select * from (select shape_id, cast(row_number() over w - 1 as bigint) seg, x x1, y y1, lead(x) over w x2, lead(y) over w y2
    from f_shapes window w as (partition by shape_id order by seq)) where x2 is not null"""))
def shape_segments(spark, sf_dir):
    return O.shape_segments(O.shape_points(read(spark, sf_dir, "shapes")))


@query("generated_shapes", D.with_views(["f_trips", "f_stop_times", "f_stops"], """
    select trip_id shape_id, cast(row_number() over (partition by trip_id order by stop_sequence)-1 as bigint) seq, stop_lon x, stop_lat y
    from f_stop_times join f_trips using (trip_id) join f_stops using (stop_id) where shape_id is null"""))
def generated_shapes(spark, sf_dir):
    return O.generated_shapes(read(spark, sf_dir, "trips", "stop_times", "stops"))


@query("departure_board", D.with_views(["f_trips", "f_stop_times"], """
    select stop_id, route_id, coalesce(shape_id, trip_id) shape_id, direction_id, trip_id, stop_sequence seq, arrival_time as time
    from f_stop_times join f_trips using (trip_id) where arrival_time is not null"""))
def departure_board(spark, sf_dir):
    return O.departure_board(read(spark, sf_dir, "trips", "stop_times")).drop("headsign")


@query("stop_times_with_arrival", D.with_views(["f_stop_times"], """
    select trip_id, stop_sequence, arrival_time from f_stop_times where arrival_time is not null order by trip_id, stop_sequence"""))
def stop_times_with_arrival(spark, sf_dir):
    rows = read(spark, sf_dir, "stop_times")["stop_times"].where("arrival_time is not null")
    return rows.orderBy("trip_id", "stop_sequence").select("trip_id", "stop_sequence", "arrival_time")


_DAYS_SQL = f"""days as (select service_id, bits, unnest(generate_series(start_date, end_date, interval 1 day))::date d from f_calendar),
    reg as (select service_id, d from days where {RUNS}),
    ex as (select distinct service_id, date d, exception_type from f_calendar_dates)"""


@query("service_days", D.with_views(["f_calendar", "f_calendar_dates"], f"""with {_DAYS_SQL}
    select service_id, d date from reg where (service_id, d) not in (select service_id, d from ex where exception_type=2)
    union select service_id, d from ex where exception_type=1"""))
def service_days(spark, sf_dir):
    feed = read(spark, sf_dir, "calendar", "calendar_dates")
    return O.service_days(feed["calendar"], feed["calendar_dates"])


@query("running_services", D.with_views(["f_calendar", "f_calendar_dates"], f"""with {_DAYS_SQL}, q as (select max(start_date) + 100 as day from f_calendar where start_date<=end_date)
    select 'correct' mode, service_id from (
      (select service_id from reg, q where d=day and service_id not in (select service_id from ex, q where exception_type=2 and d=day))
      union select service_id from ex, q where exception_type=1 and d=day)
    union all select 'weekday_only', service_id from (select service_id, bits, day d from f_calendar, q) where {RUNS}"""))
def running_services(spark, sf_dir):
    feed = read(spark, sf_dir, "calendar", "calendar_dates")
    cal, dates = feed["calendar"], feed["calendar_dates"]
    day = F.lit(cal.where("start_date <= end_date").agg(F.date_add(F.max("start_date"), 100)).first()[0])
    parts = [O.running_services(cal.select("service_id"), cal, dates, day, m).select(F.lit(m).alias("mode"), "service_id")
             for m in ("correct", "weekday_only")]
    return parts[0].unionByName(parts[1])


@query("merge_feeds", D.with_views(["f_stops", "f_routes"], """
    select coalesce(route_id, stop_id) stop_id, case when route_id is null then 'left' else 'right' end side,
           coalesce(route_short_name, stop_name) stop_name from f_stops full join f_routes on stop_id=route_id"""))
def merge_feeds(spark, sf_dir):
    feed = read(spark, sf_dir, "stops", "routes", "agency")
    mine = feed["stops"].select("stop_id", F.lit("left").alias("side"), "stop_name")
    other = feed["routes"].select(F.col("route_id").alias("stop_id"), F.lit("right").alias("side"),
                                  F.col("route_short_name").alias("stop_name"))
    city = feed["agency"].withColumn("city", F.lit("north"))
    merged = O.merge_feeds(R.Feed({"stops": mine, "agency": city}), R.Feed({"stops": other, "agency": city}),
                           {"stops": ["stop_id"]})
    return merged["stops"]


@query("mode_words", """select c_mktsegment segment, word as mode, route_type, count(*) n from (
    select c_mktsegment, ([ 'bus','tram','subway','rail','ferry','rocket'])[c_custkey%6+1] word from customer)
    join (values ('bus','bus'),('tram','tramway'),('subway','subway'),('rail','rail'),('ferry','ferry')) v(w, route_type) on w=word group by 1,2,3""")
def mode_words(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("bus", "tram", "subway", "rail", "ferry", "rocket")])
    rows = D.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.element_at(words, (F.col("c_custkey") % 6 + 1).cast("int")).alias("mode"))
    return codes.requested_types(rows).groupBy("segment", "mode", "route_type").agg(F.count("*").alias("n"))


@query("agencies_per_city", D.with_views(["f_agency"], "select city, agency_name from f_agency, (values ('north'),('south')) c(city)"))
def agencies_per_city(spark, sf_dir):
    path = feed_path(spark, sf_dir, ("agency",))
    feed = R.read_feeds(spark, [(path, "north"), (path, "south")], ("agency",))
    return feed["agency"].select("city", "agency_name").distinct()


@query("namespaced_ids", D.with_views(["f_routes"], "select agency_id, route_id, cast(dense_rank() over (order by agency_id, route_id) as bigint) id from f_routes"))
def namespaced_ids(spark, sf_dir):
    """Composite ids kept as text, with a dense integer key where one is wanted."""
    pairs = read(spark, sf_dir, "routes")["routes"].select("agency_id", "route_id").distinct()
    return OrderedScan(pairs, [], ["agency_id", "route_id"]).index("id").frame().withColumn("id", F.col("id") + 1)
