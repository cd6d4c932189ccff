"""Registered transit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlake.catalog.registry import prepared, query
from reachlake.plans import transit as T
from reachlake.session import written
from reachlake.sources import derived as D


def network(spark, sf_dir, trips: bool = False) -> T.Network:
    def build():
        return T.Network(
            D.stops(spark, sf_dir), D.stop_times(spark, sf_dir), D.trips(spark, sf_dir) if trips else None
        )

    return prepared(spark, sf_dir, f"network-{trips}", build)


def labels_of_requests(spark, sf_dir):
    return prepared(spark, sf_dir, "labels", lambda: written(T.reach(D.requests(spark, sf_dir), network(spark, sf_dir)), "labels"))


def times_of_requests(spark, sf_dir):
    """Node times of all requests; the street catchment is the long part."""
    def build():
        return written(T.search_times(labels_of_requests(spark, sf_dir), D.requests(spark, sf_dir), network(spark, sf_dir),
                                      D.road_nodes(spark, sf_dir), D.road_edges(spark, sf_dir)), "times")

    return prepared(spark, sf_dir, "times", build)


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def reach_ctes(rounds: int = 4, requests: str = "requests", allowed: str = "true") -> str:
    """Unrolled search: r0 holds the request points, r1.. the labels per stop."""
    parts = [
        f"""ready1 as materialized (select q.request_id, s.stop_id, q.start+d/1.25+35.0 ready, 0 b, q.start+q.duration until from
            (select *, sqrt(cast((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y) as double)) d, q.x qx from {requests} q, stops s
             where (q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)<=640000) j
            join {requests} q on q.request_id=j.request_id join stops s on s.stop_id=j.stop_id)"""
    ]
    for k in range(1, rounds + 1):
        if k > 1:
            parts.append(
                f"""ready{k} as materialized (select r.request_id, w.to_stop stop_id, min(r.t+w.dist/1.25+35.0) ready,
                arg_min(r.b, r.t+w.dist/1.25+35.0) b, any_value(until) until
                from r{k - 1} r join walk w on r.stop_id=w.from_stop group by 1,2)"""
            )
        prev = "" if k == 1 else f"select request_id, stop_id, t, b, until from r{k - 1} union all "
        parts.append(
            f"""r{k} as materialized (select request_id, stop_id, min(t) t, arg_min(b, t*100+b) b, any_value(until) until from ({prev}
            select c.request_id, d.stop_id, cast(d.arrival as double) t, {k} b, c.until from (
              select l.request_id, st.trip_id, min(st.seq) seq, any_value(l.until) until from ready{k} l
              join stop_times st on st.stop_id=l.stop_id and st.arrival>=l.ready and st.arrival<=l.until
              where {allowed} group by 1,2) c
            join stop_times d on d.trip_id=c.trip_id and d.seq>c.seq and d.arrival<=c.until) u group by 1,2)"""
        )
    return ",\n".join(parts)


@query("reach_by_transit", D.with_views(["stops", "stop_times", "requests", "walk"],
       f"with {reach_ctes()} select request_id, stop_id, t, b boardings from r4"))
def reach_by_transit(spark, sf_dir):
    labels = T.reach(D.requests(spark, sf_dir), network(spark, sf_dir))
    return T.best_labels(labels, 2).select("request_id", "stop_id", "t", "boardings")


def scored_ctes(rounds: int, cost: float) -> str:
    """Like :func:`reach_ctes`, keeping the least score ``t + boardings * cost``; earlier labels win ties."""
    parts = []
    for k in range(1, rounds + 1):
        if k == 1:
            parts.append(reach_ctes(1).split("r1 as materialized")[0].rstrip().rstrip(","))
        else:
            parts.append(
                f"""ready{k} as materialized (select r.request_id, w.to_stop stop_id, min(r.t+w.dist/1.25+35.0) ready,
                arg_min(r.b, row(r.t+w.dist/1.25+35.0, r.b)) b, any_value(until) until
                from r{k - 1} r join walk w on r.stop_id=w.from_stop group by 1,2)""")
        prev = "" if k == 1 else f"select request_id, stop_id, t, b, until, 0 fresh from r{k - 1} union all "
        key = f"row(t+b*{cost}, fresh, t, b)"
        parts.append(
            f"""r{k} as materialized (select request_id, stop_id, arg_min(t, {key}) t, arg_min(b, {key}) b, any_value(until) until from ({prev}
            select c.request_id, d.stop_id, cast(d.arrival as double) t, c.b+1, c.until, 1 from (
              select l.request_id, st.trip_id, min(st.seq) seq, arg_min(l.b, st.seq*10+l.b) b, any_value(l.until) until from ready{k} l
              join stop_times st on st.stop_id=l.stop_id and st.arrival>=l.ready and st.arrival<=l.until group by 1,2) c
            join stop_times d on d.trip_id=c.trip_id and d.seq>c.seq and d.arrival<=c.until) u(request_id, stop_id, t, b, until, fresh) group by 1,2)""")
    return ",\n".join(parts)


@query("reach_with_transfer_cost", D.with_views(["stops", "stop_times", "requests", "walk"],
       f"with {scored_ctes(4, 300.0)} select request_id, stop_id, t, b boardings from r4"))
def reach_with_transfer_cost(spark, sf_dir):
    labels = T.reach(D.requests(spark, sf_dir), network(spark, sf_dir), transfer_cost=300.0)
    return T.best_labels(labels, 2).select("request_id", "stop_id", "t", "boardings")


@query("reach_with_allow_lists", D.with_views(["stops", "stop_times", "requests", "walk", "trips"],
       "with " + reach_ctes(allowed="""exists (select 1 from trips tr where tr.trip_id=st.trip_id and service_id<>'3-MEDIUM'
          and l.request_id%7<>3 and route_id%3 in (l.request_id%3, (l.request_id+1)%3)
          and (l.request_id%5=0 or mode in (l.request_id%4, (l.request_id+1)%4)))""") +
       " select request_id, stop_id, t, b boardings from r4"))
def reach_with_allow_lists(spark, sf_dir):
    """Modes per request (none listed means all), agencies (none listed means none) and the services of the day."""
    n = F.col("request_id")
    modes = F.when(n % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((n % 4).cast("int"), ((n + 1) % 4).cast("int")))
    agencies = F.when(n % 7 == 3, F.array().cast("array<long>")).otherwise(F.array(n % 3, (n + 1) % 3))
    trips = D.trips(spark, sf_dir).withColumn("agency", F.col("route_id") % 3)
    running = trips.where("service_id <> '3-MEDIUM'").select(F.lit("2024-01-01").alias("day"), "service_id")
    services = running.groupBy("day").agg(F.collect_set("service_id").alias("services"))  # the services of a feed's calendar
    asked = D.requests(spark, sf_dir).withColumns({"modes": modes, "agencies": agencies, "day": F.lit("2024-01-01")}).join(services, "day")
    net = T.Network(D.stops(spark, sf_dir), D.stop_times(spark, sf_dir), trips.drop("block_id"))
    labels = T.reach(asked, net)
    return T.best_labels(labels, 2).select("request_id", "stop_id", "t", "boardings")


SWEEP_SQL = """(select origin*12+s request_id, x, y, 18000+s*7200 as start, 2700 duration from
    (select request_id origin, x, y from requests), (select unnest(generate_series(0,11)) s))"""


@query("start_time_sweep", D.with_views(["stops", "stop_times", "requests", "walk"],
       f"with sweep as materialized {SWEEP_SQL}, " + reach_ctes(requests="sweep") +
       " select request_id, stop_id, t, b boardings from r4"))
def start_time_sweep(spark, sf_dir):
    origins = D.requests(spark, sf_dir).withColumn("duration", F.lit(2700).cast("long"))
    asked = T.with_start_times(origins, 18000, 97200, 7200)
    labels = T.reach(asked, network(spark, sf_dir))
    return T.best_labels(labels, 2).select("request_id", "stop_id", "t", "boardings")


CUSTOMERS_SQL = """(select c_custkey request_id, (c_custkey*3571)%8009 x, (c_custkey*6211)%8009 y, 30000+c_custkey%60*60 as start, 1500 duration from customer)"""


def customer_requests(spark, sf_dir):
    """Load profile: one request per customer, scattered over the city."""
    k = F.col("c_custkey")
    return D.table(spark, sf_dir, "customer").select(
        k.alias("request_id"), (k * 3571 % D.EXTENT).alias("x"), (k * 6211 % D.EXTENT).alias("y"),
        (30000 + k % 60 * 60).alias("start"), F.lit(1500).cast("long").alias("duration"))


@query("reach_from_customers", D.with_views(["stops", "stop_times", "walk"],
       f"with cust as materialized {CUSTOMERS_SQL}, " + reach_ctes(requests="cust") +
       " select request_id, stop_id, t, b boardings from r4"))
def reach_from_customers(spark, sf_dir):
    labels = T.reach(customer_requests(spark, sf_dir), network(spark, sf_dir))
    return T.best_labels(labels, 2).select("request_id", "stop_id", "t", "boardings")


CATCH_SQL = """catch(k, base, node, s) as (
      select 0, base, node_id, d/1.25 from (select b.base, n.node_id, sqrt(cast((b.x-n.x)*(b.x-n.x)+(b.y-n.y)*(b.y-n.y) as double)) d
        from bases b, road_nodes n where (b.x-n.x)*(b.x-n.x)+(b.y-n.y)*(b.y-n.y)<=10000)
      union all select k+1, base, dst, min(s+weight/1.42) from catch join road_both on src=node where s<1440 group by 1,2,3),
    catchment as materialized (select base, node, min(s) s from catch group by 1,2)"""
STOP_BASES = "bases as materialized (select 's'||stop_id base, x, y from stops union all select 'r'||request_id, x, y from requests)"


@query("street_catchment", D.with_views(["stops", "road_nodes", "road_both", "requests"],
       f"with recursive {STOP_BASES}, {CATCH_SQL} select distinct b.x, b.y, node node_id, round(s,6) walk_s from catchment join bases b using (base) where base[1]='s'"))
def street_catchment(spark, sf_dir):
    out = T.street_catchment(D.stops(spark, sf_dir), D.road_nodes(spark, sf_dir), D.road_edges(spark, sf_dir))
    return out.select("x", "y", "node_id", r6("walk_s", "walk_s"))


ISO_SQL = f"""{reach_ctes()}, {STOP_BASES}, {CATCH_SQL},
    times as materialized (select request_id, node, min(t) t from (
      select request_id, node, t+10+s t from r4 join catchment on base='s'||stop_id
      union all select request_id, node, start+10+s from requests join catchment on base='r'||request_id) group by 1,2)"""


@query("isochrone", D.with_views(["stops", "stop_times", "requests", "walk", "road_nodes", "road_edges", "road_both"],
       f"with recursive {ISO_SQL} select a.request_id, edge_id, round((a.t+b.t)/2,6) t, cast(trunc((a.t+b.t)/2) as int) as seconds from road_edges join times a on a.node=src "
       "join times b on b.node=dst and a.request_id=b.request_id"))
def isochrone(spark, sf_dir):
    from reachlake.sources.sinks import edge_seconds

    t = T.isochrone(D.requests(spark, sf_dir), network(spark, sf_dir), D.road_nodes(spark, sf_dir), D.road_edges(spark, sf_dir))
    t = written(t, "edge-times")
    return t.select("request_id", "edge_id", r6("t", "t")).join(edge_seconds(t), ["request_id", "edge_id"])


@query("isochrone_shades", D.with_views(["stops", "stop_times", "requests", "walk", "road_nodes", "road_edges", "road_both"],
       f"""with recursive {ISO_SQL}, e as (select a.request_id, (a.t+b.t)/2 t from road_edges join times a on a.node=src
         join times b on b.node=dst and a.request_id=b.request_id)
       select request_id, case when (t-start)/7200>1 then null when t<start then -1 else least(cast(trunc((t-start)/7200*7) as int), 6) end shade, count(*) edges
       from e join requests using (request_id) group by 1,2"""))
def isochrone_shades(spark, sf_dir):
    """Histogram of colour buckets per request."""
    from reachlake.functions.text import shade

    asked = D.requests(spark, sf_dir)
    t = T.edge_times(times_of_requests(spark, sf_dir), D.road_edges(spark, sf_dir))
    bucket = shade(F.col("t"), F.col("start"), F.col("start") + F.col("duration"))
    return t.join(asked, "request_id").groupBy("request_id", bucket.alias("shade")).agg(F.count("*").alias("edges"))


@query("edge_seconds_json", D.with_views(["stops", "stop_times", "requests", "walk", "road_nodes", "road_edges", "road_both"],
       f"""with recursive {ISO_SQL}, e as (select a.request_id, edge_id, cast(trunc((a.t+b.t)/2) as int) s,
           (row_number() over (partition by a.request_id order by edge_id)-1)//1000 piece
         from road_edges join times a on a.node=src join times b on b.node=dst and a.request_id=b.request_id)
       select request_id, piece, '{{'||string_agg('"'||edge_id||'":'||s, ',' order by edge_id)||'}}' json from e group by 1,2"""))
def edge_seconds_json(spark, sf_dir):
    from reachlake.sources.sinks import edge_seconds_json as as_json

    t = T.edge_times(times_of_requests(spark, sf_dir), D.road_edges(spark, sf_dir))
    return as_json(t)


@query("hover_edge_seconds", D.with_views(["stops", "stop_times", "requests", "walk", "road_nodes", "road_edges", "road_both"],
       f"""with recursive {ISO_SQL} select e.edge_id, coalesce(cast(trunc((a.t+b.t)/2) as int), -1) as seconds from road_edges e
         left join times a on a.node=src and a.request_id=0 left join times b on b.node=dst and b.request_id=0"""))
def hover_edge_seconds(spark, sf_dir):
    from reachlake.sources.sinks import edge_seconds

    asked = D.requests(spark, sf_dir)
    t = edge_seconds(T.edge_times(times_of_requests(spark, sf_dir), D.road_edges(spark, sf_dir)))
    first = asked.agg(F.min("request_id")).first()[0]
    seen = t.where(F.col("request_id") == first).select("edge_id", "seconds")
    return D.road_edges(spark, sf_dir).select("edge_id").join(seen, "edge_id", "left").select(
        "edge_id", F.coalesce("seconds", F.lit(-1)).alias("seconds"))


NEXT_SQL = """ask as materialized (select trip_id*100+seq label_id, stop_id, arrival+35 ready from stop_times),
    dep as materialized (select stop_id, mode, direction, arrival, seq, trip_id from stop_times join trips using (trip_id))"""


def asks(spark, sf_dir):
    """Every arrival as a label ready to board again after the transfer time."""
    return D.stop_times(spark, sf_dir).select(
        (F.col("trip_id") * 100 + F.col("seq")).alias("label_id"), "stop_id", (F.col("arrival") + 35).alias("ready"))


def departures(spark, sf_dir):
    return D.stop_times(spark, sf_dir).join(D.trips(spark, sf_dir), "trip_id").select(
        "stop_id", "mode", "direction", F.col("arrival").alias("time"), "seq", "trip_id")


@query("next_departure", D.with_views(["stop_times", "trips"], f"""with {NEXT_SQL}
    select label_id, stop_id, mode, direction, d.arrival as time, d.seq, d.trip_id from (
      select label_id, ask.stop_id, mode, direction, min(row(arrival, seq, trip_id)) m from ask join dep on dep.stop_id=ask.stop_id and arrival>=ready group by 1,2,3,4) x,
      lateral (select x.m[1] arrival, x.m[2] seq, x.m[3] trip_id) d"""))
def next_departure(spark, sf_dir):
    from reachlake.operators.asof import next_departure as asof

    return asof(asks(spark, sf_dir), departures(spark, sf_dir), ["mode", "direction"])


@query("downstream_stops", D.with_views(["stop_times"], """
    select b.trip_id, b.board_seq, d.seq, d.stop_id, d.arrival from (select trip_id, min(seq) board_seq from stop_times group by 1) b
    join stop_times d on d.trip_id=b.trip_id and d.seq>b.board_seq"""))
def downstream_stops(spark, sf_dir):
    from reachlake.operators.asof import downstream_stops as down

    st = D.stop_times(spark, sf_dir)
    return down(st.groupBy("trip_id").agg(F.min("seq").alias("board_seq")), st)


@query("reach_staying_in_block", D.with_views(["stops", "stop_times", "requests", "walk"],
       f"with {reach_ctes()} select request_id, stop_id, t from r4"))
def reach_staying_in_block(spark, sf_dir):
    """With blocks a continuation costs no boarding; up to the boarding limit the times can only fall."""
    asked = D.requests(spark, sf_dir)
    plain = T.best_labels(T.reach(asked, network(spark, sf_dir)), 1).select("request_id", "stop_id", F.col("t").alias("plain"))
    free = T.best_labels(T.reach(asked, network(spark, sf_dir, trips=True)), 1).select("request_id", "stop_id", "t")
    both = plain.join(free, ["request_id", "stop_id"], "full")
    worse = F.col("t").isNull() | (F.col("t") > F.col("plain"))
    return both.where(F.col("plain").isNotNull()).select("request_id", "stop_id", F.when(worse, -1.0).otherwise(F.col("plain")).alias("t"))


def routes(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("bus", "tramway", "subway", "rail")])
    return D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("route_id"), F.col("c_name").alias("short_name"),
        F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")).alias("route_kind"),
        F.lit("FFFFFF").alias("color"), F.lit("000000").alias("text_color"))


def traced(spark, sf_dir):
    from reachlake.plans import itinerary as I

    labels = labels_of_requests(spark, sf_dir)
    build = lambda: written(I.trace_labels(I.label_ends(labels), labels), "rides")
    return labels, prepared(spark, sf_dir, "rides", build)


@query("itinerary_back_trace", D.with_views(["stops", "stop_times", "requests", "walk"],
       f"with {reach_ctes()} select request_id, stop_id target_id, t arrival, b::bigint rides, true as linked from r4"))
def itinerary_back_trace(spark, sf_dir):
    """Every itinerary has as many rides as boardings, ends at its label, and boards after each exit."""
    _, rides = traced(spark, sf_dir)
    key = ["request_id", "target_id"]
    later = rides.select(*key, (F.col("depth") + 1).alias("depth"), F.col("board_time").alias("next_board"))
    chain = rides.join(later, [*key, "depth"], "left")
    ok = F.bool_and((F.col("exit_seq") > F.col("board_seq")) & (F.col("t") >= F.col("board_time")) &
                    (F.col("next_board").isNull() | (F.col("next_board") >= F.col("t") + 35)))
    return chain.groupBy(*key).agg(F.max("t").alias("arrival"), F.count("*").alias("rides"), ok.alias("linked"))


@query("itinerary_legs", D.with_views(["stops", "stop_times", "requests", "walk"],
       f"with {reach_ctes()} select request_id, stop_id target_id, b::bigint rides, t last_exit from r4"))
def itinerary_legs(spark, sf_dir):
    from reachlake.plans import itinerary as I

    _, rides = traced(spark, sf_dir)
    rows = I.legs(rides, D.trips(spark, sf_dir), routes(spark, sf_dir), D.stops(spark, sf_dir))
    return rows.groupBy("request_id", "target_id").agg(
        F.count_if(F.col("method") == "Transit").alias("rides"), F.max("exit_time").alias("last_exit"))


@query("itinerary_details")
def itinerary_details(spark, sf_dir):
    """Walks and rides to every street corner near a stop, with the final walk."""
    from reachlake.plans import itinerary as I

    asked, labels = D.requests(spark, sf_dir), labels_of_requests(spark, sf_dir)
    nodes, times = D.road_nodes(spark, sf_dir), times_of_requests(spark, sf_dir)
    targets = asked.select("request_id", F.lit(0).cast("long").alias("target_id"),
                           ((F.col("x") + 2500) % 8009).alias("x"), ((F.col("y") * 3 + 500) % 4009).alias("y"))
    ends = written(I.access_nodes(targets, nodes, times), "ends")
    rides = written(I.trace_labels(ends, labels), "rides")
    return I.legs(rides, D.trips(spark, sf_dir), routes(spark, sf_dir), D.stops(spark, sf_dir),
                  ends.select("request_id", "target_id", "final_walk_s"))


@query("itinerary_text")
def itinerary_text(spark, sf_dir):
    from reachlake.plans import itinerary as I

    _, rides = traced(spark, sf_dir)
    return I.itinerary_text(I.legs(rides, D.trips(spark, sf_dir), routes(spark, sf_dir), D.stops(spark, sf_dir)))


@query("itinerary_durations")
def itinerary_durations(spark, sf_dir):
    from reachlake.plans import itinerary as I

    labels, rides = traced(spark, sf_dir)
    rows = I.legs(rides, D.trips(spark, sf_dir), routes(spark, sf_dir), D.stops(spark, sf_dir))
    arrivals = T.best_labels(labels).select("request_id", F.col("stop_id").alias("target_id"), F.col("t").alias("arrival"))
    return I.durations(rows, arrivals)


@query("trip_usage", D.with_views(["stops", "stop_times", "requests", "walk"],
       f"with {reach_ctes()} select sum(b)::bigint uses from r4"))
def trip_usage(spark, sf_dir):
    from reachlake.plans import itinerary as I

    return I.trip_usage(traced(spark, sf_dir)[1]).agg(F.sum("uses").alias("uses"))


@query("access_node_of_target", D.with_views(["stops", "stop_times", "requests", "walk", "road_nodes", "road_edges", "road_both"],
       f"""with recursive {ISO_SQL.replace('min(t) t from', "min(t) t, arg_min(b, row(t, b)) b from").replace('t+10+s t from r4', 't+10+s t, b from r4').replace('start+10+s from', 'start+10+s, 0 from')},
       tg as (select request_id, (x+2500)%8009 x, (y*3+500)%4009 y from requests),
       near as (select * from (select request_id, node_id node, sqrt(cast(d2 as double)) d, row_number() over (partition by request_id order by d2, node_id) rn from (
         select request_id, node_id, (tg.x-n.x)*(tg.x-n.x)+(tg.y-n.y)*(tg.y-n.y) d2 from tg, road_nodes n)) where rn<=5)
       select request_id, arg_min(node, row(t+d/1.42+b*120, node)) node_id, round(arg_min(t+d/1.42, row(t+d/1.42+b*120, node)),6) arrival
       from near join times using (request_id, node) group by 1"""))
def access_node_of_target(spark, sf_dir):
    from reachlake.plans import itinerary as I

    asked = D.requests(spark, sf_dir)
    nodes, times = D.road_nodes(spark, sf_dir), times_of_requests(spark, sf_dir)
    targets = asked.select("request_id", F.lit(0).cast("long").alias("target_id"),
                           ((F.col("x") + 2500) % 8009).alias("x"), ((F.col("y") * 3 + 500) % 4009).alias("y"))
    return I.access_nodes(targets, nodes, times).select("request_id", "node_id", r6("arrival", "arrival"))
