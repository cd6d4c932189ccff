"""Registered queries: bicycle network, profiles, text columns, graph documents and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlake.catalog.feed_queries import read
from reachlake.catalog.geo_queries import PLACE_SQL, feed_stops_on_shapes, hav, node_lonlat, r6, stop_points
from reachlake.catalog.graph_queries import cheap_roads, road_vertices
from reachlake.catalog.registry import prepared, query
from reachlake.functions import bike, codes, geo, text
from reachlake.operators import feed_ops, grid, profile, raster
from reachlake.operators.shapes import shape_slices
from reachlake.operators.skew import OrderedScan
from reachlake.plans import bike as B
from reachlake.session import new_table_path, shuffles_freed, written
from reachlake.sources import derived as D
from reachlake.sources import sinks

# Street tags cycled over the edges, and the rating and access each must get.
TAGS = [
    ("{highway=cycleway}", 5, True), ("{highway=primary}", 1, True), ("{highway=tertiary}", 2, True),
    ("{highway=residential, bicycle=yes}", 3, True), ("{highway=footway, bicycle=yes}", 5, False),
    ("{highway=steps}", 0, False), ("{cycleway:right=shared_lane, highway=secondary}", 4, True),
    ("{highway=footway}", 0, False), ("{access=private, highway=service}", 3, False),
    ("{highway=track, cycleway=opposite_track}", 5, False), ("{surface=asphalt, bicycle=permissive}", 3, True),
    ("{highway=trunk, bicycle=no, area=yes}", 1, False), ("{highway=motorway, bicycle=designated, lit}", 5, True),
]
N = len(TAGS)


def bike_nodes(spark, sf_dir):
    return node_lonlat(spark, sf_dir).withColumn("ele", (F.col("node_id") * 37 % 90).cast("double"))


def bike_edges(spark, sf_dir):
    tags = F.array(*[F.lit(t) for t, _, _ in TAGS])
    return D.road_edges(spark, sf_dir).select(
        F.col("edge_id").alias("id"), F.col("src").alias("node_a"), F.col("dst").alias("node_b"),
        (F.col("weight") + 220.0).alias("dist"), F.element_at(tags, (F.col("edge_id") % N + 1).cast("int")).alias("kvs"))


def bike_points(spark, sf_dir):
    """Start, middle and end of each edge."""
    n = bike_nodes(spark, sf_dir)
    e = bike_edges(spark, sf_dir)
    a = n.select(F.col("node_id").alias("node_a"), F.struct("lat", "lon", "ele").alias("a"))
    b = n.select(F.col("node_id").alias("node_b"), F.struct("lat", "lon", "ele").alias("b"))
    mid = F.struct(*[((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2).alias(c) for c in ("lat", "lon", "ele")])
    return e.join(a, "node_a").join(b, "node_b").select(
        F.col("id").alias("edge_id"), F.posexplode(F.array("a", mid, "b")).alias("pos", "p")).select(
        (F.col("edge_id") * 3 + F.col("pos")).alias("point_id"), "edge_id", "p.lat", "p.lon", "p.ele")


def od_pairs(spark, sf_dir):
    q = D.requests(spark, sf_dir)
    at = lambda x, y, p: [(F.lit(37.0) + y * 9 / 1e6).alias(f"{p}_lat"), (F.lit(-122.0) - x * 12 / 1e6).alias(f"{p}_lon")]
    x, y = F.col("x"), F.col("y")
    return q.select(F.col("request_id").alias("od_id"), *at(x, y, "start"), *at(F.least(x + 700, F.lit(7800)), F.least(y + 500, F.lit(7800)), "end"),
                    F.lit(0.5).alias("avoid_hills"), F.lit(0.5).alias("prefer_protected_lanes"))


D.SQL["b_nodes"] = "select *, cast(node_id*37%90 as double) ele from node_ll"
D._NEEDS["b_nodes"] = ["node_ll"]
D.SQL["b_edges"] = f"""select edge_id id, src node_a, dst node_b, weight+220.0 dist, ({[t for t, _, _ in TAGS]})[edge_id%{N}+1] kvs,
    ({[r for _, r, _ in TAGS]})[edge_id%{N}+1] rating, ({[a for _, _, a in TAGS]})[edge_id%{N}+1] access from road_edges"""
D._NEEDS["b_edges"] = ["road_edges"]
D.SQL["b_ways"] = """select id, node_a src, node_b dst, dist, rating, access, b.ele-a.ele climb from b_edges join b_nodes a on a.node_id=node_a join b_nodes b on b.node_id=node_b
    union all select id, node_b, node_a, dist, rating, access, a.ele-b.ele from b_edges join b_nodes a on a.node_id=node_a join b_nodes b on b.node_id=node_b"""
D._NEEDS["b_ways"] = ["b_edges", "b_nodes"]
COST = """dist + greatest(climb,0.0)*(1500.0*pow(0.5,30)) + 0.5*(([2.0,1.0,0.7,0.65,0.5,0.5])[rating+1]+0.5)*0.5*dist + case when access then 0.0 else 20.0*dist end"""
SPEED = """case when s between 0.02 and 0.1 then 6.0 when s between 0.1 and 0.2 then 4.5 when s>=0.2 then 3.5 when s between -0.02 and 0.02 then 6.26
    when s between -0.1 and 0 then 6.6 when s<=-0.1 then 7.0 else 6.0 end::double"""


@query("parse_tags", """select p_partkey, p_brand brand, p_name||'=x' as kind, 3 as n from part""")
def parse_tags(spark, sf_dir):
    raw = F.concat(F.lit("{brand="), "p_brand", F.lit(", kind="), "p_type", F.lit(", size="), F.col("p_size").cast("string"),
                   F.lit(", junk, kind="), "p_name", F.lit("=x}"))
    t = D.table(spark, sf_dir, "part").select("p_partkey", text.parse_tags(raw).alias("t"))
    return t.select("p_partkey", F.col("t")["brand"].alias("brand"), F.col("t")["kind"].alias("kind"), F.size("t").alias("n"))


@query("rated_edges", D.with_views(["b_edges"], "select id, rating, access access_friendly from b_edges"))
def rated_edges(spark, sf_dir):
    return B.rated_edges(bike_edges(spark, sf_dir), bike_nodes(spark, sf_dir)).select("id", "rating", "access_friendly")


@query("bike_edges_with_both_ends", D.with_views(["b_edges"], """select id from b_edges where node_a in (select max(c_custkey) from customer group by c_nationkey
    union select c_custkey from customer where c_acctbal>0) and node_b in (select max(c_custkey) from customer group by c_nationkey union select c_custkey from customer where c_acctbal>0)"""))
def bike_edges_with_both_ends(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    keep = c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("node_id")).select("node_id").union(c.where("c_acctbal > 0").select("c_custkey"))
    return B.rated_edges(bike_edges(spark, sf_dir), keep.distinct()).select("id")


@query("nodes_with_edges", D.with_views(["cheap_roads", "road_nodes"], """
    select node_id from road_nodes where node_id in (select src from cheap_roads union select dst from cheap_roads)"""))
def nodes_with_edges(spark, sf_dir):
    e = cheap_roads(spark, sf_dir).select(F.col("src").alias("node_a"), F.col("dst").alias("node_b"))
    return B.connected_nodes(D.road_nodes(spark, sf_dir).select("node_id"), e)


@query("edge_polylines", D.with_views(["b_edges", "b_nodes"], """with e as (select id, unnest([[a.lat, a.lon, a.ele], [(a.lat+b.lat)/2, (a.lon+b.lon)/2, (a.ele+b.ele)/2], [b.lat, b.lon, b.ele]]) p, unnest([0, 1, 2]) i
      from b_edges join b_nodes a on a.node_id=node_a join b_nodes b on b.node_id=node_b)
    select id edge_id, 0::bigint piece, string_agg(round(p[1]*2e6)::bigint||' '||round(p[2]*2e6)::bigint||' '||round(p[3]*2)::bigint, ',' order by i) points from e group by id"""))
def edge_polylines(spark, sf_dir):
    out = B.polylines(bike_edges(spark, sf_dir), bike_points(spark, sf_dir))
    whole = lambda p: F.concat_ws(" ", *[F.round(p[c] * k).cast("long").cast("string") for c, k in (("lat", 2e6), ("lon", 2e6), ("ele", 2.0))])
    return out.select("edge_id", "piece", F.array_join(F.transform("points", whole), ",").alias("points"))


def _two_latitudes(df):
    """Rows as they are and once more 23 degrees to the north, with ids from a million on."""
    north = df.withColumns({"lat": F.col("lat") + 23.0, "id": F.col("id") + 1_000_000})
    return df.unionByName(north)


D.SQL["far_nodes"] = "select node_id id, lat, lon from node_ll union all select node_id+1000000, lat+23.0, lon from node_ll"
D._NEEDS["far_nodes"] = ["node_ll"]
D.SQL["far_stops"] = """select stop_id id, 37.0::double+y*9/1e6::double lat, -122.0::double-x*12/1e6::double lon from stops
    union all select stop_id+1000000, 37.0::double+y*9/1e6::double+23.0, -122.0::double-x*12/1e6::double from stops"""
D._NEEDS["far_stops"] = ["stops"]


@query("snap_at_two_latitudes", D.with_views(["far_nodes", "far_stops"], f"""select p.id, round(min({hav('p.lat','p.lon','n.lat','n.lon')}), 4) dist,
    min(abs(n.lat - p.lat)) < 1 near from far_stops p, far_nodes n group by p.id"""))
def snap_at_two_latitudes(spark, sf_dir):
    """Nearest node by great-circle distance, where east-west degrees differ in length."""
    nodes = _two_latitudes(node_lonlat(spark, sf_dir).withColumnRenamed("node_id", "id"))
    s = D.stops(spark, sf_dir)
    points = _two_latitudes(s.select(F.col("stop_id").alias("id"), (F.lit(37.0) + F.col("y") * 9 / 1e6).alias("lat"), (F.lit(-122.0) - F.col("x") * 12 / 1e6).alias("lon")))
    got = B.snap(points, nodes.withColumnRenamed("id", "node_id"), "id").join(points, "id")
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("node_lat"), F.col("node_lon"))
    return got.select("id", F.round(d, 4).alias("dist"), (F.abs(F.col("node_lat") - F.col("lat")) < 1).alias("near"))


@query("bike_edge_costs", D.with_views(["b_ways"], f"select id edge_id, src, dst, round({COST},6) cost from b_ways"))
def bike_edge_costs(spark, sf_dir):
    n = bike_nodes(spark, sf_dir)
    ways = B.directed(B.rated_edges(bike_edges(spark, sf_dir), n), n)
    c = bike.edge_cost(F.col("dist"), F.col("climb"), F.col("rating"), F.col("access_friendly"), F.lit(0.5), F.lit(0.5))
    return ways.select("edge_id", "src", "dst", r6(c).alias("cost"))


@query("ride_energy", D.with_views(["b_ways"], f"""
    select rating, round(sum(greatest(v*(7.0+0.3153*v*v+10.5*86.0*s),5.0)*(dist/v)/4186.0/0.25),4) calories, sum(greatest(climb,0.0)) uphill_meters,
      sum(least(climb,0.0)) downhill_meters, sum(dist) total_meters from (select *, {SPEED} v from (select *, climb/dist s from b_ways)) group by 1"""))
def ride_energy(spark, sf_dir):
    """Energy of all directed edges of each rating."""
    n = bike_nodes(spark, sf_dir)
    ways = B.directed(B.rated_edges(bike_edges(spark, sf_dir), n), n).withColumn("od_id", F.col("rating"))
    return B.energy(ways).select(F.col("od_id").alias("rating"), F.round("calories", 4).alias("calories"), "uphill_meters", "downhill_meters", "total_meters")


ROUTE_SQL = f"""pt as (select request_id od, x, y, least(x+700,7800) x2, least(y+500,7800) y2 from requests),
    ll as (select od, 37.0::double+y*9/1e6::double la, -122.0::double-x*12/1e6::double lo, 37.0::double+y2*9/1e6::double la2, -122.0::double-x2*12/1e6::double lo2 from pt),
    s as (select od, arg_min(node_id, row({hav('la','lo','lat','lon')}, node_id)) a, arg_min(node_id, row({hav('la2','lo2','lat','lon')}, node_id)) b from ll, b_nodes group by 1),
    w(k, od, id, c) as (select 0, od, a, 0.0::double from s union all select k+1, w.od, dst, min(c+{COST}) from w join b_ways on src=w.id where k<110 group by 1,2,3),
    best as (select od, id, min(c) c from w group by 1,2)"""


@query("bike_routes", D.with_views(["b_ways", "b_nodes", "requests"], f"""with recursive {ROUTE_SQL}
    select s.od od_id, a start_node, b end_node, round(c,4) cost, round(c,4) ridden, case when a=b then 'No path found' else 'ok' end status
    from s left join best on best.od=s.od and best.id=b"""))
def bike_routes(spark, sf_dir):
    """Least-cost routes; the cost of the ridden steps must add up to the label's cost."""
    rated, steps, res = found_routes(spark, sf_dir)
    e = rated.select(F.col("id").alias("edge_id"), "access_friendly")
    c = bike.edge_cost(F.col("dist"), F.col("climb"), F.col("rating"), F.col("access_friendly"), F.lit(0.5), F.lit(0.5))
    ridden = steps.join(e, "edge_id").groupBy("od_id").agg(F.sum(c).alias("ridden"))
    return res.join(ridden, "od_id", "left").select(
        "od_id", "start_node", "end_node", F.round("cost", 4).alias("cost"), F.round(F.coalesce("ridden", F.lit(0.0)), 4).alias("ridden"), "status")


def found_routes(spark, sf_dir):
    def build():
        n = bike_nodes(spark, sf_dir)
        e = written(B.rated_edges(bike_edges(spark, sf_dir), n), "rated")
        return e, *B.routes(od_pairs(spark, sf_dir), n, e)

    return prepared(spark, sf_dir, "bike-routes", build)


@query("bike_route_points")
def bike_route_points(spark, sf_dir):
    """Rendered routes with elevation, rating and distance so far."""
    e, steps, res = found_routes(spark, sf_dir)
    return B.rendered(steps, e, bike_points(spark, sf_dir), bike_nodes(spark, sf_dir), res)


@query("bike_route_runs_and_extremes")
def bike_route_runs(spark, sf_dir):
    pts = written(bike_route_points(spark, sf_dir), "points")
    runs = profile.runs(pts, ["od_id"], "i", "rating")
    top = profile.extremes(pts, ["od_id"], max_ele=F.col("ele"), max_dist=F.col("cumdist"))
    return runs.join(top, "od_id")


EV = """ev as (select user_id, event_type, value, event_id, cast(row_number() over (partition by user_id order by ts, event_id)-1 as bigint) i from events)"""


def event_profile(spark, sf_dir):
    return OrderedScan(D.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).index("i").frame()


@query("total_climb", f"with {EV} select user_id, round(coalesce(sum(greatest(d,0.0)),0.0),4) climb from (select user_id, value-lag(value) over (partition by user_id order by i) d from ev) group by 1")
def total_climb(spark, sf_dir):
    out = profile.total_climb(D.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value"))
    return out.select("user_id", F.round("climb", 4).alias("climb"))


@query("cumulative_profile", f"with {EV} select event_id, round(sum(value) over (partition by user_id order by i),4) total from ev")
def cumulative_profile(spark, sf_dir):
    out = profile.cumulative(D.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value"))
    return out.select("event_id", F.round("total", 4).alias("total"))


@query("consecutive_pairs", f"with {EV} select * from (select event_id, event_type, lead(event_type) over (partition by user_id order by i) next from ev) where next is not null")
def consecutive_pairs(spark, sf_dir):
    return profile.consecutive(D.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "next")


@query("profile_runs", f"""with {EV}, c as (select *, coalesce(event_type<>lag(event_type) over (partition by user_id order by i), true) ch, max(i) over (partition by user_id) m from ev)
    select user_id, i as first, coalesce(lead(i) over (partition by user_id order by i), m) as last, event_type from c where ch and true
    qualify i<>m or m=0""")
def profile_runs(spark, sf_dir):
    return profile.runs(event_profile(spark, sf_dir), ["user_id"], "i", "event_type").select("user_id", "first", "last", "event_type")


@query("profile_between_marks", f"""with {EV}, a as (select user_id, min(i) lo from ev where event_type='click' group by 1),
    z as (select ev.user_id, min(i) hi from ev join a using (user_id) where event_type='purchase' and i>=lo group by 1)
    select event_id from ev join a using (user_id) left join z using (user_id) where i>=lo and (hi is null or i<hi)""")
def profile_between_marks(spark, sf_dir):
    t = F.col("event_type")
    return profile.between_marks(D.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], t == "click", t == "purchase").select("event_id")


@query("profile_extremes", "select user_id, max(value) top, max(event_id) last_event from events group by 1")
def profile_extremes(spark, sf_dir):
    return profile.extremes(D.table(spark, sf_dir, "events"), ["user_id"], top=F.col("value"), last_event=F.col("event_id"))


@query("elevation_enrichment", D.with_views(["b_nodes", "stops"], f"""with px as (select floor(mx/10) cx, floor(my/10) cy, max(e) ele from (
      select radians(-122.0-x*12/1e6)*6378137.0 mx, ln(tan(radians(37.0+y*9/1e6)/2+pi()/4))*6378137.0 my, stop_id*37%500/10 e from stops) group by 1,2),
    nd as (select node_id, ele, lat, radians(lon)*6378137.0 mx, ln(tan(radians(lat)/2+pi()/4))*6378137.0 my,
      sqrt(pow(lat-37.7749,2)+pow(lon+122.4194,2))*69.0<=75.0 or sqrt(pow(lat-37.3382,2)+pow(lon+121.8863,2))*69.0<=75.0 or sqrt(pow(lat-37.8044,2)+pow(lon+122.2712,2))*69.0<=75.0 near from b_nodes)
    select node_id, case when not near then nd.ele when px.ele is null or px.ele<=0.25 then 0.0 else px.ele end ele
    from nd left join px on floor(mx/10)=cx and floor(my/10)=cy"""))
def elevation_enrichment(spark, sf_dir):
    s = D.stops(spark, sf_dir)
    mx, my = geo.web_mercator(F.lit(37.0) + F.col("y") * 9 / 1e6, F.lit(-122.0) - F.col("x") * 12 / 1e6)
    cells = geo.raster_cell(F.col("px"), F.col("py"))
    px = s.select((F.col("stop_id") * 37 % 500 / 10).alias("ele"), mx.alias("px"), my.alias("py")).withColumns(cells)
    px = px.groupBy(*cells).agg(F.max("ele").alias("ele"))
    return raster.enrich(bike_nodes(spark, sf_dir), px, "node_id").select("node_id", "ele")


@query("graph_documents", D.with_views(["road_nodes", "road_edges", "b_edges"], """
    select 'nodes' as "table", count(*) n from road_nodes union all select 'edges rated '||rating||access, count(*) from b_edges group by 1
    union all select 'points', sum(case when edge_id%2=0 then 2 else 3 end)::bigint from road_edges"""))
def graph_documents(spark, sf_dir):
    """Nested JSON documents, one per edge, to tables that can be rated; odd edges lack their end point."""
    n = bike_nodes(spark, sf_dir)
    e = bike_edges(spark, sf_dir)
    end = lambda k, p: n.select(F.col("node_id").alias(k), F.struct("lat", "lon", "ele").alias(p))
    mid = F.struct(*[((F.col(f"a.{c}") * 2 + F.col(f"b.{c}")) / 3).alias(c) for c in ("lat", "lon", "ele")])
    pts = F.when(F.col("id") % 2 == 0, F.array("a", "b")).otherwise(F.array(F.col("a"), mid))
    edge = F.struct("id", F.col("node_a").alias("nodeA"), F.col("node_b").alias("nodeB"), "dist", text.parse_tags(F.col("kvs")).alias("kvs"), pts.alias("points"))
    docs = e.join(end("node_a", "a"), "node_a").join(end("node_b", "b"), "node_b").select(F.array(edge).alias("edges"))
    nodes = n.select(F.array(F.struct(F.col("node_id").alias("id"), "lat", "lon", "ele")).alias("nodes"))
    path = new_table_path(spark, "graph-json")
    docs.write.json(path)
    nodes.write.mode("append").json(path)
    tables = sinks.graph_tables(spark.read.schema(sinks.GRAPH_SCHEMA).json(path))
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, d in zip(("nodes", "points"), tables[::2])]
    kind = F.concat(F.lit("edges rated "), F.col("rating"), F.col("access_friendly").cast("string"))
    parts.append(B.rated_edges(tables[1], tables[0]).groupBy(kind.alias("table")).agg(F.count("*").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("union_of_cities", D.with_views(["road_edges", "trade_edges"], """select 'streets' city, src, dst, weight from road_edges union all select 'trade', src, dst, weight from trade_edges"""))
def union_of_cities(spark, sf_dir):
    cols = ["src", "dst", "weight"]
    return sinks.union_cities({"streets": D.road_edges(spark, sf_dir).select(*cols), "trade": D.trade_edges(spark, sf_dir).select(*cols)})


@query("stops_in_circles", D.with_views(["stops", "requests"], """select distinct stop_id from stops s, requests q where (s.x-q.x)*(s.x-q.x)+(s.y-q.y)*(s.y-q.y)<=250000"""))
def stops_in_circles(spark, sf_dir):
    return grid.any_within(D.stops(spark, sf_dir), D.requests(spark, sf_dir).select("x", "y"), 500.0).select("stop_id")


@query("time_texts", D.with_views(["stop_times"], """
    select trip_id, seq, lpad((a//3600)::varchar,2,'0')||':'||lpad((a%3600//60)::varchar,2,'0')||':'||lpad((a%60)::varchar,2,'0') service_time,
      lpad((a%86400//3600)::varchar,2,'0')||':'||lpad((a%3600//60)::varchar,2,'0')||':'||lpad((a%60)::varchar,2,'0') duration,
      lpad((m//3600)::varchar,2,'0')||':'||lpad((m%3600//60)::varchar,2,'0')||case when a>=86400 then ' am (next day)' when a>=43200 then ' pm' else ' am' end clock,
      case when w<60 then w||'s' else (w//60)||'m'||(w%60)||'s' end walk, (cast(floor(w*1.42/10+0.5) as bigint)*10)||' meters' distance
    from (select *, case when a>43200 and a<46800 then a else a%43200 end m from (select trip_id, seq, arrival+trip_id%7*3600 a, (trip_id+seq)%900 w from stop_times))"""))
def time_texts(spark, sf_dir):
    a, w = F.col("a"), F.col("w")
    st = D.stop_times(spark, sf_dir).select("trip_id", "seq", (F.col("arrival") + F.col("trip_id") % 7 * 3600).alias("a"), ((F.col("trip_id") + F.col("seq")) % 900).alias("w"))
    return st.select("trip_id", "seq", text.format_time(a).alias("service_time"), text.duration_text(a).alias("duration"),
                     text.clock_text(a).alias("clock"), text.walk_text(w).alias("walk"), text.walk_distance_text(w * 1.42).alias("distance"))


@query("stop_name_texts", """select s_suppkey, case s_suppkey%3 when 0 then 'Supplier#'||right(s_name, 9) when 1 then 'Pearson Airport Terminal '||s_suppkey
    else 'Main St Station   Northbound Platform Station' end shown from supplier""")
def stop_name_texts(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, F.concat(F.lit("AT PEARSON AIRPORT TERMINAL "), k, F.lit(" platform"))).otherwise(
        F.lit("MAIN ST Station - Northbound Platform"))
    return D.table(spark, sf_dir, "supplier").select("s_suppkey", text.stop_text(name).alias("shown"))


@query("mode_widths", """select c_custkey, (['bus','tram','subway','rail',''])[c_custkey%5+1] as mode, ([2.6,3.4,4.3,4.9,2.6])[c_custkey%5+1]::double width from customer""")
def mode_widths(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("bus", "tramway", "subway", "rail", "ferry")])
    rows = D.table(spark, sf_dir, "customer").select("c_custkey", codes.mode_label(F.element_at(kinds, (F.col("c_custkey") % 5 + 1).cast("int"))).alias("mode"))
    return rows.withColumn("width", codes.line_width(F.col("mode")))


@query("request_dedupe", "select count(*) requests, count(distinct row(user_id%40, event_type, event_id%3)) distinct_requests from events")
def request_dedupe(spark, sf_dir):
    u = F.col("user_id") % 40
    key = text.request_key(43.0 + u / 1000, -79.0 - u / 1000, F.col("event_type"), F.col("event_id") % 3)
    rows = D.table(spark, sf_dir, "events").select(key.alias("request_key"))
    return rows.agg(F.count("*").alias("requests"), F.count_distinct("request_key").alias("distinct_requests"))


@query("shape_slices", D.with_views(["f_shapes", "f_stop_times", "f_trips", "f_stops"], f"""with {PLACE_SQL},
    leg as (select trip_id, shape_id, arg_min(shape_index, seq) a, arg_max(shape_index, seq) b from placed group by 1,2),
    pts as (select shape_id, x, y, row_number() over (partition by shape_id order by seq)-1 i from f_shapes),
    sp as (select *, floor(a)::bigint lo, greatest(ceil(b), floor(a))::bigint hi from leg)
    select sp.trip_id leg_id, p.i::bigint i, round(case when hi-lo<=1 then p.x when p.i=lo then p.x+(nx.x-p.x)*(a-floor(a)) when p.i=hi and b>floor(b) then pv.x+(p.x-pv.x)*(b-floor(b)) else p.x end,6) x,
      round(case when hi-lo<=1 then p.y when p.i=lo then p.y+(nx.y-p.y)*(a-floor(a)) when p.i=hi and b>floor(b) then pv.y+(p.y-pv.y)*(b-floor(b)) else p.y end,6) y
    from sp join pts p on p.shape_id=sp.shape_id and p.i between lo and hi left join pts nx on nx.shape_id=sp.shape_id and nx.i=p.i+1 left join pts pv on pv.shape_id=sp.shape_id and pv.i=p.i-1"""))
def slices(spark, sf_dir):
    placed = written(feed_stops_on_shapes(spark, sf_dir), "placed")
    legs = placed.groupBy(F.col("trip_id").alias("leg_id"), "shape_id").agg(
        F.min_by("shape_index", "seq").alias("a"), F.max_by("shape_index", "seq").alias("b"))
    pts = feed_ops.shape_points(read(spark, sf_dir, "shapes"))
    pts = OrderedScan(pts, ["shape_id"], ["seq"]).index("i").frame()
    return shape_slices(legs, pts).select("leg_id", "i", r6("x").alias("x"), r6("y").alias("y"))


@query("nearest_point_on_line", D.with_views(["stops", "road_nodes"], """select stop_id, node_row as "row", round(sqrt(least(
      case when x<=7800 then (y-node_row*200)*(y-node_row*200) else (x-7800)*(x-7800)+(y-node_row*200)*(y-node_row*200) end)::double),6) dist
    from (select stop_id, x, y, cast(least(greatest(ceil(y/200.0-0.5),0),(select max(c_custkey)//40 - 1 from customer)) as bigint) node_row from stops)"""))
def nearest_point_on_line(spark, sf_dir):
    """Nearest full street row, a line of 39 segments, for each stop."""
    top = D.road_nodes(spark, sf_dir).agg(F.max("node_id")).first()[0] // D.ROAD_COLUMNS - 1
    nodes = D.road_nodes(spark, sf_dir).select(F.expr(f"node_id div {D.ROAD_COLUMNS}").alias("row"), F.col("x").alias("seq"), "x", "y").where(F.col("row") <= top)
    segs = feed_ops.shape_segments(nodes.withColumnRenamed("row", "shape_id")).withColumnRenamed("shape_id", "row")
    s = D.stops(spark, sf_dir).select("stop_id", "x", "y")
    near = grid.nearest(s, segs, ["row", "seg"])
    return s.join(near, ["x", "y"]).select("stop_id", "row", r6(F.sqrt("dist2")).alias("dist"))


@query("stream_of_requests", "select count(distinct user_id) answered from events")
def stream_of_requests(spark, sf_dir):
    """Requests read as a stream, repeats dropped, each micro-batch answered with its nearest stop."""
    from reachlake.streaming.requests import answer

    u = F.col("request_id")
    src = new_table_path(spark, "requests")
    # Only the ids are dealt; the other columns follow from them.
    asked = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id")).repartition(4).select(
        u, F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), (43.0 + u / 1000).alias("latitude"), (-79.0 - u / 1000).alias("longitude"),
        F.array(F.lit("A1")).alias("agencies"), F.array(F.lit("bus")).alias("modes"), F.lit(28800).alias("start_time"),
        F.lit(3600.0).alias("max_search_time"), F.lit(0).cast("long").alias("transfer_penalty_secs"))
    with shuffles_freed(spark):
        asked.write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 2).parquet(src)
    stops = stop_points(spark, sf_dir).select("stop_id", F.col("lon").alias("x"), F.col("lat").alias("y"))

    def search(batch):
        q = batch.select("request_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"))
        return q.join(grid.nearest_points(q, stops, "stop_id"), ["x", "y"]).select("request_id", "stop_id", "dist")

    out = new_table_path(spark, "answers")
    run = answer(stream, search, out, new_table_path(spark, "stream"))
    run.awaitTermination()
    return spark.read.parquet(out).agg(F.count("request_id").alias("answered"))


@query("itinerary_geojson")
def itinerary_geojson(spark, sf_dir):
    """Line and end points of every ride on a trip with a shape, as GeoJSON features."""
    from reachlake.catalog.transit_queries import traced
    from reachlake.operators.skew import in_pieces
    from reachlake.plans.itinerary import leg_shapes

    _, rides = traced(spark, sf_dir)
    placed = feed_stops_on_shapes(spark, sf_dir).withColumn("trip_id", F.col("trip_id").cast("long"))
    pts = OrderedScan(feed_ops.shape_points(read(spark, sf_dir, "shapes")), ["shape_id"], ["seq"]).index("i").frame()
    cut = written(leg_shapes(rides, placed, pts), "leg-shapes")
    spot = F.array(F.col("x"), F.col("y"))
    style = F.struct(F.lit("FFFFFF").alias("color"), F.lit(codes.OTHER_WIDTH).alias("line_width"))
    lines = in_pieces(cut, ["leg_id"], ["i"], spot, name="line").select(
        "leg_id", F.col("piece"), sinks.line_feature(F.col("line"), style).alias("feature"))
    ends = cut.groupBy("leg_id").agg(F.array(F.min_by(spot, F.col("i")), F.max_by(spot, F.col("i"))).alias("e"))
    color = F.struct(F.lit("FFFFFF").alias("color"))
    return lines.unionByName(ends.select("leg_id", F.lit(-1).cast("long").alias("piece"), sinks.points_feature(F.col("e"), color).alias("feature")))
