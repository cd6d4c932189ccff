"""Registered spatial queries: distances, projections, grid joins, shapes, tiles and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlake.catalog.feed_queries import read
from reachlake.catalog.registry import query
from reachlake.functions import geo
from reachlake.operators import feed_ops, grid, raster, shapes, tiles
from reachlake.plans.transit import STOP_RADIUS, STREET_RADIUS
from reachlake.sources import derived as D


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def stop_points(spark, sf_dir):
    """Stops with longitude and latitude of the derived feed."""
    return D.stops(spark, sf_dir).select(
        "stop_id", "x", "y", (F.lit(43.0) + F.col("y") * 9 / 1e6).alias("lat"),
        (F.lit(-79.0) - F.col("x") * 12 / 1e6).alias("lon"))


D.SQL["lonlat"] = "select stop_id, x, y, 43.0::double + y*9/1e6::double lat, -79.0::double - x*12/1e6::double lon from stops"
D._NEEDS["lonlat"] = ["stops"]
HAV = ("2*6371000.0*atan2(sqrt(hh), sqrt(greatest(1-hh,0.0)))")


def hav(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = (f"({v})" for v in (lat1, lon1, lat2, lon2))
    h = (f"(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2))")
    return HAV.replace("hh", h)


@query("haversine", D.with_views(["lonlat"], f"""select a.stop_id, round({hav('a.lat','a.lon','43.6532','-79.3832')}, 4) m,
    round({hav('a.lat','a.lon','43.6532','-79.3832')} + abs(100.0-a.stop_id%300), 4) with_climb from lonlat a"""))
def haversine(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    to = F.lit(43.6532), F.lit(-79.3832)
    ele = (F.col("stop_id") % 300).cast("double")
    return stop_points(spark, sf_dir).select(
        "stop_id", F.round(geo.haversine(lat, lon, *to), 4).alias("m"),
        F.round(geo.haversine_with_climb(lat, lon, ele, *to, F.lit(100.0)), 4).alias("with_climb"))


@query("project_around_city", D.with_views(["lonlat"], f"""
    select stop_id, round(k*cos(radians(lat))*sin(dl),3) px, round(k*(cos(p0)*sin(radians(lat))-sin(p0)*cos(radians(lat))*cos(dl)),3) py
    from (select *, c/sin(c)*6371000.0 k, radians(lon+79.3832) dl, radians(43.6532) p0 from
      (select *, {hav('43.6532','-79.3832','lat','lon')}/6371000.0 c from lonlat))"""))
def project_around_city(spark, sf_dir):
    x, y = geo.project(F.col("lat"), F.col("lon"), *geo.CITY_CENTERS["Toronto"])
    return stop_points(spark, sf_dir).select("stop_id", F.round(x, 3).alias("px"), F.round(y, 3).alias("py"))


@query("web_mercator", D.with_views(["lonlat"], """
    select stop_id, round(radians(lon)*6378137.0,3) mx, round(ln(tan(radians(lat)/2+pi()/4))*6378137.0,3) my from lonlat"""))
def web_mercator(spark, sf_dir):
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    return stop_points(spark, sf_dir).select("stop_id", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


def tile_sql(zoom):
    return (f"cast(trunc((lon+180)/360*pow(2,{zoom})) as bigint)",
            f"cast(trunc((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*pow(2,{zoom})) as bigint)")


@query("map_tile_of_stop", D.with_views(["lonlat"], f"""
    select stop_id, zoom, x, y, round(x/pow(2,zoom)*360-180,6) west, round(degrees(atan(sinh(pi()*(1-2*(y+1)/pow(2,zoom))))),6) south,
    round((x+1)/pow(2,zoom)*360-180,6) east, round(degrees(atan(sinh(pi()*(1-2*y/pow(2,zoom))))),6) north
    from (select stop_id, cast(zoom as int) zoom, {tile_sql('zoom')[0]} x, {tile_sql('zoom')[1]} y from lonlat, (values (7),(12),(16)) z(zoom))"""))
def map_tile_of_stop(spark, sf_dir):
    p = stop_points(spark, sf_dir).withColumn("zoom", F.explode(F.array(F.lit(7), F.lit(12), F.lit(16))))
    x, y = geo.tile_of(F.col("lat"), F.col("lon"), F.col("zoom"))
    t = p.select("stop_id", "zoom", x.alias("x"), y.alias("y"))
    b = geo.tile_bounds(F.col("x"), F.col("y"), F.col("zoom"))
    return t.select("*", *[r6(c).alias(n) for n, c in b.items()])


@query("elevation_tile_key", D.with_views(["lonlat"], """
    select tile_x, tile_y, tile_x+20480 right_x, tile_y+20480 top_y, count(*) n from (
    select cast(floor(radians(lon)*6378137.0/20480)*20480 as double) tile_x, cast(floor(ln(tan(radians(lat)/2+pi()/4))*6378137.0/20480)*20480 as double) tile_y
    from lonlat) group by 1,2"""))
def elevation_tile_key(spark, sf_dir):
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    p = stop_points(spark, sf_dir).select(x.alias("px"), y.alias("py"))
    t = p.select(geo.raster_tile(F.col("px")).cast("double").alias("tile_x"), geo.raster_tile(F.col("py")).cast("double").alias("tile_y"))
    return t.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n")).withColumns(
        {"right_x": F.col("tile_x") + geo.RASTER_M, "top_y": F.col("tile_y") + geo.RASTER_M})


@query("stop_pairs_within_800m", D.with_views(["walk"], "select from_stop, to_stop, round(dist,6) dist from walk"))
def stop_pairs(spark, sf_dir):
    s = D.stops(spark, sf_dir)
    left = s.select(F.col("stop_id").alias("from_stop"), "x", "y")
    right = s.select(F.col("stop_id").alias("to_stop"), "x", "y")
    return grid.within_distance(left, right, STOP_RADIUS).select("from_stop", "to_stop", r6("dist").alias("dist"))


@query("street_nodes_within_100m", D.with_views(["stops", "road_nodes"], """
    select stop_id, node_id, round(sqrt(cast((s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y) as double)),6) dist
    from stops s join road_nodes n on (s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y)<=10000"""))
def street_nodes(spark, sf_dir):
    out = grid.within_distance(D.stops(spark, sf_dir).select("stop_id", "x", "y"), D.road_nodes(spark, sf_dir), STREET_RADIUS)
    return out.select("stop_id", "node_id", r6("dist").alias("dist"))


def knn_sql(k):
    return f"""select stop_id, node_id, round(sqrt(cast(d2 as double)),6) dist, cast(rn as int) "rank" from (
        select *, row_number() over (partition by stop_id order by d2, node_id) rn from (
        select stop_id, node_id, (s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y) d2 from stops s, road_nodes n)) where rn<={k}"""


def _knn(spark, sf_dir, k):
    s = D.stops(spark, sf_dir).select("stop_id", "x", "y")
    near = grid.nearest_points(s, D.road_nodes(spark, sf_dir), "node_id", k)
    return s.join(near, ["x", "y"]).select("stop_id", "node_id", r6("dist").alias("dist"), "rank")


@query("nearest_street_node", D.with_views(["stops", "road_nodes"], knn_sql(1)))
def nearest_street_node(spark, sf_dir):
    return _knn(spark, sf_dir, 1)


@query("five_nearest_street_nodes", D.with_views(["stops", "road_nodes"], knn_sql(5)))
def five_nearest(spark, sf_dir):
    return _knn(spark, sf_dir, 5)


@query("nearest_embedding_points", """with p as (select vec_id id, cast(embedding[1] as double) x, cast(embedding[2] as double) y, label from embeddings)
    select id, other, round(sqrt(d2),6) dist, cast(rn as int) "rank" from (select *, row_number() over (partition by id order by d2, other) rn from (
    select a.id, b.id other, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) d2 from p a, p b)) where rn<=3""")
def nearest_embedding_points(spark, sf_dir):
    p = D.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    near = grid.nearest_points(p, p.withColumnRenamed("id", "other"), "other", 3)
    return p.join(near, ["x", "y"]).select("id", "other", r6("dist").alias("dist"), "rank")


def feed_stops_on_shapes(spark, sf_dir):
    feed = read(spark, sf_dir, "trips", "stop_times", "stops", "shapes")
    segs = feed_ops.shape_segments(feed_ops.shape_points(feed))
    st = feed["stop_times"].select("trip_id", F.col("stop_sequence").alias("seq"), "stop_id")
    at = st.join(feed["trips"].select("trip_id", "shape_id"), "trip_id").where("shape_id is not null").join(
        feed["stops"].select("stop_id", F.col("stop_lon").alias("x"), F.col("stop_lat").alias("y")), "stop_id")
    return shapes.place_on_shape(at, segs)


PLACE_SQL = """segs as materialized (select * from (select shape_id, cast(row_number() over w - 1 as bigint) seg, x x1, y y1, lead(x) over w x2, lead(y) over w y2
      from f_shapes window w as (partition by shape_id order by seq)) where x2 is not null),
    loc as (select trip_id, stop_sequence seq, shape_id, stop_lon x, stop_lat y from f_stop_times join f_trips using (trip_id) join f_stops using (stop_id)),
    pos as (select *, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) l2, case when (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)=0 then 0.0 else
      greatest(0.0, least(1.0, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) end u from loc join segs using (shape_id)),
    dd as (select *, (x-(x1+u*(x2-x1)))*(x-(x1+u*(x2-x1)))+(y-(y1+u*(y2-y1)))*(y-(y1+u*(y2-y1))) d2 from pos),
    placed as materialized (select trip_id, shape_id, seq, x, y, arg_min(seg, row(d2, seg)) seg, arg_min(seg + case when l2<1e-6 then 0.0 else u end, row(d2, seg)) shape_index
      from dd group by all)"""


@query("stops_on_shapes", D.with_views(["f_shapes", "f_stop_times", "f_trips", "f_stops"],
       f"with {PLACE_SQL} select trip_id, seq, seg, round(shape_index, 6) shape_index from placed"))
def stops_on_shapes(spark, sf_dir):
    return feed_stops_on_shapes(spark, sf_dir).select("trip_id", "seq", "seg", r6("shape_index").alias("shape_index"))


@query("requests_in_coverage", D.with_views(["requests", "stops"], """
    select request_id, round(min(d),6) dist, min(d) is not null and duration < 12600 accepted,
      case when min(d) is null then 'no stop within reach' when duration >= 12600 then 'window too long' end reason
    from (select request_id, x qx, y qy, duration + request_id*300 duration from requests) q left join
      (select stop_id, x, y from stops) s on (qx-x)*(qx-x)+(qy-y)*(qy-y)<=1000000
      left join lateral (select sqrt(cast((qx-x)*(qx-x)+(qy-y)*(qy-y) as double)) d) on true group by request_id, duration"""))
def requests_in_coverage(spark, sf_dir):
    from reachlake.plans.requests import validate

    q = D.requests(spark, sf_dir).withColumn("duration", F.col("duration") + F.col("request_id") * 300)
    out = validate(q, D.stops(spark, sf_dir))
    return out.select("request_id", r6("dist").alias("dist"), "accepted", "reason")


@query("near_listed_city", D.with_views(["lonlat"], """
    select stop_id, sqrt(pow(lat-7.5-37.7749,2)+pow(lon-44.0+122.4194,2))*69.0<=75.0 or sqrt(pow(lat-7.5-37.3382,2)+pow(lon-44.0+121.8863,2))*69.0<=75.0
      or sqrt(pow(lat-7.5-37.8044,2)+pow(lon-44.0+122.2712,2))*69.0<=75.0 near from (select stop_id, lat + stop_id%5 lat, lon lon from lonlat)"""))
def near_listed_city(spark, sf_dir):
    p = stop_points(spark, sf_dir)
    return p.select("stop_id", geo.near_any_city(F.col("lat") + F.col("stop_id") % 5 - 7.5, F.col("lon") - 44.0).alias("near"))


def pixels(spark, sf_dir):
    s = D.stops(spark, sf_dir)
    cells = geo.raster_cell(F.col("x"), F.col("y"))
    return s.select(*[c.alias(n) for n, c in cells.items()], (F.col("stop_id") * 37 % 500 / 10).alias("ele")).groupBy(
        *cells).agg(F.max("ele").alias("ele"))


SAMPLE_SQL = """px as (select floor(x/20480) tx, floor(y/20480) ty, floor(x/10) cx, floor(y/10) cy, max(stop_id*37%500/10) ele from stops group by 1,2,3,4),
    pt as (select c_custkey id, (c_custkey*7919)%8009 x, (c_custkey*104729)%8009 y from customer),
    smp as (select id, px.ele raw, x, y from pt left join px on floor(x/10)=cx and floor(y/10)=cy)"""


@query("elevation_sample", D.with_views(["stops"], f"""with {SAMPLE_SQL}
    select id, case when raw is null or raw<=0.25 then 5.0 else raw end ele,
      case when coalesce(raw,0.0)<0.1 then greatest(5.0, coalesce(raw,0.0)) else raw end ele_max from smp"""))
def elevation_sample(spark, sf_dir):
    pts = D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % D.EXTENT).alias("px"), (F.col("c_custkey") * 104729 % D.EXTENT).alias("py"))
    px = pixels(spark, sf_dir)
    a = raster.sample(pts, px, "id", F.lit(5.0))
    b = raster.sample(pts, px, "id", F.lit(5.0), geo.sampled_elevation_max).select("id", F.col("ele").alias("ele_max"))
    return a.join(b, "id").select("id", "ele", "ele_max")


@query("raster_tiles_needed", D.with_views(["road_nodes"], """
    select distinct cast(floor(x/20480)*20480 as double) tile_x, cast(floor(y/20480)*20480 as double) tile_y from road_nodes"""))
def raster_tiles_needed(spark, sf_dir):
    t = raster.tiles_needed(D.road_nodes(spark, sf_dir).select(F.col("x").alias("px"), F.col("y").alias("py")))
    return t.select(F.col("tile_x").cast("double").alias("tile_x"), F.col("tile_y").cast("double").alias("tile_y"))


def node_lonlat(spark, sf_dir):
    return D.road_nodes(spark, sf_dir).select(
        "node_id", (F.lit(37.0) + F.col("y") * 9 / 1e6).alias("lat"), (F.lit(-122.0) - F.col("x") * 12 / 1e6).alias("lon"))


D.SQL["node_ll"] = "select node_id, 37.0::double + y*9/1e6::double lat, -122.0::double - x*12/1e6::double lon from road_nodes"
D._NEEDS["node_ll"] = ["road_nodes"]


def edges_lonlat(spark, sf_dir):
    n = node_lonlat(spark, sf_dir)
    return D.road_edges(spark, sf_dir).join(
        n.select(F.col("node_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "src").join(
        n.select(F.col("node_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "dst")


@query("street_tiles", D.with_views(["node_ll", "road_edges"], f"""with e as (
    select edge_id, zoom, {tile_sql('zoom')[0].replace('lon', 'a.lon')} xa, {tile_sql('zoom')[1].replace('lat', 'a.lat')} ya,
      {tile_sql('zoom')[0].replace('lon', 'b.lon')} xb, {tile_sql('zoom')[1].replace('lat', 'b.lat')} yb
    from road_edges join node_ll a on a.node_id=src join node_ll b on b.node_id=dst, (select unnest([13,14,15,16]) as zoom))
    select edge_id, zoom, x, unnest(generate_series(least(ya,yb), greatest(ya,yb))) y from (
      select *, unnest(generate_series(least(xa,xb), greatest(xa,xb))) x from e)"""))
def street_tiles(spark, sf_dir):
    return tiles.edge_tiles(edges_lonlat(spark, sf_dir), 13, 16)


def stop_tiles(spark, sf_dir, zoom):
    x, y = geo.tile_of(F.col("lat"), F.col("lon"), zoom)
    return stop_points(spark, sf_dir).select(F.lit(zoom).alias("zoom"), x.alias("x"), y.alias("y")).distinct()


PYRAMID_SQL = f"""seed as (select distinct {tile_sql(12)[0]} x, {tile_sql(12)[1]} y from lonlat),
    pyr as (select distinct cast(z as int) zoom, x*m+i x, y*m+j y from seed, (values (12,1),(13,2),(14,4),(15,8)) p(z,m),
      generate_series(0,7) a(i), generate_series(0,7) b(j) where i<m and j<m)"""


@query("tile_pyramid", D.with_views(["lonlat"], f"with {PYRAMID_SQL} select * from pyr"))
def tile_pyramid(spark, sf_dir):
    return tiles.pyramid(stop_tiles(spark, sf_dir, 12), 15)


@query("missing_tiles", D.with_views(["lonlat"], f"""with {PYRAMID_SQL} select * from pyr where (zoom,x,y) not in
    (select 15, {tile_sql(15)[0]}, {tile_sql(15)[1]} from lonlat)"""))
def missing_tiles(spark, sf_dir):
    return tiles.missing_tiles(tiles.pyramid(stop_tiles(spark, sf_dir, 12), 15), stop_tiles(spark, sf_dir, 15))


@query("tiles_in_polygons", D.with_views(["lonlat", "requests"], f"""with {PYRAMID_SQL},
    ring as (select request_id pid, 43.0+(y)*9/1e6 lat0, -79.0-(x)*12/1e6 lon0 from requests),
    b as (select *, x/pow(2,zoom)*360-180 w, (x+1)/pow(2,zoom)*360-180 e, degrees(atan(sinh(pi()*(1-2*(y+1)/pow(2,zoom))))) s,
      degrees(atan(sinh(pi()*(1-2*y/pow(2,zoom))))) n from pyr)
    select pid polygon_id, zoom, x, y from b join ring on w<=lon0+0.011 and e>=lon0-0.01 and s<=lat0+0.009 and n>=lat0-0.008"""))
def tiles_in_polygons(spark, sf_dir):
    q = D.requests(spark, sf_dir).select(
        F.col("request_id").alias("polygon_id"), (F.lit(43.0) + F.col("y") * 9 / 1e6).alias("lat0"), (F.lit(-79.0) - F.col("x") * 12 / 1e6).alias("lon0"))
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(a).alias("a"), F.lit(o).alias("o"))
                        for i, (a, o) in enumerate([(-0.008, -0.01), (-0.008, 0.011), (0.009, 0.011), (0.009, -0.01)])])
    pts = q.withColumn("c", F.explode(corners)).select(
        "polygon_id", "c.seq", (F.col("lat0") + F.col("c.a")).alias("lat"), (F.col("lon0") + F.col("c.o")).alias("lon"))
    return tiles.tiles_in_polygons(tiles.pyramid(stop_tiles(spark, sf_dir, 12), 15), pts)


@query("edge_points_geojson", D.with_views(["node_ll", "road_edges"], """
    select edge_id, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[['||round(a.lon*1e6)::bigint||','||round(a.lat*1e6)::bigint||'],['
      ||round(b.lon*1e6)::bigint||','||round(b.lat*1e6)::bigint||']]},"properties":{"edge_id":'||edge_id||'}}' feature
    from road_edges join node_ll a on a.node_id=src join node_ll b on b.node_id=dst"""))
def edge_points_geojson(spark, sf_dir):
    from reachlake.sources.sinks import line_feature

    e = edges_lonlat(spark, sf_dir)
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long")
    line = F.array(F.array(micro("lon1"), micro("lat1")), F.array(micro("lon2"), micro("lat2")))
    return e.select("edge_id", line_feature(line, F.struct("edge_id")).alias("feature"))
