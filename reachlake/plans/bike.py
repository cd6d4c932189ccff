"""Bicycle network: rated edges, routes for a batch of pairs, rendering and energy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.functions import bike, geo, text
from reachlake.operators import profile
from reachlake.operators.fixpoint import relax
from reachlake.operators.graph.paths import trace_back
from reachlake.operators.grid import nearest_points
from reachlake.operators.skew import OrderedScan, in_pieces, salted_join
from reachlake.session import written

# Fixed value: points closer than this (metres) are the same.
SAME_POINT = 0.001


def rated_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``bike_edges(id, node_a, node_b, dist, kvs)`` with rating and access; both ends must exist."""
    tags = text.parse_tags(F.col("kvs"))
    known = nodes.select("node_id")
    e = edges.join(known.withColumnRenamed("node_id", "node_a"), "node_a", "left_semi").join(
        known.withColumnRenamed("node_id", "node_b"), "node_b", "left_semi")
    e = e.withColumn("_t", tags).withColumn("rating", bike.rating(F.col("_t")))
    return e.withColumn("access_friendly", bike.rideable(F.col("_t")) & (F.col("rating") > 0)).drop("_t")


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at the end of some edge."""
    ends = edges.select(F.col("node_a").alias("node_id")).unionByName(edges.select(F.col("node_b").alias("node_id")))
    return nodes.join(ends, "node_id", "left_semi")


def polylines(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Ordered points per edge in pieces: ``edge_id, piece, points``."""
    rows = points.join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    return in_pieces(rows, ["edge_id"], ["point_id"], F.struct("lat", "lon", "ele"), name="points")


def directed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions of each rated edge with the climb and the position of the target."""
    at = nodes.select("node_id", "lat", "lon", "ele")
    e = edges.join(at.withColumnsRenamed({"node_id": "node_a", "lat": "a_lat", "lon": "a_lon", "ele": "a_ele"}), "node_a").join(
        at.withColumnsRenamed({"node_id": "node_b", "lat": "b_lat", "lon": "b_lon", "ele": "b_ele"}), "node_b")

    def way(s, t):
        return e.select(F.col("id").alias("edge_id"), F.col(f"node_{s}").alias("src"), F.col(f"node_{t}").alias("dst"), "dist",
                        "rating", "access_friendly", (F.col(f"{t}_ele") - F.col(f"{s}_ele")).alias("climb"),
                        F.col(f"{t}_lat").alias("dst_lat"), F.col(f"{t}_lon").alias("dst_lon"))

    return way("a", "b").unionByName(way("b", "a"))


def snap(points: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Node nearest to each ``points(key, lat, lon)``: ``key, node_id, node_lat, node_lon``, exact.

    A node near on a flat map gives a distance that the answer can't exceed. All nodes within it are
    then compared by great-circle distance, found through cubes in space whose size fits each point's
    own distance; the chord between two points is never longer than the way along the surface.
    """
    flat = {"y": F.radians("lat") * geo.EARTH_M, "x": F.radians("lon") * geo.EARTH_M * F.cos(F.radians(F.lit(_mid_lat(nodes))))}
    at = nodes.select("node_id", F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon"))
    p = written(points.select(key, "lat", "lon").withColumns(flat), "snapped")
    near = nearest_points(p, nodes.withColumns(flat), "node_id", 1).select("x", "y", "node_id")
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("node_lat"), F.col("node_lon"))
    # The least power of two, in metres, that is no less than the distance.
    level = F.ceil(F.log2(F.greatest(d, F.lit(1e-3)) * (1 + 1e-9))).cast("int")
    spots = written(p.join(near, ["x", "y"]).join(at, "node_id").groupBy("lat", "lon").agg(F.min(level).alias("level")), "spots")

    def cube(lat, lon):
        size = F.pow(F.lit(2.0), F.col("level"))
        la, lo = F.radians(lat), F.radians(lon)
        xyz = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
        return {c: F.floor(v * geo.EARTH_M / size) for c, v in zip(("_cx", "_cy", "_cz"), xyz)}

    around = spots.withColumns(cube("lat", "lon"))
    for c in ("_cx", "_cy", "_cz"):
        around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    # Distances lie between a millimetre and half the earth's girth, so there are at most 35 levels.
    levels = [F.lit(r["level"]) for r in spots.select("level").distinct().collect()] or [F.lit(0)]
    placed = at.withColumn("level", F.explode(F.array(*levels))).withColumns(cube("node_lat", "node_lon"))
    both = salted_join(placed, around, ["level", "_cx", "_cy", "_cz"], ["node_id"])
    best = F.min(F.struct(d.alias("d"), "node_id", "node_lat", "node_lon")).alias("b")
    found = both.groupBy("lat", "lon").agg(best)
    return p.join(found, ["lat", "lon"]).select(key, "b.node_id", "b.node_lat", "b.node_lon")


def _mid_lat(nodes: DataFrame) -> float:
    return nodes.agg(F.avg("lat")).first()[0] or 0.0


GROUP = ["od_id", "end_lat", "end_lon", "avoid_hills", "prefer_protected_lanes"]


def routes(od_pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Least-cost routes for ``od_pairs(od_id, start_lat, start_lon, end_lat, end_lon, options...)``.

    Returns ``steps(od_id, step, src, dst, edge_id, ...)`` and
    ``results(od_id, cost, status, start_node, end_node)``. All pairs advance together; labels that
    cannot beat a cost already found at their goal are dropped with the straight distance as bound.
    """
    usable = written(connected_nodes(nodes, edges), "usable")
    start = snap(od_pairs.select("od_id", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")), usable, "od_id")
    end = snap(od_pairs.select("od_id", F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")), usable, "od_id")
    ways = written(directed(edges, nodes), "ways")
    asked = od_pairs.join(start.select("od_id", F.col("node_id").alias("start_node")), "od_id").join(
        end.select("od_id", F.col("node_id").alias("end_node"), F.col("node_lat").alias("_lat"), F.col("node_lon").alias("_lon")), "od_id")
    asked = written(asked.drop("end_lat", "end_lon").withColumnsRenamed({"_lat": "end_lat", "_lon": "end_lon"}), "asked")
    cost = bike.edge_cost(F.col("dist"), F.col("climb"), F.col("rating"), F.col("access_friendly"),
                          F.col("avoid_hills"), F.col("prefer_protected_lanes"))
    ahead = geo.haversine(F.col("dst_lat"), F.col("dst_lon"), F.col("end_lat"), F.col("end_lon"))
    labels, _ = relax(
        asked.select(*GROUP, F.col("start_node").alias("id"), F.lit(0.0).alias("cost")), ways, GROUP,
        step=F.col("cost") + cost, via="edge_id", goals=asked.select(*GROUP, F.col("end_node").alias("id")), bound=ahead)
    labels = written(labels.select(F.col("od_id").alias("source"), "id", "cost", "pred", "edge_id"), "labels")
    goals = asked.select(F.col("od_id").alias("source"), F.col("end_node").alias("id"))
    path = trace_back(labels, goals)
    length = path.groupBy("source").agg(F.max("back").alias("n"))
    steps = path.join(length, "source").join(labels, ["source", "id"]).where("pred is not null").select(
        F.col("source").alias("od_id"), (F.col("n") - F.col("back") - 1).alias("step"), F.col("pred").alias("src"),
        F.col("id").alias("dst"), "edge_id")
    steps = written(steps.join(ways.select("edge_id", "src", "dst", "dist", "climb", "rating"), ["edge_id", "src", "dst"]), "steps")
    found = labels.join(goals, ["source", "id"], "left_semi").select(F.col("source").alias("od_id"), "cost")
    res = asked.select("od_id", "start_node", "end_node").join(found, "od_id", "left")
    none = F.col("cost").isNull() | (F.col("start_node") == F.col("end_node"))
    return steps, res.withColumn("status", F.when(none, "No path found").otherwise("ok"))


def energy(steps: DataFrame) -> DataFrame:
    """Calories, climb, descent and length per route."""
    return steps.groupBy("od_id").agg(
        F.sum(bike.calories(F.col("dist"), F.col("climb"))).alias("calories"),
        F.sum(F.greatest(F.col("climb"), F.lit(0.0))).alias("uphill_meters"),
        F.sum(F.least(F.col("climb"), F.lit(0.0))).alias("downhill_meters"),
        F.sum("dist").alias("total_meters"))


def _close(lat1, lon1, lat2, lon2):
    return F.coalesce(geo.haversine(lat1, lon1, lat2, lon2) <= SAME_POINT, F.lit(False))


def rendered(steps: DataFrame, edges: DataFrame, points: DataFrame, nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Points of each route in riding order: ``od_id, i, lat, lon, ele, rating, cumdist``.

    Edges are turned to the riding direction, points outside the snapped ends are cut, an edge that
    ends where the one before it ended loses that point, distance starts anew on each edge, and the
    end node closes the route.
    """
    turn = edges.select(F.col("id").alias("edge_id"), "node_a")
    p = steps.join(turn, "edge_id").join(points, "edge_id")
    p = p.withColumn("k", F.when(F.col("src") == F.col("node_a"), F.col("point_id")).otherwise(-F.col("point_id")))
    at = nodes.select("node_id", "lat", "lon", "ele")
    ends = results.join(at.withColumnsRenamed({"node_id": "start_node", "lat": "s_lat", "lon": "s_lon", "ele": "s_ele"}), "start_node").join(
        at.withColumnsRenamed({"node_id": "end_node", "lat": "e_lat", "lon": "e_lon", "ele": "e_ele"}), "end_node")
    p = p.join(ends.select("od_id", "s_lat", "s_lon", "e_lat", "e_lon"), "od_id")
    lat, lon = F.col("lat"), F.col("lon")
    kept = profile.between_marks(p, ["od_id"], ["step", "k"], _close(lat, lon, F.col("s_lat"), F.col("s_lon")),
                                 _close(lat, lon, F.col("e_lat"), F.col("e_lon")))
    kept = written(kept.select("od_id", "step", "k", "lat", "lon", "ele", "rating"), "kept")
    last = kept.groupBy("od_id", "step").agg(F.max("k").alias("last_k"), F.max_by(F.struct("lat", "lon"), F.col("k")).alias("last"))
    last = OrderedScan(last, ["od_id"], ["step"]).lag("prev", F.col("last")).frame()
    repeat = _close(F.col("last.lat"), F.col("last.lon"), F.col("prev.lat"), F.col("prev.lon"))
    rows = kept.join(last, ["od_id", "step"]).where(~((F.col("k") == F.col("last_k")) & repeat)).select(kept.columns)
    here = F.struct("step", "lat", "lon", "ele")
    rows = OrderedScan(rows, ["od_id"], ["step", "k"]).index("i").lag("p", here).frame()
    d = geo.haversine_with_climb(F.col("p.lat"), F.col("p.lon"), F.col("p.ele"), lat, lon, F.col("ele"))
    rows = rows.withColumn("d", F.when(F.col("p.step") == F.col("step"), d).otherwise(F.lit(0.0)))
    rows = written(profile.cumulative(rows, ["od_id"], ["i"], F.col("d"), "cumdist").select(
        "od_id", "i", "lat", "lon", "ele", "rating", "cumdist"), "points")
    final = rows.groupBy("od_id").agg(F.max("i").alias("i"), F.max("cumdist").alias("cumdist")).join(
        steps.groupBy("od_id").agg(F.max_by("rating", "step").alias("rating")), "od_id").join(ends, "od_id").select(
        "od_id", (F.col("i") + 1).alias("i"), F.col("e_lat").alias("lat"), F.col("e_lon").alias("lon"),
        F.col("e_ele").alias("ele"), "rating", "cumdist")
    return rows.unionByName(final)
