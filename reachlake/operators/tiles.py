"""Map tile sets: indexes, pyramids, gaps and polygon cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.functions import geo
from reachlake.operators.skew import OrderedScan


def edge_tiles(edges: DataFrame, first_zoom: int, last_zoom: int) -> DataFrame:
    """Tiles touched by the box of each edge ``(edge_id, lat1, lon1, lat2, lon2)`` at every zoom."""
    z = F.explode(F.sequence(F.lit(first_zoom), F.lit(last_zoom))).alias("zoom")
    e = edges.select("edge_id", "lat1", "lon1", "lat2", "lon2", z)
    x1, y1 = geo.tile_of(F.col("lat1"), F.col("lon1"), F.col("zoom"))
    x2, y2 = geo.tile_of(F.col("lat2"), F.col("lon2"), F.col("zoom"))
    return (
        e.select("edge_id", "zoom", x1.alias("a"), x2.alias("b"), y1.alias("c"), y2.alias("d"))
        .withColumn("x", F.explode(F.sequence(F.least("a", "b"), F.greatest("a", "b"))))
        .withColumn("y", F.explode(F.sequence(F.least("c", "d"), F.greatest("c", "d"))))
        .select("edge_id", "zoom", "x", "y")
    )


def pyramid(seeds: DataFrame, last_zoom: int) -> DataFrame:
    """Seed tiles and all their descendants down to ``last_zoom``, each once."""
    by_zoom = seeds.distinct().withColumn("to", F.explode(F.sequence(F.col("zoom"), F.lit(last_zoom))))
    m = F.pow(F.lit(2.0), F.col("to") - F.col("zoom")).cast("long")
    return (
        by_zoom.withColumn("m", m)
        .withColumn("nx", F.explode(F.sequence(F.col("x") * F.col("m"), F.col("x") * F.col("m") + F.col("m") - 1)))
        .withColumn("ny", F.explode(F.sequence(F.col("y") * F.col("m"), F.col("y") * F.col("m") + F.col("m") - 1)))
        .select(F.col("to").alias("zoom"), F.col("nx").alias("x"), F.col("ny").alias("y"))
        .distinct()
    )


def missing_tiles(needed: DataFrame, cached: DataFrame) -> DataFrame:
    return needed.join(cached, ["zoom", "x", "y"], "left_anti")


def polygon_segments(points: DataFrame) -> DataFrame:
    """Closed rings ``(polygon_id, seq, lat, lon)`` to segments; the last point joins the first."""
    first = points.groupBy("polygon_id").agg(
        F.min_by(F.struct("lat", "lon"), F.col("seq")).alias("first"))
    scan = OrderedScan(points, ["polygon_id"], ["seq"])
    scan.lead("lat2", F.col("lat")).lead("lon2", F.col("lon"))
    return scan.frame().join(first, "polygon_id").select(
        "polygon_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"),
        F.coalesce("lat2", "first.lat").alias("lat2"), F.coalesce("lon2", "first.lon").alias("lon2"))


def polygon_cover(points: DataFrame, zooms: list[int]) -> DataFrame:
    """Tiles ``polygon_id, zoom, x, y`` that share a point with a polygon.

    Each outline segment is cut at the tile rows it passes and gives the tiles of every piece; the
    centre line of a row is inside between its odd and even outline crossings.
    """
    n = F.pow(F.lit(2.0), F.col("zoom"))
    segs = polygon_segments(points).withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    _, ya = geo.tile_of(F.col("lat1"), F.col("lon1"), F.col("zoom"))
    _, yb = geo.tile_of(F.col("lat2"), F.col("lon2"), F.col("zoom"))
    rows = segs.withColumns({"_a": ya, "_b": yb}).withColumn(
        "y", F.explode(F.sequence(F.least("_a", "_b"), F.greatest("_a", "_b"))))
    north, south = geo.tile_edge_lat(F.col("y"), F.col("zoom")), geo.tile_edge_lat(F.col("y") + 1, F.col("zoom"))
    dx, dy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")

    def lon_at(lat):
        u = F.when(dy != 0, (lat - F.col("lat1")) / dy)
        return F.col("lon1") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)) * dx

    west = F.when(dy == 0, F.least("lon1", "lon2")).otherwise(F.least(lon_at(north), lon_at(south)))
    east = F.when(dy == 0, F.greatest("lon1", "lon2")).otherwise(F.greatest(lon_at(north), lon_at(south)))
    column = lambda lon: F.floor((lon + 180) / 360 * n)
    keys = ["polygon_id", "zoom", "x", "y"]
    outline = rows.withColumn("x", F.explode(F.sequence(column(west), column(east)))).select(*keys)
    mid = (north + south) / 2
    crossing = rows.where((F.col("lat1") > mid) != (F.col("lat2") > mid)).select(
        "polygon_id", "zoom", "y", (F.col("lon1") + dx * (mid - F.col("lat1")) / dy).alias("at"), "lat1", "lon1")
    scan = OrderedScan(crossing, ["polygon_id", "zoom", "y"], ["at", "lat1", "lon1"]).index("i").lead("to", F.col("at"))
    first = F.ceil((F.col("at") + 180) / 360 * n - 0.5)
    last = F.ceil((F.col("to") + 180) / 360 * n - 0.5) - 1
    inside = scan.frame().where("i % 2 = 0").withColumns({"_f": first, "_l": last}).where("_f <= _l")
    inside = inside.withColumn("x", F.explode(F.sequence("_f", "_l"))).select(*keys)
    return outline.unionByName(inside).distinct()


def tiles_in_polygons(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs ``polygon_id, zoom, x, y`` of the given tiles and the polygons they share a point with."""
    zooms = [r[0] for r in tiles.select("zoom").distinct().collect()]  # a map has a few dozen levels
    zooms = zooms or [0]
    return polygon_cover(points, zooms).join(tiles.select("zoom", "x", "y").distinct(), ["zoom", "x", "y"]).select(
        "polygon_id", "zoom", "x", "y")
