"""Elevation sampling from rasters held as pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.functions import geo
from reachlake.operators.skew import salted_join

PIXEL = ["tile_x", "tile_y", "row", "col"]


def sample(points: DataFrame, pixels: DataFrame, key: str, default: Column | None = None,
           rule=geo.sampled_elevation) -> DataFrame:
    """Projected ``points(key, px, py, ...)`` with ``ele`` from ``pixels(tile_x, tile_y, row, col, ele)``."""
    at = points.withColumns(geo.raster_cell(F.col("px"), F.col("py")))
    raster = pixels.select(*[F.col(c).cast("long").alias(c) for c in PIXEL], F.col("ele").alias("_ele"))
    fallback = F.lit(None).cast("double") if default is None else default
    joined = salted_join(at, raster, PIXEL, [key], "left")
    return joined.withColumn("ele", rule(F.col("_ele"), fallback)).drop("_ele", *PIXEL)


def tiles_needed(points: DataFrame) -> DataFrame:
    """Distinct raster tiles of projected points."""
    return points.select(
        geo.raster_tile(F.col("px")).alias("tile_x"), geo.raster_tile(F.col("py")).alias("tile_y")).distinct()


def enrich(nodes: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """``nodes(key, lat, lon, ele)`` with sampled elevation near the listed cities; others stay."""
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    near = nodes.where(geo.near_any_city(F.col("lat"), F.col("lon"))).select(key, x.alias("px"), y.alias("py"))
    found = sample(near, pixels, key).select(key, F.col("ele").alias("_new"))
    return nodes.join(found, key, "left").withColumn("ele", F.coalesce("_new", "ele")).drop("_new")
