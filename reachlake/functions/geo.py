"""Distances, projections and map tiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_M = 6371000.0
MERCATOR_M = 6378137.0
RASTER_PIXELS = 2048
PIXEL_M = 10
RASTER_M = RASTER_PIXELS * PIXEL_M
MILES_PER_DEGREE = 69.0
CITY_MILES = 75.0
# Centres (latitude, longitude) of the transit cities and of the places with elevation data.
CITY_CENTERS = {
    "NewYorkCity": (40.7128, -74.0060), "Vancouver": (49.2827, -123.1207), "Toronto": (43.6532, -79.3832),
    "Montreal": (45.5017, -73.5673), "Paris": (48.8566, 2.3522), "SanFrancisco": (37.7749, -122.4194),
    "Chicago": (41.8781, -87.6298),
}
ELEVATION_CITIES = [
    (34.0522, -118.2437), (32.7157, -117.1611), (37.3382, -121.8863), (37.7749, -122.4194), (36.7378, -119.7871),
    (38.5816, -121.4944), (33.7701, -118.1937), (37.8044, -122.2712), (35.3733, -119.0187), (33.8366, -117.9143),
]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def haversine_with_climb(lat1, lon1, ele1, lat2, lon2, ele2) -> Column:
    """Great-circle metres plus the difference in elevation."""
    return haversine(lat1, lon1, lat2, lon2) + F.abs(ele2 - ele1)


def project(lat: Column, lon: Column, lat0: float | Column, lon0: float | Column) -> tuple[Column, Column]:
    """Azimuthal equidistant metres around a centre, on the sphere."""
    lat0 = F.lit(lat0) if not isinstance(lat0, Column) else lat0
    lon0 = F.lit(lon0) if not isinstance(lon0, Column) else lon0
    c = haversine(lat0, lon0, lat, lon) / EARTH_M
    k = F.when(c == 0, F.lit(1.0)).otherwise(c / F.sin(c)) * EARTH_M
    p, p0, dl = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    return k * F.cos(p) * F.sin(dl), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    y = F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERCATOR_M
    return F.radians(lon) * MERCATOR_M, y


def tile_of(lat: Column, lon: Column, zoom: Column | int) -> tuple[Column, Column]:
    """Slippy map tile of a point."""
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    r = F.radians(lat)
    y = (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n
    return ((lon + 180) / 360 * n).cast("long"), y.cast("long")


def tile_edge_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_edge_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


def tile_bounds(x: Column, y: Column, zoom: Column) -> dict[str, Column]:
    return {
        "west": tile_edge_lon(x, zoom), "east": tile_edge_lon(x + 1, zoom),
        "north": tile_edge_lat(y, zoom), "south": tile_edge_lat(y + 1, zoom),
    }


def raster_tile(c: Column) -> Column:
    """Lower edge of the elevation tile a projected coordinate falls in."""
    return F.floor(c / RASTER_M) * RASTER_M


def raster_cell(x: Column, y: Column) -> dict[str, Column]:
    """Tile and pixel of a projected point; rows count from the top of the tile."""
    tx, ty = raster_tile(x), raster_tile(y)
    return {
        "tile_x": tx, "tile_y": ty,
        "col": F.floor((x - tx) / PIXEL_M), "row": F.lit(RASTER_PIXELS - 1) - F.floor((y - ty) / PIXEL_M),
    }


def near_any_city(lat: Column, lon: Column, cities=ELEVATION_CITIES, miles: float = CITY_MILES) -> Column:
    """Within the box-degree radius of one of a fixed list of cities."""
    out = F.lit(False)
    for la, lo in cities:
        out = out | (F.sqrt(F.pow(lat - la, 2) + F.pow(lon - lo, 2)) * MILES_PER_DEGREE <= miles)
    return out


def is_sample_missing(ele: Column) -> Column:
    return ele.isNull() | (ele <= 0.25)


def sampled_elevation(ele: Column, default: Column) -> Column:
    """Raster value, or the default (else 0) where the raster holds no ground."""
    return F.when(is_sample_missing(ele), F.coalesce(default, F.lit(0.0))).otherwise(ele)


def sampled_elevation_max(ele: Column, default: Column) -> Column:
    """Variant that keeps the larger of both where the raster value is below 0.1."""
    raw = F.coalesce(ele, F.lit(0.0))
    return F.when(raw < 0.1, F.greatest(F.coalesce(default, F.lit(0.0)), raw)).otherwise(raw)
