"""Street tags to ratings, edge costs and rider energy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that close a street to riders.
CLOSED_KEYS = ["man_made", "railway"]
CLOSED_ACCESS = ["no", "private"]
CLOSED_HIGHWAY = ["elevator", "steps", "platform", "track", "footway", "pedestrian"]
# Score by key prefix and tag value.
SCORES = {
    "cycleway": {5: ["exclusive", "lane", "opposite_lane", "opposite", "track", "opposite_track"],
                 4: ["shared_lane", "share_busway", "opposite_share_busway", "shared"]},
    "highway": {5: ["path", "cycleway"], 3: ["service", "residential", "unclassified"], 2: ["tertiary"],
                1: ["motorway", "trunk", "primary", "secondary"]},
    "bicycle": {5: ["designated"]},
}
WALKWAY = ["footway", "pedestrian"]
BICYCLE_OK = ["yes", "permissive", "use_sidepath"]
# Cost factor by rating, and the cost of streets closed to riders.
PENALTY = {0: 2.0, 1: 1.0, 2: 0.7, 3: 0.65, 4: 0.5, 5: 0.5}
CLOSED_FACTOR = 20.0
HILL_FACTOR = 1500.0
# Rider and energy model.
MASS_KG = 86.0
JOULES_PER_CALORIE = 4186.0
EFFICIENCY = 0.25


def rideable(tags: Column) -> Column:
    """Whether the tags leave a street open to riders."""
    get = lambda k: F.try_element_at(tags, F.lit(k))
    closed = F.coalesce(get("access").isin(CLOSED_ACCESS), F.lit(False)) | F.coalesce(get("area") == "yes", F.lit(False))
    for k in CLOSED_KEYS:
        closed = closed | F.map_contains_key(tags, k)
    return ~(closed | F.coalesce(get("highway").isin(CLOSED_HIGHWAY), F.lit(False)))


def rating(tags: Column) -> Column:
    """Friendliness 0 to 5: best tag score, then the rule for walkways open to bicycles."""

    def score(k: Column, v: Column) -> Column:
        out = F.lit(0)
        for prefix, scores in SCORES.items():
            value = F.lit(0)
            for points, words in scores.items():
                value = F.when(v.isin(words), points).otherwise(value)
            out = F.greatest(out, F.when(k.startswith(prefix), value).otherwise(0))
        return out

    entries = F.map_entries(tags)
    best = F.aggregate(entries, F.lit(0), lambda a, e: F.greatest(a, score(e["key"], e["value"])))
    foot = F.exists(entries, lambda e: e["key"].startswith("highway") & e["value"].isin(WALKWAY))
    bike = F.exists(entries, lambda e: e["key"].startswith("bicycle") & e["value"].isin(BICYCLE_OK))
    return F.when(foot & bike, F.greatest(best, F.lit(5))).when(bike & ~foot, F.greatest(best, F.lit(3))).otherwise(best)


def edge_cost(dist: Column, climb: Column, stars: Column, open_: Column, avoid_hills: Column, prefer_lanes: Column) -> Column:
    """Cost of riding an edge in one direction; ``climb`` is target minus source elevation."""
    factor = F.lit(None).cast("double")
    for k, p in PENALTY.items():
        factor = F.when(stars == k, p).otherwise(factor)
    hills = F.greatest(climb, F.lit(0.0)) * (HILL_FACTOR * F.pow(avoid_hills, F.lit(30.0)))
    lanes = 0.5 * (factor + 0.5) * prefer_lanes * dist
    return dist + hills + lanes + F.when(open_, 0.0).otherwise(CLOSED_FACTOR) * dist


def speed(slope: Column) -> Column:
    """Metres per second by slope; the first matching range counts."""
    return (
        F.when(slope.between(0.02, 0.1), 6.0).when(slope.between(0.1, 0.2), 4.5).when(slope >= 0.2, 3.5)
        .when(slope.between(-0.02, 0.02), 6.26).when(slope.between(-0.1, 0.0), 6.6).when(slope <= -0.1, 7.0).otherwise(6.0))


def watts(v: Column, slope: Column, headwind: float = 0.0, mass: float = MASS_KG, acceleration: float = 0.0) -> Column:
    air = v + headwind
    power = v * (7.0 + 0.3153 * air * air + 10.5 * mass * (slope + 1.01 * acceleration / 9.806))
    return F.greatest(power, F.lit(5.0))


def calories(dist: Column, climb: Column) -> Column:
    slope = climb / dist
    v = speed(slope)
    return watts(v, slope) * (dist / v) / JOULES_PER_CALORIE / EFFICIENCY
