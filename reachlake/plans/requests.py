"""Checks on request rows before a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.operators.grid import any_within

# Metres to the nearest stop that count as covered, longest window in seconds.
COVERAGE_RADIUS = 1000.0
MAX_WINDOW = int(3.5 * 3600)


def validate(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """Requests with ``dist`` to the nearest stop, ``accepted`` and the ``reason`` if not."""
    near = any_within(requests.select("request_id", "x", "y"), stops, COVERAGE_RADIUS).select("request_id", "dist")
    covered = F.col("dist").isNotNull()
    short = F.col("duration") < MAX_WINDOW
    reason = F.when(~covered, "no stop within reach").when(~short, "window too long")
    return requests.join(near, "request_id", "left").withColumns({"accepted": covered & short, "reason": reason})
