"""Distance and nearest-item joins through grid cells.

Points that share coordinates are joined once and expanded afterwards, so a pile of copies at one
place costs one point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reachlake.operators.fixpoint import union_all
from reachlake.operators.skew import hot_row_limit, salted_join
from reachlake.session import written, written_with_count


def cell(c: str | Column, size: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(size))).cast("long")


def _around(df: DataFrame) -> DataFrame:
    """Repeat each row for its cell and the eight around it."""
    near = F.sequence(F.lit(-1), F.lit(1))
    return (
        df.withColumn("_dx", F.explode(near))
        .withColumn("_dy", F.explode(near))
        .withColumn("_cx", F.col("_cx") + F.col("_dx"))
        .withColumn("_cy", F.col("_cy") + F.col("_dy"))
        .drop("_dx", "_dy")
    )


def places_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of distinct coordinates ``(x, y) -> (x2, y2)`` at most ``radius`` apart, with ``dist``."""
    a = left.select("x", "y").distinct()
    b = right.select(F.col("x").alias("x2"), F.col("y").alias("y2")).distinct()
    a = a.withColumns({"_cx": cell("x", radius), "_cy": cell("y", radius)})
    b = b.withColumns({"_cx": cell("x2", radius), "_cy": cell("y2", radius)})
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (
        F.col("y") - F.col("y2")
    )
    pairs = salted_join(a, _around(b), ["_cx", "_cy"], ["x", "y"])
    return pairs.where(d2 <= radius * radius).select(
        "x", "y", "x2", "y2", F.sqrt(d2.cast("double")).alias("dist")
    )


# Rows that a task expands from pairs of places, and rows of one place that are handed on as one list.
ROWS_PER_TASK = 1_000_000
LIST_ROWS = 1000


def _lists(df: DataFrame, place: Sequence[str], name: str) -> DataFrame:
    """Rows of each place in lists of about ``LIST_ROWS``: ``place..., name``."""
    rest = [c for c in df.columns if c not in place]
    lists = df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("_n"))
    dealt = df.join(lists, list(place)).withColumn("_list", F.pmod(F.xxhash64(*rest), F.col("_n")))
    return dealt.groupBy(*place, "_list").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_list")


def within_distance(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All pairs of rows at most ``radius`` apart. Columns of both sides besides ``x, y`` must differ.

    Places with many rows give far more pairs of rows than of places, so where a task would expand too many,
    pairs of places are dealt anew, with the rows of both in lists.
    """
    near = places_within(left, right, radius)
    other = right.withColumnRenamed("x", "x2").withColumnRenamed("y", "y2")
    of_left = left.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("_a"))
    of_other = other.groupBy("x2", "y2").agg(F.count(F.lit(1)).cast("double").alias("_b"))
    rows = near.join(of_left, ["x", "y"]).join(of_other, ["x2", "y2"]).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    tasks = int(rows // ROWS_PER_TASK) + 1
    rest = [[c for c in df.columns if c not in place] for df, place in ((left, ["x", "y"]), (other, ["x2", "y2"]))]
    if tasks == 1 or not all(rest):
        return left.join(near, ["x", "y"]).join(other, ["x2", "y2"]).drop("x2", "y2")
    met = near.join(_lists(left, ["x", "y"], "_a"), ["x", "y"]).join(_lists(other, ["x2", "y2"], "_b"), ["x2", "y2"])
    tasks = max(tasks, left.sparkSession.sparkContext.defaultParallelism)
    met = met.repartition(tasks).select("x", "y", "dist", F.explode("_a").alias("_a"), "_b")
    met = met.select("x", "y", "dist", "_a", F.explode("_b").alias("_b"))
    return met.select("x", "y", *[F.col("_a")[c].alias(c) for c in rest[0]], "dist", *[F.col("_b")[c].alias(c) for c in rest[1]])


def any_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Rows of ``left`` with some row of ``right`` within ``radius``, with the least distance."""
    near = places_within(left, right, radius).groupBy("x", "y").agg(F.min("dist").alias("dist"))
    return left.join(near, ["x", "y"])


def segment_distance2(px, py, x1, y1, x2, y2) -> tuple[Column, Column]:
    """Squared distance from a point to a segment, and the position 0..1 of the nearest point."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    raw = ((px - x1) * dx + (py - y1) * dy) / F.when(len2 == 0, F.lit(1.0)).otherwise(len2)
    pos = F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    nx, ny = x1 + pos * dx, y1 + pos * dy
    return (px - nx) * (px - nx) + (py - ny) * (py - ny), pos


def _start_cell(items: DataFrame, by: Sequence[str], k: int) -> float:
    """A cell size for which no cell holds many pieces, from the extent and the number of items."""
    box = items.agg(
        F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"),
        F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y9"),
        F.count("*").alias("n"),
        F.avg(F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))).alias("len"),
        F.approx_count_distinct(F.struct(*by) if by else F.lit(0)).alias("groups"),
    ).first()
    if not box["n"]:
        return 1.0
    extent = max(box["x9"] - box["x0"], box["y9"] - box["y0"], 1e-9)
    per_group = max(1.0, box["n"] / max(1, box["groups"]))
    size = max(extent * (k / per_group) ** 0.5, box["len"], extent * 1e-12)
    limit = max(1000, hot_row_limit(items.sparkSession) // 100)
    # A far outlier stretches the extent, so cells may have to get very small beside it.
    while size > extent * 1e-12:
        dense = items.groupBy(*by, cell("x1", size), cell("y1", size)).count().agg(F.max("count")).first()[0]
        if dense <= limit:
            break
        size /= 16.0
    return float(size)


# A group of so few items is kept as one list, which costs a query less than nine cells of a grid.
FEW_ITEMS = 32


def lists_of_few(items: DataFrame, item_id: Sequence[str], by: Sequence[str]) -> DataFrame | None:
    """Items ``by..., _items`` of each group as one list, or None where a group has more than ``FEW_ITEMS``."""
    largest = items.groupBy(*by).count().agg(F.max("count")).first()[0]
    if largest is None or largest > FEW_ITEMS:
        return None
    ends = ["x1", "y1", "x2", "y2"]
    return items.where(" and ".join(f"{c} is not null" for c in ends)).groupBy(*by).agg(
        F.collect_list(F.struct(*item_id, *[F.col(c).cast("double").alias(c) for c in ends])).alias("_items"))


def best_of_few(item_id: Sequence[str], k: int) -> Column:
    """The ``k`` of ``_items`` nearest to ``x, y`` as ``dist2, item_id..., pos, x1, y1, x2, y2``, nearest first."""
    def measured(i):
        d2, pos = segment_distance2(F.col("x").cast("double"), F.col("y").cast("double"), *[i[c] for c in ("x1", "y1", "x2", "y2")])
        return F.struct(d2.alias("dist2"), *[i[c].alias(c) for c in item_id], pos.alias("pos"), *[i[c].alias(c) for c in ("x1", "y1", "x2", "y2")])

    return F.slice(F.sort_array(F.array_distinct(F.transform("_items", measured))), 1, k)


def _nearest_of_few(q: DataFrame, lists: DataFrame, by, item_id, k: int) -> DataFrame:
    met = q.where("x is not null and y is not null").join(lists, by)
    rows = met.select(*by, "x", "y", F.posexplode(best_of_few(item_id, k)).alias("_at", "_i"))
    return rows.select(*by, "x", "y", *[F.col("_i")[c].alias(c) for c in [*item_id, "dist2", "pos"]], (F.col("_at") + 1).alias("rank"))


def nearest(
    queries: DataFrame,
    items: DataFrame,
    item_id: Sequence[str],
    k: int = 1,
    by: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` items nearest to each distinct ``(by..., x, y)`` of ``queries``, exact, any density.

    ``items`` has ``by..., item_id..., x1, y1, x2, y2``: a point when both ends agree, else a
    segment. Ties go to the lowest ``item_id``. Cells start small and double each round; a query is
    done once its k-th distance fits inside one cell, so dense places finish in small cells and
    only the rest goes on. Where no group has more than ``FEW_ITEMS`` items, a query looks at all of its
    group. Result: ``by..., x, y, item_id..., dist2, pos, rank``.
    """
    by, item_id = list(by), list(item_id)
    q = written(queries.select(*by, "x", "y").distinct(), "queries")
    ends = ["x1", "y1", "x2", "y2"]
    # Items with equal geometry: only the k lowest ids can be among the answers.
    same = W.partitionBy(*by, *ends).orderBy(*item_id)
    items = items.select(*by, *item_id, *[F.col(c).cast("double") for c in ends])
    items = items.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    items = written(items, "items")
    if by and (lists := lists_of_few(items, item_id, by)) is not None:
        return _nearest_of_few(q, lists, by, item_id, k)
    size = _start_cell(items, by, k)
    box = items.agg(
        F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")),
        F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2")),
    ).first()
    qbox = q.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    answers = []
    if box[0] is None or qbox[0] is None:
        return items.limit(0).select(
            *by, F.col("x1").alias("x"), F.col("y1").alias("y"), *item_id,
            F.col("x1").alias("dist2"), F.col("x1").alias("pos"), F.lit(1).alias("rank"),
        )
    span = max(max(box[1], qbox[1]) - min(box[0], qbox[0]), max(box[3], qbox[3]) - min(box[2], qbox[2]))
    rank = W.partitionBy(*by, "x", "y").orderBy("dist2", *item_id)
    todo = q
    while True:
        last = size >= span
        found = _candidates(todo, items, by, item_id, size)
        ranked = written(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "near")
        state = ranked.groupBy(*by, "x", "y").agg(F.count("*").alias("n"), F.max("dist2").alias("far"))
        done = state if last else state.where((F.col("n") == k) & (F.col("far") <= size * size))
        answers.append(ranked.join(done.select(*by, "x", "y"), [*by, "x", "y"], "left_semi"))
        if last:
            break
        todo, left = written_with_count(todo.join(done, [*by, "x", "y"], "left_anti"), "open")
        if not left:
            break
        size *= 2.0
    return union_all(answers)


def _candidates(q: DataFrame, items: DataFrame, by, item_id, size: float) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # A long segment is registered piece by piece, each no longer than a cell.
    pieces = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / size).cast("int"))
    cut = items.withColumn("_p", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    a, b = F.col("_i") / F.col("_p"), (F.col("_i") + 1) / F.col("_p")
    ax, bx, ay, by_ = F.col("x1") + a * dx, F.col("x1") + b * dx, F.col("y1") + a * dy, F.col("y1") + b * dy
    cells = (
        cut.withColumn("_cx", F.explode(F.sequence(cell(F.least(ax, bx), size), cell(F.greatest(ax, bx), size))))
        .withColumn("_cy", F.explode(F.sequence(cell(F.least(ay, by_), size), cell(F.greatest(ay, by_), size))))
        .drop("_p", "_i")
        .distinct()
    )
    near = _around(q.withColumns({"_cx": cell("x", size), "_cy": cell("y", size)}))
    pairs = near.join(cells, [*by, "_cx", "_cy"])
    d2, pos = segment_distance2(*[F.col(c).cast("double") for c in ("x", "y", "x1", "y1", "x2", "y2")])
    keys = [*by, "x", "y", *item_id]
    return pairs.select(*keys, d2.alias("dist2"), pos.alias("pos")).distinct()


def nearest_points(queries: DataFrame, points: DataFrame, point_id: str, k: int = 1) -> DataFrame:
    """``k`` nearest points per query location: ``x, y, point_id, dist, rank``."""
    items = points.select(
        point_id, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    out = nearest(queries, items, [point_id], k)
    return out.select("x", "y", point_id, F.sqrt("dist2").alias("dist"), "rank")
