"""Loops over joins: relaxation of labels along edges until nothing improves.

Each round writes only the labels it improved. The state is the union of those small tables, so a
round reads the state once, shuffles it together with the new candidates in one aggregation, and
never rewrites it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.operators.skew import hot_keys_and_rows, with_all_salts, with_salt
from reachlake.session import written_observed, written_with_count


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


ROWS_PER_PART = 200_000


class Adjacency:
    """Edges partitioned and sorted by source once and kept for all rounds; hub sources are salted."""

    def __init__(self, edges: DataFrame, key: str = "src", spread: Sequence[str] = ("dst",)):
        self.key = key
        self.hot, rows = hot_keys_and_rows(edges, [key])
        if self.hot is None:
            salted = edges.withColumn("_salt", F.lit(0))
        else:
            salted = with_salt(edges, [key], self.hot, spread)
        spark = edges.sparkSession
        n = max(spark.sparkContext.defaultParallelism, rows // ROWS_PER_PART)
        self.edges = salted.repartition(n, key, "_salt").sortWithinPartitions(key).persist()

    def join(self, rows: DataFrame, how: str = "inner", ends: tuple | None = None) -> DataFrame:
        """Rows with a column named like the key, each joined with its edges.

        With ``ends``, the least and largest key among the rows, kept batches of other keys are not read.
        """
        if self.hot is None:
            rows = rows.withColumn("_salt", F.lit(0))
        else:
            rows = with_all_salts(rows, [self.key], self.hot)
        edges = self.edges
        if ends is not None and None not in ends:
            edges = edges.where(F.col(self.key).between(*[F.lit(e) for e in ends]))
        return rows.join(edges, [self.key, "_salt"], how).drop("_salt")

    def release(self) -> None:
        self.edges.unpersist()


class Deltas:
    """Tables added round by round, with few enough of them to keep plans short.

    When there are many, the recent ones are merged into one, together with the oldest only once
    they have grown to half its size, so a row is rewritten a logarithmic number of times.
    """

    def __init__(self, merge: Callable[[DataFrame], DataFrame] = lambda df: df, most: int = 6):
        self.merge = merge
        self.most = most
        self.parts: list[tuple[DataFrame, int]] = []

    def add(self, df: DataFrame, n: int) -> None:
        self.parts.append((df, n))
        if len(self.parts) > self.most:
            first = self.parts[0][1]
            keep = 0 if sum(n for _, n in self.parts[1:]) * 2 >= first else 1
            old = union_all([d for d, _ in self.parts[keep:]])
            self.parts[keep:] = [written_with_count(self.merge(old), "merged")]

    def union(self) -> DataFrame:
        return union_all([d for d, _ in self.parts])


def relax(
    seeds: DataFrame,
    edges: DataFrame,
    group: Sequence[str] = (),
    step: Column | None = None,
    keep: Column | None = None,
    expand: Column | None = None,
    max_rounds: int | None = None,
    via: str | None = None,
    goals: DataFrame | None = None,
    bound: Column | None = None,
    every_goal: bool = False,
) -> tuple[DataFrame, int]:
    """Least cost per ``(group, id)`` from ``seeds(group..., id, cost)`` along ``edges(src, dst, ...)``.

    ``step`` is the new cost in terms of ``cost`` and the edge columns (default ``cost + weight``).
    ``keep`` drops candidate labels, ``expand`` says which labels travel on; both see ``cost``,
    ``id`` and the group columns. ``via`` names an edge column to keep with the label. With
    ``goals(group..., id)`` labels that cannot beat the cost already found at the nearest goal of the group
    are dropped, or, with ``every_goal``, once all its goals are found, those that cannot beat the dearest one;
    ``bound`` is a lower bound of the cost still ahead, in terms of edge and group columns. Returns
    the labels ``(group..., id, cost, hop, pred[, via])`` and the number of rounds; with ``max_rounds`` reached while
    labels still improve, that number is ``max_rounds + 1``.
    """
    group = list(group)
    keys = [*group, "id"]
    step = F.col("cost") + F.col("weight") if step is None else step
    adjacency = Adjacency(edges)

    facts = ["cost", "hop", "pred", *([via] if via else [])]

    def best(cands: DataFrame) -> DataFrame:
        pick = F.min(F.struct(*facts)).alias("b")
        return cands.groupBy(*keys).agg(pick).select(*keys, "b.*")

    id_type = edges.schema["dst"].dataType
    start = best(
        seeds.select(
            *group,
            F.col("id").cast(id_type).alias("id"),
            F.col("cost"),
            F.lit(0).alias("hop"),
            F.lit(None).cast(id_type).alias("pred"),
            *([F.lit(None).cast(edges.schema[via].dataType).alias(via)] if via else []),
        )
    )
    if keep is not None:
        start = start.where(keep)
    seen = {"n": F.count(F.lit(1)), "first": F.min("id"), "last": F.max("id")}
    frontier, at = written_observed(start, "labels", **seen)
    n = int(at["n"])
    deltas = Deltas(best)
    deltas.add(frontier, n)
    rounds = 0
    while n and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        grow = frontier if expand is None else frontier.where(expand)
        if goals is not None:
            at_goal = deltas.union().join(goals.select(*keys), keys, "left_semi")
            if every_goal:
                each = at_goal.groupBy(*keys).agg(F.min("cost").alias("cost"))
                each = each.groupBy(*group).agg(F.max("cost").alias("_found"), F.count(F.lit(1)).alias("_n"))
                asked = goals.select(*keys).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
                found = each.join(asked, [*group, "_n"]).select(*group, "_found")
            else:
                found = at_goal.groupBy(*group).agg(F.min("cost").alias("_found"))
            grow = grow.join(found, group, "left")
        cands = adjacency.join(grow.withColumnRenamed("id", "src").drop(*([via] if via else [])), ends=(at["first"], at["last"]))
        cands = cands.select(
            *group,
            F.col("dst").alias("id"),
            step.alias("cost"),
            (F.col("hop") + 1).alias("hop"),
            F.col("src").alias("pred"),
            *([via] if via else []),
            *([(F.lit(0.0) if bound is None else bound).alias("_ahead"), "_found"] if goals is not None else []),
        )
        if goals is not None:
            open_ = F.col("_found").isNull() | (F.col("cost") + F.col("_ahead") <= F.col("_found"))
            cands = cands.where(open_).drop("_ahead", "_found")
        if keep is not None:
            cands = cands.where(keep)
        cands = cands.select(*keys, F.lit(None).cast(cands.schema["cost"].dataType).alias("old"), F.struct(*facts).alias("new"))
        new_type = cands.schema["new"].dataType
        old = deltas.union().select(*keys, F.col("cost").alias("old"), F.lit(None).cast(new_type).alias("new"))
        tagged = old.unionByName(cands)
        merged = tagged.groupBy(*keys).agg(F.min("old").alias("old"), F.min("new").alias("new"))
        better = F.col("new").isNotNull() & (
            F.col("old").isNull() | (F.col("new.cost") < F.col("old"))
        )
        frontier, at = written_observed(merged.where(better).select(*keys, "new.*"), "labels", **seen)
        n = int(at["n"])
        if n:
            deltas.add(frontier, n)
    adjacency.release()
    if n:
        rounds += 1
    return best(deltas.union()), rounds
