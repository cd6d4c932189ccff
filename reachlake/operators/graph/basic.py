"""Building, viewing, filtering and reshaping graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.operators.skew import OrderedScan, last_per_key
from reachlake.session import written


def vertices_of(edges: DataFrame, dense: bool = False) -> DataFrame:
    """End points of the edges; with ``dense`` every id from 0 to the largest."""
    if dense:
        top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        return edges.sparkSession.range(0, 0 if top is None else top + 1)
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; a loop stays single."""
    return edges.unionByName(reverse(edges.where("src <> dst")))


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected form with ``src <= dst``."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """``id, neighbor`` for the asked vertices; direction out, in or any (undirected)."""
    e = {"out": lambda: edges, "in": lambda: reverse(edges), "any": lambda: both_ways(edges)}[direction]()
    return e.select(F.col("src").alias("id"), F.col("dst").alias("neighbor")).join(ids, "id", "left_semi")


def incident_edges(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """Edges leaving, entering or touching the vertices, as stored."""
    src = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*edges.columns)
    dst = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    if direction == "out":
        return src
    if direction == "in":
        return dst
    not_yet = dst.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns)
    return src.unionByName(not_yet)


def edges_connecting(edges: DataFrame, pairs: DataFrame, directed: bool = True) -> DataFrame:
    """Edges between the asked ``(src, dst)`` pairs."""
    if directed:
        return edges.join(pairs, ["src", "dst"], "left_semi")
    keys = canonical(pairs.select("src", "dst")).distinct().withColumnsRenamed({"src": "_a", "dst": "_b"})
    e = edges.withColumns({"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")})
    return e.join(keys, ["_a", "_b"], "left_semi").drop("_a", "_b")


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.agg(F.count("*").alias("n")).select(F.lit("vertices").alias("what"), "n").unionByName(
        edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree``, zero for isolated vertices."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    none = vertices.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))
    return ends.unionByName(none).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def externals(vertices: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """Vertices without out edges (``out``), without in edges (``in``) or without any (``any``)."""
    out = vertices
    if direction in ("out", "any"):
        out = out.join(edges.select(F.col("src").alias("id")), "id", "left_anti")
    if direction in ("in", "any"):
        out = out.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    return out


def retain_nodes(vertices: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Vertices for which ``keep`` holds, and the edges with both ends among them."""
    kept = vertices.where(keep)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside.select(*edges.columns)


def retain_edges(edges: DataFrame, keep: Column) -> DataFrame:
    return edges.where(keep)


def filter_map(vertices, edges, vertex_keep: Column, vertex_cols: Sequence[Column], edge_keep: Column,
               edge_cols: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Filter and project both tables; edges with a removed end go."""
    kept, inside = retain_nodes(vertices, edges, vertex_keep)
    return kept.select("id", *vertex_cols), inside.where(edge_keep).select("src", "dst", *edge_cols)


def update_edges(edges: DataFrame, order: Sequence[str], directed: bool = True) -> DataFrame:
    """One edge per pair, the last in ``order``."""
    return last_per_key(edges if directed else canonical(edges), ["src", "dst"], order)


def complement(vertices: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    """Edges absent from the graph, without loops. The result itself has about V squared rows.

    Vertices lie in blocks of the root of their number. Each vertex meets each block with the list of
    its own neighbours there, so neither the pairs nor the edges are sent to every task. A repeated vertex
    has its pairs as often as it occurs.
    """
    times = vertices.where("id is not null").groupBy("id").agg(F.count("*").alias("times"))
    placed = OrderedScan(times, [], ["id"]).index("i").frame()
    n = placed.count()
    size = int(n**0.5) + 1
    placed = written(placed.select("id", "times", F.expr(f"i div {size}").alias("block")), "blocks")
    more = F.flatten(F.collect_list(F.array_repeat("id", (F.col("times") - 1).cast("int"))))
    blocks = placed.groupBy("block").agg(F.collect_list("id").alias("ids"), more.alias("more"))
    meet = placed.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0) // size).cast("long"))).alias("block"),
                         F.col("times"))
    ends = edges.select("src", F.col("dst").alias("id")).join(placed.select("id", "block"), "id")
    near = ends.groupBy("src", "block").agg(F.collect_set("id").alias("near")).hint("merge")
    meet = meet.join(near, ["src", "block"], "left").withColumn("near", F.array_append(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), F.col("src")))
    far = F.concat(F.array_except("ids", "near"), F.filter("more", lambda v: ~F.array_contains("near", v)))
    pairs = meet.join(blocks, "block").select("src", "times", F.explode(far).alias("dst"))
    return pairs.select("src", "dst", F.explode(F.array_repeat(F.lit(weight), F.col("times").cast("int"))).alias("weight"))
