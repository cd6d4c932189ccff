"""Shortest paths, walks, closures and pattern search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reachlake.operators.fixpoint import Adjacency, Deltas, relax, union_all
from reachlake.operators.graph.basic import reverse
from reachlake.operators.skew import OrderedScan
from reachlake.session import written, written_with_count


def hop_levels(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first levels ``source, id, level`` from each ``sources(source, id)``."""
    seeds = sources.select("source", "id", F.lit(0).alias("cost"))
    labels, _ = relax(seeds, edges, ["source"], step=F.col("cost") + 1)
    return labels.select("source", "id", F.col("cost").alias("level"))


def has_path(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b, connected`` for each asked pair. The search from a vertex ends once all vertices asked for are found."""
    starts = pairs.select(F.col("a").alias("source"), F.col("a").alias("id")).distinct().withColumn("cost", F.lit(0))
    goals = pairs.select(F.col("a").alias("source"), F.col("b").alias("id")).distinct()
    labels, _ = relax(starts, edges, ["source"], step=F.col("cost") + 1, goals=goals, every_goal=True)
    reached = labels.select(F.col("source").alias("a"), F.col("id").alias("b"), F.lit(True).alias("r"))
    return pairs.join(reached, ["a", "b"], "left").select("a", "b", F.coalesce("r", F.lit(False)).alias("connected"))


def shortest_paths(sources: DataFrame, edges: DataFrame, weight: Column | None = None,
                   goals: DataFrame | None = None, max_cost: float | None = None) -> DataFrame:
    """Least cost ``source, id, cost, pred`` for non-negative weights.

    ``weight`` is any expression over the edge columns. With ``goals(source, id)`` only goal rows
    are returned, and a source's search drops labels dearer than its goals once all are found.
    """
    step = F.col("cost") + (F.col("weight") if weight is None else weight)
    keep = None if max_cost is None else F.col("cost") <= max_cost
    seeds = sources.select("source", "id", F.lit(0.0).alias("cost"))
    labels, _ = relax(seeds, edges, ["source"], step=step, keep=keep, goals=goals, every_goal=True)
    out = labels.select("source", "id", "cost", "pred")
    return out if goals is None else out.join(goals, ["source", "id"], "left_semi")


STEPS_PER_JOB = 6


def trace_back(labels: DataFrame, goals: DataFrame) -> DataFrame:
    """Vertices of the path to each goal ``(source, id)``: ``source, goal, back, id``.

    ``back`` counts from the goal. All paths move several steps per round, so the number of rounds
    follows the longest path.
    """
    links = written(labels.select("source", "id", "pred").where("pred is not null"), "links")
    ends = goals.select("source", "id").distinct().join(labels.select("source", "id"), ["source", "id"], "left_semi")
    at, n = written_with_count(ends.select("source", F.col("id").alias("goal"), F.lit(0).alias("back"), "id"), "trace")
    steps = [at]
    while n:
        cur = at.withColumn("p0", F.col("id"))
        for i in range(STEPS_PER_JOB):
            cur = cur.join(links.select("source", F.col("id").alias(f"p{i}"), F.col("pred").alias(f"p{i + 1}")), ["source", f"p{i}"], "left")
        walked = F.array_compact(F.array(*[F.col(f"p{i + 1}") for i in range(STEPS_PER_JOB)]))
        found, _ = written_with_count(
            cur.select("source", "goal", "back", F.posexplode(walked).alias("pos", "id"))
            .select("source", "goal", (F.col("back") + F.col("pos") + 1).alias("back"), "id"), "trace")
        steps.append(found)
        at, n = written_with_count(found.where((F.col("back") % STEPS_PER_JOB == 0)), "trace")
    return union_all(steps)


def bellman_ford(sources: DataFrame, edges: DataFrame, vertex_count: int) -> tuple[DataFrame, bool]:
    """Least costs with negative weights allowed, and whether a negative cycle was met."""
    seeds = sources.select("source", "id", F.lit(0.0).alias("cost"))
    # Labels that still improve after V steps are on or behind such a cycle.
    labels, rounds = relax(seeds, edges, ["source"], max_rounds=vertex_count)
    return labels.select("source", "id", "cost", "pred"), rounds > vertex_count


class NegativeCycle(ValueError):
    pass


def bellman_ford_or_raise(sources: DataFrame, edges: DataFrame, vertex_count: int) -> DataFrame:
    labels, negative = bellman_ford(sources, edges, vertex_count)
    if negative:
        raise NegativeCycle("the graph has a cycle of negative weight")
    return labels


def negative_cycle(source: DataFrame, edges: DataFrame, vertex_count: int) -> DataFrame:
    """Vertices ``position, id`` of one negative cycle in edge order; empty when there is none.

    Predecessor links form a cycle only where there is a negative one, mostly long before all rounds
    are done. So they are looked at after 8 rounds and each time their number has doubled.
    """
    most = min(8, vertex_count)
    while True:
        labels, negative = bellman_ford(source, edges, most)
        to = written(labels.where("pred is not null").select("id", F.col("pred").alias("p")), "preds")
        if not negative:
            return to.select(F.lit(0).alias("position"), "id").limit(0)
        jump, steps, n = to, 1, 1
        while steps < vertex_count and n:
            # Twice as many steps back each time; who is still reached after V steps lies on a cycle.
            back = jump.select(F.col("id").alias("p"), F.col("p").alias("q"))
            jump, n = written_with_count(jump.join(back, "p").select("id", F.col("q").alias("p")), "jump")
            steps *= 2
        if n:
            break
        most = min(2 * most, vertex_count)
    start = jump.agg(F.min("p").alias("id"))
    around = to.select(F.col("id").alias("src"), F.col("p").alias("dst"))
    labels, _ = relax(start.select("id", F.lit(0).alias("cost")), around, step=F.col("cost") + 1)
    length = labels.agg(F.max("cost")).first()[0]
    return labels.select(F.when(F.col("cost") == 0, 0).otherwise(F.lit(length + 1) - F.col("cost")).alias("position"), "id")


def k_shortest_walks(sources: DataFrame, edges: DataFrame, k: int, weight: Column | None = None) -> DataFrame:
    """Cost of the k-th shortest walk ``source, id, cost``; vertices with fewer walks are absent."""
    step = F.col("cost") + (F.col("weight") if weight is None else weight)
    adjacency = Adjacency(edges)
    by = W.partitionBy("source", "id").orderBy("cost", "hop")
    front, n = written_with_count(sources.select("source", "id", F.lit(0.0).alias("cost"), F.lit(0).alias("hop")), "walks")
    kept = Deltas()
    kept.add(front, n)
    hop = 0
    while n:
        hop += 1
        grown = adjacency.join(front.withColumnRenamed("id", "src")).select(
            "source", F.col("dst").alias("id"), step.alias("cost"), (F.col("hop") + 1).alias("hop"))
        # Only the k best of a vertex matter; ranks are cut before and after the shuffle.
        ranked = kept.union().unionByName(grown).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        front, n = written_with_count(ranked.where(F.col("hop") == hop).drop("rank"), "walks")
        if n:
            kept.add(front, n)
    adjacency.release()
    best = kept.union().withColumn("rank", F.row_number().over(by))
    return best.where(F.col("rank") == k).select("source", "id", "cost")


def all_pairs(vertices: DataFrame, edges: DataFrame, vertex_count: int | None = None) -> DataFrame:
    """Least cost ``source, id, cost`` between all connected pairs, 0 on the diagonal.

    Of parallel edges the least counts. A negative cycle is an error.
    """
    n = vertices.count() if vertex_count is None else vertex_count
    starts = vertices.select(F.col("id").alias("source"), "id")
    return bellman_ford_or_raise(starts, edges, n).select("source", "id", "cost")


def simple_paths(pairs: DataFrame, edges: DataFrame, max_between: int, min_between: int = 0) -> DataFrame:
    """All paths without repeated vertices for each ``pairs(a, b)``, with the given number of
    vertices in between; parallel edges give separate paths. ``a, b, path``."""
    adjacency = Adjacency(edges.select("src", "dst"))
    at = pairs.select("a", "b", F.array("a").alias("path"), F.col("a").alias("src"))
    found = []
    for between in range(max_between + 1):
        nxt = adjacency.join(at).where(~F.array_contains("path", F.col("dst")))
        nxt = written(nxt.select("a", "b", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("src")), "paths")
        if between >= min_between:
            found.append(nxt.where("src = b").select("a", "b", "path"))
        at = nxt.where("src <> b")
    adjacency.release()
    return union_all(found)


WORD = 64


def _source_words(edges: DataFrame) -> tuple[DataFrame, DataFrame, Adjacency]:
    """Who reaches whom by at least one edge, 64 sources in one number.

    Returns ``(id, word, bits)``, in which a set bit is a source of the word that reaches ``id``, the
    sources ``(src, word, bit)``, and the edges the search used. A round sends one number per vertex,
    word and edge for all the sources that came new to the vertex, not one row per source.
    """
    sources = written(
        OrderedScan(edges.select("src").distinct(), [], ["src"]).index("n").frame()
        .select("src", F.expr(f"n div {WORD}").alias("word"), (F.col("n") % WORD).cast("int").alias("bit")), "sources")
    adjacency = Adjacency(edges.select("src", "dst"))
    own = sources.select(F.col("src").alias("_s"), "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    start = edges.join(own, F.col("src").eqNullSafe(F.col("_s"))).groupBy(F.col("dst").alias("id"), "word")
    front, n = written_with_count(start.agg(F.bit_or("bits").alias("bits")), "words")

    def together(df):
        return df.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))

    known = Deltas(together)
    known.add(front, n)
    none = F.lit(0).cast("long")
    while n:
        grown = together(_sent_on(adjacency, front)).select("id", "word", "bits", none.alias("old"))
        old = known.union().select("id", "word", none.alias("bits"), F.col("bits").alias("old"))
        both = old.unionByName(grown).groupBy("id", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not("old"))
        front, n = written_with_count(both.select("id", "word", fresh.alias("bits")).where("bits <> 0"), "words")
        if n:
            known.add(front, n)
    return together(known.union()), sources, adjacency


def _sent_on(adjacency: Adjacency, words: DataFrame) -> DataFrame:
    return adjacency.join(words.withColumnRenamed("id", "src")).select(F.col("dst").alias("id"), "word", "bits")


def closure(edges: DataFrame) -> DataFrame:
    """All pairs ``src, dst`` joined by a path of at least one edge."""
    words, sources, adjacency = _source_words(written(edges.select("src", "dst").distinct(), "edges"))
    adjacency.release()
    members = sources.groupBy("word").agg(F.collect_list(F.struct("bit", "src")).alias("members"))
    held = F.expr("filter(members, m -> bits & shiftleft(1L, m.bit) <> 0)")
    pairs = words.join(members, "word").select("id", F.explode(held).alias("m"))
    return pairs.select("m.src", F.col("id").alias("dst"))


def reduction(edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Edges of an acyclic graph that no longer path replaces."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    if closed is None:
        # One edge more behind every path: the sources that reach a vertex by two edges or more.
        words, sources, adjacency = _source_words(e)
        longer = written(_sent_on(adjacency, words).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")), "longer")
        adjacency.release()
        at = e.join(sources, "src").join(longer.withColumnRenamed("id", "dst"), ["dst", "word"])
        replaced = at.where(F.expr("bits & shiftleft(1L, bit)") != 0).select("src", "dst")
        return e.join(replaced, ["src", "dst"], "left_anti")
    # Pairs of edges of one source, kept where the first leads on to the end of the second.
    pairs = e.withColumnRenamed("dst", "mid").join(e, "src").where("mid <> dst")
    longer = pairs.join(closed.withColumnRenamed("src", "mid"), ["mid", "dst"], "left_semi").select("src", "dst")
    return e.join(longer, ["src", "dst"], "left_anti")


def find_pattern(
    vertices: DataFrame,
    edges: DataFrame,
    pattern: Sequence[tuple[int, int]],
    node_match: Callable[[int], Column] | None = None,
    edge_match: Callable[[int, int], Column] | None = None,
    induced: bool = True,
) -> DataFrame:
    """Places where a small connected directed pattern occurs: columns ``n0, n1, ...``.

    ``pattern`` lists edges between node numbers. The match callbacks give conditions over the
    columns of ``vertices`` and ``edges``. Induced means no further edges among the matched nodes.
    """
    size = 1 + max(max(p) for p in pattern)
    plain = edges.select("src", "dst").distinct()

    def node_ids(i):
        return None if node_match is None else vertices.where(node_match(i)).select(F.col("id").alias(f"n{i}"))

    def edge_table(i, j):
        e = edges if edge_match is None else edges.where(edge_match(i, j))
        return e.select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{j}")).distinct()

    out, bound, todo = None, set(), list(pattern)
    while todo:
        pick = next((p for p in todo if out is None or bound & set(p)), None)
        if pick is None:
            raise ValueError("the pattern must be connected")
        todo.remove(pick)
        i, j = pick
        new = {i, j} - bound
        e = edge_table(i, j)
        for v in new:
            ids = node_ids(v)
            if ids is not None:
                e = e.join(ids, f"n{v}", "left_semi")
        if out is None:
            out = e.where(F.col(f"n{i}") != F.col(f"n{j}")) if i != j else e
        else:
            on = [f"n{v}" for v in dict.fromkeys((i, j)) if v in bound]
            out = out.join(e, on, "left_semi" if not new else "inner")
            for v in new:
                for w in bound:
                    out = out.where(F.col(f"n{v}") != F.col(f"n{w}"))
        bound |= {i, j}
    if induced:
        have = set(pattern)
        for i in range(size):
            for j in range(size):
                if (i, j) not in have:
                    ban = plain if i != j else plain.where("src = dst")
                    on = {"src": f"n{i}", "dst": f"n{j}"} if i != j else {"src": f"n{i}"}
                    ban = ban.select(*[F.col(c).alias(a) for c, a in on.items()])
                    out = out.join(ban, list(on.values()), "left_anti")
    return out.select(*[f"n{i}" for i in range(size)])
