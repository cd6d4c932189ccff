"""Components, order, cycles and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.operators.fixpoint import Adjacency, Deltas, relax, union_all
from reachlake.operators.graph.basic import both_ways, reverse, vertices_of
from reachlake.session import written, written_observed, written_with_count


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` with the least id of the component; edges count both ways.

    Every round links each vertex's larger neighbours to its least one, then its smaller ones, so
    the graph shrinks to stars in a logarithmic number of rounds even on long paths.
    """
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    mark = {"n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("u", "v"))}
    links, seen = written_observed(links.where("u <> v").distinct(), "links", **mark)
    while seen["n"]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
        before = seen
        links, seen = written_observed(nxt, "links", **mark)
        if before == seen:
            break
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_count(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return connected_components(vertices, edges).agg(F.count_distinct("component").alias("components"))


def undirected_cycles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, vertices, edges, cyclic``; loops and parallel edges are cycles."""
    label = connected_components(vertices, edges)
    v = label.groupBy("component").agg(F.count("*").alias("vertices"))
    e = edges.join(label.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count("*").alias("edges"))
    out = v.join(e, "component", "left").select("component", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"))
    return out.withColumn("cyclic", F.col("edges") >= F.col("vertices"))


def topological_levels(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peel vertices whose predecessors are all peeled.

    Returns ``(id, level)`` for the peeled ones, an order of which is ``(level, id)``, and the
    remaining ids, which is not empty exactly when there is a cycle.
    """
    need = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    need = written(vertices.select("id").join(need, "id", "left").select("id", F.coalesce("need", F.lit(0)).alias("need")), "need")
    adjacency = Adjacency(edges.select("src", "dst"))
    ready, n = written_with_count(need.where("need = 0").select("id", F.lit(0).alias("level")), "peel")
    def total(df):
        return df.groupBy("id").agg(F.sum("done").alias("done"))

    peeled, passed, level = Deltas(), Deltas(total), 0
    peeled.add(ready, n)
    while n:
        level += 1
        step = adjacency.join(ready.select(F.col("id").alias("src"))).groupBy(F.col("dst").alias("id")).agg(
            F.count("*").alias("done"))
        step, m = written_with_count(step, "passed")
        passed.add(step, m)
        # Only vertices touched this round can have become ready.
        sums = total(passed.union().join(step.select("id"), "id", "left_semi"))
        ready, n = written_with_count(
            sums.join(need, "id").where("done = need").select("id", F.lit(level).alias("level")), "peel")
        if n:
            peeled.add(ready, n)
    adjacency.release()
    levels = peeled.union()
    return levels, vertices.select("id").join(levels, "id", "left_anti")


def has_directed_cycle(vertices: DataFrame, edges: DataFrame) -> bool:
    return not topological_levels(vertices, edges)[1].isEmpty()


def strongly_connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` with the least id of the strong component.

    Each round colours a vertex with the least id that reaches it; within a colour, the vertices
    that reach back to the colour's own vertex form its component and leave the graph.
    """
    # Whatever can be peeled off from either end is alone; without this a long path, of which a round
    # trims one vertex at each end, would be coloured anew for each of them.
    all_, e = written(vertices.select("id").distinct(), "open"), written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    _, rest = topological_levels(all_, e)
    rest = written(rest, "rest")
    inside = e.join(rest.withColumnRenamed("id", "src"), "src", "left_semi").join(rest.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = written(inside.select("src", "dst"), "edges")
    _, rest = topological_levels(rest, reverse(e))
    left, n = written_with_count(rest, "open")
    done = [all_.join(left, "id", "left_anti").select("id", F.col("id").alias("component"))]
    while n:
        alive_src, alive_dst = left.withColumnRenamed("id", "src"), left.withColumnRenamed("id", "dst")
        e = written(e.join(alive_src, "src", "left_semi").join(alive_dst, "dst", "left_semi").select("src", "dst"), "edges")
        # Without an in or an out edge a vertex is alone in its component.
        inner = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        alone = left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))
        core, m = written_with_count(left.join(inner, "id", "left_semi"), "core")
        if m:
            ce = e.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(
                core.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
            color, _ = relax(core.select("id", F.col("id").alias("cost")), ce, step=F.col("cost"))
            color = written(color.select("id", F.col("cost").alias("color")), "color")
            same = (
                ce.join(color.withColumnsRenamed({"id": "src", "color": "a"}), "src")
                .join(color.withColumnsRenamed({"id": "dst", "color": "b"}), "dst")
                .where("a = b").select("src", "dst"))
            back, _ = relax(color.where("id = color").select("id", F.col("id").alias("cost")), reverse(same), step=F.col("cost"))
            done.append(back.select("id", F.col("cost").alias("component")))
        done.append(written(alone, "alone"))
        left, n = written_with_count(left.join(union_all(done[-2:]).select("id"), "id", "left_anti"), "open")
    return union_all(done)


def condensation(edges: DataFrame, components: DataFrame, make_acyclic: bool = True) -> DataFrame:
    """Edges between strong components; with ``make_acyclic`` without loops and duplicates."""
    e = edges.join(components.withColumnsRenamed({"id": "src", "component": "a"}), "src").join(
        components.withColumnsRenamed({"id": "dst", "component": "b"}), "dst")
    out = e.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return out.where("src <> dst").distinct() if make_acyclic else out


def reverse_topological_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component, position``: components after everything they lead to come first."""
    comp = written(strongly_connected(vertices, edges), "scc")
    dag = condensation(edges, comp)
    levels, _ = topological_levels(comp.select(F.col("component").alias("id")).distinct(), reverse(dag))
    return comp.join(levels.withColumnsRenamed({"id": "component", "level": "position"}), "component")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges ``edge_id, src, dst, weight`` of a minimum spanning forest; ties by ``edge_id``.

    Every component picks its least outgoing edge, components joined by picks merge, and edges
    inside a component leave, which halves the components each round.
    """
    cols = ["edge_id", "src", "dst", "weight"]
    live, n = written_with_count(
        edges.select(*cols).where("src <> dst").withColumns({"a": F.col("src"), "b": F.col("dst")}), "live")
    chosen = []
    while n:
        rest = F.struct("weight", "edge_id", "src", "dst", "a", "b").alias("e")
        ends = live.select(F.col("a").alias("c"), rest).unionByName(live.select(F.col("b").alias("c"), rest))
        picks = written(ends.groupBy("c").agg(F.min("e").alias("e")), "picks")
        chosen.append(picks.select("e.*").distinct().select(*cols))
        to = F.when(F.col("c") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a"))
        comp = _roots(picks.select("c", to.alias("up")))
        moved = (
            live.join(comp.withColumnsRenamed({"c": "a", "up": "na"}), "a")
            .join(comp.withColumnsRenamed({"c": "b", "up": "nb"}), "b")
            .where("na <> nb").select(*cols, F.col("na").alias("a"), F.col("nb").alias("b")))
        live, n = written_with_count(moved, "live")
    return union_all(chosen) if chosen else live.select(*cols)


def _roots(up: DataFrame) -> DataFrame:
    """Root of each ``c, up`` where links lead into one pair that points at each other.

    The smaller of the pair is the root. Each round a vertex takes over its parent's parent, so the
    number of rounds is the logarithm of the longest chain.
    """
    def above(links):
        return links.select(F.col("c").alias("up"), F.col("up").alias("top"))

    top = (F.col("top") == F.col("c")) & (F.col("c") < F.col("up"))
    up = written(up.join(above(up), "up").select("c", F.when(top, F.col("c")).otherwise(F.col("up")).alias("up")), "roots")
    while True:
        nxt = up.join(above(up), "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
        up, seen = written_observed(nxt, "roots", n=F.count_if("moved"))
        up = up.drop("moved")
        if not seen["n"]:
            return up


def bipartite(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, bipartite``: whether the vertex's component can be split into two sides.

    Each vertex appears once per side and each edge links opposite sides; an odd cycle is where
    both copies of a vertex fall into one component.
    """
    copies = vertices.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("id"))
    a, b = F.col("src") * 2, F.col("dst") * 2
    links = edges.select(a.alias("src"), (b + 1).alias("dst")).unionByName(
        edges.select((a + 1).alias("src"), b.alias("dst")))
    comp = written(connected_components(copies, links), "sides")
    left = comp.where("id % 2 = 0").select(F.expr("id div 2").alias("id"), F.col("component").alias("a"))
    right = comp.where("id % 2 = 1").select(F.expr("id div 2").alias("id"), F.col("component").alias("b"))
    return left.join(right, "id").select("id", (F.col("a") != F.col("b")).alias("bipartite"))


def maximal_matching(edges: DataFrame) -> DataFrame:
    """A valid matching that no further edge extends: ``src, dst``.

    Each round every vertex proposes its edge of least hash, edges proposed by both ends match,
    and edges touching a matched vertex leave.
    """
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    live, n = written_with_count(pair.distinct().withColumn("h", F.xxhash64("src", "dst")), "live")
    out = []
    while n:
        key = F.struct("h", "src", "dst")
        ends = live.select(F.col("src").alias("v"), key.alias("e")).unionByName(live.select(F.col("dst").alias("v"), key.alias("e")))
        best = ends.groupBy("v").agg(F.min("e").alias("e"))
        agreed = written(best.groupBy("e").count().where("count = 2").select("e.src", "e.dst"), "matched")
        out.append(agreed)
        used = agreed.select(F.col("src").alias("v")).unionByName(agreed.select(F.col("dst").alias("v")))
        live, n = written_with_count(
            live.join(used.withColumnRenamed("v", "src"), "src", "left_anti")
            .join(used.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst", "h"), "live")
    return union_all(out) if out else live.select("src", "dst")


def mates(matching: DataFrame) -> DataFrame:
    """``id, mate`` for both ends of each matched edge."""
    return both_ways(matching).select(F.col("src").alias("id"), F.col("dst").alias("mate"))


def matching_report(vertices: DataFrame, edges: DataFrame, matching: DataFrame) -> DataFrame:
    """Size, perfection and the checks a valid maximal matching must pass."""
    m = mates(matching)
    used = m.groupBy("id").count()
    known = matching.join(both_ways(edges.select("src", "dst")), ["src", "dst"], "left_anti")
    ids = m.select("id")
    open_ = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    facts = [
        matching.agg(F.count("*").alias("n")).select(F.lit("size").alias("fact"), "n"),
        used.where("count > 1").agg(F.count("*").alias("n")).select(F.lit("vertices_used_twice").alias("fact"), "n"),
        known.agg(F.count("*").alias("n")).select(F.lit("edges_not_in_graph").alias("fact"), "n"),
        open_.agg(F.count("*").alias("n")).select(F.lit("edges_still_free").alias("fact"), "n"),
        vertices.select("id").join(ids, "id", "left_anti").agg(F.count("*").alias("n")).select(
            F.lit("unmatched_vertices").alias("fact"), "n"),
    ]
    return union_all(facts)


def feedback_arcs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose removal leaves no cycle, loops included.

    Vertices that can be peeled from either end lie on no cycle. The rest is put in order of out
    minus in degree, and the smaller of the backward and the forward edges goes.
    """
    from reachlake.operators.graph.basic import degrees, retain_nodes

    loops = edges.where("src = dst")
    plain = edges.where("src <> dst")
    _, rest = topological_levels(vertices, plain)
    rest = written(rest, "rest")
    _, core_e = retain_nodes(rest, plain, F.lit(True))
    core_e = written(core_e, "core")
    _, rest2 = topological_levels(rest, reverse(core_e))
    rest2 = written(rest2, "rest")
    _, e = retain_nodes(rest2, core_e, F.lit(True))
    d = degrees(rest2, e).select("id", F.struct((F.col("in_degree") - F.col("out_degree")).alias("d"), F.col("id").alias("i")).alias("at"))
    placed = written(
        e.join(d.withColumnsRenamed({"id": "src", "at": "sa"}), "src").join(d.withColumnsRenamed({"id": "dst", "at": "da"}), "dst")
        .withColumn("backward", F.col("sa") > F.col("da")).select(*edges.columns, "backward"), "placed")
    n = placed.agg(F.count_if("backward").alias("b"), F.count("*").alias("n")).first()
    pick = F.col("backward") if n["b"] * 2 <= n["n"] else ~F.col("backward")
    return placed.where(pick).drop("backward").unionByName(loops)
