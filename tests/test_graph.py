"""Known answers and random graphs against small Python references."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reachlake.operators.fixpoint import relax
from reachlake.operators.graph import basic as G
from reachlake.operators.graph import components as C
from reachlake.operators.graph import paths as P
from reachlake.sources import derived as D

def graph(spark, pairs, weight=None):
    data = [(int(a), int(b), float(w)) for a, b, w in ((*p, 1.0) if len(p) == 2 else p for p in pairs)]
    return spark.createDataFrame(data, "src long, dst long, weight double")


def at(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "source long, id long")


def random_graph(seed, n, m, negative=False):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), float(rnd.randrange(-2 if negative else 0, 9))) for _ in range(m)]


def floyd(n, edges):
    d = {(i, j): 0.0 if i == j else float("inf") for i in range(n) for j in range(n)}
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


def simple_graph(seed, n, m):
    """Different edges of positive weight."""
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
    return [(a, b, float(rnd.randint(1, 9))) for a, b in sorted(pairs) if a != b]


def kth_walks(edges, start, k):
    """Cost of the k-th cheapest walk from ``start`` to every vertex that has as many."""
    heap, seen = [(0.0, start)], {}
    while heap:
        cost, v = heapq.heappop(heap)
        seen.setdefault(v, []).append(cost)
        if len(seen[v]) <= k:
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (cost + w, b))
    return {v: costs[k - 1] for v, costs in seen.items() if len(costs) >= k}


def test_shortest_paths_equal_brute_force(spark):
    edges = simple_graph(21, 10, 24)
    d = floyd(10, edges)
    got = {r.id: r.cost for r in P.shortest_paths(at(spark, 3), graph(spark, edges)).collect()}
    assert got == {j: d[3, j] for j in range(10) if d[3, j] < float("inf")} and len(got) > 4


def test_k_shortest_equals_brute_force(spark):
    edges = simple_graph(22, 7, 34)
    got = {r.id: r.cost for r in P.k_shortest_walks(at(spark, 0), graph(spark, edges), 2).collect()}
    assert got == kth_walks(edges, 0, 2) and len(got) > 3


def test_goal_path_known(spark):
    e = graph(spark, [(0, 1, 2), (0, 3, 4), (1, 2, 1), (1, 5, 7), (2, 4, 5), (4, 5, 1), (3, 4, 1)])
    labels = P.shortest_paths(at(spark, 0), e)
    goal = spark.createDataFrame([(0, 5)], "source long, id long")
    assert labels.join(goal, ["source", "id"], "left_semi").first()["cost"] == 6.0
    path = [r["id"] for r in sorted(P.trace_back(labels, goal).collect(), key=lambda r: -r["back"])]
    assert path == [0, 3, 4, 5]


def test_long_trace(spark):
    e = graph(spark, [(i, i + 1) for i in range(20)])
    labels = P.shortest_paths(at(spark, 0), e)
    path = P.trace_back(labels, spark.createDataFrame([(0, 20), (0, 6), (0, 0)], "source long, id long"))
    by = {}
    for r in path.collect():
        by.setdefault(r["goal"], []).append((r["back"], r["id"]))
    assert {g: [i for _, i in sorted(v)] for g, v in by.items()} == {
        20: list(range(20, -1, -1)), 6: list(range(6, -1, -1)), 0: [0]}


def test_negative_cycle_known(spark):
    e = graph(spark, [(0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 3, 1), (2, 1, 1), (3, 2, -3)])
    cycle = [r["id"] for r in sorted(P.negative_cycle(at(spark, 0), e, 4).collect(), key=lambda r: r["position"])]
    k = cycle.index(1)
    assert cycle[k:] + cycle[:k] == [1, 3, 2]
    with pytest.raises(P.NegativeCycle):
        P.bellman_ford_or_raise(at(spark, 0), e, 4)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_random(spark, seed):
    n, edges = 8, random_graph(seed, 8, 20)
    d = floyd(n, edges)
    got = {(r["source"], r["id"]): r["cost"] for r in P.all_pairs(spark.range(n), graph(spark, edges)).collect()}
    assert got == {k: v for k, v in d.items() if v < float("inf")}


@pytest.mark.parametrize("seed", [3, 4])
def test_strong_components_random(spark, seed):
    n, edges = 12, random_graph(seed, 12, 20)
    d = floyd(n, edges)
    inf = float("inf")
    want = sorted((i, min(j for j in range(n) if d[i, j] < inf and d[j, i] < inf)) for i in range(n))
    e = graph(spark, edges)
    assert rows(C.strongly_connected(spark.range(n), e)) == want
    order = {r["component"]: r["position"] for r in C.reverse_topological_components(spark.range(n), e).collect()}
    comp = dict(want)
    assert all(order[comp[a]] > order[comp[b]] for a, b, _ in edges if comp[a] != comp[b])
    arcs = {(r["src"], r["dst"]) for r in C.feedback_arcs(spark.range(n), e).collect()}
    left = [(a, b, 1.0) for a, b, _ in edges if (a, b) not in arcs]
    assert C.topological_levels(spark.range(n), graph(spark, left))[1].count() == 0 if left else True


@pytest.mark.parametrize("seed", [5, 6])
def test_undirected_random(spark, seed):
    n, raw = 14, random_graph(seed, 14, 14)
    edges = [(a, b, w, i) for i, (a, b, w) in enumerate(raw)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    forest, weight = 0, 0.0
    for a, b, w, _ in sorted(edges, key=lambda e: (e[2], e[3])):
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
            forest, weight = forest + 1, weight + w
    e = spark.createDataFrame(edges, "src long, dst long, weight double, edge_id long")
    assert rows(C.connected_components(spark.range(n), e)) == sorted((i, find(i)) for i in range(n))
    t = C.spanning_forest(e).agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    assert tuple(t) == (forest, weight)
    facts = {r["fact"]: r["n"] for r in C.matching_report(spark.range(n), e, C.maximal_matching(e)).collect()}
    assert facts["vertices_used_twice"] == facts["edges_not_in_graph"] == facts["edges_still_free"] == 0


def test_components_of_a_long_path(spark):
    e = graph(spark, [(i, i + 1) for i in range(100)])
    assert {r["component"] for r in C.connected_components(spark.range(101), e).collect()} == {0}


def test_bipartite(spark):
    e = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 4)])
    out = {r["id"]: r["bipartite"] for r in C.bipartite(spark.range(7), e).collect()}
    assert out == {**{i: True for i in range(4)}, **{i: False for i in range(4, 7)}}


def test_order_and_cycles(spark):
    levels, rest = C.topological_levels(spark.range(4), graph(spark, [(0, 1), (1, 2), (0, 2)]))
    assert rows(levels) == [(0, 0), (1, 1), (2, 2), (3, 0)] and rest.count() == 0
    assert C.has_directed_cycle(spark.range(2), graph(spark, [(0, 0)]))


def test_reduction_and_closure(spark):
    e = graph(spark, [(0, 1), (0, 2), (0, 3), (0, 4), (1, 3), (2, 3), (2, 4), (3, 4)])
    assert rows(P.reduction(e)) == [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]
    assert len(rows(P.closure(e))) == 4 + 2 + 2 + 1


def test_complement_twice(spark):
    e = graph(spark, [(0, 1), (1, 2)])
    c = G.complement(spark.range(3), e, 1.0)
    assert rows(c.select("src", "dst")) == [(0, 2), (1, 0), (2, 0), (2, 1)]
    assert rows(G.complement(spark.range(3), c, 1.0).select("src", "dst")) == [(0, 1), (1, 2)]


def test_closure_sends_sources_in_words(spark):
    """Over 64 sources, in a graph without and one with cycles, against a search from each vertex."""
    rnd = random.Random(7)
    pairs = {(a, b) for a, b in ((rnd.randrange(150), rnd.randrange(150)) for _ in range(900)) if a < b}
    for links in (pairs, {(0, i) for i in range(1, 80)} | {(i, i + 20) for i in range(80, 120)} | {(i, 149 - i) for i in range(70, 80)} | {(3, 3), (139, 79)}):
        after = {a: {b for x, b in links if x == a} for a in range(150)}
        reached = {}
        for a in after:
            seen, todo = set(), list(after[a])
            while todo:
                b = todo.pop()
                if b not in seen:
                    seen.add(b)
                    todo += after[b]
            reached[a] = seen
        e = graph(spark, sorted(links))
        assert rows(P.closure(e)) == sorted((a, b) for a, bs in reached.items() for b in bs)
        words, _, adjacency = P._source_words(e.select("src", "dst").distinct())
        adjacency.release()
        assert words.count() <= 150 * 3
        if links is pairs:
            kept = sorted((a, b) for a, b in links if not any(b in reached[m] for m in after[a]))
            assert rows(P.reduction(e)) == kept


def test_complement_meets_neighbours_by_block(spark, capsys):
    """Repeated and null vertices, edges to unknown ones; the edges are sent to no task whole."""
    v = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 6, 2, 5, 5, None)], "id long")
    e = graph(spark, [(0, 1), (0, 2), (0, 0), (2, 5), (6, 9), (9, 1), (4, 6)])
    ids = [r.id for r in v.collect() if r.id is not None]
    have = {(r.src, r.dst) for r in e.collect()}
    want = sorted((a, b, 2.0) for a in ids for b in ids if a != b and (a, b) not in have)
    got = G.complement(v, e, 2.0)
    assert rows(got) == want
    got.explain()
    assert "LeftAnti" not in capsys.readouterr().out
    assert rows(G.complement(spark.range(0), e, 1.0)) == []


def test_simple_paths_with_parallel_edges(spark):
    e = graph(spark, [(0, 1), (0, 1), (1, 2), (1, 2)])
    pair = spark.createDataFrame([(0, 2)], "a long, b long")
    assert P.simple_paths(pair, e, max_between=2).count() == 4


def test_pattern(spark):
    e = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    got = P.find_pattern(spark.range(4), e, [(0, 1), (1, 2), (2, 0)])
    assert rows(got) == [(0, 1, 2), (1, 2, 0), (2, 0, 1)]
    assert rows(P.find_pattern(spark.range(4), e, [(0, 1), (1, 2)])) == [(1, 2, 3)]


def test_searches_end_at_their_goals(spark):
    """Sources with near, several, missing and no goals; the search of a long street stops behind its goals."""
    street = [(i, i + 1, 1.0) for i in range(40)] + [(3, 100, 50.0), (100, 101, 1.0)]
    g = graph(spark, street)
    goals = spark.createDataFrame([(0, 2), (0, 4), (30, 33), (30, 7), (38, 38)], "source long, id long")
    got = {(r.source, r.id): r.cost for r in P.shortest_paths(at(spark, 0, 30, 38, 5), g, goals=goals).collect()}
    assert got == {(0, 2): 2, (0, 4): 4, (30, 33): 3, (38, 38): 0}
    seeds = spark.createDataFrame([(0, 0, 0.0)], "source long, id long, cost double")
    labels, rounds = relax(seeds, g, ["source"], goals=goals, every_goal=True)
    assert rounds <= 7 and labels.count() <= 8
    pairs = spark.createDataFrame([(0, 2), (0, 101), (5, 3), (7, 7), (2, 40)], "a long, b long")
    assert rows(P.has_path(pairs, g)) == [(0, 2, True), (0, 101, True), (2, 40, True), (5, 3, False), (7, 7, True)]


def test_hops_shuffle_the_lines_once(spark, tmp_path, capsys):
    lines = [(o, n, (o * 7 + n * 3) % 11) for o in range(40) for n in range(o % 5)] + [(3, 1, 0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    hops = D.hop_edges(spark, str(tmp_path))
    hops.explain()
    # Lines are dealt by order once, hops by their ends.
    assert capsys.readouterr().out.count("Exchange") == 2
    stop = {}
    for o, n, s in lines:
        stop[o, n] = min(s, stop.get((o, n), s))
    want = {(stop[o, a], stop[o, b]) for o, a in stop for b in [min((n for p, n in stop if p == o and n > a), default=None)] if b is not None}
    assert {(r.src, r.dst) for r in hops.collect()} == {(a, b) for a, b in want if a != b}
    spark.conf.set("reachlake.hot.rows", "3")
    try:
        assert {(r.src, r.dst) for r in D.hop_edges(spark, str(tmp_path)).collect()} == {(a, b) for a, b in want if a != b}
    finally:
        spark.conf.unset("reachlake.hot.rows")


def test_closure_reads_its_edges_once(spark, tmp_path, monkeypatch):
    graph(spark, [(0, 1), (1, 2), (2, 3), (5, 6)]).write.parquet(f"{tmp_path}/e")
    used, plain = [], P._source_words
    monkeypatch.setattr(P, "_source_words", lambda e: used.append(e.inputFiles()) or plain(e))
    assert rows(P.closure(spark.read.parquet(f"{tmp_path}/e"))) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (5, 6)]
    # The search works on a table of its own, not on the input again and again.
    assert not any(str(tmp_path) in f for f in used[0])
