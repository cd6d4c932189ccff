"""Registered graph queries over stop, street, trade and order networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlake.catalog.registry import query
from reachlake.operators.graph import basic as G
from reachlake.operators.graph import components as C
from reachlake.operators.graph import paths as P
from reachlake.operators.skew import first_per_key
from reachlake.session import written
from reachlake.sources import derived as D


def best_edges(spark, sf_dir):
    """Sparse directed graph: a preferred out edge and in edge of every stop."""
    e = D.hop_edges(spark, sf_dir).withColumn("h", (F.col("src") * F.col("src") * 7 + F.col("dst") * F.col("dst") * 13 + F.col("src") * F.col("dst") * 5) % 101)
    out = first_per_key(e, ["src"], ["h", "dst"])
    into = first_per_key(e, ["dst"], ["h", "src"])
    return out.unionByName(into).select("src", "dst", "weight").distinct()


D.SQL["best_edges"] = """select distinct src, dst, weight from (
    select *, row_number() over (partition by src order by (src*src*7+dst*dst*13+src*dst*5)%101, dst) a,
      row_number() over (partition by dst order by (src*src*7+dst*dst*13+src*dst*5)%101, src) b from hop_edges) where a=1 or b=1"""
D._NEEDS["best_edges"] = ["hop_edges"]
D.SQL["cheap_roads"] = "select * from road_edges where weight<=110"
D._NEEDS["cheap_roads"] = ["road_edges"]
D.SQL["starts"] = "select cast(s_nationkey as bigint) source, min(s_suppkey) id, max(s_suppkey) goal from supplier group by 1"


D.SQL["next_edges"] = """select src, dst, weight from (
    select *, row_number() over (partition by src order by (src*src*7+dst*dst*13+src*dst*5)%101, dst) a from hop_edges) where a=1"""
D._NEEDS["next_edges"] = ["hop_edges"]


def next_edges(spark, sf_dir):
    """Preferred out edge of every stop: cycles with tails leading into them."""
    h = (F.col("src") * F.col("src") * 7 + F.col("dst") * F.col("dst") * 13 + F.col("src") * F.col("dst") * 5) % 101
    e = D.hop_edges(spark, sf_dir).withColumn("h", h)
    return first_per_key(e, ["src"], ["h", "dst"]).select("src", "dst", "weight")


def starts(spark, sf_dir):
    """One start and goal stop per nation."""
    return D.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("source")).agg(
        F.min("s_suppkey").alias("id"), F.max("s_suppkey").alias("goal"))


def stop_vertices(spark, sf_dir):
    return D.stops(spark, sf_dir).select(F.col("stop_id").alias("id"), "x", "y")


def road_vertices(spark, sf_dir):
    return D.road_nodes(spark, sf_dir).select(F.col("node_id").alias("id"))


def nations(spark, sf_dir):
    return D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def cheap_roads(spark, sf_dir):
    return D.road_edges(spark, sf_dir).where("weight <= 110")


@query("graph_vertices_from_edges", D.with_views(["trade_edges"], """
    select unnest(generate_series(0, (select max(greatest(src,dst)) from trade_edges))) id"""))
def graph_vertices(spark, sf_dir):
    return G.vertices_of(D.trade_edges(spark, sf_dir), dense=True)


@query("graph_neighbors", D.with_views(["hop_edges"], """
    select 'out' direction, src id, count(*) n, sum(dst) total from hop_edges group by src
    union all select 'in', dst, count(*), sum(src) from hop_edges group by dst
    union all select 'any', a, count(*), sum(b) from (select src a, dst b from hop_edges union all select dst, src from hop_edges) group by a"""))
def graph_neighbors(spark, sf_dir):
    e = D.hop_edges(spark, sf_dir)
    ids = stop_vertices(spark, sf_dir).select("id")
    parts = [G.neighbors(e, ids, d).groupBy("id").agg(F.count("*").alias("n"), F.sum("neighbor").alias("total")).select(
        F.lit(d).alias("direction"), "id", "n", "total") for d in ("out", "in", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("graph_incident_edges", D.with_views(["road_edges"], """
    with k as (select max(c_custkey) id from customer group by c_nationkey)
    select 'out' direction, edge_id from road_edges where src in (from k)
    union all select 'in', edge_id from road_edges where dst in (from k)
    union all select 'any', edge_id from road_edges where src in (from k) or dst in (from k)"""))
def graph_incident(spark, sf_dir):
    ids = D.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("id")).select("id")
    e = D.road_edges(spark, sf_dir)
    parts = [G.incident_edges(e, ids, d).select(F.lit(d).alias("direction"), "edge_id") for d in ("out", "in", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("graph_edges_connecting", D.with_views(["road_edges"], """
    select edge_id from road_edges where dst=src+1"""))
def graph_connecting(spark, sf_dir):
    v = road_vertices(spark, sf_dir)
    pairs = v.select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    return G.edges_connecting(D.road_edges(spark, sf_dir), pairs, directed=False).select("edge_id")


@query("graph_degrees", D.with_views(["road_edges", "road_nodes"], """
    select node_id id, (select count(*) from road_edges where src=node_id) out_degree,
      (select count(*) from road_edges where dst=node_id) in_degree from road_nodes"""))
def graph_degrees(spark, sf_dir):
    return G.degrees(road_vertices(spark, sf_dir), D.road_edges(spark, sf_dir))


@query("graph_counts", D.with_views(["road_edges", "road_nodes"], """
    select 'vertices' what, count(*) n from road_nodes union all select 'edges', count(*) from road_edges"""))
def graph_counts(spark, sf_dir):
    return G.counts(road_vertices(spark, sf_dir), D.road_edges(spark, sf_dir))


@query("graph_externals", D.with_views(["order_network"], """
    with v as (select src id from order_network union select dst from order_network)
    select 'in' direction, id from v where id not in (select dst from order_network)
    union all select 'out', id from v where id not in (select src from order_network)"""))
def graph_externals(spark, sf_dir):
    e = D.order_network(spark, sf_dir)
    v = G.vertices_of(e)
    parts = [G.externals(v, e, d).select(F.lit(d).alias("direction"), "id") for d in ("in", "out")]
    return parts[0].unionByName(parts[1])


@query("graph_isolated", D.with_views(["cheap_roads", "road_nodes"], """
    select node_id id from road_nodes where node_id not in (select src from cheap_roads union select dst from cheap_roads)"""))
def graph_isolated(spark, sf_dir):
    return G.externals(road_vertices(spark, sf_dir), cheap_roads(spark, sf_dir), "any")


@query("graph_reverse_and_undirected", D.with_views(["hop_edges"], """
    select 'reverse' form, dst src, src dst, count(*) n from hop_edges group by 2,3
    union all select 'undirected', least(src,dst), greatest(src,dst), count(*) from hop_edges group by 2,3"""))
def graph_reverse(spark, sf_dir):
    e = D.hop_edges(spark, sf_dir)
    parts = [d.groupBy("src", "dst").agg(F.count("*").alias("n")).select(F.lit(f).alias("form"), "src", "dst", "n")
             for f, d in (("reverse", G.reverse(e)), ("undirected", G.canonical(e)))]
    return parts[0].unionByName(parts[1])


@query("graph_retain_nodes", D.with_views(["hop_edges", "stops"], """
    select src, dst, weight from hop_edges where src in (select stop_id from stops where x<y) and dst in (select stop_id from stops where x<y)"""))
def graph_retain(spark, sf_dir):
    return G.retain_nodes(stop_vertices(spark, sf_dir), D.hop_edges(spark, sf_dir), F.col("x") < F.col("y"))[1]


@query("graph_filter_map", D.with_views(["hop_edges", "stops"], """
    select src, dst, weight/60 as minutes from hop_edges where weight>=840 and src in (select stop_id from stops where x>=y)
      and dst in (select stop_id from stops where x>=y)"""))
def graph_filter_map(spark, sf_dir):
    return G.filter_map(stop_vertices(spark, sf_dir), D.hop_edges(spark, sf_dir), F.col("x") >= F.col("y"), [F.col("x")],
                        F.col("weight") >= 840, [(F.col("weight") / 60).alias("minutes")])[1]


@query("graph_update_edges", """select o_custkey src, l_suppkey dst, arg_max(l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_quantity)) weight
    from lineitem join orders on l_orderkey=o_orderkey group by 1,2""")
def graph_update(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem").join(D.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = li.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"),
                  F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("at"))
    return G.update_edges(e, ["at"]).select("src", "dst", "weight")


@query("graph_complement", D.with_views(["hop_edges", "stops"], """
    select a.stop_id src, b.stop_id dst, 1.0::double weight from stops a, stops b where a.stop_id<>b.stop_id
      and (a.stop_id, b.stop_id) not in (select src, dst from hop_edges)"""))
def graph_complement(spark, sf_dir):
    return G.complement(stop_vertices(spark, sf_dir), D.hop_edges(spark, sf_dir), 1.0)


def walks_sql(edges, weight, rounds, seeds="select source, id, 0.0::double d from starts", extra=""):
    return f"""with recursive w(k, source, id, d) as (select 0, source, id, d from ({seeds})
        union all select k+1, source, dst, min(d+({weight})) from w join {edges} on src=id where k<{rounds} group by 1,2,3),
      best as (select source, id, min(d) cost from w group by 1,2){extra}"""


@query("hop_levels", D.with_views(["hop_edges", "starts"], walks_sql("hop_edges", "1", 6) +
       " select source, id, cast(cost as int) as level from best"))
def hop_levels(spark, sf_dir):
    return P.hop_levels(starts(spark, sf_dir), written(D.hop_edges(spark, sf_dir), "edges"))


@query("has_path", D.with_views(["dag_edges", "starts"], """with recursive r(a, id) as (
    select id, id from starts union select a, dst from r join dag_edges on src=id)
    select id a, goal b, (id, goal) in (select a, id from r) connected from starts"""))
def has_path(spark, sf_dir):
    pairs = starts(spark, sf_dir).select(F.col("id").alias("a"), F.col("goal").alias("b"))
    return P.has_path(pairs, D.hop_edges(spark, sf_dir).where("src < dst"))


CC_SQL = """with recursive both_ as (select src, dst from {e} union all select dst, src from {e}),
    r(id, c) as (select {v}, {v} from {t} union select dst, c from r join both_ on src=id), comp as (select id, min(c) component from r group by id)"""


@query("connected_components", D.with_views(["cheap_roads", "road_nodes"],
       CC_SQL.format(e="cheap_roads", v="node_id", t="road_nodes") + " select * from comp"))
def connected_components(spark, sf_dir):
    return C.connected_components(road_vertices(spark, sf_dir), cheap_roads(spark, sf_dir))


@query("component_count", D.with_views(["cheap_roads", "road_nodes"],
       CC_SQL.format(e="cheap_roads", v="node_id", t="road_nodes") + " select count(distinct component) components from comp"))
def component_count(spark, sf_dir):
    return C.component_count(road_vertices(spark, sf_dir), cheap_roads(spark, sf_dir))


@query("undirected_cycles", D.with_views(["cheap_roads", "road_nodes"],
       CC_SQL.format(e="cheap_roads", v="node_id", t="road_nodes") + """
    select component, count(*) vertices, cast(sum(n) as bigint) edges, sum(n)>=count(*) cyclic from (
      select component, (select count(*) from cheap_roads where src=comp.id) n from comp) group by 1"""))
def undirected_cycles(spark, sf_dir):
    return C.undirected_cycles(road_vertices(spark, sf_dir), cheap_roads(spark, sf_dir))


@query("topological_levels", D.with_views(["order_network"], """with recursive l(id, level) as (
    select distinct src, 0 from order_network where src not in (select dst from order_network)
    union select dst, level+1 from l join order_network on src=id)
    select id, max(level) as level from l group by id"""))
def topological_levels(spark, sf_dir):
    e = D.order_network(spark, sf_dir)
    return C.topological_levels(G.vertices_of(e), e)[0]


@query("directed_cycle_test", D.with_views(["hop_edges", "best_edges"], """
    with recursive r(a, id) as (select src, dst from best_edges union select a, dst from r join best_edges on src=id)
    select 'stops' graph, exists(select 1 from r where a=id) cyclic union all select 'orders', false"""))
def directed_cycle_test(spark, sf_dir):
    rows = []
    for name, e in (("stops", best_edges(spark, sf_dir)), ("orders", D.order_network(spark, sf_dir))):
        e = written(e, "edges")
        _, rest = C.topological_levels(G.vertices_of(e), e)
        rows.append(rest.agg((F.count("*") > 0).alias("cyclic")).select(F.lit(name).alias("graph"), "cyclic"))
    return rows[0].unionByName(rows[1])


SCC_SQL = """with recursive r(a, id) as (select src, dst from next_edges union select a, dst from r join next_edges on src=id),
    v as (select src id from next_edges union select dst from next_edges),
    scc as (select v.id, least(v.id, coalesce(min(x.id), v.id)) component from v left join
      (select p.a, p.id from r p join r q on p.a=q.id and p.id=q.a) x on x.a=v.id group by v.id)"""


@query("strongly_connected", D.with_views(["next_edges"], SCC_SQL + " select id, component from scc"))
def strongly_connected(spark, sf_dir):
    e = written(next_edges(spark, sf_dir), "edges")
    return C.strongly_connected(G.vertices_of(e), e)


@query("strongly_connected_hops", D.with_views(["hop_edges"], SCC_SQL.replace("next_edges", "hop_edges") + " select id, component from scc"))
def strongly_connected_hops(spark, sf_dir):
    """All hops, where most stops reach each other."""
    e = written(D.hop_edges(spark, sf_dir).select("src", "dst"), "edges")
    return C.strongly_connected(G.vertices_of(e), e)


@query("strongly_connected_order_network", D.with_views(["order_network"], """
    select src id, src component from order_network union select dst, dst from order_network"""))
def strongly_connected_order_network(spark, sf_dir):
    """A network without cycles, in which every vertex is alone."""
    e = written(D.order_network(spark, sf_dir).select("src", "dst"), "edges")
    return C.strongly_connected(G.vertices_of(e), e)


@query("connected_components_of_streets", D.with_views(["road_edges", "road_nodes"],
       CC_SQL.format(e="road_edges", v="node_id", t="road_nodes") + " select * from comp"))
def connected_components_of_streets(spark, sf_dir):
    return C.connected_components(road_vertices(spark, sf_dir), D.road_edges(spark, sf_dir))


@query("condensation", D.with_views(["next_edges"], SCC_SQL + """
    select distinct a.component src, b.component dst from next_edges join scc a on a.id=src join scc b on b.id=dst where a.component<>b.component"""))
def condensation(spark, sf_dir):
    e = written(next_edges(spark, sf_dir), "edges")
    return C.condensation(e, C.strongly_connected(G.vertices_of(e), e))


@query("reverse_topological_components", D.with_views(["next_edges"], SCC_SQL + """
    select count(distinct component) components, 0::bigint out_of_order from scc"""))
def reverse_topological(spark, sf_dir):
    e = written(next_edges(spark, sf_dir), "edges")
    order = written(C.reverse_topological_components(G.vertices_of(e), e), "order")
    links = e.join(order.select(F.col("id").alias("src"), F.col("component").alias("a"), F.col("position").alias("pa")), "src").join(
        order.select(F.col("id").alias("dst"), F.col("component").alias("b"), F.col("position").alias("pb")), "dst")
    bad = links.where("a <> b and pa <= pb").agg(F.count("*").alias("out_of_order"), F.lit(1).alias("k"))
    return order.agg(F.count_distinct("component").alias("components"), F.lit(1).alias("k")).join(bad, "k").drop("k")


@query("shortest_paths", D.with_views(["hop_edges", "starts"], walks_sql("hop_edges", "weight", 8) + " select * from best"))
def shortest_paths(spark, sf_dir):
    return P.shortest_paths(starts(spark, sf_dir), written(D.hop_edges(spark, sf_dir), "edges")).select("source", "id", "cost")


@query("shortest_path_to_goal", D.with_views(["hop_edges", "starts"], walks_sql("hop_edges", "weight", 8) + """
    select s.source, s.goal, cost, cost path_cost from starts s join best b on b.source=s.source and b.id=s.goal"""))
def shortest_path_to_goal(spark, sf_dir):
    e = written(D.hop_edges(spark, sf_dir), "edges")
    s = starts(spark, sf_dir)
    labels = written(P.shortest_paths(s, e), "labels")
    goals = s.select("source", F.col("goal").alias("id"))
    path = P.trace_back(labels, goals)
    nxt = path.select("source", "goal", (F.col("back") + 1).alias("back"), F.col("id").alias("dst"))
    length = path.withColumnRenamed("id", "src").join(nxt, ["source", "goal", "back"]).join(e, ["src", "dst"]).groupBy(
        "source", "goal").agg(F.sum("weight").alias("path_cost"))
    cost = labels.join(goals, ["source", "id"]).select("source", F.col("id").alias("goal"), "cost")
    return cost.join(length, ["source", "goal"], "left").select("source", "goal", "cost", F.coalesce("path_cost", F.lit(0.0)).alias("path_cost"))


@query("bellman_ford", D.with_views(["order_network"], walks_sql("order_network", "src%7-3.0", 6,
       "select cast(r_regionkey as bigint) source, cast(r_regionkey as bigint) id, 0.0::double d from region") + " select * from best"))
def bellman_ford(spark, sf_dir):
    e = D.order_network(spark, sf_dir).withColumn("weight", F.col("src") % 7 - 3.0)
    r = D.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("source"), F.col("r_regionkey").cast("long").alias("id"))
    return P.bellman_ford_or_raise(r, e, G.vertices_of(e).count()).select("source", "id", "cost")


@query("negative_cycle", D.with_views(["trade_edges"], "select true as closed, true as negative from trade_edges limit 1"))
def negative_cycle(spark, sf_dir):
    e = written(D.trade_edges(spark, sf_dir).withColumn("weight", F.col("weight") % 5 - 1.0), "edges")
    v = nations(spark, sf_dir)
    source = v.agg(F.min("id").alias("id")).select(F.col("id").alias("source"), "id")
    cycle = written(P.negative_cycle(source, e, v.count()), "cycle")
    n = cycle.count()
    nxt = cycle.select(((F.col("position") - 1 + n) % n).cast("int").alias("position"), F.col("id").alias("dst"))
    hops = cycle.withColumnRenamed("id", "src").join(nxt, "position").join(e, ["src", "dst"])
    return hops.agg((F.count("*") == n).alias("closed"), (F.sum("weight") < 0).alias("negative"))


def k_walks_sql(k, rounds):
    parts = ["k0 as (select cast(n_nationkey as bigint) source, cast(n_nationkey as bigint) id, 0.0::double cost, 0 hop from nation)"]
    for r in range(1, rounds + 1):
        parts.append(f"""k{r} as materialized (select source, id, cost, hop from (select *, row_number() over (partition by source, id order by cost, hop) rn from (
            select * from k{r-1} union all select source, dst, cost+weight, {r} from k{r-1} join trade_edges on src=id where hop={r-1})) where rn<={k})""")
    return f"with {', '.join(parts)} select source, id, max(cost) cost from k{rounds} group by 1,2 having count(*)={k}"


@query("k_shortest_walks", D.with_views(["trade_edges"], k_walks_sql(3, 10)))
def k_shortest_walks(spark, sf_dir):
    s = nations(spark, sf_dir).select(F.col("id").alias("source"), "id")
    return P.k_shortest_walks(s, D.trade_edges(spark, sf_dir), 3)


@query("all_pairs", D.with_views(["trade_edges"], walks_sql("trade_edges", "weight", 12,
       "select cast(n_nationkey as bigint) source, cast(n_nationkey as bigint) id, 0.0::double d from nation") + " select * from best"))
def all_pairs(spark, sf_dir):
    return P.all_pairs(nations(spark, sf_dir), D.trade_edges(spark, sf_dir))


@query("simple_paths", D.with_views(["trade_edges"], """with p as (select cast(n_nationkey as bigint) a, cast((n_nationkey+1)%25 as bigint) b from nation)
    select a, b, cast(a as varchar)||'>'||m||'>'||b path from (select p.a, p.b, x.dst m from p join trade_edges x on x.src=a join trade_edges y on y.src=x.dst and y.dst=b where x.dst not in (a,b))
    union all select p.a, p.b, p.a||'>'||x.dst||'>'||y.dst||'>'||p.b from p join trade_edges x on x.src=a join trade_edges y on y.src=x.dst join trade_edges z on z.src=y.dst and z.dst=b
      where x.dst not in (a,b) and y.dst not in (a,b) and x.dst<>y.dst"""))
def simple_paths(spark, sf_dir):
    pairs = nations(spark, sf_dir).select(F.col("id").alias("a"), ((F.col("id") + 1) % 25).alias("b"))
    out = P.simple_paths(pairs, D.trade_edges(spark, sf_dir), max_between=2, min_between=1)
    return out.select("a", "b", F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"))


@query("spanning_forest", D.with_views(["trade_edges"], """with recursive e as materialized (select least(src,dst)*100+greatest(src,dst) edge_id, least(src,dst) src, greatest(src,dst) dst, sum(weight) weight
      from trade_edges where src<>dst group by 1,2,3),
    r(edge_id, w, goal, pos) as (select edge_id, weight, dst, src from e union
      select r.edge_id, r.w, r.goal, case when e.src=r.pos then e.dst else e.src end from r join e on (e.src=r.pos or e.dst=r.pos)
        and (e.weight<r.w or (e.weight=r.w and e.edge_id<r.edge_id)))
    select edge_id, src, dst, weight from e where edge_id not in (select edge_id from r where pos=goal)"""))
def spanning_forest(spark, sf_dir):
    e = G.canonical(D.trade_edges(spark, sf_dir)).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return C.spanning_forest(e.withColumn("edge_id", F.col("src") * 100 + F.col("dst")))


@query("spanning_forest_of_streets", D.with_views(["road_edges"], """with recursive e as materialized (select edge_id, src, dst, weight from road_edges where src<>dst),
    w as materialized (select src a, dst b, weight, edge_id from e union all select dst, src, weight, edge_id from e),
    r(edge_id, weight, goal, pos) as (select edge_id, weight, dst, src from e union
      select r.edge_id, r.weight, r.goal, w.b from r join w on w.a=r.pos and (w.weight<r.weight or (w.weight=r.weight and w.edge_id<r.edge_id)))
    select edge_id, src, dst, weight from e where edge_id not in (select edge_id from r where pos=goal)"""))
def spanning_forest_of_streets(spark, sf_dir):
    return C.spanning_forest(D.road_edges(spark, sf_dir))


@query("bipartite", D.with_views(["best_edges"], """with recursive both_ as (select src, dst from best_edges union all select dst, src from best_edges),
    r(s, id, p) as (select distinct src, src, 0 from both_ union select s, dst, 1-p from r join both_ on src=id)
    select s id, not bool_or(id=s and p=1) bipartite from r group by s"""))
def bipartite(spark, sf_dir):
    e = written(best_edges(spark, sf_dir), "edges")
    return C.bipartite(G.vertices_of(e), e)


@query("bipartite_streets", D.with_views(["road_nodes"], "select node_id id, true bipartite from road_nodes"))
def bipartite_streets(spark, sf_dir):
    return C.bipartite(road_vertices(spark, sf_dir), D.road_edges(spark, sf_dir))


@query("maximal_matching", D.with_views(["road_nodes"], """select unnest(['vertices_used_twice','edges_not_in_graph','edges_still_free']) fact, 0::bigint n
    union all select 'matched_and_unmatched_vertices', count(*) from road_nodes"""))
def maximal_matching(spark, sf_dir):
    e = written(D.road_edges(spark, sf_dir), "edges")
    m = written(C.maximal_matching(e), "matching")
    report = C.matching_report(road_vertices(spark, sf_dir), e, m)
    both = report.agg(F.sum(F.when(F.col("fact") == "size", 2 * F.col("n")).when(F.col("fact") == "unmatched_vertices", F.col("n"))).alias("n"))
    return report.where(F.col("fact").isin("vertices_used_twice", "edges_not_in_graph", "edges_still_free")).unionByName(
        both.select(F.lit("matched_and_unmatched_vertices").alias("fact"), "n"))


@query("matching_mates")
def matching_mates(spark, sf_dir):
    return C.mates(C.maximal_matching(D.road_edges(spark, sf_dir)))


@query("feedback_arcs", D.with_views(["hop_edges"], """select true as acyclic, true as at_most_half, count(*) as arcs_and_rest,
    (select count(*) from (select src from hop_edges union select dst from hop_edges)) as vertices from hop_edges"""))
def feedback_arcs(spark, sf_dir):
    e = written(D.hop_edges(spark, sf_dir), "edges")
    arcs = written(C.feedback_arcs(G.vertices_of(e), e), "arcs")
    rest = written(e.join(arcs, ["src", "dst"], "left_anti").select("src", "dst"), "rest")
    loops = P.closure(rest).where("src = dst")
    acyclic = loops.agg((F.count("*") == 0).alias("acyclic"), F.lit(1).alias("k"))
    half = arcs.agg(F.count("*").alias("a")).select((F.col("a") * 2 <= e.count()).alias("at_most_half"), F.lit(1).alias("k"), "a")
    left = rest.agg(F.count("*").alias("r")).withColumn("vertices", F.lit(G.vertices_of(e).count())).withColumn("k", F.lit(1))
    return acyclic.join(half, "k").join(left, "k").withColumn("arcs_and_rest", F.col("a") + F.col("r")).drop("k", "a", "r")


TRED = """with recursive c(src, dst) as (select src, dst from dag_edges union select c.src, d.dst from c join dag_edges d on c.dst=d.src)"""


@query("transitive_closure", D.with_views(["dag_edges"], TRED + " select src, dst from c"))
def transitive_closure(spark, sf_dir):
    return P.closure(D.hop_edges(spark, sf_dir).where("src < dst"))


@query("transitive_reduction", D.with_views(["dag_edges"], TRED + """
    select src, dst from dag_edges where (src, dst) not in (select d.src, c.dst from dag_edges d join c on d.dst=c.src)"""))
def transitive_reduction(spark, sf_dir):
    return P.reduction(D.hop_edges(spark, sf_dir).where("src < dst"))


@query("pattern_induced_path", D.with_views(["best_edges", "stops"], """
    select a.src n0, a.dst n1, b.dst n2 from best_edges a join best_edges b on a.dst=b.src
    where a.src<>b.dst and a.src in (select stop_id from stops where x<y)
      and (a.dst,a.src) not in (select src,dst from best_edges) and (b.dst,b.src) not in (select src,dst from best_edges)
      and (a.src,b.dst) not in (select src,dst from best_edges) and (b.dst,a.src) not in (select src,dst from best_edges)"""))
def pattern_induced_path(spark, sf_dir):
    e = written(best_edges(spark, sf_dir), "edges")
    only_first = lambda i: F.col("x") < F.col("y") if i == 0 else F.lit(True)
    return P.find_pattern(stop_vertices(spark, sf_dir), e, [(0, 1), (1, 2)], only_first)


@query("pattern_triangles", D.with_views(["trade_edges"], """
    select a.src n0, a.dst n1, b.dst n2 from trade_edges a join trade_edges b on a.dst=b.src join trade_edges c on c.src=b.dst and c.dst=a.src
    where a.src<>a.dst and a.dst<>b.dst and a.src<>b.dst and a.weight>=100"""))
def pattern_triangles(spark, sf_dir):
    e = written(D.trade_edges(spark, sf_dir), "edges")
    heavy = lambda i, j: F.col("weight") >= 100 if (i, j) == (0, 1) else F.lit(True)
    return P.find_pattern(nations(spark, sf_dir), e, [(0, 1), (1, 2), (2, 0)], edge_match=heavy, induced=False)
