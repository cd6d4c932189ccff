"""Transit, road and graph tables derived from the general-purpose input tables.

All keys and coordinates come from integer arithmetic, so any engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.operators.skew import OrderedScan, any_hot

# Layout of the derived city. Stops fall on a square of EXTENT metres.
EXTENT = 8009
ROAD_COLUMNS = 40
ROAD_SPACING = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scatter(key: str, factor: int) -> Column:
    return (F.col(key) * factor % EXTENT).cast("long")


def stops(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("stop_id"),
        F.col("s_name").alias("stop_name"),
        _scatter("s_suppkey", 7919).alias("x"),
        _scatter("s_suppkey", 104729).alias("y"),
    )


def stop_times(spark, sf_dir, by_trip: bool = False) -> DataFrame:
    """Visits of all trips; with ``by_trip`` they are dealt by trip, so that work per trip doesn't shuffle them again."""
    li = table(spark, sf_dir, "lineitem")
    if by_trip:
        li = li.select("l_orderkey", "l_linenumber", "l_suppkey").repartition("l_orderkey")
    arrival = 18000 + F.col("l_orderkey") * 613 % 64800 + F.col("l_linenumber") * 420
    return (
        li.groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_suppkey").alias("stop_id"))
        .select(
            F.col("l_orderkey").alias("trip_id"),
            F.col("l_linenumber").cast("long").alias("seq"),
            "stop_id",
            arrival.cast("long").alias("arrival"),
        )
    )


def trips(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_custkey").alias("route_id"),
        (F.col("o_custkey") % 4).cast("int").alias("mode"),
        (F.col("o_orderkey") % 2).cast("int").alias("direction"),
        F.col("o_orderpriority").alias("service_id"),
        F.expr("o_orderkey div 3").alias("block_id"),
    )


def requests(spark, sf_dir) -> DataFrame:
    """One request per nation."""
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        k.alias("request_id"),
        (k * 3001 % EXTENT).alias("x"),
        (k * 1777 % EXTENT).alias("y"),
        (28800 + k * 600).alias("start"),
        F.lit(7200).cast("long").alias("duration"),
    )


def hop_edges(spark, sf_dir) -> DataFrame:
    """Least travel time between stops that follow each other on some trip."""
    # A trip has no more visits than lines.
    hot = any_hot(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    st = stop_times(spark, sf_dir, by_trip=not hot)
    scan = OrderedScan(st, ["trip_id"], ["seq"], blocked=None if hot else False)
    scan.lead("next_stop", F.col("stop_id")).lead("next_arrival", F.col("arrival"))
    return (
        scan.frame()
        .where(F.col("next_stop").isNotNull() & (F.col("next_stop") != F.col("stop_id")))
        .groupBy(F.col("stop_id").alias("src"), F.col("next_stop").alias("dst"))
        .agg(F.min(F.col("next_arrival") - F.col("arrival")).cast("double").alias("weight"))
    )


def road_nodes(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("node_id"),
        (k % ROAD_COLUMNS * ROAD_SPACING).alias("x"),
        (F.expr(f"c_custkey div {ROAD_COLUMNS}") * ROAD_SPACING).alias("y"),
    )


def road_edges(spark, sf_dir) -> DataFrame:
    """Street grid: along the row unless it ends there, and up unless that street is missing."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))
    k = F.col("src")
    last_in_row = k % ROAD_COLUMNS == ROAD_COLUMNS - 1
    no_street_up = k % 3 == 0
    along = F.when(~last_in_row, F.struct((k + 1).alias("dst"), (20 + k * 31 % 180).alias("w")))
    up = F.when(~no_street_up, F.struct((k + ROAD_COLUMNS).alias("dst"), (20 + k * 17 % 180).alias("w")))
    both = keys.select("src", F.explode(F.array_compact(F.array(along, up))).alias("e"))
    rows = both.select("src", "e.dst", F.col("e.w").cast("double").alias("weight"))
    return rows.join(keys.withColumnRenamed("src", "dst"), "dst", "left_semi").select(
        (F.col("src") * 2 + (F.col("dst") != F.col("src") + 1).cast("long")).alias("edge_id"),
        "src", "dst", "weight",
    )


def trade_edges(spark, sf_dir) -> DataFrame:
    """Order lines from the nation of the customer to the nation of the supplier."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").count()
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(cust, F.col("o_custkey") == cust.c_custkey)
        .join(sup, li.l_suppkey == sup.s_suppkey)
        .groupBy(
            F.col("c_nationkey").cast("long").alias("src"),
            F.col("s_nationkey").cast("long").alias("dst"),
        )
        .agg(F.sum("count").cast("double").alias("weight"))
    )


# Offsets that keep the vertex kinds of the order network apart.
NATION0, CUSTOMER0, ORDER0, SUPPLIER0 = 1_000, 1_000_000_000, 2_000_000_000_000, 3_000_000_000_000


def order_network(spark, sf_dir) -> DataFrame:
    """Layered directed network: region, nation, customer, order, supplier."""
    nation = table(spark, sf_dir, "nation")
    cust = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")

    def edges(df, src, dst):
        return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))

    return (
        edges(nation, F.col("n_regionkey"), F.col("n_nationkey") + NATION0)
        .unionByName(edges(cust, F.col("c_nationkey") + NATION0, F.col("c_custkey") + CUSTOMER0))
        .unionByName(edges(orders, F.col("o_custkey") + CUSTOMER0, F.col("o_orderkey") + ORDER0))
        .unionByName(edges(li, F.col("l_orderkey") + ORDER0, F.col("l_suppkey") + SUPPLIER0).distinct())
    )


SQL = {
    "stops": "select s_suppkey stop_id, s_name stop_name, (s_suppkey*7919)%8009 x, (s_suppkey*104729)%8009 y from supplier",
    "stop_times": """select l_orderkey trip_id, cast(l_linenumber as bigint) seq, min(l_suppkey) stop_id,
        18000+(l_orderkey*613)%64800+l_linenumber*420 arrival from lineitem group by l_orderkey, l_linenumber""",
    "trips": """select o_orderkey trip_id, o_custkey route_id, cast(o_custkey%4 as int) as mode,
        cast(o_orderkey%2 as int) direction, o_orderpriority service_id, o_orderkey//3 block_id from orders""",
    "requests": """select cast(n_nationkey as bigint) request_id, (n_nationkey*3001)%8009 x, (n_nationkey*1777)%8009 y,
        28800+n_nationkey*600 as start, 7200 duration from nation""",
    "hop_edges": """select src, dst, cast(min(w) as double) weight from (
        select stop_id src, lead(stop_id) over (partition by trip_id order by seq) dst,
               lead(arrival) over (partition by trip_id order by seq)-arrival w from stop_times)
        where dst is not null and dst<>src group by src, dst""",
    "road_nodes": "select c_custkey node_id, (c_custkey%40)*200 x, (c_custkey//40)*200 y from customer",
    "road_edges": """select src*2+(case when dst<>src+1 then 1 else 0 end) edge_id, src, dst, cast(w as double) weight from (
        select c_custkey src, c_custkey+1 dst, 20+(c_custkey*31)%180 w from customer where c_custkey%40<>39
        union all
        select c_custkey, c_custkey+40, 20+(c_custkey*17)%180 from customer where c_custkey%3<>0)
        where dst in (select c_custkey from customer)""",
    "road_both": "select src, dst, weight from road_edges union all select dst, src, weight from road_edges",
    "trade_edges": """select cast(c_nationkey as bigint) src, cast(s_nationkey as bigint) dst, cast(count(*) as double) weight
        from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
        join supplier on l_suppkey=s_suppkey group by 1,2""",
    "dag_edges": "select src, dst, weight from hop_edges where src<dst",
    "order_network": """select cast(n_regionkey as bigint) src, cast(n_nationkey+1000 as bigint) dst from nation
        union all select c_nationkey+1000, c_custkey+1000000000 from customer
        union all select o_custkey+1000000000, o_orderkey+2000000000000 from orders
        union all select distinct l_orderkey+2000000000000, l_suppkey+3000000000000 from lineitem""",
    "walk": """select a.stop_id from_stop, b.stop_id to_stop,
        sqrt(cast((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as double)) dist
        from stops a join stops b on (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=640000""",
}
_NEEDS = {
    "hop_edges": ["stop_times"], "road_both": ["road_edges"], "dag_edges": ["hop_edges"], "walk": ["stops"],
}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the named views as common table expressions, in dependency order."""
    seen: list[str] = []

    def add(n):
        for d in _NEEDS.get(n, []):
            add(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} as materialized ({SQL[n]})" for n in seen)
    lead = body.strip()
    if lead.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{lead[len('with recursive'):]}"
    if lead.lower().startswith("with "):
        return f"with {ctes},\n{lead[len('with'):]}"
    return f"with {ctes}\n{lead}"
