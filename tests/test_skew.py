"""The paths for hot keys give the same rows as the plain ones."""

import random
import time

from pyspark.sql import functions as F

from conftest import rows
from reachlake.operators import grid, skew
from reachlake.operators.fixpoint import Adjacency, relax
from reachlake.operators.grid import nearest_points, within_distance
from reachlake.session import written


def sample(spark):
    rnd = random.Random(3)
    data = [(0 if i % 3 else rnd.randrange(5), i, float(rnd.randrange(100)), rnd.choice([None, i])) for i in range(200)]
    return spark.createDataFrame(data, "k int, i int, v double, w int")


def scanned(df):
    scan = skew.OrderedScan(df, ["k"], ["i"])
    scan.index("n").lag("before", F.col("v")).lead("after", F.col("v")).running_sum("total", F.col("v"))
    scan.running_max("top", F.col("v")).fill_next("filled", F.col("w"))
    return scan


def test_scan_over_hot_key_equals_plain_scan(spark):
    df = sample(spark)
    plain = scanned(df)
    assert not plain.blocked
    want = rows(plain.frame().fillna(-1))
    spark.conf.set("reachlake.hot.rows", "5")
    try:
        blocked = scanned(df)
        assert blocked.blocked
        assert rows(blocked.frame().fillna(-1)) == want
    finally:
        spark.conf.unset("reachlake.hot.rows")


def test_scan_values(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 1, 3), ("b", 1, 7)], "k string, i int, v int")
    out = skew.OrderedScan(df, ["k"], ["i"]).index("n").lag("p", F.col("v")).running_sum("s", F.col("v")).frame()
    assert rows(out.fillna(-1)) == [("a", 1, 3, 0, -1, 3), ("a", 2, 5, 1, 3, 8), ("b", 1, 7, 0, -1, 7)]


def test_salted_join_equals_join(spark, hot):
    left = sample(spark).drop("w")
    right = spark.createDataFrame([(0, "x"), (0, "y"), (2, "z"), (9, "n")], "k int, name string")
    assert skew.hot_keys(left, ["k"]) is not None
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.salted_join(left, right, ["k"], ["i"], how)
        want = left.join(right, "k", how)
        assert rows(got.select(want.columns).fillna("-")) == rows(want.fillna("-"))


def test_hot_keys_of_the_other_side_are_split(spark, hot):
    left = spark.createDataFrame([(0, "x"), (2, "z"), (9, "n")], "k int, name string")
    right = sample(spark).drop("w")
    assert skew.hot_keys(left, ["k"]) is None
    got, want = skew.salted_join(left, right, ["k"], ["name"]), left.join(right, "k")
    assert rows(got.select(want.columns)) == rows(want)


def test_pieces_are_bounded_and_whole(spark, hot):
    df = sample(spark)
    out = skew.in_pieces(df, ["k"], ["i"], F.col("i"), size=7).collect()
    assert max(len(r["items"]) for r in out) <= 7
    zero = [x for r in sorted((r for r in out if r["k"] == 0), key=lambda r: r["piece"]) for x in r["items"]]
    assert zero == [r["i"] for r in df.where("k = 0").orderBy("i").collect()]


def test_relax_through_hub_equals_plain(spark):
    rnd = random.Random(5)
    edges = [(0, i, float(rnd.randrange(1, 9))) for i in range(1, 40)] + [(i, rnd.randrange(40), 1.0) for i in range(1, 40)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    seeds = spark.createDataFrame([(5, 0.0)], "id long, cost double")
    want = rows(relax(seeds, e)[0].select("id", "cost"))
    spark.conf.set("reachlake.hot.rows", "5")
    try:
        assert rows(relax(seeds, e)[0].select("id", "cost")) == want
    finally:
        spark.conf.unset("reachlake.hot.rows")


def test_grid_joins_equal_brute_force_with_piles(spark, hot):
    rnd = random.Random(7)
    pts = [(i, 10 if i % 3 == 0 else rnd.randrange(300), 10 if i % 3 == 0 else rnd.randrange(300)) for i in range(90)]
    p = spark.createDataFrame(pts, "id long, x long, y long")
    q = p.withColumnRenamed("id", "other")
    d2 = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    want = sorted((a[0], b[0]) for a in pts for b in pts if d2(a, b) <= 40 * 40)
    assert rows(within_distance(p, q, 40).select("id", "other")) == want
    near = p.join(nearest_points(p, q, "other", 3), ["x", "y"]).select("id", "other", "rank")
    best = sorted((a[0], b[0], i + 1) for a in pts for i, b in enumerate(sorted(pts, key=lambda b: (d2(a, b), b[0]))[:3]))
    assert rows(near) == best


def test_lost_deltas_merge(spark):
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "src long, dst long, weight double")
    labels, rounds = relax(spark.createDataFrame([(0, 0.0)], "id long, cost double"), line)
    assert rows(labels.select("id", "cost")) == [(i, float(i)) for i in range(31)]
    assert rounds == 31


def test_piles_are_expanded_in_even_tasks(spark, monkeypatch):
    rnd = random.Random(8)
    spots = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(6)]
    pts = [(i, *spots[0 if i < 40 else i % 6]) for i in range(90)]
    p = spark.createDataFrame(pts, "id int, x long, y long")
    q = p.withColumnRenamed("id", "other")
    want = sorted((a[0], b[0]) for a in pts for b in pts if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 6400)
    monkeypatch.setattr(grid, "ROWS_PER_TASK", 400)
    monkeypatch.setattr(grid, "LIST_ROWS", 7)
    out = within_distance(p, q, 80)
    assert out.columns == ["x", "y", "id", "dist", "other"]
    assert rows(out.select("id", "other")) == want
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < len(want) / 2


def test_a_frontier_does_not_read_other_edges(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(100)], "src long, dst long, weight double")
    kept = Adjacency(edges)
    met = kept.join(spark.createDataFrame([(3,), (5,)], "src long"), ends=(3, 5))
    assert rows(met.select("src", "dst")) == [(3, 4), (5, 6)]
    assert kept.edges.where("src between 3 and 5").count() == 3
    assert "src#" in met._jdf.queryExecution().optimizedPlan().toString() and ">= 3" in met._jdf.queryExecution().optimizedPlan().toString()
    kept.release()


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles().iterator()
    found = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_"):
            found.add(name)
    return found


def test_written_tables_leave_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")).repartition("s")
    before = shuffle_files(spark)
    kept = written(df)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert rows(kept) == rows(df)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_hot_keys_are_found_behind_their_hashes(spark, monkeypatch):
    df = sample(spark)
    monkeypatch.setattr(skew, "COUNTED_HASHES", 2)
    spark.conf.set("reachlake.hot.rows", "60")
    try:
        many = df.groupBy("k").count().where("count > 60").count()
        assert skew.any_hot(df, ["k"]) and skew.hot_keys(df, ["k"]).count() == many
        # Two hashes hold more than 60 of these rows each, but no key does.
        assert not skew.any_hot(df, ["i"]) and skew.hot_keys_and_rows(df, ["i"]) == (None, 200)
    finally:
        spark.conf.unset("reachlake.hot.rows")
