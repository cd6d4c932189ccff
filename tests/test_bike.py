"""A street of three nodes, the second edge stored against the riding direction."""

from reachlake.plans import bike as B


def test_route_and_rendering(spark):
    nodes = spark.createDataFrame([(1, 37.0, -122.0, 0.0), (2, 37.001, -122.0, 5.0), (3, 37.002, -122.0, 5.0), (9, 37.0, -122.5, 0.0)],
                                  "node_id long, lat double, lon double, ele double")
    edges = spark.createDataFrame([(10, 1, 2, 112.0, "{highway=cycleway}"), (11, 3, 2, 112.0, "{highway=primary}"), (12, 3, 99, 1.0, "{}")],
                                  "id long, node_a long, node_b long, dist double, kvs string")
    points = spark.createDataFrame(
        [(1, 10, 37.0, -122.0, 0.0), (2, 10, 37.001, -122.0, 5.0),
         (3, 11, 37.002, -122.0, 5.0), (4, 11, 37.0015, -122.0, 6.0), (5, 11, 37.001, -122.0, 5.0)],
        "point_id long, edge_id long, lat double, lon double, ele double")
    rated = B.rated_edges(edges, nodes)
    assert sorted((r.id, r.rating, r.access_friendly) for r in rated.collect()) == [(10, 5, True), (11, 1, True)]
    pair = spark.createDataFrame([(1, 37.0, -122.0001, 37.002, -122.0001, 0.5, 0.5), (2, 37.0, -122.0, 37.0, -122.0, 0.5, 0.5)],
                                 "od_id long, start_lat double, start_lon double, end_lat double, end_lon double, "
                                 "avoid_hills double, prefer_protected_lanes double")
    steps, res = B.routes(pair, nodes, rated)
    found = {r.od_id: r for r in res.collect()}
    assert found[2].status == "No path found" and found[1].status == "ok"
    hills = 5.0 * 1500 * 0.5**30
    assert abs(found[1].cost - (112 * (1 + 0.5 * 1.0 * 0.5) + hills + 112 * (1 + 0.5 * 1.5 * 0.5))) < 1e-9
    assert [(r.src, r.dst, r.edge_id) for r in sorted(steps.collect(), key=lambda r: r.step)] == [(1, 2, 10), (2, 3, 11)]
    line = sorted(B.rendered(steps, rated, points, nodes, res).where("od_id = 1").collect(), key=lambda r: r.i)
    # The second edge is turned, its end is cut at the goal, and the goal node closes the line.
    assert [r.lat for r in line] == [37.0, 37.001, 37.001, 37.0015, 37.002]
    assert [r.rating for r in line] == [5, 5, 1, 1, 1]
    assert [round(r.cumdist) for r in line] == [0, 116, 116, 173, 173]
    e = B.energy(steps).first()
    assert (e.uphill_meters, e.downhill_meters, e.total_meters) == (5.0, 0.0, 224.0)


def test_snap_is_exact_far_from_the_mean_latitude(spark):
    import math
    import random

    rnd = random.Random(8)
    nodes = [(i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(400)]
    nodes += [(1000 + i, 60 + rnd.uniform(-0.002, 0.002), 179.999 + rnd.uniform(-0.002, 0.004)) for i in range(9)]
    nodes += [(2000, 89.9999, 10.0), (2001, 89.9999, -170.0)]
    points = [(i, 60 + rnd.uniform(-0.003, 0.003), (180 + rnd.uniform(-0.004, 0.004) + 180) % 360 - 180) for i in range(20)]
    points += [(100, 0.0, 0.0), (101, 89.99995, 12.0), (102, -70.0, 30.0), (103, nodes[5][1], nodes[5][2])]

    def far(a, b):
        la, lo, lb, l2 = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((l2 - lo) / 2) ** 2
        return 2 * math.asin(math.sqrt(min(1, h)))

    got = B.snap(spark.createDataFrame(points, "id int, lat double, lon double"),
                 spark.createDataFrame(nodes, "node_id int, lat double, lon double"), "id").collect()
    by_id = {n[0]: n for n in nodes}
    assert len(got) == len(points)
    for r in got:
        p = next(q for q in points if q[0] == r["id"])
        assert abs(far(p, by_id[r["node_id"]]) - min(far(p, n) for n in nodes)) < 1e-9
