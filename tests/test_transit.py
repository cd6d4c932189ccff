"""Searches on tiny networks worked out by hand, and routes against brute force."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reachlake.operators import grid
from reachlake.operators.asof import next_departure
from reachlake.operators.profile import between_marks, runs
from reachlake.operators.shapes import place_on_shape, shape_slices
from reachlake.operators.tiles import pyramid, tiles_in_polygons
from reachlake.plans import itinerary as I
from reachlake.plans import transit as T
from reachlake.streaming.requests import answer


@pytest.fixture
def city(spark):
    stops = spark.createDataFrame(
        [(1, "One", 0, 0), (2, "Two", 5000, 0), (3, "Three", 5200, 0), (4, "Four", 9000, 0)],
        "stop_id long, stop_name string, x long, y long")
    times = spark.createDataFrame(
        [(10, 0, 1, 1000), (10, 1, 2, 1600), (20, 0, 3, 1700), (20, 1, 4, 2000), (21, 0, 3, 1800), (21, 1, 4, 2100)],
        "trip_id long, seq long, stop_id long, arrival long")
    trips = spark.createDataFrame(
        [(10, 1, "b1"), (20, 2, None), (21, 2, "b1")], "trip_id long, route_id long, block_id string")
    return stops, times, trips


def ask(spark, **extra):
    base = {"request_id": 7, "x": 0, "y": 0, "start": 900, "duration": 3000}
    return spark.createDataFrame([{**base, **extra}]).select(
        *[F.col(c).cast("long").alias(c) for c in base], *[c for c in extra if c not in base])


def test_transfer_needs_walk_and_change_time(spark, city):
    stops, times, _ = city
    labels = T.best_labels(T.reach(ask(spark), T.Network(stops, times)))
    got = {r.stop_id: (r.t, r.boardings) for r in labels.collect()}
    # 1600 + 200 / 1.25 + 35 = 1795: the 1700 is gone, the 1800 is caught.
    assert got == {2: (1600.0, 1), 4: (2100.0, 2)}


def test_horizon_and_limit(spark, city):
    stops, times, trips = city
    net = T.Network(stops, times)
    assert rows(T.best_labels(T.reach(ask(spark, duration=1000), net)).select("stop_id")) == [(2,)]
    assert rows(T.best_labels(T.reach(ask(spark), net, max_boardings=1)).select("stop_id")) == [(2,)]
    assert T.reach(ask(spark, start=1200), net).count() == 0


def test_block_keeps_boardings(spark, city):
    labels = T.best_labels(T.reach(ask(spark), T.Network(*city)))
    assert {r.stop_id: r.boardings for r in labels.collect()} == {2: 1, 4: 1}


def test_itinerary(spark, city):
    stops, times, trips = city
    labels = T.reach(ask(spark), T.Network(*city))
    rides = I.trace_labels(I.label_ends(labels), labels)
    routes = spark.createDataFrame([(1, "1", "bus", "FF0000", "000000"), (2, "2", "subway", "00FF00", "FFFFFF")],
                                   "route_id long, short_name string, route_kind string, color string, text_color string")
    legs = I.legs(rides, trips, routes, stops)
    to4 = [r for r in sorted(legs.collect(), key=lambda r: r.leg) if r.target_id == 4]
    assert [r.method for r in to4] == ["Transit", "Walking", "Transit"]
    assert to4[0].exit == "Two (stay on vehicle)" and to4[1].seconds == 160.0 and to4[2].line_width == 4.3
    words = {r.target_id: r.text for r in I.itinerary_text(legs).collect()}
    assert words[2] == "Get on bus #1 at One, 00:16:40\nGet off at Two, 00:26:40"
    arrive = spark.createDataFrame([(7, 4, 2100.0)], "request_id long, target_id long, arrival double")
    assert I.durations(legs, arrive).first().duration == 1100.0


def test_walking_stops_past_the_limit(spark):
    nodes = spark.createDataFrame([(i, i * 1000, 0) for i in range(5)], "node_id long, x long, y long")
    edges = spark.createDataFrame([(i, i, i + 1, 1000.0) for i in range(4)], "edge_id long, src long, dst long, weight double")
    point = spark.createDataFrame([(50, 0)], "x long, y long")
    got = {r.node_id: round(r.walk_s) for r in T.street_catchment(point, nodes, edges).collect()}
    # 40 s to the first node, then 704 s per street; the node at 1448 s is reached and not left.
    assert got == {0: 40, 1: 744, 2: 1448}


def test_next_departure_at_equal_time(spark):
    deps = spark.createDataFrame([(1, 0, 100, 1, 5), (1, 0, 90, 1, 4), (1, 1, 300, 1, 6)],
                                 "stop_id long, p int, time long, seq long, trip_id long")
    labels = spark.createDataFrame([(1, 1, 100.0), (2, 1, 101.0)], "label_id long, stop_id long, ready double")
    got = rows(next_departure(labels, deps, ["p"]).select("label_id", "p", "trip_id"))
    assert got == [(1, 0, 5), (1, 1, 6), (2, 1, 6)]


def test_stop_on_shape_and_slice(spark):
    segs = spark.createDataFrame([("s", 0, 0.0, 0.0, 10.0, 0.0), ("s", 1, 10.0, 0.0, 10.0, 10.0), ("s", 2, 10.0, 10.0, 20.0, 10.0)],
                                 "shape_id string, seg long, x1 double, y1 double, x2 double, y2 double")
    stops = spark.createDataFrame([("s", 2.5, 1.0), ("s", 16.0, 12.0), ("s", 10.0, 0.0)], "shape_id string, x double, y double")
    got = {r.x: r.shape_index for r in place_on_shape(stops, segs).collect()}
    assert got == {2.5: 0.25, 16.0: 2.6, 10.0: 1.0}
    pts = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 10.0, 0.0), ("s", 2, 10.0, 10.0), ("s", 3, 20.0, 10.0)],
                                "shape_id string, i long, x double, y double")
    legs = spark.createDataFrame([("l", "s", 0.25, 2.6), ("m", "s", 0.2, 0.9)], "leg_id string, shape_id string, a double, b double")
    cut = rows(shape_slices(legs, pts))
    assert cut == [("l", 0, 2.5, 0.0), ("l", 1, 10.0, 0.0), ("l", 2, 10.0, 10.0), ("l", 3, 16.0, 10.0),
                   ("m", 0, 0.0, 0.0), ("m", 1, 10.0, 0.0)]


def test_runs_and_marks(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbca")], "k int, i int, v string")
    assert rows(runs(df, ["k"], "i", "v")) == [(1, 0, 2, "a"), (1, 2, 5, "b"), (1, 5, 6, "c")]
    kept = between_marks(df, ["k"], ["i"], F.col("v") == "b", F.col("v") == "c")
    assert rows(kept.select("i")) == [(2,), (3,), (4,)]


def test_tiles(spark):
    seed = spark.createDataFrame([(3, 1, 2)], "zoom int, x long, y long")
    assert pyramid(seed, 5).count() == 1 + 4 + 16
    ring = spark.createDataFrame([(1, i, la, lo) for i, (la, lo) in enumerate([(-60.0, -100.0), (-60.0, 100.0), (60.0, 100.0), (60.0, -100.0)])],
                                 "polygon_id int, seq int, lat double, lon double")
    every = spark.createDataFrame([(3, x, y) for x in range(8) for y in range(8)], "zoom int, x long, y long")
    inside = rows(tiles_in_polygons(every, ring).select("x", "y"))
    assert inside == [(x, y) for x in range(1, 7) for y in range(2, 6)]


def test_slower_label_with_boardings_left_goes_on(spark):
    """Stop 3 is reached sooner with two boardings, later with one by staying in the block."""
    stops = spark.createDataFrame([(1, "A", 0, 0), (2, "B", 5000, 0), (3, "C", 10000, 0), (4, "D", 15000, 0)],
                                  "stop_id long, stop_name string, x long, y long")
    times = spark.createDataFrame(
        [(10, 0, 1, 1000), (10, 1, 2, 1200), (20, 0, 2, 1300), (20, 1, 3, 1500), (30, 0, 2, 1400), (30, 1, 3, 1700),
         (40, 0, 3, 2000), (40, 1, 4, 2300)], "trip_id long, seq long, stop_id long, arrival long")
    trips = spark.createDataFrame([(10, "b"), (20, None), (30, "b"), (40, None)], "trip_id long, block_id string")
    net = T.Network(stops, times, trips)
    found = {(most, r.stop_id): (r.t, r.boardings) for most in (2, 3)
             for r in T.best_labels(T.reach(ask(spark), net, max_boardings=most)).collect()}
    assert found[2, 3] == found[3, 3] == (1500.0, 2)
    assert found[2, 4] == found[3, 4] == (2300.0, 2)


def lines_of_service():
    """Stops, visits and trips of lines that run often; on the last line a trip overtakes the one before it."""
    at = {s: (s % 4 * 1500, s // 4 * 1500) for s in range(12)}
    at[12] = (1700, 100)  # a short walk from stop 1
    lines = [[0, 1, 2, 3], [3, 7, 11], [8, 9, 10, 11], [4, 12, 6, 7], [11, 10, 6, 2], [2, 5, 8, 0]]
    times, trip = [], 0
    for n, line in enumerate(lines):
        for k in range(14):
            trip += 1
            start = 1000 + 130 * n + (420 + 90 * n) * k
            for i, s in enumerate(line):
                pace = 100 if n == len(lines) - 1 and k % 3 == 2 else 400
                times.append((trip, i, s, start + i * pace, start + i * pace + 20))
    return at, times


def plain_reach(at, times, x, y, start, until, most):
    walk = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    trips = {}
    for trip, seq, stop, arrival, departure in times:
        trips.setdefault(trip, []).append((seq, stop, arrival, departure))
    ready = {s: start + walk(p, (x, y)) / 1.25 + 35 for s, p in at.items() if walk(p, (x, y)) <= 800}
    best = {}
    for _ in range(most):
        new = dict(best)
        for rows_ in trips.values():
            on = next((q for q, s, _, d in sorted(rows_) if s in ready and ready[s] <= d <= until), None)
            for q, s, a, _ in rows_:
                if on is not None and q > on and a <= until:
                    new[s] = min(a, new.get(s, a))
        best = new
        ready = {s: min([t + walk(at[f], p) / 1.25 + 35 for f, t in best.items() if walk(at[f], p) <= 800] + ([ready[s]] if s in ready else []), default=None)
                 for s, p in at.items()}
        ready = {s: t for s, t in ready.items() if t is not None}
    return best


@pytest.mark.parametrize("slots", [2, -1])
def test_search_by_pattern_equals_brute_force(spark, monkeypatch, slots):
    monkeypatch.setattr(T, "NEAR_SLOTS", slots)
    at, times = lines_of_service()
    stops = spark.createDataFrame([(s, *p) for s, p in at.items()], "stop_id long, x long, y long")
    visits = spark.createDataFrame(times, "trip_id long, seq long, stop_id long, arrival long, departure long")
    net = T.Network(stops, visits)
    assert (net.departures.where("near").count() > 0) == (slots == 2)
    asked = [(1, 0, 0, 900, 4000), (2, 1600, 100, 2500, 6000), (3, 3000, 3000, 1500, 7200), (4, 90_000, 0, 0, 9000)]
    requests = spark.createDataFrame(asked, "request_id long, x long, y long, start long, duration long")
    for most in (1, 4):
        got = {}
        for r in T.best_labels(T.reach(requests, net, max_boardings=most)).collect():
            got.setdefault(r.request_id, {})[r.stop_id] = r.t
        for i, x, y, start, duration in asked:
            assert got.get(i, {}) == plain_reach(at, times, x, y, start, start + duration, most)


def test_rounds_carry_numbers_and_shuffle_nothing_twice(spark, monkeypatch):
    """Boardings hold no walk and no parent, and known ready times aren't dealt again after they were grouped."""
    kept, keep = {}, T.written_with_count

    def spy(df, label="step"):
        kept.setdefault(label, []).append(df)
        return keep(df, label)

    monkeypatch.setattr(T, "written_with_count", spy)
    at, times = lines_of_service()
    stops = spark.createDataFrame([(s, *p) for s, p in at.items()], "stop_id long, x long, y long")
    visits = spark.createDataFrame(times, "trip_id long, seq long, stop_id long, arrival long, departure long")
    T.reach(spark.createDataFrame([(1, 0, 0, 900, 4000)], "request_id long, x long, y long, start long, duration long"), T.Network(stops, visits))
    assert set(kept["boards"][0].columns) == {*T.REQ, "trip_id", "seq", "boardings", "until_seq"}
    assert not [c for df in kept["ready"] for c, t in df.select(*T.REQ, "place_id").dtypes if t == "double"]


def test_departures_follow_within_patterns_that_no_trip_overtakes(spark):
    at, times = lines_of_service()
    visits = spark.createDataFrame([(*t, t[0] % 2) for t in times], "trip_id long, seq long, stop_id long, arrival long, departure long, mode int")
    got = {(r.trip_id, r.seq): r.after for r in T.following(visits, []).collect()}
    by_trip = {(t, q): d for t, q, _, _, d in times}
    for (trip, seq), after in got.items():
        line, k = divmod(trip - 1, 14)
        assert after == (None if line == 5 or k == 0 else by_trip[trip - 1, seq])
    classes = {(r.trip_id, r.seq): r.after for r in T.following(visits, ["mode"]).collect()}
    assert classes[3, 0] == by_trip[1, 0] and classes[2, 0] is None


@pytest.fixture
def shuffled(spark):
    """Joins shuffle both sides, as those of large tables do."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def test_stops_of_short_and_long_shapes(spark, monkeypatch, shuffled):
    line = [(s, i, i * 10.0, float(i % 3), (i + 1) * 10.0, float((i + 1) % 3)) for s in ("a", "b") for i in range(6)]
    segs = spark.createDataFrame(line, "shape_id string, seg long, x1 double, y1 double, x2 double, y2 double")
    stops = spark.createDataFrame([(t, s, x, y) for t, (s, x, y) in enumerate(
        [("a", 3.0, 1.0), ("a", 3.0, 1.0), ("b", 41.0, 9.0), ("b", 90.0, 0.0), ("c", 1.0, 1.0), ("a", None, 2.0), (None, 1.0, 1.0)])],
        "trip_id int, shape_id string, x double, y double")
    monkeypatch.setattr(grid, "FEW_ITEMS", 2)
    cells = place_on_shape(stops, segs)
    monkeypatch.setattr(grid, "FEW_ITEMS", 6)
    lists = place_on_shape(stops, segs)
    assert rows(lists) == rows(cells) and len(rows(lists)) == 4
    assert lists.columns == cells.columns and lists.dtypes == cells.dtypes
    q = stops.where("trip_id < 5").select("shape_id", "x", "y")
    few = rows(grid.nearest(q, segs, ["seg"], 3, ["shape_id"]))
    monkeypatch.setattr(grid, "FEW_ITEMS", 2)
    assert few == rows(grid.nearest(q, segs, ["seg"], 3, ["shape_id"]))
    # No query is repeated for nine cells, and a stop is shuffled once.
    assert len(shuffles(lists)) == 2 < len(shuffles(cells))


def test_points_of_slices_are_not_shuffled(spark, shuffled):
    pts = spark.createDataFrame([(s, i, i * 10.0, float(i * i)) for s in ("s", "t") for i in range(5)],
                                "shape_id string, i long, x double, y double")
    legs = spark.createDataFrame([("l", "s", 0.5, 3.25), ("m", "s", 1.0, 3.0), ("n", "t", 4.0, 4.0), ("o", "t", 2.5, 3.5)],
                                 "leg_id string, shape_id string, a double, b double")
    cut = shape_slices(legs, pts)
    assert rows(cut) == [
        ("l", 0, 5.0, 0.5), ("l", 1, 10.0, 1.0), ("l", 2, 20.0, 4.0), ("l", 3, 30.0, 9.0), ("l", 4, 32.5, 10.75),
        ("m", 1, 10.0, 1.0), ("m", 2, 20.0, 4.0), ("m", 3, 30.0, 9.0), ("n", 4, 40.0, 16.0),
        ("o", 2, 25.0, 6.5), ("o", 3, 30.0, 9.0), ("o", 4, 35.0, 12.5)]
    assert len(shuffles(cut)) == 2 and not any("leg_id" in x for x in shuffles(cut))


def searched(stops, times, x, y, start, until, most):
    """Earliest arrivals by rounds over all walks and trips: stop -> (t, boardings)."""
    place = {s: (a, b) for s, a, b in stops}
    trips = {}
    for trip, seq, stop, arrival in times:
        trips.setdefault(trip, []).append((seq, stop, arrival))
    ready = {s: start + math.dist((x, y), p) / T.STRAIGHT_SPEED + 35 for s, p in place.items() if math.dist((x, y), p) <= 800}
    best = {}
    for k in range(1, most + 1):
        new = {}
        for visits in trips.values():
            for seq, stop, arrival in visits:
                if stop in ready and ready[stop] <= arrival <= until:
                    for later, to, t in visits:
                        if later > seq and t <= until and t < min(new.get(to, math.inf), best.get(to, (math.inf,))[0]):
                            new[to] = t
        best |= {s: (float(t), k) for s, t in new.items()}
        for s, (t, _) in best.items():
            for to, p in place.items():
                if (d := math.dist(place[s], p)) <= 800:
                    ready[to] = min(ready.get(to, math.inf), t + d / T.STRAIGHT_SPEED + 35)
    return best


@pytest.mark.parametrize("sent", [T.WALKS_SENT, 0])
def test_search_equals_brute_force_and_skips_what_leads_nowhere(spark, monkeypatch, sent):
    monkeypatch.setattr(T, "WALKS_SENT", sent)
    rnd = random.Random(5)
    stops = [(s, rnd.randrange(2500), rnd.randrange(2500)) for s in range(30)]
    times = [(trip, q, rnd.randrange(28), 1000 + trip * 17 % 2000 + q * 150) for trip in range(90) for q in range(1 + trip % 4)]
    # Trips of one pattern, the same up to a last stop that differs, and one that goes back in time.
    times += [(trip, q, s, 1200 + trip + q * 200) for trip, last in ((200, 7), (210, 7), (220, 9)) for q, s in enumerate((3, 5, last))]
    times += [(300, 0, 4, 2500), (300, 1, 6, 2400), (300, 2, 8, 2600)]
    net = T.Network(spark.createDataFrame(stops, "stop_id long, x long, y long"),
                    spark.createDataFrame(times, "trip_id long, seq long, stop_id long, arrival long"))
    ends = {trip: max(q for p, q, _, _ in times if p == trip) for trip, *_ in times}
    assert not [r for r in net.boardable().collect() if ends[r.trip_id] == r.seq]
    gone = {s for s, *_ in stops} - {stop for trip, q, stop, _ in times if q < ends[trip]}
    assert {28, 29} <= gone and not gone & {r.to_place for r in net.walks.collect()}
    asked = [(i, rnd.randrange(2500), rnd.randrange(2500), 900 + 100 * i, 1500) for i in range(6)]
    labels = T.reach(spark.createDataFrame(asked, "request_id long, x long, y long, start long, duration long"), net)
    got = {}
    for r in T.best_labels(labels, 2).collect():
        got.setdefault(r.request_id, {})[r.stop_id] = (r.t, r.boardings)
    for i, x, y, start, duration in asked:
        assert got.get(i, {}) == searched(stops, times, x, y, start, start + duration, T.MAX_BOARDINGS)


def test_a_round_puts_walks_of_a_request_together(spark, city, capsys):
    stops, times, _ = city
    net = T.Network(stops, times)
    labels = T.reach(ask(spark), net)
    T._least_by_boardings(T._walked(labels, net, 4), [*T.REQ, "place_id"], T.READY, 4).explain()
    plan = capsys.readouterr().out
    # Only labels are dealt, by request; what is walked to isn't shuffled.
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(request_id" in plan


def test_next_departure_reads_each_key_once(spark, capsys):
    labels = spark.createDataFrame([(1, 5, 10.0), (2, 5, 21.0), (3, 6, 0.0), (4, 5, 99.0)], "label_id long, stop_id long, ready double")
    buses = spark.createDataFrame([(5, 0, 20, 1, 7), (5, 0, 21, 0, 8), (5, 1, 10, 0, 9), (6, 0, 3, 2, 7)],
                                  "stop_id long, mode int, time long, seq long, trip_id long")
    got = next_departure(labels, buses, ["mode"])
    got.explain()
    # A window to the end of the key is worked out anew for every row.
    assert "unboundedfollowing" not in capsys.readouterr().out
    assert rows(got.select("label_id", "mode", "time", "trip_id")) == [(1, 0, 20, 7), (1, 1, 10, 9), (2, 0, 21, 8), (3, 0, 3, 7)]


def test_a_batch_of_requests_is_read_once(spark, tmp_path):
    cols = "request_id long, ts timestamp, latitude double, longitude double, agencies array<string>, modes array<string>, " \
           "start_time int, max_search_time double, transfer_penalty_secs long"
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, at, 43.0 + i % 3, -79.0, ["A"], ["bus"], 0, 60.0, 0) for i in range(9)], cols).write.parquet(f"{tmp_path}/in")
    read = []

    def search(batch):
        read.append(batch.inputFiles())
        return batch.select("latitude")

    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    answer(stream, search, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("latitude")) == [(43.0,), (44.0,), (45.0,)]
    # Repeats are dropped once: the search reads a written table.
    assert read and all(files and not any(f"{tmp_path}" in f for f in files) for files in read)
