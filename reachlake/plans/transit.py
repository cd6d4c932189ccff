"""Earliest arrival by transit and walking for a batch of requests, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reachlake.operators.fixpoint import Deltas, relax, union_all
from reachlake.operators.grid import places_within
from reachlake.operators.skew import OrderedScan
from reachlake.session import hashed_table, written, written_in_buckets, written_with_count

# Speeds in m/s, penalties in seconds, radii in metres.
STREET_SPEED = 1.42
STRAIGHT_SPEED = 1.25
TRANSFER_SECONDS = 35.0
EXIT_SECONDS = 10.0
MAX_BOARDINGS = 4
STOP_RADIUS = 800.0
STREET_RADIUS = 100.0
STREET_SECONDS = 1440.0
SLOT_SECONDS = 3600
# A departure that follows its pattern's last one within so many slots is filed under all slots between.
NEAR_SLOTS = 2
# Up to so many walks are sent to every task, so that what a request walks to is put together where its labels are.
WALKS_SENT = 2_000_000

# What a label says about how its stop was reached. Its parent is the label of the same request at
# (parent_round, parent_stop); the label of round 0 is the request point and has no stop. A label's
# round also tells its boardings, as a stop can be improved for several numbers of them at once.
LABEL = ["t", "boardings", "trip_id", "board_stop", "board_seq", "board_time", "exit_seq", "walk_m",
         "parent_stop", "parent_round"]


ROUND_STEP = 1000  # above any number of boardings


def _least_by_boardings(df: DataFrame, keys: list[str], fields: list[str], most: int) -> DataFrame:
    """Rows of each key of which the first of ``fields`` is below that of all rows with fewer boardings.

    At most one row per number of boardings stays, the least by ``fields`` in order.
    """
    first = fields[0]
    wide = df.groupBy(*keys).agg(*[
        F.min(F.when(F.col("boardings") == b, F.struct(*fields))).alias(f"_b{b}") for b in range(most + 1)])
    kept = []
    for b in range(most + 1):
        here = F.col(f"_b{b}")
        fewer = F.array_min(F.array(F.lit(None).cast(wide.schema[f"_b{b}"].dataType[first].dataType), *[F.col(f"_b{k}")[first] for k in range(b)]))
        kept.append(F.when(fewer.isNull() | (here[first] < fewer), here))
    return wide.select(*keys, F.explode(F.array_compact(F.array(*kept))).alias("_a")).select(*keys, "_a.*")


class Network:
    """Stops, places, walks and departures prepared once and shared by every request batch.

    ``stops(stop_id, x, y)``, ``stop_times(trip_id, seq, stop_id, arrival[, departure])`` and
    ``trips(trip_id, ...)`` with optional ``block_id`` and the columns allow-lists refer to.
    """

    def __init__(self, stops: DataFrame, stop_times: DataFrame, trips: DataFrame | None = None):
        place = stops.groupBy("x", "y").agg(F.min("stop_id").alias("place_id"))
        self.stops = written(stops.join(place, ["x", "y"]).select("stop_id", "place_id", "x", "y"), "stops")
        self.places = self.stops.where("stop_id = place_id").select("place_id", "x", "y")
        st = stop_times.where(F.col("arrival").isNotNull())
        if "departure" not in st.columns:
            st = st.withColumn("departure", F.col("arrival"))
        st = st.select("trip_id", "seq", "stop_id", "arrival", "departure")
        info = ["trip_id"]
        if trips is not None:
            info = [c for c in ("trip_id", "block_id", "mode", "agency", "service_id") if c in trips.columns]
            st = st.join(trips.select(*info), "trip_id")
        self.has_block = "block_id" in info
        self.filters = [c for c in ("mode", "agency", "service_id") if c in info]
        spark = st.sparkSession
        buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.visits = written_in_buckets(st.join(self.stops.select("stop_id", "place_id"), "stop_id"), "visits-by-trip", ["trip_id"], buckets)
        classes = [c for c in (*self.filters, "block_id") if c in info]
        departures = following(with_next_arrival(self.visits), classes).where("then is not null")
        self.departures = written_in_buckets(filed_departures(departures), "departures-by-place", ["place_id", "near", "slot"], buckets)
        # The shortest ride from each place; a place without one is not walked to.
        rides = self.departures.groupBy("place_id").agg(F.min(F.col("then") - F.col("departure")).alias("least"))
        self.boarding = written(self.places.join(rides, "place_id"), "boarding-places")
        near = places_within(self.places, self.boarding, STOP_RADIUS)
        ends = near.join(self.places.withColumnRenamed("place_id", "from_place"), ["x", "y"]).join(
            self.boarding.select(F.col("place_id").alias("to_place"), F.col("x").alias("x2"), F.col("y").alias("y2"), "least"),
            ["x2", "y2"],
        )
        self.walks, self.n_walks = written_with_count(ends.select("from_place", "to_place", "dist", "least"), "walks")
        ahead = F.min(F.col("dist") / STRAIGHT_SPEED + TRANSFER_SECONDS + F.col("least")).alias("ahead")
        onward = self.walks.groupBy(F.col("from_place").alias("place_id")).agg(ahead)
        self.onward = written(self.stops.join(onward, "place_id").select("stop_id", F.col("place_id").alias("from_place"), "ahead"), "onward")
        self._catchments: list[tuple] = []

    def boardable(self) -> DataFrame:
        """Departures per place and hour slot, see :func:`filed_departures`."""
        cols = ["place_id", "near", "slot", "trip_id", "seq", "departure", "after", "then", *self.filters]
        return self.departures.select(*cols)

    def catchment(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Street catchment of all places, worked out once for these streets."""
        for n, e, known in self._catchments:
            if n is nodes and e is edges or (n.sameSemantics(nodes) and e.sameSemantics(edges)):
                return known
        found = written(street_catchment(self.places, nodes, edges), "catchment")
        self._catchments.append((nodes, edges, found))
        return found


def with_next_arrival(visits: DataFrame) -> DataFrame:
    """``visits`` with ``then``: the earliest arrival at a later stop of the trip, null where it ends.

    Who boards gains nothing when that is too late, so such boardings are left out from the start.
    """
    later = W.partitionBy("trip_id").orderBy(F.desc("seq")).rangeBetween(W.unboundedPreceding, -1)
    return visits.withColumn("then", F.min("arrival").over(later))


def following(visits: DataFrame, classes: list[str]) -> DataFrame:
    """``visits`` with ``after``: the departure before, at the same stop, of the same pattern.

    A pattern is a list of stops with sequence numbers and the columns that allow-lists and blocks
    refer to. Where each trip of a pattern departs and arrives later than the one before it at every
    stop, nobody who can board a trip gains by waiting for the next one: a departure is worth boarding
    only for those who are ready after the one before it. Patterns in which a trip is overtaken or
    caught up with have no ``after``, and all their trips are tried.
    """
    def patterns(visits):
        stops = F.sort_array(F.collect_list(F.struct("seq", "stop_id")))
        trips = visits.groupBy("trip_id", *classes).agg(stops.alias("stops"), F.min_by("departure", "seq").alias("start"))
        return trips.where(F.size("stops") > 1).select("trip_id", F.to_json(F.struct("stops", *classes)).alias("json"), "start")

    # Trips alike by a short hash are few where patterns are rarely shared; only they need the long one.
    short = written(patterns(visits).select("trip_id", F.xxhash64("json").alias("h")), "short-patterns")
    twice = short.groupBy("h").count().where("count > 1").select("h")
    alike = written(short.join(twice, "h", "left_semi").select("trip_id"), "alike")
    pattern = F.unhex(F.sha2("json", 256)).alias("pattern")
    trips = written(patterns(visits.join(alike, "trip_id", "left_semi")).select("trip_id", pattern, "start"), "patterns")
    shared = trips.groupBy("pattern").count().where("count > 1").select("pattern")
    times = visits.select("trip_id", "seq", "arrival", "departure")
    rows = written(times.join(trips.join(shared, "pattern"), "trip_id"), "shared-patterns")
    scan = OrderedScan(rows, ["pattern", "seq"], ["start", "trip_id"]).lag("last", F.struct("arrival", "departure"))
    rows = written(scan.frame(), "followed")
    late = (F.col("last.arrival") >= F.col("arrival")) | (F.col("last.departure") >= F.col("departure"))
    mixed = rows.where(late).select("pattern").distinct()
    after = rows.join(mixed, "pattern", "left_anti").select("trip_id", "seq", F.col("last.departure").alias("after"))
    return visits.join(after, ["trip_id", "seq"], "left")


def filed_departures(departures: DataFrame) -> DataFrame:
    """Departures by the slots in which they are looked up.

    Those with the departure before them at most ``NEAR_SLOTS`` slots away (``near``) are filed under
    each slot between the two and looked up in the slot of the ready time alone. All others are filed
    under their own slot and looked up in all slots up to the horizon.
    """
    slot, last = F.expr(f"departure div {SLOT_SECONDS}"), F.expr(f"after div {SLOT_SECONDS}")
    near = F.coalesce(slot - last <= NEAR_SLOTS, F.lit(False))
    return departures.withColumn("near", near).withColumn(
        "slot", F.explode(F.when(F.col("near"), F.sequence(last, slot)).otherwise(F.array(slot))))


# Constants of a request that travel with its rows, so that no round joins the requests again. The cost is
# a text there: rows dealt by a double among their keys would be dealt again by the next join on the same keys.
REQ = ["request_id", "until", "cost_s"]


def _walked(frontier: DataFrame, network: Network, most: int) -> DataFrame:
    """Times each request can board at each place after walking from improved labels.

    Labels without a boarding left don't count, and one with fewer boardings stays beside an earlier
    one with more.
    """
    here = frontier.where(F.col("boardings") < most).join(network.onward, "stop_id")
    # A label too late for any ride behind it; the times ahead are sums of doubles, hence the slack.
    here = here.where(F.col("t") <= F.col("until") - F.col("ahead") + 0.001)
    walks = network.walks
    if network.n_walks <= WALKS_SENT:
        here = here.repartition(int(here.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id")
        walks = F.broadcast(walks)
    # The least time at a place stands for all its stops.
    at = _least_by_boardings(here, [*REQ, "from_place"], ["t", "boardings", "stop_id", "round"], most)
    ready = F.col("t") + F.col("dist") / STRAIGHT_SPEED + TRANSFER_SECONDS
    return at.join(walks, "from_place").where(ready <= F.col("until") - F.col("least")).select(
        *REQ,
        F.col("to_place").alias("place_id"),
        ready.alias("ready"),
        "boardings",
        F.col("dist").alias("walk_m"),
        F.col("stop_id").alias("parent_stop"),
        F.col("round").alias("parent_round"),
    )


def _of_requests(history: DataFrame, rows: DataFrame) -> DataFrame:
    """What is known of the requests that still have ``rows``.

    Their ids are written first, so that a short list is known to be one and ``history`` isn't shuffled for it.
    """
    return history.join(written(rows.select("request_id").distinct(), "requests"), "request_id", "left_semi")


READY = ["ready", "boardings", "walk_m", "parent_stop", "parent_round"]


def _earlier_ready(walked: DataFrame, past: DataFrame | None, most: int) -> tuple[DataFrame, int]:
    """The earliest ready times per request, place and boardings that are earlier than in all rounds before.

    ``before`` is the earliest time of those rounds with no more boardings: whatever departs from then
    on has been boarded already, so only departures between the two are new.
    """
    keys = [*REQ, "place_id"]
    # ``before`` falls with more boardings, so whatever a time with fewer rules out isn't earlier than it either.
    fresh = _least_by_boardings(walked.where(F.col("ready") <= F.col("until")), keys, READY, most)
    if past is None:
        return written_with_count(fresh.withColumn("before", F.lit(None).cast("double")), "ready")
    known = past.groupBy(*keys).agg(*[
        F.min(F.when(F.col("boardings") <= b, F.col("ready"))).alias(f"_k{b}") for b in range(most)])
    before = F.coalesce(*[F.when(F.col("boardings") == b, F.col(f"_k{b}")) for b in range(most)])
    met = fresh.join(known, keys, "left").withColumn("before", before)
    better = met.where(F.col("before").isNull() | (F.col("ready") < F.col("before")))
    return written_with_count(better.select(*keys, *READY, "before"), "ready")


def _allowed(boards: DataFrame, network: Network, requests: DataFrame) -> DataFrame:
    """Mode, agency and service allow-lists carried by the request rows."""
    lists = [c for c in ("modes", "agencies", "services") if c in requests.columns]
    if not lists:
        return boards
    boards = boards.join(requests.select("request_id", *lists), "request_id")
    if "modes" in lists and "mode" in network.filters:
        boards = boards.where((F.size("modes") == 0) | F.array_contains("modes", F.col("mode")))
    if "agencies" in lists and "agency" in network.filters:
        boards = boards.where(F.array_contains("agencies", F.col("agency")))
    if "services" in lists and "service_id" in network.filters:
        boards = boards.where(F.array_contains("services", F.col("service_id")))
    return boards


def reach(
    requests: DataFrame,
    network: Network,
    max_boardings: int = MAX_BOARDINGS,
    transfer_cost: float = 0.0,
) -> DataFrame:
    """Labels per request and stop: transit with at most ``max_boardings`` boardings.

    ``requests(request_id, x, y, start, duration)`` plus optional ``modes`` (empty means all),
    ``agencies`` (empty means none), ``services`` (ids running on the request's day) and
    ``transfer_cost`` seconds per boarding used to compare labels. Every catchable trip is tried
    and each is boarded once, at its earliest catchable stop. Staying in the same block costs no
    boarding. Returns every label that is better than all at its stop with as many or fewer boardings,
    so none is lost for being slower but with boardings left; :func:`best_labels` reduces them to one
    per stop.
    """
    cost = F.col("transfer_cost") if "transfer_cost" in requests.columns else F.lit(transfer_cost)
    asked = requests.withColumns(
        {"until": F.col("start") + F.col("duration"), "cost_s": cost.cast("double").cast("string")}
    )
    from_point = places_within(requests, network.boarding, STOP_RADIUS)
    place_at = network.boarding.select("place_id", F.col("x").alias("x2"), F.col("y").alias("y2"), "least")
    at = F.col("start") + F.col("dist") / STRAIGHT_SPEED + TRANSFER_SECONDS
    first = (
        asked.select(*REQ, "x", "y", "start")
        .join(from_point, ["x", "y"])
        .join(place_at, ["x2", "y2"])
        .where(at <= F.col("until") - F.col("least"))
        .select(
            *REQ, "place_id",
            at.alias("ready"),
            F.lit(0).alias("boardings"), F.col("dist").alias("walk_m"),
            F.lit(None).cast("long").alias("parent_stop"), F.lit(0).alias("parent_round"),
        )
    )
    ready, n_ready = _earlier_ready(first, None, max_boardings)
    deltas: list[DataFrame] = []
    boarded: list[DataFrame] = []
    n_boarded = 0
    times = Deltas()
    frontier = None
    n = 1
    while n:
        times.add(ready, n_ready)
        boards, n_boards, blocks = _board(ready, frontier, network, asked, boarded, n_boarded, max_boardings)
        frontier, n = _improved(boards, ready, blocks, network, deltas, max_boardings)
        boarded.append(boards)
        n_boarded += n_boards
        if n or not deltas:
            deltas.append(frontier)
        if n:
            walked = _walked(frontier, network, max_boardings)
            ready, n_ready = _earlier_ready(walked, _of_requests(times.union(), frontier), max_boardings)
            if not n_ready and not network.has_block:
                break
    return union_all(deltas).withColumn("cost_s", F.col("cost_s").cast("double"))


BOARD = ["departure", "stop_id", "walk_m", "parent_stop", "parent_round"]


def _catchable() -> Column:
    """Conditions between a ready time and a departure."""
    worth = F.col("after").isNull() | (F.col("after") < F.col("ready"))
    new = F.col("before").isNull() | (F.col("departure") < F.col("before"))
    return (F.col("departure") >= F.col("ready")) & (F.col("then") <= F.col("until")) & (F.col("departure") <= F.col("until")) & worth & new


def _board(ready, frontier, network, requests, boarded, n_boarded, max_boardings):
    """Trips boarded by each request this round, where that beats an earlier boarding; their number; stays in a block.

    Boardings are numbers alone; how a trip was reached is looked up for the labels that come of them.
    """
    own = F.floor(F.col("ready") / SLOT_SECONDS).cast("long")
    end = F.least(F.col("until").cast("double"), F.coalesce("before", F.col("until").cast("double")))
    far = F.transform(F.sequence(own, F.floor(end / SLOT_SECONDS).cast("long")), lambda s: F.struct(F.lit(False).alias("near"), s.alias("slot")))
    lookups = F.concat(F.array(F.struct(F.lit(True).alias("near"), own.alias("slot"))), far)
    by_slot = ready.select("*", F.explode(lookups).alias("_l")).select("*", "_l.near", "_l.slot")
    caught = _allowed(by_slot.join(network.boardable(), ["place_id", "near", "slot"]).where(_catchable()), network, requests)
    cols = [*REQ, "trip_id", "seq", (F.col("boardings") + 1).alias("boardings")]
    tagged = caught.select(*cols)
    blocks = None
    if frontier is not None and network.has_block:
        same = _same_block(frontier, network, requests)  # costs no boarding
        blocks = written(same.select(*REQ, "trip_id", "seq", "boardings", *BOARD), "same-block")
        tagged = tagged.unionByName(blocks.select(tagged.columns))
    keys = [*REQ, "trip_id"]
    levels = range(max_boardings + 1)
    seen = Observation()
    caught = tagged.groupBy(*keys).agg(*[F.min(F.when(F.col("boardings") == b, F.col("seq"))).alias(f"_n{b}") for b in levels])
    partitions = int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    caught = hashed_table(caught.observe(seen, F.count(F.lit(1)).alias("n")), "caught", keys, partitions)
    if boarded:
        known = union_all(boarded).select(*keys, "boardings", "seq")
        if seen.get["n"] < n_boarded:
            known = known.join(caught.select(*keys), keys, "left_semi")
        wide = caught.join(known.groupBy(*keys).agg(*[
            F.min(F.when(F.col("boardings") == b, F.col("seq"))).alias(f"_o{b}") for b in levels]), keys, "left")
    else:
        wide = caught.select("*", *[F.lit(None).cast("long").alias(f"_o{b}") for b in levels])
    fresh = []
    for b in levels:
        # The earliest stop of the trip that is boarded with no more boardings, before or now with fewer.
        known = F.array_min(F.array(*[F.col(f"_o{k}") for k in range(b + 1)], *[F.col(f"_n{k}") for k in range(b)]))
        here = F.col(f"_n{b}")
        new = F.struct(here.alias("seq"), F.lit(b).alias("boardings"), known.alias("until_seq"))
        fresh.append(F.when(here.isNotNull() & (known.isNull() | (here < known)), new))
    won = wide.select(*keys, F.explode(F.array_compact(F.array(*fresh))).alias("_f")).select(*keys, "_f.*")
    boards, n = written_with_count(won, "boards")
    return boards, n, blocks


def _same_block(frontier, network, requests):
    """Continue on another trip of the block the label arrived with, at the stops it can walk to."""
    trips = network.visits.select("trip_id", "block_id").where(F.col("block_id").isNotNull()).distinct()
    walked = (
        frontier.join(trips, "trip_id")
        .withColumnRenamed("trip_id", "from_trip")
        .join(network.stops.select("stop_id", F.col("place_id").alias("from_place")), "stop_id")
        .join(network.walks, "from_place")
        .select(*REQ, "block_id", "from_trip", "boardings",
                (F.col("t") + F.col("dist") / STRAIGHT_SPEED + TRANSFER_SECONDS).alias("ready"),
                F.col("to_place").alias("place_id"), F.col("dist").alias("walk_m"),
                F.col("stop_id").alias("parent_stop"), F.col("round").alias("parent_round"))
    )
    stops = ["place_id", "block_id", "trip_id", "seq", "stop_id", "departure", *network.filters]
    same = walked.join(network.visits.select(*stops), ["place_id", "block_id"]).where(
        (F.col("departure") >= F.col("ready"))
        & (F.col("departure") <= F.col("until"))
        & (F.col("trip_id") != F.col("from_trip"))
    )
    return _allowed(same, network, requests)


def _ride(boards, network, round_no):
    """Later stops of each boarded trip, up to where an earlier boarding already rode."""
    visits = network.visits.select(
        "trip_id", F.col("seq").alias("exit_seq"), F.col("stop_id").alias("to_stop"), "arrival"
    )
    ridden = boards.join(visits, "trip_id").where(
        (F.col("exit_seq") > F.col("seq"))
        & (F.col("until_seq").isNull() | (F.col("exit_seq") <= F.col("until_seq")))
        & (F.col("arrival") <= F.col("until"))
    )
    return ridden.select(
        *REQ,
        F.col("to_stop").alias("stop_id"),
        F.col("arrival").cast("double").alias("t"),
        "boardings",
        "trip_id",
        F.col("seq").alias("board_seq"),
        "exit_seq",
        (F.lit(round_no * ROUND_STEP) + F.col("boardings")).alias("round"),
    )


def _score():
    return F.col("t") + F.col("boardings") * F.col("cost_s").cast("double")


RIDE = ["t", "boardings", "trip_id", "board_seq", "exit_seq", "round"]


def _told(rides, ready, blocks, network):
    """Labels of the rides that won, with how their trips were reached.

    The rides are written with their places first, so that few of them can be sent to where ``ready`` lies.
    """
    at = network.visits.select("trip_id", F.col("seq").alias("board_seq"), "place_id", "stop_id", "departure")
    how = ready.select(*REQ, "place_id", (F.col("boardings") + 1).alias("boardings"), "ready", *BOARD[2:])
    keys = [*REQ, "to_stop", *RIDE]
    rides = written(rides.withColumnRenamed("stop_id", "to_stop").join(at, ["trip_id", "board_seq"]), "rides")
    told = rides.join(how, [*REQ, "place_id", "boardings"]).where(F.col("departure") >= F.col("ready"))
    told = told.select(*keys, *BOARD)
    if blocks is not None:
        stays = blocks.withColumnRenamed("seq", "board_seq").select(*REQ, "trip_id", "board_seq", "boardings", *BOARD)
        told = told.unionByName(rides.select(*keys).join(stays, [*REQ, "trip_id", "board_seq", "boardings"]).select(told.columns))
    first = F.min(F.struct("stop_id", *[c for c in BOARD if c != "stop_id"])).alias("_b")
    named = {"stop_id": "to_stop", "board_stop": "_b.stop_id", "walk_m": "_b.walk_m", "parent_stop": "_b.parent_stop", "parent_round": "_b.parent_round"}
    told = told.groupBy(*keys).agg(first).withColumn("board_time", F.col("_b.departure").cast("double"))
    return told.select(*[F.col(named.get(c, c)).alias(c) for c in [*REQ, "stop_id", *LABEL, "round"]])


def _improved(boards, ready, blocks, network, deltas, most):
    """Labels with a score strictly below every other one at the stop with as many or fewer boardings."""
    rides = _ride(boards, network, len(deltas) + 1)
    keys = [*REQ, "stop_id"]
    if deltas:
        # Rides that are no better than a label known already go before anything is sorted.
        least = _of_requests(union_all(deltas), boards).groupBy(*keys).agg(*[
            F.min(F.when(F.col("boardings") <= b, _score())).alias(f"_k{b}") for b in range(most + 1)])
        known = F.coalesce(*[F.when(F.col("boardings") == b, F.col(f"_k{b}")) for b in range(most + 1)])
        rides = rides.join(least, keys, "left").where(known.isNull() | (_score() < known))
    tagged = rides.select(
        *keys, "boardings", F.struct(_score().alias("score"), *RIDE).alias("new"), F.lit(None).cast("double").alias("old")
    )
    new_type = tagged.schema["new"].dataType
    for d in deltas:
        tagged = tagged.unionByName(d.select(*keys, "boardings", F.lit(None).cast(new_type).alias("new"), _score().alias("old")))
    levels = range(most + 1)
    wide = tagged.groupBy(*keys).agg(*[
        c for b in levels for c in (F.min(F.when(F.col("boardings") == b, F.col("new"))).alias(f"_n{b}"),
                                    F.min(F.when(F.col("boardings") == b, F.col("old"))).alias(f"_o{b}"))])
    better = []
    for b in levels:
        known = F.array_min(F.array(*[F.col(f"_o{k}") for k in range(b + 1)], *[F.col(f"_n{k}")["score"] for k in range(b)]))
        here = F.col(f"_n{b}")
        better.append(F.when(known.isNull() | (here["score"] < known), here))
    out = wide.select(*keys, F.explode(F.array_compact(F.array(*better))).alias("new"))
    return written_with_count(_told(out.select(*keys, *[f"new.{c}" for c in RIDE]), ready, blocks, network), "labels")


def best_labels(labels: DataFrame, first: int | None = None) -> DataFrame:
    """Least-score label per request and stop; with ``first`` only so many columns of it."""
    rest = [*LABEL, "round"][:first]
    pick = F.min_by(F.struct(*rest), F.struct(_score(), *[F.col(c) for c in rest]))
    return labels.groupBy("request_id", "stop_id").agg(pick.alias("b")).select("request_id", "stop_id", "b.*")


def undirected(edges: DataFrame) -> DataFrame:
    back = {"src": F.col("dst"), "dst": F.col("src")}
    return edges.unionByName(edges.withColumns(back))


def street_catchment(points: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Walking seconds ``x, y, node_id, walk_s`` from each distinct ``points(x, y)`` to street nodes.

    Nodes within 100 m are reached straight, then streets are followed both ways; a node at or past
    1440 s is reached but not left. The result does not depend on times or requests, so one
    catchment serves every search over the same places.
    """
    near = places_within(points, nodes, STREET_RADIUS)
    at = nodes.select(F.col("node_id").alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    seeds = near.join(at, ["x2", "y2"]).select("x", "y", "id", (F.col("dist") / STRAIGHT_SPEED).alias("cost"))
    both = undirected(edges.select("src", "dst", "weight"))
    step = F.col("cost") + F.col("weight") / STREET_SPEED
    labels, _ = relax(seeds, both, ["x", "y"], step=step, expand=F.col("cost") < STREET_SECONDS)
    return labels.select("x", "y", F.col("id").alias("node_id"), F.col("cost").alias("walk_s"))


def node_times(labels: DataFrame, stops: DataFrame, catchment: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Earliest time per request and street node, with the stop and round it was walked from.

    ``catchment`` covers the places of the stops and, for walking straight from the request point,
    those of ``requests``.
    """
    best = best_labels(labels).join(stops.select("stop_id", "x", "y"), "stop_id")
    walked = best.join(catchment, ["x", "y"]).select(
        "request_id", "node_id", (F.col("t") + EXIT_SECONDS + F.col("walk_s")).alias("t"),
        "walk_s", "boardings", F.col("stop_id").alias("from_stop"), F.col("round").alias("from_round"),
    )
    if requests is not None:
        walked = walked.unionByName(
            requests.join(catchment, ["x", "y"]).select(
                "request_id", "node_id", (F.col("start") + EXIT_SECONDS + F.col("walk_s")).alias("t"), "walk_s",
                F.lit(0).alias("boardings"), F.lit(None).cast("long").alias("from_stop"),
                F.lit(0).alias("from_round"),
            )
        )
    rest = ["t", "boardings", "walk_s", "from_stop", "from_round"]
    return (
        walked.groupBy("request_id", "node_id").agg(F.min(F.struct(*rest)).alias("b")).select("request_id", "node_id", "b.*")
    )


def edge_times(times: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean of the two end times for each street with both ends reached."""
    a = times.select("request_id", F.col("node_id").alias("src"), F.col("t").alias("ta"))
    b = times.select("request_id", F.col("node_id").alias("dst"), F.col("t").alias("tb"))
    ends = edges.select("edge_id", "src", "dst")
    return ends.join(a, "src").join(b, ["dst", "request_id"]).select(
        "request_id", "edge_id", ((F.col("ta") + F.col("tb")) / 2).alias("t")
    )


def isochrone(requests: DataFrame, network: Network, nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Requests to street arrival times: transit search, walking, edge times."""
    labels = reach(requests, network, **options)
    return edge_times(search_times(labels, requests, network, nodes, edges), edges)


def search_times(labels: DataFrame, requests: DataFrame, network: Network, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node times of a finished search, one catchment for stops and request points together."""
    places = network.catchment(nodes, edges)
    others = requests.select("x", "y").distinct().join(network.places.select("x", "y"), ["x", "y"], "left_anti")
    catchment = places.unionByName(street_catchment(others, nodes, edges))
    return node_times(labels, network.stops, catchment, requests)


def with_start_times(requests: DataFrame, first: int, last: int, every: int) -> DataFrame:
    """Each request repeated at every start time; ``request_id`` keeps the origin in ``origin_id``."""
    count = (last - first) // every + 1
    step = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("step")
    return (
        requests.select("*", step)
        .withColumn("origin_id", F.col("request_id"))
        .withColumn("request_id", F.col("origin_id") * count + F.col("step"))
        .withColumn("start", (F.lit(first) + F.col("step") * every).cast("long"))
        .drop("step")
    )


def random_origins(spark, n: int, x_range, y_range, start: int, duration, seed: int = 1) -> DataFrame:
    """Load profile: ``n`` random origins, durations uniform in the given range."""
    return spark.range(n).select(
        F.col("id").alias("request_id"),
        (F.rand(seed) * (x_range[1] - x_range[0]) + x_range[0]).alias("x"),
        (F.rand(seed + 1) * (y_range[1] - y_range[0]) + y_range[0]).alias("y"),
        F.lit(start).cast("long").alias("start"),
        (F.rand(seed + 2) * (duration[1] - duration[0]) + duration[0]).cast("long").alias("duration"),
    )
