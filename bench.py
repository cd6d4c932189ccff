"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from reachlake.catalog import all_queries
from reachlake.session import local_session

HEADLINE = [
    "reach_by_transit", "reach_from_customers", "isochrone", "next_departure", "departure_board", "split_by_agency",
    "service_days", "stops_on_shapes", "stop_pairs_within_800m", "five_nearest_street_nodes", "connected_components",
    "shortest_paths", "topological_levels", "transitive_reduction", "spanning_forest_of_streets", "profile_runs",
    "rated_edges",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    found, _ = all_queries()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times = {}
    for name in names:
        t = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()
