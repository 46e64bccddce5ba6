"""Run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

import json
import os
import time

from spanweave import catalog
from spanweave.session import local_session, ship

HEADLINE = ["sweep_query_k1", "sweep_target_k2", "sweep_both", "sweep_intersect", "reciprocal_best", "many_to_many", "best_buddy_chains", "gap_chain_1d", "rescue_distance", "diagonal_inversions", "identity_matrix", "ani_all", "ani_n50", "alnstats_totals", "pair_coverage", "tree_filter", "union_distinct", "full_scaffold_pipeline"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = ship(local_session(os.environ.get("BENCH_CPUS", "8"), name="bench"))
    spark.sparkContext.setLogLevel("ERROR")
    least = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.001")
    for name in ("sweep_query_k1", "gap_chain_1d"):  # start workers and compile what all queries share, on the smallest tables
        catalog.QUERIES[name](spark, least if os.path.isdir(least) else sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
