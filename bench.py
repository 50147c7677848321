"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rankweave import catalogue
from rankweave.session import session

HEADLINE = (
    "rank_metrics_by_dataset", "rank_metrics_weighted", "risk_coverage_curve", "spearman_by_dataset", "budget_curves", "subgroup_cube", "coverage_accounting", "group_regression_bootstrap", "case_ranking_intervals",
    "query_expansion_ids", "family_partition", "completeness_39", "latest_wins", "near_dup_pairs", "crop_boxes_13", "claims_summary", "zero_claim_left_join",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(sorted(runs)[1], 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
