"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from tremor.plans import catalogue
from tremor.session import session

HEADLINE = ["scan_time_mag", "missed_events_topk", "circle_query", "nearest_boundary", "dedupe_antijoin", "match_mechanisms", "merge_latest", "downsample_series", "threshold_episodes", "gk_decluster", "aftershock_bins", "recurrence_summary", "antipodal_window", "lag_window_ratio", "ks_d_plus", "h4c_tests", "h1b_tests", "h4c_with_null"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
