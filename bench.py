"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from larkspur.queries import QUERIES

HEADLINE = ("find_gt", "find_eq_nested", "find_regex", "nested_array_gt", "nested_array_gt_variant", "elem_match_object", "contains_array", "exists_true", "sort_text_desc_limit", "count_filtered", "update_set_deep_merge")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(sorted(runs)[1], 3)
    print(json.dumps({"metric": "headline queries, sum of medians of 3", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": d}))


if __name__ == "__main__":
    main()
