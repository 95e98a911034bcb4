"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import sys
import tempfile
import time

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sheetwise import queries  # noqa: E402

HEADLINE = (
    "op_fused_criteria", "fn_sumifs", "fn_countifs", "fn_sumproduct", "fn_sum_whole", "fn_stdev", "fn_correl", "fn_subtotal", "op_rollup", "fn_vlookup", "fn_xlookup_last",
    "fn_lookup", "fn_rank", "fn_large", "op_scan_running", "fn_unique", "fn_networkdays", "fn_pmt", "fn_text_date", "op_fuzzy_equal",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(3):  # the first run also compiles
            began = time.time()
            queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(time.time() - began, best or 1e9)
        seconds[name] = round(best, 4)
    print(json.dumps({"metric": "formula_queries_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
