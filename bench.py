"""Headline queries, one JSON line.

    BENCH_SF_DIR  folder with the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local threads            (default 8)
    BENCH_QUERIES comma-separated names    (default the list below)
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from catalog import QUERIES  # noqa: E402
from sparkprep.session import build_session  # noqa: E402

HEADLINE = [
    "filter_numeric_ops", "filter_text_search", "filter_documents", "filter_text_content",
    "infer_and_enforce_types", "lost_cells", "range_drop", "range_drop_counts",
    "missing_by_column", "fill_mean", "fill_median", "fill_mode", "fill_forward", "fill_backward",
    "dedupe_exact", "dedupe_normalized", "dedupe_documents", "outliers_iqr", "outliers_iqr_with_gaps",
    "outlier_shares", "validate_errors", "quality", "profile_numbers", "profile_frequent",
    "profile_histogram", "profile_correlation", "csv_scan", "json_scan", "embed_documents",
    "vectorize_numeric", "stream_split", "clean_events", "clean_orders",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
