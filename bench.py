"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm the JVM and is then timed; results go to a sink that reads every row.
"""

import json
import os
import re
import time

import pyarrow.parquet as pq

from flowspark.catalog import all_queries
from flowspark.session import build_session

HEADLINE = [
    "label_encode", "enrich_flows", "quality_report", "sessions_tumbling", "sessions_overlap", "session_stats",
    "daily_stats", "five_minute_windows", "standard_scale", "stratified_split", "capped_sample", "confusion",
    "class_report", "threshold_sweep", "average_precision", "weighted_auc", "calibration", "fp_profile",
    "alert_upsert", "alert_stats", "kb_join", "vector_topk", "vector_nearest_class", "text_search", "event_weights",
    "stream_counters", "stream_sessions", "model_fn_events",
]


def run(spark, query, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    times = {}
    for name in names:
        query = queries[name][0]
        run(spark, query, sf_dir)
        times[name] = round(run(spark, query, sf_dir), 3)
    flows = pq.ParquetFile(f"{sf_dir}/events.parquet").metadata.num_rows
    rates = {
        n: round(flows / times[n]) for n in ("session_stats", "stream_counters", "stream_sessions", "model_fn_events")
        if n in times
    }
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else sf_dir, "flows": flows, "flows_per_second": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
