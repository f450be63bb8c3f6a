"""Headline timings. Prints one JSON line; settings come from BENCH_SF_DIR and BENCH_CPUS."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tidebar.plans import catalog, flows, views  # noqa: E402

SIGNAL = {"lookback": [3, 5], "buffer_atr": [0.0, 0.01, 0.02, 0.03, 0.04, 0.06], "vwap_filter": [0, 1], "volume_z": [None, 0.0, 1.0]}
EXECUTION = {"stop_atr": [0.1, 0.15, 0.2, 0.35, 0.55], "target_r": [0.0, 0.5, 1.0, 1.5, 2.5, 4.0], "hold": [2, 4, 6, 8, 12, 16, 24, 32]}
HEADLINE = ("ingest_bars_from_ticks", "ingest_complete_grid", "win_snapshots", "win_cusum", "detect_rolling_breakout",
            "detect_double_test", "outcome_barrier", "outcome_breakeven", "select_non_overlapping", "stat_results",
            "rule_edge_map", "search_walk_forward", "portfolio_leaderboards", "join_asof_prev", "flow_opening_breakout")


def timed(df) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tidebar-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             # settings multiply rows after a shuffle: small shuffle partitions stay worth a task
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
             .config("spark.driver.memory", "12g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    timed(catalog.QUERIES["ingest_bars_from_ticks"](spark, sf))  # start the JVM paths once
    times = {}
    for kind in ("hourly", "monthly", "quarter"):  # the prepared bars the other queries read
        t = time.time()
        views.bars(spark, sf, kind)
        times[f"prepare_{kind}"] = round(time.time() - t, 3)
    for name in HEADLINE:
        t = time.time()
        timed(catalog.QUERIES[name](spark, sf))
        times[name] = round(time.time() - t, 3)
    t = time.time()
    timed(flows.grid_search(spark, sf, "quarter", SIGNAL, EXECUTION, (8, 92), 12))
    times["grid_search"] = round(time.time() - t, 3)
    n = 1
    for axis in (*SIGNAL.values(), *EXECUTION.values()):
        n *= len(axis)
    bars = views.bars(spark, sf, "quarter").count()  # each setting walks over all of them
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")), "grid_configs": n, "grid_symbols": 5,
                      "configs_per_sec": round(n / times["grid_search"], 1), "grid_bars": bars, "config_bars_per_sec": round(n * bars / times["grid_search"]), "symbol_configs_per_sec": round(5 * n / times["grid_search"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
