"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. Results go to Spark's no-op sink, so every row and
column is computed. Stage tables (packets to labelled features) are stored once,
under the ``stage_tables`` entry; queries that build on them read them back.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "clean_packets", "dedup_insert", "error_breakdown",
    "build_sessions", "assign_sessions", "extract_features", "iat_stats", "port_fanout",
    "apply_labels", "null_rates", "outlier_rates", "feature_statistics",
    "process_flows", "sample_per_file", "stratified_split", "scale_features",
    "rules_classifier", "classification_report", "auc_ovr",
    "alerts_from_predictions", "update_alert_status",
    "top_ips", "traffic_trends", "protocol_distribution", "list_packets", "live_metrics",
    "cascade_delete_sessions", "gap_sessions", "online_sessions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from packetlake.session import build_session
    from registry import catalog  # noqa: F401  (registers the operators)
    from registry.base import OPERATORS, tables

    spark = build_session(
        "packetlake-bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        began = time.perf_counter()
        action()
        return round(time.perf_counter() - began, 3)

    def run(name: str) -> None:
        OPERATORS[name](source).write.format("noop").mode("overwrite").save()

    source = tables(spark, folder)
    seconds = {"warm_up": timed(lambda: run("packet_count"))}
    seconds["stage_tables"] = timed(lambda: (
        source.raw_packets, source.flow_records, source.linked, source.features, source.labeled,
    ))
    for name in HEADLINES:
        run(name)  # first run compiles
        seconds[name] = timed(lambda: run(name))
    received = source.raw_packets.count()
    queries = {k: v for k, v in seconds.items() if k not in ("warm_up", "stage_tables")}
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "stage_tables_sec": seconds["stage_tables"],
        "ingest_packets_per_min": round(received / seconds["dedup_insert"] * 60),
    }))


if __name__ == "__main__":
    main()
