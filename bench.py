"""Times the headline queries once each, after a warm-up, and prints one JSON line.

The tables that queries share are built first, each timed as a row of its own.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is run to its last
row into Spark's no-op sink; the time includes building the plan.
"""

from __future__ import annotations

import json
import os
import time

from logtable.plans.queries import admin_logs, raw_logs, registered, stored_events, wide_words
from logtable.session import local_session

HEADLINE = (
    "list_events",
    "classify_logs",
    "decode_price_requested",
    "decode_price_fulfilled",
    "decode_asset_registered",
    "decode_admin_events",
    "uint256_decode",
    "int256_decode",
    "dedup_first",
    "resolve_asset_static",
    "resolve_asset_asof",
    "insert_if_absent",
    "event_table_scan",
    "payload_json",
    "list_deep_page",
    "cursor_page",
    "page_meta",
    "replay_history",
    "request_status",
    "request_fulfil_join",
    "fan_out",
    "deliveries",
    "events_seen",
    "current_assets",
    "current_admin_state",
    "latest_price",
    "median_price",
    "heartbeat_due",
    "list_submissions",
    "streaming_ingest",
    "streaming_dedup",
    "replay_then_live",
    "streaming_request_status",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    spark = local_session("bench", cores, **{"spark.driver.memory": "16g"})
    queries = registered()

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    def built(table) -> float:
        started = time.perf_counter()
        table(spark, folder)
        return round(time.perf_counter() - started, 3)

    run("asset_violations")
    seconds = {f"build_{t.__name__}": built(t) for t in (raw_logs, admin_logs, wide_words, stored_events)}
    seconds |= {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
