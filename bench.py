"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fieldledger.plans.queries import QUERIES
from fieldledger.session import local_session

HEADLINE = (
    "forms_filter_none",
    "forms_filter_all",
    "forms_list_ids",
    "form_get_batch",
    "form_field_put",
    "schedule_get_batch",
    "blob_get_batch",
    "blob_roundtrip",
    "form_documents_decode",
    "forms_to_json",
    "validate_forms",
    "validate_violations",
    "mutations_accept",
    "current_state",
    "version_history",
    "template_generations",
    "form_mutations",
    "forms_current",
    "forms_submit",
    "mixed_outcomes",
    "mixed_change_log",
    "sync_after",
    "sync_consumers",
    "change_feed_stream",
    "ledger_forms",
    "ledger_change_log",
    "artifact_age",
    "artifact_location",
    "store_forms",
    "store_schedules",
    "store_log",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["forms_list_ids"](spark, sf_dir).count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        result = QUERIES[name](spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec"}
    print(json.dumps({**line, "queries": seconds, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
