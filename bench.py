"""Headline timings as one JSON line: ``BENCH_SF_DIR``, ``BENCH_CPUS``.

Stored tables of the run are prepared first and timed as ``prepare``; every stage after it is
timed from stored inputs to a fully computed result, results of earlier stages being stored.
The same queries first run once on the smallest data set, so that the figures show work on
data and not the JVM compiling its first plans; that time is reported as ``warm_up`` and is
not part of the total.
"""

from __future__ import annotations

import json
import os
import time

import registry
from paisaflow.session import local_session

HEADLINE = (
    "all_matches", "fuzzy_candidates", "exception_pairs", "exceptions_by_reason_side",
    "ground_truth", "reconciliation_score", "tax_rules", "tax_summary", "settlement_records",
    "record_text", "audit_report", "search_settlements", "review_queue", "csv_ledger_parse",
    "gateway_normalize", "json_repair", "daily_gmv", "gmv_features", "naive_gmv_mae",
    "cash_position", "date_spine_cashflow", "stage_status", "cosine_topk",
    "model_days_to_settle", "model_deduction", "learning_curve",
)

WARM_UP_DIR = "/root/testdata/sf0.001"


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    def warm_up() -> None:
        small = registry.workspace(spark, WARM_UP_DIR)
        for name in HEADLINE:
            consume(registry.QUERIES[name](small))

    if os.path.isdir(WARM_UP_DIR) and WARM_UP_DIR != sf_dir:
        timed("warm_up", warm_up)
    warm = seconds.pop("warm_up", 0.0)
    space = registry.workspace(spark, sf_dir)
    timed("prepare", lambda: (space.base, space.ledger, space.bank))
    # the tiers first, each with its stored result
    timed("tier1", lambda: space.tier1)
    timed("tier2", lambda: (space.hot_keys, space.tier2))
    timed("tier3", lambda: (space.items, space.exceptions))
    for name in HEADLINE:
        timed(name, lambda: consume(registry.QUERIES[name](space)))
    print(json.dumps({
        "metric": "settlement_headline_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "warm_up": warm, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
