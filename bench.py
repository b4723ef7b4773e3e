"""Run the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated, default the headline set), BENCH_RUNS (default 1: timed runs after one
warm-up of the session).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txnrecon.plans import catalog, session  # noqa: E402

HEADLINE = (
    "fx_asof_convert amount_gate status_class validate_gates usd_ceiling account_route dedup_key dedup_first_wins "
    "unwrap_sender source_dispatch receipt_parse wire_parse model_json_normalise message_disposition alias_canonical "
    "merchant_similarity recon_candidates recon_outcomes recon_unmatched double_book_probe amount_correction "
    "ledger_payload statement_fold row_grouping balance_check statement_report accuracy_matrix outcome_rate_5m "
    "review_1h last_value_3h sustained_alert run_summary html_text noise_trim"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = session.local("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    chosen = names.split(",") if names else [n for n in HEADLINE if n in catalog.QUERIES]
    timed: dict[str, float] = {}
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    for name in chosen:
        spent = []
        for _ in range(runs):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - began)
        timed[name] = round(statistics.median(spent), 3)
        print(f"{name} {timed[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
