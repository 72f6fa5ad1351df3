"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores and
BENCH_QUERIES an optional list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hunkwise.plans.queries import QUERIES  # noqa: E402
from hunkwise.session import local_session  # noqa: E402

HEADLINE = (
    "parse_diff number_lines run_rules run_rules_diffs scan_secrets redact_typed confidence_gate dedupe_findings "
    "rank_findings attach_findings severity_rollup file_badges report_payload match_labels eval_total acceptance_rate "
    "rate_limit usage_ledger empty_rate_monitor turn_budget chunk_blocks upsert_chunks tfidf_top_terms top_k_similar "
    "text_search retrieve_context dependents stream_rules stream_rate_limit"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus)
    QUERIES["outcome_counts"](spark, folder).count()  # start the workers
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
