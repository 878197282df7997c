"""Headline queries over ``$BENCH_SF_DIR``; prints one JSON line.

Every query is computed in full into a sink that keeps nothing. ``rows_per_sec``
relates the matching and text queries to the rows they return.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fitgrid.plans.catalog import all_queries  # noqa: E402
from fitgrid.session import local_session  # noqa: E402

HEADLINES = [
    # Matching for all users at once.
    "axis_comparison", "axis_range_comparison", "version_compatibility", "salary_constraint",
    "location_constraint", "remote_constraint", "hard_constraints", "axis_status_counts", "match_summary",
    # Pages and latest-per-key reads of every user.
    "analysis_history_page", "analysis_history_filtered", "saved_jobs_page", "unmatched_evaluations",
    "latest_match_per_job", "latest_evaluation", "latest_completed_profile",
    # Analytics.
    "daily_active_users", "analysis_usage_daily", "consent_rate", "unknown_rate_daily",
    "evaluator_usage_daily", "company_interest_daily", "cohort_axis_distribution", "abuse_overview",
    "abuse_user_summary", "latency_quantiles", "histogram_quantile",
    # Text and decisions.
    "redact_text", "content_duplicates", "salary_facts", "fact_reduction", "rule_axis_decisions",
    "axis_judgement", "rank_candidates", "canonical_urls",
    # Event order.
    "request_allowance", "new_analysis_quota", "daily_budget", "idempotent_append",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, partitions=cores)
    queries = all_queries()

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("match_summary")  # the first query pays for starting workers and compiling
    seconds = {name: run(name) for name in HEADLINES}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(directory).name,
    }))


if __name__ == "__main__":
    main()
