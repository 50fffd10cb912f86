"""Headline queries, one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores. Every query runs in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "FLAGSHIP_fold_accuracy", "RG2_resample", "RG5_fill_interpolate", "CN4_running_high_increment", "CN8_increment_actuals", "LS4_carry_deficit",
    "JN2_asof_tolerance", "WF1_lags", "WF2_rolling", "AG1_lead_curve", "AG6_daily_cum_accuracy", "AG9_conformal_quantiles", "AG10_coverage_by",
    "AG12_stability", "AG18_head_to_head", "AG23_skill_common_band", "MT11_compute_all", "BM3_composite_rank", "FC5_daily_profile",
    "JN4_asof_trajectory", "HZ2_residual_quantiles", "ST4_counter_state", "CN6_accepted_level",
]


def main() -> None:
    from tidegrid.plans.catalog import QUERIES
    from tidegrid.session import get_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    QUERIES["RG1_time_bin"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
