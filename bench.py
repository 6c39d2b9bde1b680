"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Each query is built, planned and run to a sink that discards its rows, so the
time holds the whole job from the raw tables on.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tickloom.plans import REGISTRY
from tickloom.session import local_session

#: What a user waits for: score a signal, all signals, overlap, composite,
#: screen, profile, quality, universes, sweep of books, ledger, risk rules.
HEADLINE = [
    "r1_reversal_ic",
    "r6_cost_verdict",
    "r7_all_factors",
    "r8_factor_overlap",
    "r11_composite",
    "a2_universe_schedule",
    "a4_cheap_pass",
    "pf15_security_profile",
    "q1_quality_findings",
    "po9_evaluation",
    "l2_positions",
    "rk4_verdicts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    wanted = sys.argv[1:] or HEADLINE
    # the JVM and the Python workers start once, outside the clock
    REGISTRY["p9_bar_count"].run(spark, folder).collect()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
