"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidepanel.plans import ALL_QUERIES  # noqa: E402
from tidepanel.session import local_session  # noqa: E402

HEADLINE = [
    "month_calendar", "tcode_transform_fleet", "tcode_inverse", "model_ready", "interp_first3", "gap_report", "acf12", "pacf12",
    "ar1_forecast", "accuracy", "metrics_table", "chart_axis", "growth_rates", "ar_fleet", "ma_fleet", "arima_grid", "fleet_backtest",
    "gram_matrix", "pca_var_forecast", "rolling_h1", "rolling_h12", "rolling_windows", "svd_factor", "predictive_percentiles",
    "predictive_draws", "rolling_bayes", "fill_trailing", "dfm_em", "gibbs_draws", "bayes_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    ALL_QUERIES["accuracy"](spark, sf_dir).collect()  # start the JVM and the Python workers
    ALL_QUERIES["predictive_draws"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        ALL_QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
