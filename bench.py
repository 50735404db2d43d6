"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from barloom.plans.registry import QUERIES
from barloom.session import local_session

HEADLINE = (
    "ohlcv_bars ohlcv_bars_daily sma bollinger ichimoku rsi macd features equity_curve flagship trade_metrics barrier_curve "
    "portfolio_inverse_vol asof_macro panel_outer corr_pairs rolling_corr rolling_pagerank allocation walkforward_folds "
    "impute_median dominant_cycles rolling_period dwt_gate kernel_gate_cwt_morlet dmd_gate ar_residuals tensor_long "
    "csv_scan feed_items headline_dedupe lexicon_sentiment run_report gated_signals"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["ohlcv_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
