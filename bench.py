"""Time the headline queries: one warm-up, then the median of the repeats, results consumed.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8), BENCH_REPEATS (3).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from barsmith.plans import load_all
from barsmith.plans.inputs import bars, derive_bars
from barsmith.session import get_spark

HEADLINE = [
    "rsi_sql", "macd_sma", "bollinger", "macd_ewm", "moving_averages", "wave_signal",
    "performance_weekly", "market_kpis", "top_movers", "signal_dashboard", "signal_history",
    "bandar_score", "advanced_bandar_scores", "accumulation_score", "institutional_flow",
    "rebound_score", "lifecycle", "validate_breakouts", "backtest", "evaluate_rsi_grid",
    "evaluate_macd_grid", "lexicon_sentiment_bilingual", "ticker_sentiment", "sentiment_price",
    "article_extract", "upsert", "pct_rank_avg", "check_unique", "daily_bars_batch",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = get_spark("bench", cpus, int(cpus))
    entries = load_all()
    seconds: dict[str, float] = {}
    exchanges: dict[str, int] = {}

    def measure(name, make) -> None:
        consume(make())
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            df = make()
            consume(df)
            runs.append(time.perf_counter() - t0)
        seconds[name] = round(statistics.median(runs), 3)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges[name] = len(re.findall(r"\bExchange\b", plan))

    measure("bars_from_ticks", lambda: derive_bars(spark, sf_dir))
    t0 = time.perf_counter()
    n_bars = bars(spark, sf_dir).count()
    stored = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        measure(name, lambda name=name: entries[name].plan(spark, sf_dir))
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "bars": n_bars,
        "store_bars_sec": stored, "exchanges": exchanges, "repeats": repeats,
        "cpus": int(cpus)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
