"""Every registered query against its check SQL.

By default one query in each family runs; BARSMITH_ALL=1 runs them all (as
does ``python tests/oracle.py 0.01``).
"""

import os

import pytest

import oracle
from barsmith.plans import load_all
from barsmith.plans.registry import HOME

SF_DIR = "/root/testdata/sf0.001"
QUICK = """pct_change foreign_participation price_action_label trade_levels next_business_day
join_full_outer_3way join_date_range prior_range_max group_win_rate symbol_profile pct_rank_avg
rank_global offset_frame_avg tail_n_per_symbol set_membership upsert upsert_keep_columns
replace_dates update_from with_file_date rsi_sql rsi_weekly macd_ewm bollinger atr chaikin_mf
support_strength fibonacci_levels wave_signal performance_weekly market_kpis market_highlights
signal_dashboard technical_recommendation signal_history buy_score bandar_score advanced_bandar
rebound_score market_bias fib_status accumulation_score institutional_flow smart_money
accumulation_maturity early_breakout relaxed_momentum validate_breakouts retest_opportunities
lifecycle backtest evaluate_rsi_grid evaluate_macd_grid best_parameters forecast_accuracy
win_features sequence_features lexicon_sentiment_bilingual article_extract parse_published_at
sentiment_price combined_sentiment check_unique daily_bars_batch signals_from_kafka""".split()

ENTRIES = load_all()
NAMES = sorted(ENTRIES) if os.environ.get("BARSMITH_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = oracle.compare(spark, con, ENTRIES[name], SF_DIR)
    assert ok, note


def test_registry_is_complete():
    assert len(ENTRIES) >= 230
    assert {HOME[n].rsplit(".", 1)[-1] for n in ENTRIES} >= {"storage", "streams", "quality"}
    unchecked = {n for n, e in ENTRIES.items() if e.sql is None}
    assert unchecked == {"train_win_classifier"}


def test_entry_point(spark):
    import __spark_entry__ as entry_point

    df = entry_point.entry(spark)
    assert df.columns[:2] == ["symbol", "date"] and df.count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
