"""Edge rules on hand-made bars."""

import math
import random

import pytest
from helpers import closes
from pyspark.sql import functions as F

from barsmith.functions import lexicon
from barsmith.functions import scalar as S
from barsmith.functions.lexicon import parse_published
from barsmith.operators import accumulation as A
from barsmith.operators import backtest as B
from barsmith.operators import breakout as L
from barsmith.operators import indicators as I
from barsmith.operators import market as M
from barsmith.operators import relational as R
from barsmith.operators import sentiment as N
from barsmith.operators import signals as G
from barsmith.operators.quality import require_columns
from barsmith.params import DAILY


def test_flat_series_has_rsi_100_or_0(make_bars):
    flat = make_bars(closes([100] * 20))
    assert {r.rsi for r in I.rsi_sql(flat).collect()} == {100.0}
    assert {r.rsi for r in I.rsi(flat).collect()} == {0.0}


@pytest.mark.parametrize("n,rows", [(13, 0), (14, 0), (15, 1), (16, 2)])
def test_full_window_needs_period_plus_one(make_bars, n, rows):
    b = make_bars(closes([100 + (i % 3) for i in range(n)]))
    assert I.rsi(b).count() == rows
    assert I.rsi_sql(b).count() == n - 1


def test_rsi_labels_strict_and_inclusive(make_bars):
    # 7 up and 3 down moves of the same size: RSI is exactly 70.
    steps = [1, 1, 1, -1, 1, 1, -1, 1, -1, 1]
    values = [100]
    for s in steps:
        values.append(values[-1] + s)
    b = make_bars(closes(values))
    strict = I.with_rsi(b, 10).orderBy(F.desc("date")).first()
    full = I.with_rsi_full(b, 10).orderBy(F.desc("date")).first()
    assert strict.rsi == pytest.approx(70) and full.rsi == pytest.approx(70)
    assert full.rsi_signal == ("Overbought" if full.rsi >= 70 else "Neutral")
    assert strict.rsi_signal == ("Overbought" if strict.rsi > 70 else "Neutral")


def test_rsi_stays_in_range(make_bars):
    b = make_bars(closes([100 + 10 * math.sin(i) for i in range(60)]))
    got = [r.rsi for r in I.rsi_sql(b).collect()]
    assert all(0 <= x <= 100 for x in got)


def test_percent_b_is_half_at_the_middle(make_bars):
    b = make_bars(closes([90, 110] * 10 + [100]))
    last = I.with_bollinger(b).orderBy(F.desc("date")).first()
    assert last.percent_b == pytest.approx((last.close - last.lower_band)
                                           / (last.upper_band - last.lower_band))
    flat = I.bollinger(make_bars(closes([100] * 25)))
    assert flat.count() == 0
    boot = I.bollinger_bootstrap(make_bars(closes([100] * 5))).collect()
    assert {r.percent_b for r in boot} == {0.5}


def test_no_range_means_no_flow(make_bars):
    b = make_bars(closes([100, 101, 102]))
    assert {r.ad_line for r in I.ad_line_plain(b).collect()} == {0.0}
    assert all(abs(r.money_flow_volume) < 1e-6 for r in I.ad_line(b).collect())


def test_percent_change_variants(spark):
    df = spark.createDataFrame([(110.0, None), (110.0, 0.0), (110.0, 100.0)],
                               "cur double, prev double")
    rows = df.select(S.pct_change_or_zero("cur", "prev"), S.pct_change("cur", "prev"),
                     S.return_fraction("cur", "prev")).collect()
    assert [tuple(r) for r in rows] == [(0.0, None, 0.0), (0.0, None, 0.0), (10.0, 10.0, 0.1)]


def test_gap_in_dates_drops_the_exit(make_bars, spark):
    b = make_bars([{"date": d, "close": 100 + d} for d in (0, 1, 2, 5, 6)])
    sig = b.select("symbol", "date", F.lit(6).alias("buy_score"),
                   F.lit(0.8).alias("winning_probability"))
    out = B.backtest(sig, b, DAILY, "2000-01-20")
    assert sorted(r.signal_date.day for r in out.collect()) == [1, 2]
    nearest = B.backtest(sig, b, DAILY, "2000-01-20", next_bar=True)
    assert nearest.count() == 2
    assert B.backtest(sig, b, DAILY, "2000-01-02").count() == 0


def test_recalibration_touches_recent_rows_only(make_bars, spark):
    b = make_bars([{"date": d, "close": 100 + d * 3} for d in range(20)])
    sig = b.select("symbol", "date", F.lit(6).alias("buy_score"),
                   F.lit(0.8).alias("winning_probability"))
    res = B.backtest(sig, b, DAILY, "2000-01-20")
    out = B.recalibrate_probability(sig, res, "2000-01-20", days=7).orderBy("date").collect()
    assert out[0].winning_probability == 0.8 and out[-1].winning_probability == 1.0


def test_short_history_gets_no_score(make_bars):
    assert G.buy_score(make_bars(closes([100] * 19)), None, None, None, min_score=0).count() == 0
    assert G.buy_score(make_bars(closes([100] * 20)), None, None, None, min_score=0).count() == 1


def test_buy_score_weights_and_observed_rates(make_bars, spark):
    b = make_bars(closes([100 + i % 2 for i in range(30)]))
    rates = spark.createDataFrame([(2, 40.0), (3, 60.0)], "buy_score int, win_rate double")
    row = G.buy_score(b, None, None, None, rates, as_of="2000-01-30").first()
    assert row is None or row.winning_probability in (0.4, 0.6, 0.65)
    base = G.buy_score(b, None, None, None, min_score=0).first()
    heavy = G.buy_score(b, None, None, None, weights={"demand_zone": 10.0}, min_score=0).first()
    assert heavy.buy_score > base.buy_score
    assert base.indicators_triggered == ["Near Support"]


def test_scores_stay_within_caps(make_bars):
    b = make_bars([{"date": i, "close": 100 + i % 7, "prev_close": 100, "volume": 100 + 90 * (i % 5),
                    "foreign_buy": 50 * (i % 3), "foreign_sell": 20, "bid_volume": 9 * i,
                    "offer_volume": 40, "high": 110, "low": 95} for i in range(40)])
    for r in G.with_advanced_bandar(b).collect():
        assert all(0 <= r[c] <= 100 for c in (*G.COMPOSITE_WEIGHTS, "composite_bandar_score"))
    for r in A.accumulation_score(b, splits=[]).collect():
        assert 0 <= r.accumulation_score <= 100


def test_legacy_integer_division(make_bars):
    b = make_bars([{"close": 10, "prev_close": 10, "bid_volume": 19, "offer_volume": 10}])
    assert G.with_advanced_bandar(b).first().bid_ask_strength == pytest.approx(36.0)
    assert G.with_advanced_bandar(b, legacy_int_div=True).first().bid_ask_strength == 0.0


def test_ties_fall_back_to_symbol(make_bars):
    b = make_bars([{"symbol": s, "close": 110, "prev_close": 100} for s in "DBCA"])
    assert [r.symbol for r in M.top_movers(b, 2).collect()] == ["A", "B"]


def test_optional_join_adds_typed_nulls(make_bars):
    out = R.optional_join(make_bars(closes([1.0])), None, columns={"rsi": "double"})
    assert dict(out.dtypes)["rsi"] == "double" and out.first().rsi is None


def test_require_columns_names_what_is_missing(make_bars):
    with pytest.raises(ValueError, match="nope"):
        require_columns(make_bars(closes([1.0])), ["close", "nope"])


def test_one_sided_ticker(spark):
    def feed(tickers):
        return spark.createDataFrame([(t, "2000-01-01", 2, 0.5, 1, 0, 1) for t in tickers],
                                     "ticker string, date string, news_count long, avg_sentiment "
                                     "double, positive_count long, negative_count long, "
                                     "neutral_count long").withColumn(
            "date", F.col("date").cast("date"))

    a, b = feed(["X", "Y"]), feed(["Y"])
    assert [r.symbol for r in N.combined_sentiment(a, b).collect()] == ["Y"]
    kept = N.sentiment_history(a, b, "X", "2000-01-05").collect()
    assert len(kept) == 1 and kept[0].second_sentiment is None


def test_lexicon_counts_listed_twice(spark):
    df = spark.createDataFrame([("Laba NAIK, rekor!",), ("rugi besar",), (None,), ("",)],
                               "content string")
    rows = N.lexicon_sentiment(df).collect()
    assert (rows[0].positive_count, rows[0].sentiment, rows[0].sentiment_score) == (4, "Positive", 1)
    assert (rows[1].negative_count, rows[1].sentiment_score) == (2, -1.0)
    assert [r.sentiment for r in rows[2:]] == ["Neutral", "Neutral"]


def test_published_forms(spark):
    texts = ["Senin, 5 Mei 2025 14:30 WIB", "5 Agustus 2025 09:01", "17 Desember 2024",
             "2025-01-02T03:04:05Z", "yesterday"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) for r in df.select(parse_published("t")).collect()]
    assert got == ["2025-05-05 14:30:00", "2025-08-05 09:01:00", "2024-12-17 00:00:00",
                   "2025-01-02 03:04:05", "None"]


def test_breakout_seen_once(make_bars):
    rows = closes([100] * 22) + [{"date": 22, "close": 110, "volume": 1000}]
    b = make_bars(rows)
    found = L.detect_breakouts(b, None, None, None, None)
    assert [r.breakout_price for r in found.collect()] == [110.0]
    assert L.detect_breakouts(b, found, None, None, None).count() == 0
    # A ten-day look-back sees only its own rows, and still clears their highs.
    assert L.detect_breakouts(b).count() == 1


def test_business_days(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2025-01-02', DATE '2025-01-06')) AS d")
    got = [r[0].isoformat() for r in df.select(S.next_business_day("d")).collect()]
    assert got == ["2025-01-03", "2025-01-06", "2025-01-06", "2025-01-06", "2025-01-07"]


def test_one_pass_finds_every_entry_of_the_lists(spark):
    """Entries inside, across and at the start of others, regex signs, one and no characters."""
    lists = [lexicon.BILINGUAL_POSITIVE, lexicon.BILINGUAL_NEGATIVE, ["a.b", "a", "ab", "b(", "ab", ""], [], [""],
             ["rugi", "merugi", "rugi besar", "gi be"]]
    rng = random.Random(5)
    parts = [e for entries in lists for e in entries] + [" ", "x", "\n", "ñ", "🧪"]
    texts = ["".join(rng.choice(parts)[rng.randrange(2):] for _ in range(rng.randrange(25)))
             for _ in range(400)] + ["", "rugi besar " * 20_000 + "naik"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for k in range(0, len(lists), 2):
        found = lexicon.entries_found(F.col("text"), lists[k] + lists[k + 1])
        got = df.select("id", lexicon.hits(found, lists[k]).alias("p"),
                        lexicon.hits(found, lists[k + 1]).alias("n")).collect()
        assert [(r.p, r.n) for r in sorted(got)] == [
            tuple(sum(e in t for e in entries) for entries in lists[k:k + 2]) for t in texts]
