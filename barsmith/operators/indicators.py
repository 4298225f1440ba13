"""Technical indicators: one row per bar in, indicator columns out.

Each ``with_*`` function adds columns to the frame it gets, so composites
stack them over a single (symbol, date) exchange; the functions named after
an indicator project its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.frames import (by_symbol, whole_symbol, avg_n, full, lag, last_n, lead,
                                       running, since, tail)
from barsmith.functions.scalar import (clamp, first_match, foreign_in_lots, large_block,
                                       ratio)
from barsmith.operators.ewm import with_macd
from barsmith.params import DAILY, FIBONACCI, Timeframe

EPS = 1e-9


# --- relative strength index -------------------------------------------------


def with_gain_loss(bars: DataFrame) -> DataFrame:
    """gain and loss of the close against the row before; NULL on the first row."""
    step = F.col("_step")
    return (bars.withColumn("_step", F.col("close") - lag("close"))
            .withColumns({"_gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))),
                          "_loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))}))


def with_rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Simple-average RSI over up to ``period`` changes; 100 when nothing was lost."""
    gain, loss = avg_n("_gain", period), avg_n("_loss", period)
    value = F.when(loss == 0, F.lit(100.0)).otherwise(
        100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    out = with_gain_loss(bars).withColumn("rsi", F.when(F.col("_step").isNotNull(), value))
    rsi = F.col("rsi")
    label = first_match([(rsi > 70, "Overbought"), (rsi < 30, "Oversold")], "Neutral")
    return out.withColumn("rsi_signal", F.when(rsi.isNotNull(), label)).drop(
        "_step", "_gain", "_loss")


def rsi_sql(bars: DataFrame, period: int = 14) -> DataFrame:
    """RSI for every bar that has a predecessor."""
    out = with_rsi(bars.select("symbol", "date", "close"), period)
    return out.filter("rsi IS NOT NULL").select("symbol", "date", "close", "rsi", "rsi_signal")


def with_rsi_full(bars: DataFrame, period: int = 14, tf: Timeframe = DAILY) -> DataFrame:
    """RSI that stays NULL until ``period`` changes are there; labels include their bounds."""
    gain, loss = full(F.avg("_gain"), "_gain", period), full(F.avg("_loss"), "_loss", period)
    strength = gain / F.when(loss == 0, F.lit(1e-10)).otherwise(loss)
    out = with_gain_loss(bars).withColumn("rsi", clamp(100 - 100 / (1 + strength), 0.0, 100.0))
    rsi = F.col("rsi")
    label = first_match([(rsi <= tf.oversold, "Oversold"), (rsi >= tf.overbought, "Overbought")],
                        "Neutral")
    return out.withColumn("rsi_signal", F.when(rsi.isNotNull(), label)).drop(
        "_step", "_gain", "_loss")


def rsi(bars: DataFrame, period: int = 14, tf: Timeframe = DAILY, as_of=None,
        lookback: int | None = None, keep_last: int | None = 10) -> DataFrame:
    """Full-window RSI of the look-back, last rows per symbol."""
    src = since(bars.select("symbol", "date", "close"), lookback or tf.rsi_lookback, as_of)
    out = with_rsi_full(src, period, tf).filter("rsi IS NOT NULL")
    if keep_last:
        out = tail(out, keep_last)
    return out.select("symbol", "date", "rsi", "rsi_signal")


# --- MACD ----------------------------------------------------------------------


def with_macd_sma(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD on simple averages."""
    out = bars.withColumn("macd_line", avg_n("close", fast) - avg_n("close", slow))
    out = out.withColumn("signal_line", avg_n("macd_line", signal))
    line, sig = F.col("macd_line"), F.col("signal_line")
    return out.withColumns({
        "macd_histogram": line - sig,
        "macd_signal": first_match([(line > sig, "Bullish"), (line < sig, "Bearish")], "Neutral")})


def macd_sma(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return with_macd_sma(bars.select("symbol", "date", "close"), fast, slow, signal).select(
        "symbol", "date", "close", "macd_line", "signal_line", "macd_histogram", "macd_signal")


def macd_label(threshold: float) -> Column:
    """Crossing of the threshold first, then momentum on either side of zero."""
    h, p = F.col("macd_histogram"), F.col("prev_macd_histogram")
    return first_match(
        [
            ((h > threshold) & (p <= threshold), "Bullish"),
            ((h < -threshold) & (p >= -threshold), "Bearish"),
            ((h > 0) & (h > p), "Bullish"),
            ((h < 0) & (h < p), "Bearish"),
        ],
        "Neutral",
    )


def macd_ewm(bars: DataFrame, tf: Timeframe = DAILY, as_of=None, lookback: int | None = None,
             keep_last: int | None = 10) -> DataFrame:
    """MACD on recursive means, last rows of every symbol with enough history."""
    src = since(bars.select("symbol", "date", "close"), lookback or tf.macd_lookback, as_of)
    src = (src.withColumn("_n", F.count("*").over(whole_symbol()))
           .filter(F.col("_n") >= tf.macd_min_rows))
    wanted = lead("date", keep_last).isNull() if keep_last else F.lit(True)
    src = src.withColumn("_wanted", wanted)
    out = with_macd(src, tf.macd_fast, tf.macd_slow, tf.macd_signal, emit="_wanted")
    out = out.filter("prev_macd_histogram IS NOT NULL")
    return out.withColumn("macd_signal", macd_label(tf.macd_threshold)).select(
        "symbol", "date", "macd_line", "signal_line", "macd_histogram", "macd_signal")


# --- bands -----------------------------------------------------------------------


def with_bollinger(bars: DataFrame, period: int = 20, width: float = 2.0,
                   tf: Timeframe = DAILY) -> DataFrame:
    """Bands that stay NULL until the window is full."""
    close = F.col("close")
    out = bars.withColumns({"middle_band": full(F.avg("close"), "close", period),
                            "_sd": full(F.stddev_samp("close"), "close", period)})
    out = out.withColumns({"upper_band": F.col("middle_band") + F.col("_sd") * width,
                           "lower_band": F.col("middle_band") - F.col("_sd") * width})
    out = out.withColumn("percent_b", (close - F.col("lower_band")) / F.nullif(
        F.col("upper_band") - F.col("lower_band"), F.lit(0.0)))
    pb = F.col("percent_b")
    label = first_match(
        [
            (close > F.col("upper_band"), "Overbought"),
            (close < F.col("lower_band"), "Oversold"),
            (pb > tf.near_high, "Near Overbought"),
            (pb < tf.near_low, "Near Oversold"),
        ],
        "Neutral",
    )
    return out.withColumn("bb_signal", F.when(pb.isNotNull(), label)).drop("_sd")


BAND_COLUMNS = ["symbol", "date", "middle_band", "upper_band", "lower_band", "percent_b",
                "bb_signal"]


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0, tf: Timeframe = DAILY,
              as_of=None, lookback: int | None = None, keep_last: int | None = 10) -> DataFrame:
    """Bollinger bands of the look-back, last rows per symbol with enough history."""
    src = since(bars.select("symbol", "date", "close"), lookback or tf.band_lookback, as_of)
    src = (src.withColumn("_n", F.count("*").over(whole_symbol()))
           .filter(F.col("_n") >= tf.band_min_rows))
    out = with_bollinger(src, period, width, tf).filter("percent_b IS NOT NULL")
    if keep_last:
        out = tail(out, keep_last)
    return out.select(*BAND_COLUMNS)


def bollinger_bootstrap(bars: DataFrame, period: int = 20, width: float = 2.0, as_of=None,
                        lookback: int = 50) -> DataFrame:
    """Bands over whatever rows the window holds; a zero width reads as the middle."""
    src = since(bars.select("symbol", "date", "close"), lookback, as_of)
    sd = F.stddev_samp("close").over(last_n(period))
    out = src.withColumns({"middle_band": avg_n("close", period), "_sd": sd}).filter(
        "_sd IS NOT NULL")
    up, down = F.col("upper_band"), F.col("lower_band")
    out = out.withColumns({"upper_band": F.col("middle_band") + F.col("_sd") * width,
                           "lower_band": F.col("middle_band") - F.col("_sd") * width})
    return out.withColumns({
        "percent_b": F.coalesce((F.col("close") - down) / F.nullif(up - down, F.lit(0.0)),
                                F.lit(0.5)),
        "bb_signal": first_match([(F.col("close") > up, "Overbought"),
                                  (F.col("close") < down, "Oversold")], "Neutral"),
    }).select(*BAND_COLUMNS)


def vwap(bars: DataFrame, period: int = 20) -> DataFrame:
    """Volume-weighted typical price over a full window."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.withColumn("_pv", typical * F.col("volume"))
    num = full(F.sum("_pv"), "_pv", period)
    den = full(F.sum("volume"), "volume", period)
    return out.withColumn("vwap", ratio(num, den)).select("symbol", "date", "close", "vwap")


# --- range, flow and volume ----------------------------------------------------------


def with_atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """True range, its mean, the five-row slope, contraction flag and tightening.

    Without a previous close the true range is unknown; the mean skips it.
    """
    h, lo, pc = F.col("high"), F.col("low"), F.col("prev_close")
    tr = F.when(pc.isNotNull(), F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)))
    out = bars.withColumn("true_range", tr).withColumn("atr_14", avg_n("true_range", period))
    out = out.withColumn("atr_slope", F.coalesce(F.col("atr_14") - lag("atr_14", 5), F.lit(0.0)))
    return out.withColumns({
        "range_contraction": F.when(F.col("atr_slope") < 0, 1).otherwise(0),
        "price_tightening": (h - lo) / (F.col("atr_14") + EPS)})


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    return with_atr(bars, period).select("symbol", "date", "true_range", "atr_14", "atr_slope",
                                         "range_contraction", "price_tightening")


def with_ad_line(bars: DataFrame) -> DataFrame:
    """Accumulation/distribution line weighted by the foreign share of buying."""
    buy, sell = F.col("foreign_buy_adj"), F.col("foreign_sell_adj")
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    out = bars.withColumns({"foreign_buy_adj": foreign_in_lots("foreign_buy"),
                            "foreign_sell_adj": foreign_in_lots("foreign_sell")})
    out = out.withColumns({"foreign_buy_ratio": buy / (buy + sell + EPS),
                           "clv": ((c - lo) - (h - c)) / (h - lo + EPS)})
    out = out.withColumn("money_flow_volume",
                         F.col("clv") * F.col("volume") * F.col("foreign_buy_ratio"))
    return out.withColumn("ad_line", F.sum("money_flow_volume").over(running()))


def ad_line(bars: DataFrame) -> DataFrame:
    return with_ad_line(bars).select("symbol", "date", "foreign_buy_ratio", "clv",
                                     "money_flow_volume", "ad_line")


def plain_money_flow() -> Column:
    """Close location times volume; 0 on a bar without range."""
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    return F.coalesce(((c - lo) - (h - c)) / F.nullif(h - lo, F.lit(0.0)) * F.col("volume"),
                      F.lit(0.0))


def ad_line_plain(bars: DataFrame, as_of=None, lookback: int = 40) -> DataFrame:
    """Unweighted A/D line started at the beginning of the look-back."""
    out = since(bars, lookback, as_of).withColumn("money_flow_volume", plain_money_flow())
    return out.withColumn("ad_line", F.sum("money_flow_volume").over(running())).select(
        "symbol", "date", "money_flow_volume", "ad_line")


def with_chaikin(bars: DataFrame, period: int = 20) -> DataFrame:
    """Money flow weighted once more by foreign buying, over traded volume."""
    out = bars.withColumn("_mfv", F.col("money_flow_volume") * F.col("foreign_buy") /
                          (F.col("volume") + EPS))
    total = F.sum("_mfv").over(last_n(period))
    return out.withColumn("cmf", F.coalesce(ratio(total, F.sum("volume").over(last_n(period))),
                                            F.lit(0.0))).drop("_mfv")


def chaikin_mf(bars: DataFrame, period: int = 20) -> DataFrame:
    return with_chaikin(with_ad_line(bars), period).select("symbol", "date", "cmf")


def with_order_flow(bars: DataFrame) -> DataFrame:
    """Daily and cumulative imbalance of unit-corrected foreign flow."""
    out = bars
    if "foreign_buy_adj" not in bars.columns:
        out = out.withColumns({"foreign_buy_adj": foreign_in_lots("foreign_buy"),
                               "foreign_sell_adj": foreign_in_lots("foreign_sell")})
    out = out.withColumn("ofi", (F.col("foreign_buy_adj") - F.col("foreign_sell_adj")) /
                         (F.col("volume") + EPS))
    return out.withColumn("cumulative_ofi", F.sum("ofi").over(running()))


def order_flow_imbalance(bars: DataFrame) -> DataFrame:
    return with_order_flow(bars).select("symbol", "date", "ofi", "cumulative_ofi")


def with_volume_profile(bars: DataFrame, period: int = 20) -> DataFrame:
    """Relative volume, large-block flag and the institutional share of volume."""
    out = bars
    if "foreign_buy_adj" not in bars.columns:
        out = out.withColumns({"foreign_buy_adj": foreign_in_lots("foreign_buy"),
                               "foreign_sell_adj": foreign_in_lots("foreign_sell")})
    out = out.withColumn("avg_volume_20", avg_n("volume", period))
    return out.withColumns({
        "relative_volume": F.col("volume") / (F.col("avg_volume_20") + EPS),
        "large_block_ratio": large_block(),
        "institutional_footprint": (F.col("foreign_buy_adj") + F.col("foreign_sell_adj")) /
                                   (F.col("volume") + EPS)})


def volume_profile(bars: DataFrame) -> DataFrame:
    return with_volume_profile(bars).select("symbol", "date", "avg_volume_20", "relative_volume",
                                            "large_block_ratio", "institutional_footprint")


def with_support_strength(bars: DataFrame, window: int = 20, tolerance: float = 0.02,
                          touches: float = 5.0) -> DataFrame:
    """How often recent lows came within ``tolerance`` of the lowest; 0 for the first rows.

    The collected array is bounded by the frame of ``window`` rows.
    """
    floor = F.min("low").over(last_n(window))
    out = bars.withColumns({"_lows": F.collect_list("low").over(last_n(window)), "_floor": floor,
                            "_rn": F.row_number().over(by_symbol())})
    hits = F.size(F.filter("_lows", lambda x: F.abs(x - F.col("_floor")) <=
                           F.col("_floor") * tolerance))
    strength = F.when(F.col("_rn") > window, F.least(hits / touches, F.lit(1.0))).otherwise(
        F.lit(0.0))
    return out.withColumn("support_strength", strength).drop("_lows", "_floor", "_rn")


def support_strength(bars: DataFrame) -> DataFrame:
    return with_support_strength(bars).select("symbol", "date", "low", "support_strength")


# --- trend structure ------------------------------------------------------------------

SMA_WINDOWS = (5, 10, 20, 50, 100, 200)


def with_moving_averages(bars: DataFrame) -> DataFrame:
    cols = {f"sma_{n}": avg_n("close", n) for n in SMA_WINDOWS}
    cols |= {f"avg_volume_{n}": avg_n("volume", n) for n in (20, 50)}
    return bars.withColumns(cols)


def moving_averages(bars: DataFrame) -> DataFrame:
    return with_moving_averages(bars).select(
        "symbol", "date", "close", *[f"sma_{n}" for n in SMA_WINDOWS],
        "avg_volume_20", "avg_volume_50")


def with_trend(df: DataFrame) -> DataFrame:
    """Primary trend from the stack of averages, momentum against five rows ago."""
    c, s20, s50, s100 = (F.col(x) for x in ("close", "sma_20", "sma_50", "sma_100"))
    out = df.withColumns({"_s20_back": lag("sma_20", 10), "_c_back": lag("close", 5)})
    return out.withColumns({
        "primary_trend": first_match(
            [
                ((c > s20) & (s20 > s50) & (s50 > s100), "STRONG_UPTREND"),
                ((c > s20) & (s20 > F.col("_s20_back")), "UPTREND"),
                ((c < s20) & (s20 < s50) & (s50 < s100), "STRONG_DOWNTREND"),
                ((c < s20) & (s20 < F.col("_s20_back")), "DOWNTREND"),
            ],
            "SIDEWAYS",
        ),
        "momentum_direction": first_match(
            [(c > F.col("_c_back"), "BULLISH_MOMENTUM"), (c < F.col("_c_back"), "BEARISH_MOMENTUM")],
            "NEUTRAL_MOMENTUM",
        ),
    }).drop("_s20_back", "_c_back")


def trend_state(bars: DataFrame) -> DataFrame:
    return with_trend(with_moving_averages(bars)).select("symbol", "date", "close",
                                                         "primary_trend", "momentum_direction")


def swing_points(bars: DataFrame, reach: int = 4) -> DataFrame:
    """Strict extremes over ``reach`` bars on both sides; a missing neighbour is no extreme."""
    top, bottom = F.lit(True), F.lit(True)
    for k in range(1, reach + 1):
        for other in (lag, lead):
            top = top & (F.col("high") > other("high", k))
            bottom = bottom & (F.col("low") < other("low", k))
    return bars.select("symbol", "date", "high", "low",
                       F.when(top, 1).otherwise(0).alias("swing_high"),
                       F.when(bottom, 1).otherwise(0).alias("swing_low"))


def _level_name(ratio_: float) -> str:
    return f"{ratio_ * 100:.1f}".removesuffix(".0").replace(".", "_")


LEVEL_NAMES = ["0", *[_level_name(r) for r in FIBONACCI], "100"]
FIB_COLUMNS = [f"{side}_fib_{n}" for side in ("bull", "bear") for n in LEVEL_NAMES]


def with_fibonacci(bars: DataFrame, window: int = 100) -> DataFrame:
    """Retracement levels of the rolling range, measured up and down."""
    out = bars.withColumns({"_hi": F.max("high").over(last_n(window)),
                            "_lo": F.min("low").over(last_n(window))})
    hi, lo = F.col("_hi"), F.col("_lo")
    cols = {"bull_fib_0": lo, "bull_fib_100": hi, "bear_fib_0": hi, "bear_fib_100": lo}
    for r in FIBONACCI:
        cols[f"bull_fib_{_level_name(r)}"] = lo + (hi - lo) * r
        cols[f"bear_fib_{_level_name(r)}"] = hi - (hi - lo) * r
    return out.withColumns(cols).drop("_hi", "_lo")


def fibonacci_levels(bars: DataFrame, window: int = 100) -> DataFrame:
    return with_fibonacci(bars, window).select("symbol", "date", *FIB_COLUMNS)


UP = ["UPTREND", "STRONG_UPTREND"]
DOWN = ["DOWNTREND", "STRONG_DOWNTREND"]


def with_wave(df: DataFrame) -> DataFrame:
    """Bucket the close between retracement levels in the direction of the trend."""
    c = F.col("close")
    bull = first_match(
        [(c <= F.col(f"bull_fib_{n}"), f"BULL_WAVE_{i}")
         for i, n in ((1, "23_6"), (2, "38_2"), (3, "61_8"), (4, "100"))]
        + [(c > F.col("bull_fib_100"), "BULL_WAVE_5")], "BULL_UNDEFINED")
    bear = first_match(
        [(c >= F.col(f"bear_fib_{n}"), f"BEAR_WAVE_{i}")
         for i, n in ((1, "23_6"), (2, "38_2"), (3, "61_8"), (4, "100"))]
        + [(c < F.col("bear_fib_100"), "BEAR_WAVE_5")], "BEAR_UNDEFINED")
    trend = F.col("primary_trend")
    return df.withColumns({
        "bullish_wave_position": F.when(trend.isin(UP), bull),
        "bearish_wave_position": F.when(trend.isin(DOWN), bear),
        "wave_position": first_match([(trend.isin(UP), bull), (trend.isin(DOWN), bear)],
                                     "SIDEWAYS_CORRECTION")})


def with_wave_base(bars: DataFrame) -> DataFrame:
    """Averages, trend, RSI, retracement levels and wave position in one pass."""
    out = with_trend(with_moving_averages(with_rsi(bars)))
    return with_wave(with_fibonacci(out)).withColumnRenamed("rsi", "rsi_14")


def wave_position(bars: DataFrame) -> DataFrame:
    return with_wave_base(bars).select("symbol", "date", "close", "primary_trend",
                                       "bullish_wave_position", "bearish_wave_position",
                                       "wave_position")


def with_wave_signal(df: DataFrame) -> DataFrame:
    """Signal and market phase from trend, wave, RSI and momentum."""
    trend, wave, r = F.col("primary_trend"), F.col("wave_position"), F.col("rsi_14")
    bull = F.col("momentum_direction") == "BULLISH_MOMENTUM"
    bear = F.col("momentum_direction") == "BEARISH_MOMENTUM"
    up, down, flat = trend.isin(UP), trend.isin(DOWN), trend == "SIDEWAYS"
    fifth = wave.isin("BULL_WAVE_5", "BEAR_WAVE_5")
    return df.withColumns({
        "wave_signal": first_match(
            [
                (up & (wave == "BULL_WAVE_2") & r.between(30, 50) & bull, "STRONG_BUY"),
                (up & (wave == "BULL_WAVE_3") & (r > 50) & bull, "BUY"),
                (up & (wave == "BULL_WAVE_4") & r.between(40, 60), "WEAK_BUY"),
                (down & (wave == "BEAR_WAVE_2") & r.between(50, 70) & bear, "STRONG_SELL"),
                (down & (wave == "BEAR_WAVE_3") & (r < 50) & bear, "SELL"),
                (down & (wave == "BEAR_WAVE_4") & r.between(40, 60), "WEAK_SELL"),
                (fifth, "CAUTION_REVERSAL"),
                (flat, "RANGE_TRADING"),
            ],
            "WAIT",
        ),
        "market_phase": first_match(
            [
                ((trend == "STRONG_UPTREND") & wave.isin("BULL_WAVE_3", "BULL_WAVE_4"),
                 "BULL_MARKET"),
                ((trend == "STRONG_DOWNTREND") & wave.isin("BEAR_WAVE_3", "BEAR_WAVE_4"),
                 "BEAR_MARKET"),
                (fifth, "POTENTIAL_REVERSAL"),
                (flat, "CORRECTION_PHASE"),
            ],
            "UNDEFINED_PHASE",
        ),
    })


def wave_signal(bars: DataFrame) -> DataFrame:
    return with_wave_signal(with_wave_base(bars)).select(
        "symbol", "date", "primary_trend", "wave_position", "rsi_14", "momentum_direction",
        "wave_signal", "market_phase")


def with_price_levels(bars: DataFrame) -> DataFrame:
    """Distance to the 20-row range, volume shock and engulfing flag."""
    c, o = F.col("close"), F.col("open_price")
    out = bars.withColumns({
        "avg_volume_10d": full(F.avg("volume"), "volume", 10),
        "high_20d": full(F.max("high"), "high", 20),
        "low_20d": full(F.min("low"), "low", 20),
        "_po": lag("open_price"), "_pc": lag("close")})

    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    return out.withColumns({
        "volume_shock": flag(F.col("volume") > F.col("avg_volume_10d") * 3),
        "near_support": flag(c < F.col("low_20d") * 1.03),
        "near_resistance": flag(c > F.col("high_20d") * 0.97),
        "bullish_engulfing": flag((o < F.col("_pc")) & (c > F.col("_po")) & (c > o) &
                                  (F.col("_pc") < F.col("_po"))),
    }).drop("_po", "_pc")


def price_levels(bars: DataFrame) -> DataFrame:
    return with_price_levels(bars).select("symbol", "date", "high_20d", "low_20d", "volume_shock",
                                          "near_support", "near_resistance", "bullish_engulfing")
