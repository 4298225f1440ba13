"""Signal scoring and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.frames import (whole_symbol, avg_before, avg_n, before, between, lag,
                                       last_n, lead, on_date, since, tail)
from barsmith.functions.scalar import (at_least, at_most, bid_ask_ratio, expected_rebound,
                                       first_match, pct_change, ratio, trade_levels)
from barsmith.operators import indicators as I
from barsmith.operators.ewm import with_macd
from barsmith.operators.ranking import latest_per, set_membership, top_k, union_tagged
from barsmith.operators.relational import prior_range, symbol_profile
from barsmith.params import DAILY, TRIGGER_WEIGHTS, Timeframe


def with_technicals(bars: DataFrame) -> DataFrame:
    """Bars with SQL-style RSI and MACD of the same windows."""
    return I.with_macd_sma(I.with_rsi(bars))


def technical_recommendation(bars: DataFrame) -> DataFrame:
    """Seven-way label from RSI and MACD."""
    r, m = F.col("rsi"), F.col("macd_signal")
    label = first_match(
        [
            ((r < 30) & (m == "Bullish"), "Strong Buy"),
            ((r > 70) & (m == "Bearish"), "Strong Sell"),
            (r < 30, "Buy Signal"),
            (r > 70, "Sell Signal"),
            (m == "Bullish", "Weak Buy"),
            (m == "Bearish", "Weak Sell"),
        ],
        "Hold",
    )
    return with_technicals(bars).filter(r.isNotNull()).select(
        "symbol", "date", "rsi", "rsi_signal", "macd_line", "signal_line", "macd_histogram",
        "macd_signal", "close", "volume",
        pct_change("close", "prev_close").alias("percent_change"), label.alias("recommendation"))


def oversold_bullish(bars: DataFrame) -> DataFrame:
    """Every bar that is oversold, turning up, and busier than the four days before it."""
    usual = prior_range(F.avg, "volume", 4, 1)
    out = with_technicals(bars).withColumn("_usual", usual)
    return out.filter((F.col("rsi_signal") == "Oversold") & (F.col("macd_signal") == "Bullish")
                      & (F.col("volume") > F.col("_usual"))).select(
        "symbol", "date", "rsi", "rsi_signal", "macd_signal",
        F.col("volume").alias("volume_today"))


def oversold_bullish_screen(bars: DataFrame, as_of=None, k: int = 20) -> DataFrame:
    """Hits of the ``as_of`` date, by default the newest of the bars, whether it has one or not."""
    hits = oversold_bullish(bars)
    if as_of is None:
        newest = bars.agg(F.max("date").alias("_newest"))
        hits = hits.crossJoin(F.broadcast(newest)).filter("date = _newest").drop("_newest")
    else:
        hits = on_date(hits, as_of)
    return top_k(hits, [F.col("volume_today").desc()], k)


# --- weighted buy score ---------------------------------------------------------

# Trigger column, weight name, label.
TRIGGERS = (
    ("_rsi_hit", "rsi_oversold", "RSI Oversold"),
    ("_macd_hit", "macd_bullish", "MACD Bullish"),
    ("volume_shock", "volume_shock", "Volume Shock"),
    ("near_support", "demand_zone", "Near Support"),
    ("bullish_engulfing", "bullish_engulfing", "Bullish Engulfing"),
    ("_band_hit", "bollinger_oversold", "Bollinger Oversold"),
)


def _scored(df: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    weights = {**TRIGGER_WEIGHTS, **(weights or {})}
    raw = sum((F.when(F.col(c), weights[w]).otherwise(0.0) for c, w, _ in TRIGGERS), F.lit(0.0))
    best = sum(weights[w] for _, w, _ in TRIGGERS)
    score = F.least(F.lit(10), F.bround(raw * 10 / best).cast("int"))
    out = df.withColumn("buy_score", score)
    return out.withColumns({
        "selling_score": F.lit(0),
        "signal_strength": at_least("buy_score", [(8, "Strong"), (6, "Moderate"), (4, "Weak")],
                                    "No Signal"),
        "indicators_triggered": F.array_compact(F.array(*[F.when(F.col(c), lab)
                                                          for c, _, lab in TRIGGERS]))})


def default_probability() -> Column:
    return F.least(F.lit(0.95), F.col("buy_score") * 0.05 + 0.5)


def with_probability(df: DataFrame, win_rates: DataFrame | None) -> DataFrame:
    """Observed win rate of the score where there is one, else the linear default.

    One rate per whole score from 0 to 10: at most eleven rows to broadcast.
    """
    if win_rates is None:
        return df.withColumn("winning_probability", default_probability())
    rates = win_rates.filter(F.col("buy_score").between(0, 10)).select(
        F.col("buy_score").cast("int").alias("buy_score"), (F.col("win_rate") / 100).alias("_rate"))
    return (df.join(F.broadcast(rates), "buy_score", "left")
            .withColumn("winning_probability", F.coalesce("_rate", default_probability()))
            .drop("_rate"))


SIGNAL_COLUMNS = ["symbol", "date", "buy_score", "selling_score", "winning_probability",
                  "signal_strength", "indicators_triggered"]


def buy_score(bars: DataFrame, rsi: DataFrame | None, macd: DataFrame | None,
              bands: DataFrame | None, win_rates: DataFrame | None = None,
              weights: dict[str, float] | None = None, tf: Timeframe = DAILY, as_of=None,
              min_score: int = 3, min_rows: int = 20) -> DataFrame:
    """Score the last bar of every symbol against the indicator tables.

    One join per table replaces per-symbol look-ups; an absent table simply
    never triggers.
    """
    src = since(bars, tf.signal_lookback, as_of).withColumn("_n", F.count("*").over(whole_symbol()))
    last = tail(I.with_price_levels(src.filter(F.col("_n") >= min_rows)), 1)

    def hit(table: DataFrame | None, signal: str, values: list[str], name: str) -> None:
        nonlocal last
        if table is None:
            last = last.withColumn(name, F.lit(False))
            return
        flags = table.select("symbol", "date", F.col(signal).isin(values).alias(name))
        last = last.join(flags, ["symbol", "date"], "left").fillna(False, subset=[name])

    hit(rsi, "rsi_signal", ["Oversold"], "_rsi_hit")
    hit(macd, "macd_signal", ["Bullish"], "_macd_hit")
    hit(bands, "bb_signal", ["Oversold", "Near Oversold"], "_band_hit")
    out = _scored(last, weights).filter(F.col("buy_score") >= min_score)
    return with_probability(out, win_rates).select(*SIGNAL_COLUMNS)


def signal_history(bars: DataFrame, tf: Timeframe = DAILY, min_score: int = 3,
                   weights: dict[str, float] | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """The same score at every bar, for backtests.

    RSI, bands and levels are windows over one exchange; only the trigger
    flags travel through the MACD recursion.
    """
    out = I.with_bollinger(I.with_rsi_full(I.with_price_levels(bars), tf=tf), tf=tf)
    out = out.withColumns({
        "_rsi_hit": F.coalesce(F.col("rsi_signal") == "Oversold", F.lit(False)),
        "_band_hit": F.coalesce(F.col("bb_signal").isin("Oversold", "Near Oversold"),
                                F.lit(False))})
    flags = ["_rsi_hit", "_band_hit", "volume_shock", "near_support", "bullish_engulfing"]
    out = with_macd(out, tf.macd_fast, tf.macd_slow, tf.macd_signal, keep=[*flags, *keep])
    bullish = I.macd_label(tf.macd_threshold) == "Bullish"
    out = out.withColumn("_macd_hit", F.col("prev_macd_histogram").isNotNull() & bullish)
    scored = _scored(out, weights).filter(F.col("buy_score") >= min_score)
    return with_probability(scored, None).select(*SIGNAL_COLUMNS, *keep)


def volatility_liquidity_filter(bars: DataFrame, tf: Timeframe = DAILY, as_of=None,
                                volatility: tuple[float, float] | None = None,
                                volume_min: float | None = None) -> DataFrame:
    """Symbols liquid enough whose range stays within bounds."""
    lo, hi = volatility or (tf.volatility_min, tf.volatility_max)
    floor = tf.volume_min if volume_min is None else volume_min
    p = symbol_profile(since(bars, tf.volatility_days, as_of))
    spread = (F.col("max_high") - F.col("min_low")) / F.nullif(F.col("min_low"), F.lit(0.0)) * 100
    out = p.withColumns({
        "volatility_pct": spread,
        "price_volatility": F.col("std_dev") / F.nullif(F.col("avg_price"), F.lit(0.0)) * 100,
        "days_range": F.datediff("last_date", "first_date")})
    return out.filter((F.col("avg_volume") >= floor) & F.col("volatility_pct").between(lo, hi)).select(
        "symbol", "volatility_pct", "avg_volume", "price_volatility", "last_date", "first_date",
        "days_range")


def high_probability(signals: DataFrame, bars: DataFrame, rsi: DataFrame | None = None,
                     macd: DataFrame | None = None, tf: Timeframe = DAILY, as_of=None, k: int = 10,
                     min_score: int = 5, min_probability: float | None = None) -> DataFrame:
    """Best signals of the date with price, indicators and trade levels."""
    p = tf.min_probability if min_probability is None else min_probability
    out = on_date(signals, as_of).filter((F.col("winning_probability") >= p)
                                         & (F.col("buy_score") >= min_score))
    out = out.join(bars.select("symbol", "date", "name", "close", "volume"), ["symbol", "date"])
    for table, column, kind in ((rsi, "rsi", "double"), (macd, "macd_signal", "string")):
        if table is None:
            out = out.withColumn(column, F.lit(None).cast(kind))
        else:
            out = out.join(table.select("symbol", "date", column), ["symbol", "date"], "left")
    out = top_k(out.select("symbol", "date", "buy_score", "signal_strength",
                           "winning_probability", "name", "close", "volume", "rsi", "macd_signal"),
                [F.col("buy_score").desc(), F.col("winning_probability").desc()], k)
    return out.withColumns(trade_levels("close", tf))


def timeframe_confluence(signals: dict[str, DataFrame], bars: DataFrame, as_of=None, k: int = 5,
                         min_score: int = 6, min_probability: float = 0.7) -> DataFrame:
    """Symbols among the best of more than one timeframe."""
    picks = {}
    for name, s in signals.items():
        good = on_date(s, as_of).filter((F.col("winning_probability") >= min_probability)
                                        & (F.col("buy_score") >= min_score))
        picks[name] = top_k(good, [F.col("buy_score").desc(),
                                   F.col("winning_probability").desc()], k).select("symbol", "date")
    both = set_membership(union_tagged(picks, "timeframe"), "symbol", "timeframe")
    price = on_date(bars, as_of).select("symbol", "name", "close")
    return both.join(price, "symbol").select("symbol", "name", "close",
                                             F.col("tags").alias("timeframes"))


# --- order-flow scores ------------------------------------------------------------


def bandar_history(bars: DataFrame) -> DataFrame:
    """Five accumulation flags and their sum for every bar."""
    out = bars.withColumns({
        "_v20": F.round(avg_before("volume", 20), 0),
        "percent_change": pct_change("close", "prev_close"),
        "foreign_net": F.col("foreign_buy") - F.col("foreign_sell")})
    v, v20 = F.col("volume"), F.col("_v20")

    def flag(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    out = out.withColumns({
        "volume_spike": flag(v > v20 * 2),
        "foreign_buying": flag(F.col("foreign_net") > 0),
        "strong_bid": flag(F.col("bid_volume") > F.col("offer_volume") * 1.5),
        "hidden_buying": flag((v > v20 * 1.5) & (F.abs("percent_change") < 1.0)),
        "positive_close": flag(F.col("close") > F.col("prev_close")),
        "volume_ratio": ratio(v, v20)})
    score = sum((F.col(c) for c in ("volume_spike", "foreign_buying", "strong_bid",
                                    "hidden_buying", "positive_close")), F.lit(0))
    out = out.withColumns({
        "bandar_score": score,
        "next_day_change": lead("percent_change"),
        "positive_days_last5": F.sum("positive_close").over(last_n(6))})
    return out.withColumn("signal_strength", first_match(
        [(F.col("bandar_score") >= 4, "Sangat Kuat"), (F.col("bandar_score") == 3, "Kuat"),
         (F.col("bandar_score") == 2, "Sedang")], "Lemah"))


BANDAR_COLUMNS = ["symbol", "name", "close", "volume_ratio", "bandar_score", "signal_strength",
                  "positive_days_last5", "foreign_net"]


def bandar_score(bars: DataFrame, as_of=None, days: int = 30, k: int = 15, min_score: int = 2,
                 min_ratio: float = 1.5) -> DataFrame:
    out = on_date(bandar_history(since(bars, days, as_of)), as_of)
    out = out.filter((F.col("bandar_score") >= min_score) & (F.col("volume_ratio") > min_ratio))
    return top_k(out.select(*BANDAR_COLUMNS),
                 [F.col("bandar_score").desc(), F.col("volume_ratio").desc()], k)


COMPOSITE_WEIGHTS = {
    "volume_intensity": 0.20, "volume_surge": 0.15, "foreign_momentum": 0.20,
    "bid_ask_strength": 0.10, "stealth": 0.20, "buying_weakness": 0.10,
    "foreign_consistency": 0.05,
}


def with_advanced_bandar(bars: DataFrame, legacy_int_div: bool = False) -> DataFrame:
    """Seven capped component scores and their weighted sum for every bar."""
    src = bars.filter((F.col("volume") > 0) & (F.col("close") > 0) & (F.col("prev_close") > 0))
    zero = F.lit(0)
    src = src.withColumns({
        "foreign_net": F.coalesce(F.col("foreign_buy") - F.col("foreign_sell"), zero),
        "_bid": F.coalesce("bid_volume", zero), "_offer": F.coalesce("offer_volume", zero)})
    v, net, bid, offer = (F.col(c) for c in ("volume", "foreign_net", "_bid", "_offer"))
    src = src.withColumns({
        "_v20": F.coalesce(avg_before("volume", 20), v.cast("double")),
        "_v10": F.coalesce(avg_before("volume", 10), v.cast("double")),
        "_f10": F.coalesce(F.avg(F.abs(net)).over(before(10)), (F.abs(net) + 1).cast("double")),
        "foreign_consistency": F.count(F.when(net > 0, 1)).over(last_n(6)) * 100.0 / 6})
    r20, r10 = ratio(v, "_v20"), ratio(v, "_v10")
    pct = (F.col("close") - F.col("prev_close")) / F.col("prev_close") * 100
    book = F.floor(bid / F.greatest(offer, F.lit(1))) if legacy_int_div else ratio(
        bid, F.greatest(offer, F.lit(1)))

    def cap(c: Column) -> Column:
        return F.least(F.lit(100.0), c)

    out = src.withColumns({
        "volume_ratio": F.coalesce(r20, F.lit(1.0)),
        "volume_intensity": F.coalesce(cap(F.greatest(F.lit(0.0), (r20 - 1) * 30)), F.lit(0.0)),
        "volume_surge": first_match([(r10 > 1.5, cap(r10 * 20)), (r10 > 1.2, cap(r10 * 15))], 0.0),
        "foreign_momentum": first_match(
            [((net > 0) & (F.col("_f10") > 0), cap(ratio(net, "_f10") * 25)), (net > 0, 50.0)],
            0.0),
        "bid_ask_strength": first_match(
            [((offer > 0) & (bid > offer), cap((book - 1) * 40)), ((bid > 0) & (offer == 0), 70.0)],
            0.0),
        "stealth": first_match([((r20 > 1.3) & (F.abs(pct) < 2.5), cap(r20 * 25))], 0.0),
        "buying_weakness": first_match(
            [((F.col("close") < F.col("prev_close")) & (r10 > 1.2), 75.0),
             ((F.col("close") >= F.col("prev_close")) & (r10 > 1.5), 60.0)], 0.0)})
    total = sum((F.col(c) * w for c, w in COMPOSITE_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("composite_bandar_score", total)


def advanced_bandar(bars: DataFrame, as_of=None, days: int = 30, min_score: float = 25,
                    min_ratio: float = 1.1, k: int = 20, legacy_int_div: bool = False) -> DataFrame:
    out = on_date(with_advanced_bandar(since(bars, days, as_of), legacy_int_div), as_of)
    s, r = F.col("composite_bandar_score"), F.col("volume_ratio")
    out = out.filter((s >= min_score) & (r >= min_ratio)).select(
        "symbol", "name", "close", "volume_ratio", "foreign_net", "composite_bandar_score",
        at_least(s, [(70, "Sangat Kuat (Tier 1)"), (55, "Kuat (Tier 2)"), (40, "Sedang (Tier 3)"),
                     (25, "Lemah (Tier 4)")], "Sangat Lemah").alias("advanced_signal_strength"),
        first_match([((s >= 65) & (r >= 2.0), "Very High Confidence"),
                     ((s >= 55) & (r >= 1.5), "High Confidence"),
                     ((s >= 45) & (r >= 1.3), "Medium Confidence"),
                     (s >= 35, "Low-Medium Confidence")], "Low Confidence")
        .alias("confidence_level"),
        at_least(s, [(65, "1-3 hari"), (55, "3-7 hari"), (40, "1-2 minggu")], "2+ minggu")
        .alias("expected_timeframe"),
        "volume_intensity", "foreign_momentum",
        F.col("stealth").alias("stealth_score"), "foreign_consistency")
    return top_k(out, [s.desc(), r.desc()], k)


# --- rebound ----------------------------------------------------------------------


def with_rebound(bars: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Six rebound sub-scores per bar of the look-back; RSI is taken over all history."""
    chg, net = F.col("price_change_10d"), F.col("foreign_net")
    out = since(I.with_rsi(bars), days, as_of).withColumns({
        "foreign_net": F.col("foreign_buy") - F.col("foreign_sell"),
        "price_change_10d": (F.col("close") / F.nullif(lag("close", 10), F.lit(0.0)) - 1) * 100,
        "_a3": avg_n("close", 3), "_p3": F.avg("close").over(between(5, 3)),
        "volume_ratio": ratio("volume", avg_before("volume", 10)),
        "bid_ask_ratio": bid_ask_ratio()})

    def steady(share: float) -> Column:
        return (F.col("_a3") >= F.col("_p3") * share) & (chg < 0)

    parts = {
        "price_decline_score": first_match(
            [(chg <= -20, 5), (chg <= -15, 4), (chg <= -10, 3), (chg <= -5, 2), (chg < 0, 1)], 0),
        "rsi_score": at_most("rsi", [(25, 5), (30, 4), (35, 3), (40, 2)], 0),
        "volume_score": at_least("volume_ratio", [(3, 5), (2, 4), (1.5, 3), (1.2, 2), (1, 1)], 0),
        "foreign_flow_score": first_match([((net > 0) & (chg < 0), 3), (net > 0, 1)], 0),
        "bid_ask_score": at_least("bid_ask_ratio", [(2, 4), (1.5, 3), (1.2, 2), (1, 1)], 0),
        "stabilization_score": first_match([(steady(1.0), 3), (steady(0.98), 2),
                                            (steady(0.95), 1)], 0)}
    out = out.withColumns(parts)
    total = sum((F.col(c) for c in parts), F.lit(0))
    return out.withColumn("rebound_score", total).withColumns({
        "rebound_probability": F.col("rebound_score") / 25.0,
        "expected_rebound_pct": expected_rebound(chg, "rebound_score")})


REBOUND_COLUMNS = [
    "symbol", "name", "date", "close", "volume", "volume_ratio", "rsi", "price_change_10d",
    "foreign_net", "bid_ask_ratio", "price_decline_score", "rsi_score", "volume_score",
    "foreign_flow_score", "bid_ask_score", "stabilization_score", "rebound_score",
    "rebound_probability", "expected_rebound_pct"]


def rebound_score(bars: DataFrame, as_of=None, days: int = 30, decline: float = -5.0,
                  k: int = 30) -> DataFrame:
    """Oversold symbols of the date most likely to bounce."""
    out = on_date(with_rebound(bars, as_of, days), as_of).filter(
        (F.col("price_change_10d") < decline)
        & ((F.col("rsi_score") > 0) | (F.col("volume_score") > 0) | (F.col("bid_ask_score") > 0)))
    return top_k(out.select(*REBOUND_COLUMNS), [F.col("rebound_score").desc()], k)


# --- waves ------------------------------------------------------------------------


def wave_overview(bars: DataFrame, as_of=None, k: int = 20) -> DataFrame:
    """Trend, RSI and MACD setup of the latest date, best setups first."""
    out = with_technicals(bars).withColumn("_s20", avg_n("close", 20))
    out = on_date(out, as_of).filter(F.col("rsi").isNotNull())
    c, s, r, m = F.col("close"), F.col("_s20"), F.col("rsi"), F.col("macd_signal")
    trend = first_match([(c > s, "UPTREND"), (c < s, "DOWNTREND")], "SIDEWAYS")
    out = out.withColumn("trend_direction", trend)
    t = F.col("trend_direction")
    setups = [((t == "UPTREND") & (r < 70) & (m == "Bullish"), "BULLISH_WAVE", 1),
              ((t == "DOWNTREND") & (r > 30) & (m == "Bearish"), "BEARISH_WAVE", 2),
              (t == "SIDEWAYS", "CONSOLIDATION_WAVE", 3)]
    out = out.withColumns({
        "percent_change": pct_change("close", "prev_close"),
        "wave_setup": first_match([(cond, name) for cond, name, _ in setups], "MIXED_SIGNAL"),
        "_priority": first_match([(cond, rank) for cond, _, rank in setups], 4)})
    return top_k(out, [F.col("_priority").asc(), F.col("volume").desc()], k).select(
        "symbol", "name", "close", "percent_change", "volume", "trend_direction",
        r.alias("rsi_14"), "macd_signal", "wave_setup")


def market_bias(bars: DataFrame) -> DataFrame:
    """Five factor scores, their sum and its label for every bar."""
    df = I.with_wave_base(bars)
    trend, wave, r, c = (F.col(x) for x in ("primary_trend", "wave_position", "rsi_14", "close"))
    down, up = trend.isin(I.DOWN), trend.isin(I.UP)
    vol = F.coalesce(ratio("volume", "avg_volume_20"), F.lit(1.0))
    by_trend = {"STRONG_DOWNTREND": -8, "DOWNTREND": -5, "STRONG_UPTREND": 8, "UPTREND": 5}
    by_wave = {"BEAR_WAVE_4": -3, "BEAR_WAVE_2": -6, "BEAR_WAVE_3": -4, "BULL_WAVE_2": 6,
               "BULL_WAVE_3": 4, "BULL_WAVE_4": 3, "BEAR_WAVE_5": -1, "BULL_WAVE_5": -1}
    bear618, bull618 = F.col("bear_fib_61_8"), F.col("bull_fib_61_8")
    df = df.withColumns({
        "trend_score": first_match([(trend == k, v) for k, v in by_trend.items()], 0),
        "wave_score": first_match([(wave == k, v) for k, v in by_wave.items()], 0),
        "momentum_score": first_match([(r < 25, 4), (r < 30, 2), (r > 75, -4), (r > 70, -2)], 0),
        "fibonacci_score": first_match([(down & (c < bear618), -2), (down & (c > bear618), 1),
                                        (up & (c > bull618), 2), (up & (c < bull618), -1)], 0),
        "volume_score": first_match([((vol > 2) & down, -1), ((vol > 2) & up, 1)], 0)})
    parts = ["trend_score", "wave_score", "momentum_score", "fibonacci_score", "volume_score"]
    df = df.withColumn("bias_score", sum((F.col(p) for p in parts), F.lit(0)))
    steps = [
        (-10, "STRONG BEARISH", "Very High", "Bearish: 80-90% | Bullish: 10-20%"),
        (-5, "BEARISH", "High", "Bearish: 65-75% | Bullish: 25-35%"),
        (-2, "WEAK BEARISH", "Medium", "Bearish: 55-60% | Bullish: 40-45%"),
        (2, "NEUTRAL", "Low", "Bearish: 45-55% | Bullish: 45-55%"),
        (5, "WEAK BULLISH", "Medium", "Bearish: 40-45% | Bullish: 55-60%"),
        (10, "BULLISH", "High", "Bearish: 25-35% | Bullish: 65-75%"),
    ]
    last = ("STRONG BULLISH", "Very High", "Bearish: 10-20% | Bullish: 80-90%")
    named = {name: at_most("bias_score", [(s[0], s[i]) for s in steps], last[i - 1])
             for i, name in ((1, "market_bias"), (2, "confidence"), (3, "probability"))}
    return df.select("symbol", "date", *parts, "bias_score",
                     *[c_.alias(n) for n, c_ in named.items()])


def fib_status(bars: DataFrame) -> DataFrame:
    """Last bar of each symbol against every retracement level, one row per level."""
    last = latest_per(I.with_fibonacci(bars).select("symbol", "date", "close", *I.FIB_COLUMNS))
    rows = []
    for side in ("bull", "bear"):
        for n in I.LEVEL_NAMES:
            price = F.col(f"{side}_fib_{n}")
            status = F.when(price > 0, first_match([(F.col("close") > price, "Above")], "Below") if
                            side == "bull" else first_match([(F.col("close") < price, "Below")],
                                                            "Above")).otherwise("N/A")
            rows.append(F.struct(F.lit(side).alias("side"),
                                 F.lit(n.replace("_", ".") + "%").alias("level"),
                                 price.alias("price"), status.alias("status")))
    return last.select("symbol", "date", "close", F.inline(F.array(*rows)))
