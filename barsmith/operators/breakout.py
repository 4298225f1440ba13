"""Breakout preparation, detection and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.frames import (avg_before, avg_n, before, between, lag, last_n,
                                       on_date, since, tail)
from barsmith.functions.scalar import (at_least, at_most, first_match, price_action_label, ratio,
                                       text_of)
from barsmith.operators.ranking import top_k
from barsmith.operators.relational import (anti_join_new_rows, join_date_range,
                                           join_full_outer_3way, prior_range)


def _percent(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0)) * 100


# --- preparation ---------------------------------------------------------------


def accumulation_maturity(bars: DataFrame, as_of=None, months: int = 6, min_days: int = 15,
                          max_drift: float = 0.05) -> DataFrame:
    """How long and how strongly a symbol has been accumulated.

    The historic average and the dispersion are taken over the rows that pass
    the minimum, as the source query does (filter, then window).
    """
    src = since(bars, None, as_of, months=months).select(
        "symbol", "date", "close", "volume",
        (F.col("foreign_buy") - F.col("foreign_sell")).alias("foreign_net"))
    base, back = F.avg("volume").over(between(89, 30)), lag("close", 5)
    quiet = F.abs(F.col("close") - back) / F.nullif(back, F.lit(0.0)) < max_drift
    src = src.withColumn("accumulation_day",
                         F.when((F.col("volume") > base * 1.2) & quiet, 1).otherwise(0))
    day = F.col("accumulation_day") == 1
    src = src.withColumns({
        "accumulation_duration_days": F.sum("accumulation_day").over(last_n(61)),
        "total_volume_accumulated": F.sum(F.when(day, F.col("volume")).otherwise(0))
        .over(last_n(61)),
        "foreign_net_accumulated": F.sum(F.when(day, F.col("foreign_net")).otherwise(0))
        .over(last_n(61))})
    days = F.col("accumulation_duration_days")
    out = src.filter(days >= min_days).withColumns({
        "_per_day": ratio("total_volume_accumulated", days),
        "_old": F.avg("volume").over(between(149, 90)),
        "price_stability_score": 100 - F.stddev_samp("close").over(last_n(30))
        / F.nullif(avg_n("close", 30), F.lit(0.0)) * 100})
    out = tail(out, 1)
    vs = F.when(F.col("_old") > 0, F.col("_per_day") / F.col("_old")).otherwise(F.lit(1.0))
    out = out.withColumn("volume_vs_historical", vs)
    v, s = F.col("volume_vs_historical"), F.col("price_stability_score")
    return out.select(
        "symbol", F.col("date").alias("analysis_date"), "accumulation_duration_days",
        "total_volume_accumulated",
        F.round(F.coalesce("_per_day", F.lit(0.0))).cast("long").alias("avg_daily_volume"),
        "volume_vs_historical", "foreign_net_accumulated", "price_stability_score",
        first_match(
            [((days >= 30) & (v >= 1.5) & (s >= 85), "Mature Accumulation - Ready"),
             ((days >= 20) & (v >= 1.3) & (s >= 80), "Advanced Accumulation"),
             ((days >= 15) & (v >= 1.2), "Building Accumulation")],
            "Early Accumulation").alias("accumulation_maturity_signal"))


def breakout_readiness(bars: DataFrame, as_of=None, months: int = 3,
                       max_distance: float = 15.0) -> DataFrame:
    """Distance to the rolling high, volume surge and momentum of each symbol's last bar."""
    src = since(bars, None, as_of, months=months)
    net = F.col("foreign_buy") - F.col("foreign_sell")
    back = lag("close", 10)
    out = src.withColumns({
        "resistance_level": F.max("high").over(last_n(60)),
        "volume_surge_indicator": ratio(avg_n("volume", 5), F.avg("volume").over(between(34, 5))),
        "price_momentum_score": _percent(F.col("close") - back, back),
        "foreign_activity_recent": F.sum(F.greatest(net, F.lit(0))).over(last_n(3))})
    out = tail(out, 1).withColumn("distance_to_resistance_pct",
                                  _percent(F.col("resistance_level") - F.col("close"),
                                           F.col("close")))
    dist, surge = F.col("distance_to_resistance_pct"), F.col("volume_surge_indicator")
    out = out.withColumn("breakout_probability", first_match(
        [((dist <= 3) & (surge >= 1.3) & (F.col("foreign_activity_recent") > 0), 85),
         ((dist <= 5) & (surge >= 1.2), 70), ((dist <= 8) & (surge >= 1.1), 55)], 30))
    p = F.col("breakout_probability")
    return out.filter(dist <= max_distance).select(
        "symbol", F.col("date").alias("analysis_date"), F.col("close").alias("current_price"),
        "resistance_level", "distance_to_resistance_pct", "volume_surge_indicator",
        "foreign_activity_recent", "price_momentum_score", "breakout_probability",
        first_match([((p >= 80) & (dist <= 3), "Imminent Breakout (1-3 days)"),
                     ((p >= 70) & (dist <= 5), "High Breakout Probability (3-7 days)"),
                     ((p >= 55) & (dist <= 8), "Moderate Breakout Setup (1-2 weeks)")],
                    "Building Momentum").alias("breakout_signal"))


def early_breakout(bars: DataFrame, as_of=None, days: int = 30,
                   min_expansion: float = 1.2) -> DataFrame:
    """Early signs on the date: volume expansion, price action, foreign surge, support tests."""
    src = since(bars, days, as_of)
    net = F.col("foreign_buy") - F.col("foreign_sell")
    support = F.min("low").over(between(19, 1))
    out = src.withColumns({
        "volume_expansion_today": ratio("volume", avg_before("volume", 10)),
        "price_action_signal": price_action_label(lag("high")),
        "foreign_buying_surge": F.coalesce(net > F.avg(net).over(before(10)) * 2, F.lit(False)),
        "_test": F.when(F.col("low") <= support * 1.02, 1).otherwise(0)})
    out = on_date(out.withColumn("support_strength", F.sum("_test").over(last_n(20))), as_of)
    exp, act = F.col("volume_expansion_today"), F.col("price_action_signal")
    surge = F.col("foreign_buying_surge")
    momentum = F.coalesce((exp >= 1.5) & act.isin("Strong Close", "Gap Up") & surge, F.lit(False))
    strength = (F.when(exp >= 2.0, 30.0).otherwise(exp * 15)
                + first_match([(act == "Strong Close", 25), (act == "Gap Up", 30),
                               (act == "Above Midpoint", 15)], 5)
                + F.when(surge, 25).otherwise(0) + F.when(momentum, 20).otherwise(0))
    return out.filter(exp >= min_expansion).select(
        "symbol", F.col("date").alias("analysis_date"), "volume_expansion_today",
        "price_action_signal", "foreign_buying_surge", "support_strength",
        momentum.alias("momentum_building"),
        first_match([(exp >= 2.0, "High Volume Spike"), (surge, "Foreign Surge"),
                     (act == "Gap Up", "Gap Up")], "No Clear Catalyst").alias("catalysts_detected"),
        strength.alias("early_signal_strength"))


def _whole(c: str) -> Column:
    return text_of(F.round(c).cast("long"))


def breakout_candidates(maturity: DataFrame, readiness: DataFrame, early: DataFrame, as_of=None,
                        min_score: float = 50) -> DataFrame:
    """Combine the three preparations of a date into one ranked recommendation."""
    a = maturity.select("symbol", "analysis_date", "accumulation_maturity_signal")
    b = readiness.select("symbol", "analysis_date", "current_price", "resistance_level",
                         "breakout_probability", "distance_to_resistance_pct", "breakout_signal")
    e = early.select("symbol", "analysis_date", "early_signal_strength", "catalysts_detected")
    out = on_date(join_full_outer_3way(a, b, e, ["symbol", "analysis_date"]), as_of,
                  date_col="analysis_date").filter(F.col("current_price").isNotNull())
    label = F.col("accumulation_maturity_signal")
    price, res = F.col("current_price"), F.col("resistance_level")
    out = out.withColumns({
        "accumulation_score": first_match(
            [(label == "Mature Accumulation - Ready", 90), (label == "Advanced Accumulation", 75),
             (label == "Building Accumulation", 60)], 40),
        "breakout_readiness_score": F.coalesce("breakout_probability", F.lit(30)),
        "early_signal_score": F.coalesce("early_signal_strength", F.lit(20.0)),
        "_dist": F.coalesce("distance_to_resistance_pct", F.lit(20.0)),
        "risk_reward_ratio": F.when((price > 0) & (res > price),
                                    (res - price) / (price * 0.05)).otherwise(F.lit(1.0)),
        "stop_loss_level": price * 0.95, "target_price": res})
    out = out.withColumn("overall_breakout_score",
                         F.col("accumulation_score") * 0.4 + F.col("breakout_readiness_score") * 0.4
                         + F.col("early_signal_score") * 0.2)
    s, rr, dist = (F.col(c) for c in ("overall_breakout_score", "risk_reward_ratio", "_dist"))
    return out.filter(s >= min_score).select(
        "symbol", "analysis_date", "current_price", "target_price", "resistance_level",
        "accumulation_score", "breakout_readiness_score", "early_signal_score",
        "overall_breakout_score",
        first_match([((s >= 85) & (dist <= 3), "1-3 days"), ((s >= 75) & (dist <= 5), "3-7 days"),
                     (s >= 65, "1-2 weeks")], "2+ weeks").alias("breakout_timeframe"),
        first_match([((s >= 85) & (rr >= 2), "STRONG BUY - Immediate Entry"),
                     ((s >= 75) & (rr >= 1.5), "BUY - Good Setup"),
                     (s >= 65, "WATCH - Prepare Entry")],
                    "MONITOR - Wait for Better Setup").alias("recommendation"),
        "risk_reward_ratio", "stop_loss_level",
        at_least(s, [(85, "Very High"), (75, "High"), (65, "Medium")], "Low")
        .alias("confidence_level"),
        F.concat(F.lit("Entry: "), _whole("current_price"), F.lit(" | Target: "),
                 _whole("target_price"), F.lit(" | Stop: "), _whole("stop_loss_level"),
                 F.lit(" | Signals: "), F.coalesce("catalysts_detected", F.lit("Standard")))
        .alias("action_plan"))


def breakout_alerts(candidates: DataFrame, as_of=None, min_score: float = 70,
                    k: int = 10) -> DataFrame:
    """Best candidates of the date with their potential gain."""
    price = F.col("current_price")
    out = on_date(candidates, as_of, date_col="analysis_date").filter(
        F.col("overall_breakout_score") >= min_score).select(
        "symbol", "current_price", "target_price", "overall_breakout_score", "breakout_timeframe",
        "recommendation", "risk_reward_ratio", "confidence_level", "action_plan",
        F.when(price > 0, (F.col("target_price") - price) / price * 100).otherwise(F.lit(0.0))
        .alias("potential_gain_pct"))
    return top_k(out, [F.col("overall_breakout_score").desc()], k)


def relaxed_momentum(bars: DataFrame, as_of=None, months: int = 2, recent_days: int = 3,
                     max_distance: float = 25.0) -> DataFrame:
    """Four sub-scores, weighted score, timeframe, recommendation and risk per symbol."""
    b5, b10 = lag("close", 5), lag("close", 10)
    c = F.col("close")
    out = since(bars, None, as_of, months=months).withColumns({
        "_m5": _percent(c - b5, b5), "_m10": _percent(c - b10, b10),
        "_r7": ratio("volume", avg_before("volume", 7)),
        "_f3": F.sum(F.col("foreign_buy") - F.col("foreign_sell")).over(last_n(3)),
        "_res": F.max("high").over(last_n(20))})
    out = tail(since(out, recent_days, as_of), 1).withColumn(
        "distance_to_resistance_pct", _percent(F.col("_res") - c, c))
    m5, m10, dist = F.col("_m5"), F.col("_m10"), F.col("distance_to_resistance_pct")
    out = out.withColumns({
        "volume_score": at_least("_r7", [(1.5, 80), (1.3, 65), (1.1, 50), (1.0, 35)], 20),
        "momentum_score": first_match([((m5 > 3) & (m10 > 2), 80), ((m5 > 1) & (m10 > 0), 65),
                                       ((m5 > 0) | (m10 > 0), 50), ((m5 > -2) & (m10 > -3), 35)],
                                      20),
        "foreign_score": first_match([(F.col("_f3") > 0, 70), (F.col("_f3") >= 0, 50)], 30),
        "technical_score": at_most(dist, [(3, 80), (7, 65), (12, 50), (20, 35)], 20)})
    v, m, f, t = (F.col(f"{n}_score") for n in ("volume", "momentum", "foreign", "technical"))
    out = out.withColumn("overall_score", v * 0.25 + m * 0.35 + f * 0.20 + t * 0.20)
    s = F.col("overall_score")

    def part(name: str, score: Column) -> list[Column]:
        return [F.lit(name), text_of(score), F.lit("/100")]

    notes = F.concat(*part("Vol: ", v), *part(" | Momentum: ", m), *part(" | Foreign: ", f),
                     *part(" | Technical: ", t))
    return out.filter(dist <= max_distance).select(
        "symbol", F.col("date").alias("analysis_date"), c.alias("current_price"),
        F.col("_res").alias("target_price"), "volume_score", "momentum_score", "foreign_score",
        "technical_score", "distance_to_resistance_pct", "overall_score",
        first_match([((v + m + t >= 210) & (dist <= 5), "2-5 days"),
                     ((v + m + t >= 180) & (dist <= 10), "1-2 weeks"),
                     (v + m >= 100, "2-4 weeks")], "1+ month").alias("timeframe_estimate"),
        at_least(s, [(65, "BUY - Strong Setup"), (55, "WATCH - Good Potential"),
                     (45, "MONITOR - Building Momentum")],
                 "WAIT - No Clear Signal").alias("recommendation"),
        first_match([((dist <= 5) & (v >= 60), "Low Risk"),
                     ((dist <= 10) & (m >= 60), "Medium Risk"), (dist <= 15, "Medium-High Risk")],
                    "High Risk").alias("risk_level"),
        notes.alias("notes"))


def breakout_shortlist(relaxed: DataFrame, as_of=None, min_score: float = 45,
                       k: int = 15) -> DataFrame:
    """Best setups of the date, grouped by the wording of the recommendation."""
    rec = F.col("recommendation")
    group = first_match([(rec.contains("BUY"), "BUY"), (rec.contains("WATCH"), "WATCH"),
                         (rec.contains("MONITOR"), "MONITOR")], None)
    out = on_date(relaxed, as_of, date_col="analysis_date").filter(
        F.col("overall_score") >= min_score).select(
        "symbol", "current_price", "target_price", "overall_score", "timeframe_estimate",
        "recommendation", "risk_level", "volume_score", "momentum_score", "foreign_score",
        "technical_score", group.alias("recommendation_group"))
    return top_k(out, [F.col("overall_score").desc()], k)


# --- lifecycle -----------------------------------------------------------------


def detect_breakouts(bars: DataFrame, history: DataFrame | None = None, as_of=None,
                     lookback: int | None = 10, recent: int | None = 5, rows: int = 20,
                     clearance: float = 1.02, volume_factor: float = 1.5) -> DataFrame:
    """Closes that clear the preceding highs on expanded volume.

    ``lookback`` bounds the rows the window sees, ``recent`` the rows
    reported; None takes all. Known breakouts are left out.
    """
    src = since(bars, lookback, as_of).select("symbol", "date", "high", "close", "volume")
    out = src.withColumns({"_res": F.max("high").over(before(rows)),
                           "_vol": avg_before("volume", rows)})
    out = out.filter((F.col("close") > F.col("_res") * clearance)
                     & (F.col("volume") > F.col("_vol") * volume_factor) & (F.col("_res") > 0))
    out = since(out, recent, as_of) if recent is not None else out
    out = out.select("symbol", F.col("date").alias("breakout_date"),
                     F.col("_res").alias("resistance_level"), F.col("close").alias("breakout_price"),
                     F.col("volume").alias("breakout_volume"),
                     ratio("volume", "_vol").alias("volume_ratio"))
    return out if history is None else anti_join_new_rows(out, history, ["symbol", "breakout_date"])


def _aged(history: DataFrame, as_of, youngest: int | None, oldest: int) -> DataFrame:
    """Breakouts between ``youngest`` and ``oldest`` days before the date."""
    day = F.lit(as_of).cast("date")
    out = history.filter((F.col("breakout_date") >= F.date_sub(day, oldest))
                         & (F.col("breakout_date") <= day))
    if youngest is not None:
        out = out.filter(F.col("breakout_date") <= F.date_sub(day, youngest))
    return out


def validate_breakouts(history: DataFrame, bars: DataFrame, as_of, youngest: int = 2,
                       oldest: int = 7, days: int = 5) -> DataFrame:
    """Score the follow-through of breakouts on the bars of the next days."""
    events = _aged(history, as_of, youngest, oldest)
    after = join_date_range(events, bars.select("symbol", "date", "high", "low", "close", "volume"),
                            1, days, "breakout_date")
    stats = after.groupBy("symbol", "breakout_date", "resistance_level", "breakout_price",
                          "breakout_volume", "volume_ratio").agg(
        F.max("high").alias("highest_post_breakout"), F.min("low").alias("lowest_post_breakout"),
        F.avg("volume").alias("avg_volume_post"),
        F.count_if(F.col("close") >= F.col("breakout_price")).alias("days_above_breakout"),
        F.count("*").alias("total_days_observed"))
    now = on_date(bars, as_of).select("symbol", F.col("close").alias("current_price"))
    out = stats.join(now, "symbol").withColumns({
        "price_performance_pct": _percent(F.col("current_price") - F.col("breakout_price"),
                                          F.col("breakout_price")),
        "volume_sustainability_ratio": ratio("breakout_volume", "avg_volume_post")})
    above, seen = F.col("days_above_breakout"), F.col("total_days_observed")
    score = (at_least("price_performance_pct", [(5, 30), (2, 20), (0, 10)], 0)
             + at_least("volume_sustainability_ratio", [(0.8, 25), (0.6, 15), (0.4, 10)], 0)
             + first_match([(above == seen, 25), (above >= seen * 0.8, 20),
                            (above >= seen * 0.6, 15)], 5)
             + at_least("volume_ratio", [(2.0, 20), (1.5, 15), (1.2, 10)], 5))
    out = out.withColumn("validation_score", score)
    return out.select(
        "symbol", "breakout_date", "current_price", "breakout_price", "price_performance_pct",
        "validation_score",
        at_least("validation_score", [(70, "TRUE BREAKOUT - STRONG"),
                                      (50, "TRUE BREAKOUT - MODERATE"), (30, "WEAK BREAKOUT")],
                 "FALSE BREAKOUT").alias("validation_status"),
        at_least("validation_score", [(70, "HOLD/ADD - Strong breakout confirmed"),
                                      (50, "HOLD - Moderate breakout, monitor closely"),
                                      (30, "CAUTION - Weak follow-through")],
                 "EXIT - False breakout detected").alias("recommendation"),
        "days_above_breakout", "total_days_observed")


def retest_opportunities(history: DataFrame, bars: DataFrame, as_of, oldest: int = 15,
                         min_score: int = 40) -> DataFrame:
    """Breakouts that pulled back towards their old resistance."""
    after = join_date_range(_aged(history, as_of, None, oldest),
                            bars.select("symbol", "date", "close", "volume")
                            .filter(F.col("date") <= F.lit(as_of)), 1, oldest, "breakout_date")
    per_event = Window.partitionBy("symbol", "breakout_date").orderBy("date")
    now = on_date(after.withColumn("avg_volume_3d", F.avg("volume").over(
        per_event.rowsBetween(-2, 0))), as_of)
    p, bp, sup = F.col("close"), F.col("breakout_price"), F.col("resistance_level")
    fib618, fib50 = bp * 0.618 + sup * 0.382, bp * 0.5 + sup * 0.5
    now = now.withColumns({
        "current_gain_pct": _percent(p - bp, bp), "distance_to_support_pct": _percent(p - sup, sup),
        "days_since_breakout": F.datediff("date", "breakout_date")})
    gain, cushion, age = (F.col(c) for c in ("current_gain_pct", "distance_to_support_pct",
                                             "days_since_breakout"))
    score = (
        # The second branch cannot match while the 61.8 level lies above the 50 level.
        first_match([((p >= fib50) & (p <= bp * 1.05), 25), ((p >= fib618) & (p <= fib50), 30),
                     ((p >= sup) & (p <= fib618), 15)], 5)
        + first_match([(age.between(2, 7), 20), (age.between(8, 12), 15), (age == 1, 10)], 5)
        + first_match([((gain > 0) & (gain <= 8), 20), ((gain > -3) & (gain <= 0), 25),
                       ((gain > -7) & (gain <= -3), 15)], 5)
        + at_least(cushion, [(2, 15), (0, 10)], 0))
    out = now.withColumn("retest_quality_score", score).filter(
        F.col("retest_quality_score") >= min_score)
    q = F.col("retest_quality_score")
    return out.select(
        "symbol", "breakout_date", F.col("date").alias("retest_date"), "breakout_price",
        p.alias("current_price"), "current_gain_pct", sup.alias("new_support_level"),
        "distance_to_support_pct", "days_since_breakout", "avg_volume_3d", "retest_quality_score",
        at_least(q, [(70, "EXCELLENT RETEST"), (55, "GOOD RETEST"), (40, "FAIR RETEST")],
                 "POOR RETEST").alias("retest_quality"),
        at_least(q, [(70, "STRONG BUY - Excellent entry opportunity"),
                     (55, "BUY - Good risk/reward setup"),
                     (40, "CONSIDER - Monitor for improvement")],
                 "WAIT - Poor retest setup").alias("entry_recommendation"),
        F.when(cushion >= 0, (bp * 1.1 - p) / F.nullif(p - sup, F.lit(0.0))).otherwise(F.lit(1.0))
        .alias("risk_reward_ratio"))


STAGES = (("BREAKOUT", 1, "IMMEDIATE ACTION"), ("RETEST", 2, "ENTRY OPPORTUNITY"),
          ("VALIDATED", 3, "HOLD/MONITOR"), ("SETUP", 4, "PREPARE/WATCH"),
          ("RECOVERY", 5, "WAIT/RESET"))


def fresh_breakouts(bars: DataFrame, as_of, days: int = 3, window: int = 20,
                    clearance: float = 1.02, volume_factor: float = 1.5) -> DataFrame:
    """Recent bars above the highs of the preceding calendar days on expanded volume."""
    src = bars.select("symbol", "date", "high", "close", "volume").withColumns({
        "_high": prior_range(F.max, "high", window, 1),
        "_vol": prior_range(F.avg, "volume", window, 1)})
    hit = src.filter((F.col("close") > F.col("_high") * clearance)
                     & (F.col("volume") > F.col("_vol") * volume_factor))
    return since(hit, days, as_of)


def _stage(kind: str, when: Column, price: Column, target: Column, score: Column, rec: Column,
           text: str) -> Column:
    """One lifecycle row as a struct."""
    return F.struct(F.lit(kind).alias("stage"), when.alias("analysis_date"), price.alias("price"),
                    target.cast("double").alias("target_price"),
                    score.cast("double").alias("score"), rec.alias("recommendation"),
                    F.lit(text).alias("stage_description"))


def lifecycle(relaxed: DataFrame, bars: DataFrame, history: DataFrame, as_of,
              days: tuple[int, int, int, int, int] = (2, 3, 7, 10, 10)) -> DataFrame:
    """All five stages in one list with priority and urgency.

    ``days`` are the ages of setup, breakout, validated, retest and recovery.
    A known breakout is priced once and yields a row for every stage it
    meets.
    """
    day = F.lit(as_of).cast("date")
    setup_days, fresh_days, valid_days, retest_days, recovery_days = days
    setup = since(relaxed, setup_days, as_of, date_col="analysis_date").filter(
        F.col("overall_score") >= 50).select("symbol", F.inline(F.array(_stage(
            "SETUP", day, F.col("current_price"), F.col("target_price"), F.col("overall_score"),
            F.col("recommendation"), "Pre-breakout accumulation detected"))))
    fresh = fresh_breakouts(bars, as_of, fresh_days).select("symbol", F.inline(F.array(_stage(
        "BREAKOUT", F.col("date"), F.col("close"), F.col("high"), F.lit(75),
        F.lit("BREAKOUT DETECTED"), "Fresh breakout with volume confirmation"))))
    now = on_date(bars, as_of).select("symbol", "close")
    known = _aged(history, as_of, None, max(valid_days, retest_days, recovery_days)).join(now,
                                                                                         "symbol")
    age = F.datediff(day, "breakout_date")
    c, bp, res = F.col("close"), F.col("breakout_price"), F.col("resistance_level")
    met = F.array_compact(F.array(
        F.when((age <= valid_days) & (c >= bp * 0.98), _stage(
            "VALIDATED", day, c, bp * 1.15, F.lit(85), F.lit("VALIDATED TRUE BREAKOUT"),
            "Breakout confirmed with follow-through")),
        F.when((age <= retest_days) & (c >= res) & (c <= bp * 1.05), _stage(
            "RETEST", day, c, bp * 1.1, F.lit(70), F.lit("RETEST ENTRY"),
            "Retest opportunity - GOOD RETEST")),
        F.when((age <= recovery_days) & (c < bp * 0.95), _stage(
            "RECOVERY", day, c, res, F.lit(40), F.lit("MONITOR RECOVERY"),
            "False breakout - wait for new setup"))))
    out = setup.unionByName(fresh).unionByName(known.select("symbol", F.inline(met)))
    name = F.col("stage")
    return out.withColumns({
        "stage_priority": first_match([(name == n, p) for n, p, _ in STAGES], None),
        "action_urgency": first_match([(name == n, u) for n, _, u in STAGES], None)})
