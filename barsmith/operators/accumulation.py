"""Accumulation scoring, institutional flow and smart-money screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.frames import avg_n, on_date, running, since
from barsmith.functions.scalar import (buy_sell_ratio, clamp, cut, first_match, foreign_share,
                                       large_block, pct_change_or_zero, price_impact, ratio)
from barsmith.operators import indicators as I
from barsmith.operators.market import liquid_universe
from barsmith.operators.ranking import top_k, union_tagged, with_pct_rank_avg, with_rank

SCORE_EDGES = [0, 40, 60, 80, 100]
SCORE_LABELS = ["No Signal", "Weak", "Moderate", "Strong"]


def with_accumulation_indicators(bars: DataFrame) -> DataFrame:
    """All indicators the score needs, stacked over one exchange."""
    src = bars.withColumns({
        "foreign_buy": F.coalesce("foreign_buy", F.lit(0)),
        "foreign_sell": F.coalesce("foreign_sell", F.lit(0)),
        "listed_shares": F.coalesce("listed_shares", F.lit(1_000_000_000)),
        "percent_change": pct_change_or_zero("close", "prev_close")})
    src = src.withColumn("foreign_net", F.col("foreign_buy") - F.col("foreign_sell"))
    out = I.with_order_flow(I.with_chaikin(I.with_ad_line(src)))
    return I.with_support_strength(I.with_atr(I.with_volume_profile(out)))


def accumulation_score(bars: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """0..100 score from volume, price action, institutional activity and strength."""
    return scored(with_accumulation_indicators(bars), splits)


def scored(indicators: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """The score of rows that have their indicators; strength is ranked inside each date."""
    out = with_pct_rank_avg(indicators, "percent_change", "relative_strength", by=["date"],
                            splits=splits)

    def unit(c: Column) -> Column:
        return F.coalesce(clamp(c, 0.0, 1.0), F.lit(0.0))

    score = (unit(F.col("relative_volume") / 3) * 20 + unit(F.col("ofi") * 10 + 0.5) * 10
             + F.col("range_contraction") * 15 + unit(F.col("support_strength")) * 10
             + unit(F.col("foreign_buy_ratio") * 2) * 15 + F.col("large_block_ratio") * 10
             + unit(F.col("relative_strength")) * 15 + unit(F.col("cmf") * 10 + 0.5) * 5)
    out = out.withColumn("accumulation_score", score)
    return out.withColumn("signal_strength", cut("accumulation_score", SCORE_EDGES, SCORE_LABELS))


SIGNAL_COLUMNS = ["symbol", "analysis_date", "accumulation_score", "signal_strength",
                  "foreign_net", "relative_volume", "ad_line", "cmf", "ofi", "price_tightening",
                  "support_strength", "close_price"]


def accumulation_screen(bars: DataFrame, as_of=None, days: int = 60, min_value: float = 15e9,
                        min_score: float = 60, min_volume: float = 1.2,
                        universe: dict | None = None) -> DataFrame:
    """Candidates of the date inside the liquid universe."""
    src = liquid_universe(bars, as_of, days, **(universe or {}))
    # Strength is ranked inside a date, so only the rows of this one go through the ranks.
    day = scored(on_date(with_accumulation_indicators(src), as_of))
    hit = day.filter((F.col("value") >= min_value) & (F.col("accumulation_score") >= min_score)
                     & (F.col("foreign_net") > 0) & (F.col("relative_volume") > min_volume))
    return hit.withColumns({"analysis_date": F.col("date"), "close_price": F.col("close")}).select(
        *SIGNAL_COLUMNS)


def accumulation_overview(signals: DataFrame) -> DataFrame:
    """Counts and averages over stored signals."""
    s = F.col("accumulation_score")
    return signals.agg(F.count("*").alias("total_stocks_analyzed"),
                       F.count_if(s >= 80).alias("strong_signals"),
                       F.count_if(s >= 60).alias("moderate_plus_signals"),
                       F.avg("foreign_net").alias("avg_foreign_net"),
                       F.avg("relative_volume").alias("avg_relative_volume"))


def accumulation_top(signals: DataFrame, bars: DataFrame, k: int = 15) -> DataFrame:
    """Best signals with company name and score band."""
    names = bars.select("symbol", F.col("date").alias("analysis_date"), "name")
    s = F.col("accumulation_score")
    band = first_match([(s >= 80, "hot"), (s >= 60, "active")], "watch")
    out = signals.join(names, ["symbol", "analysis_date"]).select(
        "symbol", "name", "accumulation_score", "signal_strength", "foreign_net",
        "relative_volume", "close_price", "cmf", "ofi", band.alias("score_band"))
    return top_k(out, [s.desc()], k)


def top_net_buyers(bars: DataFrame, as_of=None, k: int = 10) -> DataFrame:
    """Fallback when no signal was found: largest foreign net buying of the date."""
    net = F.col("foreign_buy") - F.col("foreign_sell")
    day = on_date(bars, as_of).filter((net > 0) & (F.col("volume") > 0)).select(
        "symbol", "name", "close", net.alias("foreign_net"), "volume")
    return top_k(day, [F.col("foreign_net").desc()], k)


# --- institutional flow --------------------------------------------------------------


def foreign_flow(bars: DataFrame, as_of=None) -> DataFrame:
    """Participation measures, both ranks and the flow pattern of every symbol of the date."""
    buy, sell = F.coalesce("foreign_buy", F.lit(0)), F.coalesce("foreign_sell", F.lit(0))
    day = on_date(bars, as_of).filter((F.col("volume") > 0)
                                      & (F.col("foreign_buy") + F.col("foreign_sell") > 0))
    raw = ratio(buy + sell, "volume")
    day = day.select(
        "symbol", "name", buy.alias("foreign_buy"), sell.alias("foreign_sell"),
        (buy - sell).alias("foreign_net"), "volume", "close", "value",
        raw.alias("foreign_participation_method1"),
        (raw * 100).alias("foreign_participation_method2"),
        (foreign_share() * 100).alias("foreign_participation"),
        buy_sell_ratio().alias("buy_sell_ratio"))
    day = with_rank(day, "foreign_net", "net_rank", descending=True)
    day = with_rank(day, "foreign_participation", "participation_rank", descending=True)
    net, part = F.col("foreign_net"), F.col("foreign_participation")
    return day.withColumn("flow_pattern", first_match(
        [
            ((net > 0) & (part > 0.3), "Strong Accumulation"),
            ((net > 0) & (part > 0.15), "Moderate Accumulation"),
            (net > 0, "Weak Accumulation"),
            ((net < 0) & (part > 0.3), "Strong Distribution"),
            ((net < 0) & (part > 0.15), "Moderate Distribution"),
        ],
        "Weak Distribution",
    ))


def institutional_flow(bars: DataFrame, as_of=None, min_net: int = 1000, k: int = 20) -> DataFrame:
    flow = foreign_flow(bars, as_of).filter(F.abs("foreign_net") > min_net)
    return top_k(flow, [F.col("foreign_net").desc()], k)


def flow_summary(flow: DataFrame) -> DataFrame:
    """Total net flow and mean participation, the latter capped at 100 per symbol."""
    return flow.agg(F.sum("foreign_net").alias("total_net_flow"),
                    F.avg(F.least("foreign_participation", F.lit(100.0)))
                    .alias("avg_participation"),
                    F.count_if(F.col("foreign_net") > 0).alias("accumulating"),
                    F.count_if(F.col("foreign_net") < 0).alias("distributing"))


# --- smart money ------------------------------------------------------------------------


def with_smart_money(bars: DataFrame) -> DataFrame:
    src = bars.filter(F.col("volume") > 0)
    out = src.withColumns({
        "volume_ratio": ratio("volume", avg_n("volume", 20)),
        "value_ratio": ratio("value", avg_n("value", 20)),
        "foreign_participation": foreign_share(),
        "large_block": large_block(), "price_impact": price_impact()})
    r, part = F.col("volume_ratio"), F.col("foreign_participation")
    return out.withColumn("smart_money_score", first_match(
        [((r > 2) & (part > 0.2) & (F.col("price_impact") < 2), 3),
         ((r > 1.5) & (part > 0.15), 2), (r > 1.2, 1)], 0))


SMART_COLUMNS = ["symbol", "name", "date", "volume", "value", "close", "volume_ratio",
                 "value_ratio", "foreign_participation", "large_block", "price_impact",
                 "smart_money_score"]


def smart_money(bars: DataFrame, as_of=None, days: int = 25, k: int = 15) -> DataFrame:
    day = on_date(with_smart_money(since(bars, days, as_of)), as_of)
    out = day.filter(F.col("smart_money_score") > 0).select(*SMART_COLUMNS)
    return top_k(out, [F.col("smart_money_score").desc(), F.col("volume_ratio").desc()], k)


def hidden_accumulation(smart: DataFrame) -> DataFrame:
    """Busy, foreign-driven rows whose price hardly moved."""
    return smart.filter((F.col("volume_ratio") > 1.5) & (F.col("price_impact") < 1.5)
                        & (F.col("foreign_participation") > 0.2))


def ad_leaders(bars: DataFrame, as_of=None, days: int = 40, k: int = 10) -> DataFrame:
    """Largest accumulation and distribution by A/D line on the date."""
    out = since(bars, days, as_of).withColumn("money_flow_volume", I.plain_money_flow())
    out = out.withColumn("ad_line", F.sum("money_flow_volume").over(running()))
    day = on_date(out, as_of).select("symbol", "date", "money_flow_volume", "ad_line", "name",
                                     "close")
    flow, line = F.col("money_flow_volume"), F.col("ad_line")
    return union_tagged({"accumulation": top_k(day.filter(flow > 0), [line.desc()], k),
                         "distribution": top_k(day.filter(flow < 0), [line.asc()], k)}, "type")
