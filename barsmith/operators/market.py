"""Market summaries and performance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.functions.frames import on_date, since
from barsmith.functions.scalar import first_match, pct_change, pct_change_or_zero, return_fraction
from barsmith.operators.ranking import abs_desc, latest_per, top_k, union_tagged
from barsmith.operators.relational import semi_join_having


def daily_metrics(bars: DataFrame) -> DataFrame:
    """Bar columns with percent change, intraday range measures and net foreign flow."""
    spread = (F.col("high") - F.col("low")) / F.nullif(F.col("low"), F.lit(0.0)) * 100
    return bars.select(
        "symbol", "name", "date", "prev_close", "open_price", "high", "low", "close", "change",
        pct_change("close", "prev_close").alias("percent_change"),
        spread.alias("intraday_volatility"),
        (F.col("high") - F.col("low")).alias("daily_range"),
        spread.alias("low_to_high_percent"),
        "volume", "value", "frequency",
        (F.col("foreign_buy") - F.col("foreign_sell")).alias("foreign_net"))


def dim_companies(bars: DataFrame) -> DataFrame:
    """Latest known attributes per symbol."""
    out = latest_per(bars.select("symbol", "date", "name", "listed_shares", "tradable_shares"))
    return out.select("symbol", "name", "listed_shares", "tradable_shares",
                      F.col("date").alias("last_updated_date"))


def performance_daily(bars: DataFrame, companies: DataFrame, as_of=None) -> DataFrame:
    """Return of the latest day per symbol."""
    out = on_date(bars.drop("name"), as_of).join(companies.select("symbol", "name"), "symbol")
    return out.select("symbol", "name", F.col("date").alias("day"), "prev_close", "close",
                      "volume", "value",
                      return_fraction("close", "prev_close").alias("daily_return"))


def performance_period(bars: DataFrame, companies: DataFrame, unit: str, as_of=None) -> DataFrame:
    """The latest week or month per symbol: mean daily return, volume, first and last close.

    Only bars of that period are read; first and last close come out of the
    same aggregation, so the bars are not joined to themselves.
    """
    start = f"{unit}_starting"
    prefix = f"{unit}ly"
    src = bars.select("symbol", "date", "close", "prev_close", "volume")
    if as_of is not None:
        first_day = F.trunc(F.lit(as_of).cast("date"), unit)
        src = src.filter((F.col("date") >= first_day) & (F.col("date") <= F.lit(as_of)))
    else:
        edge = src.agg(F.trunc(F.max("date"), unit).alias("_start"))
        src = src.crossJoin(F.broadcast(edge)).filter(F.col("date") >= F.col("_start"))
    out = (src.withColumn("_r", return_fraction("close", "prev_close"))
           .groupBy("symbol", F.trunc("date", unit).alias(start)).agg(
               F.avg("_r").alias("avg_daily_return"),
               F.sum("volume").alias(f"{prefix}_volume"),
               F.min_by("close", "date").alias(f"{unit}_open"),
               F.max_by("close", "date").alias(f"{unit}_close")))
    out = out.join(companies.select("symbol", "name"), "symbol")
    return out.select("symbol", "name", start, "avg_daily_return", f"{prefix}_volume",
                      f"{unit}_open", f"{unit}_close",
                      return_fraction(f"{unit}_close", f"{unit}_open").alias(f"{prefix}_return"))


def market_kpis(bars: DataFrame, as_of=None) -> DataFrame:
    """Totals, mean change, gainers and losers of the latest date in one pass."""
    priced = F.col("prev_close") > 0
    change = F.when(priced, (F.col("close") - F.col("prev_close")) / F.col("prev_close") * 100)
    return on_date(bars, as_of).agg(
        F.count_distinct("symbol").alias("total_stocks"),
        F.avg(change).alias("avg_change"),
        F.sum("volume").alias("total_volume"),
        F.sum("value").alias("total_value"),
        F.count_if(priced & (F.col("close") > F.col("prev_close"))).alias("gainers"),
        F.count_if(priced & (F.col("close") < F.col("prev_close"))).alias("losers"))


def top_movers(bars: DataFrame, k: int = 15, as_of=None) -> DataFrame:
    out = on_date(bars, as_of).filter(F.col("prev_close") > 0).select(
        "symbol", "name", "close", "prev_close",
        pct_change_or_zero("close", "prev_close").alias("percent_change"), "volume")
    return top_k(out, [abs_desc("percent_change")], k)


def top_by(metrics: DataFrame, column: str, k: int = 10, as_of=None, descending: bool = True,
           beyond: float | None = None) -> DataFrame:
    """Top k of the latest date by a metric, optionally only beyond a threshold."""
    c = F.col(column)
    out = on_date(metrics, as_of).filter(c.isNotNull()).select("symbol", "name", column)
    if beyond is not None:
        out = out.filter(c > beyond if descending else c < beyond)
    return top_k(out, [c.desc_nulls_last() if descending else c.asc_nulls_last()], k)


def market_highlights(metrics: DataFrame, k: int = 3, as_of=None) -> DataFrame:
    """Top gainers, losers and most active of the latest date."""
    day = on_date(metrics, as_of).filter(F.col("prev_close") > 0).select(
        "symbol", "name", "percent_change", "volume")
    pc = F.col("percent_change")
    return union_tagged({
        "Top Gainer": top_k(day.filter(pc > 0), [pc.desc()], k),
        "Top Loser": top_k(day.filter(pc < 0), [pc.asc()], k),
        "Most Active": top_k(day, [F.col("volume").desc()], k),
    }, "category")


def quick_stats(bars: DataFrame, as_of=None, move: float = 5.0,
                busy: int = 10_000_000) -> DataFrame:
    change = pct_change("close", "prev_close")
    day = on_date(bars, as_of).filter((F.col("volume") > 0) & (F.col("prev_close") > 0))
    return day.agg(
        F.count_if(change > move).alias("big_gainers"),
        F.count_if(change < -move).alias("big_losers"),
        F.count_if(F.col("volume") > busy).alias("high_volume_stocks"),
        F.count("*").alias("total_active_stocks"),
        F.avg("volume").alias("avg_volume"), F.max("volume").alias("max_volume"))


def volume_leaders(bars: DataFrame, k: int = 8, as_of=None) -> DataFrame:
    day = on_date(bars, as_of).filter((F.col("volume") > 0) & (F.col("prev_close") > 0)).select(
        "symbol", "name", "volume",
        pct_change_or_zero("close", "prev_close").alias("percent_change"))
    return top_k(day, [F.col("volume").desc()], k)


def stock_movement(metrics: DataFrame, symbol: str, days: int = 30, as_of=None) -> DataFrame:
    """Recent rows of one symbol."""
    return since(metrics, days, as_of).filter(F.col("symbol") == symbol).select(
        "symbol", "name", "date", "close", "prev_close", "percent_change", "volume", "value",
        "high", "low", "open_price", "foreign_net")


def stock_history(metrics: DataFrame, rsi: DataFrame, macd: DataFrame, symbol: str, days: int,
                  as_of=None) -> DataFrame:
    """One symbol's bars with RSI and MACD where present."""
    pick = F.col("symbol") == symbol
    base = since(metrics, days, as_of).filter(pick).select(
        "symbol", "name", "date", "open_price", "high", "low", "close", "volume",
        "percent_change", "value")
    r = rsi.filter(pick).select("symbol", "date", "rsi", "rsi_signal")
    m = macd.filter(pick).select("symbol", "date", "macd_line", "signal_line", "macd_histogram",
                                 "macd_signal")
    return base.join(r, ["symbol", "date"], "left").join(m, ["symbol", "date"], "left")


def available_symbols(bars: DataFrame, as_of=None) -> DataFrame:
    """Symbols traded on the latest date."""
    return on_date(bars, as_of).select("symbol", "name").distinct()


def symbols_with_indicators(metrics: DataFrame, rsi: DataFrame, days: int = 30,
                            as_of=None) -> DataFrame:
    """Symbols that have an RSI row in the look-back."""
    recent = since(rsi.select("symbol", "date"), days, as_of)
    return recent.join(metrics.select("symbol", "date", "name"), ["symbol", "date"]).select(
        "symbol", "name").distinct()


def summary_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, minimum and maximum of numeric columns, one row per column."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(c).cast("double").alias(f"{c}__{s}") for c in columns
                    for s, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns])
    return wide.select(F.inline(rows))


def liquid_universe(bars: DataFrame, as_of=None, days: int = 60, min_value: float = 5e9,
                    min_cap: float = 1e12) -> DataFrame:
    """Traded bars of the look-back for symbols large enough on the latest date."""
    base = since(bars, days, as_of).filter((F.col("volume") > 0) & (F.col("value") >= min_value))
    day = on_date(base, as_of)
    return semi_join_having(base, F.col("market_cap") >= min_cap,
                            F.max(F.col("close") * F.col("listed_shares")).alias("market_cap"),
                            within=day)


def final_label(macd: str = "macd_signal", rsi: str = "rsi_signal",
                news: str = "news_trading_signal"):
    """Combined label; a news label counts by its Buy or Sell wording."""
    m, r, n = F.col(macd), F.col(rsi), F.coalesce(F.col(news), F.lit(""))
    buy, sell = n.isin("Buy Signal", "Strong Buy Signal"), n.isin("Sell Signal",
                                                                  "Strong Sell Signal")
    m, r = F.coalesce(m, F.lit("")), F.coalesce(r, F.lit(""))
    return first_match(
        [
            ((m == "Bullish") & (r == "Overbought") & buy, "Bullish Strong"),
            ((m == "Bearish") & (r == "Oversold") & sell, "Bearish Strong"),
            ((m == "Bullish") | (r == "Overbought") | buy, "Bullish"),
            ((m == "Bearish") | (r == "Oversold") | sell, "Bearish"),
        ],
        "Neutral",
    )


def signal_dashboard(technical: DataFrame, sentiment: DataFrame, forecasts: DataFrame,
                     as_of=None, days: int = 90) -> DataFrame:
    """Metrics and indicators per bar with news sentiment and forecast.

    ``technical`` carries the metrics with RSI and MACD columns of the same
    (symbol, date) windows, so only news and forecasts are joined.
    """
    base = since(technical, days, as_of).select(
        "symbol", "date", "close", "volume", "percent_change", "rsi", "rsi_signal", "macd_line",
        "macd_signal", "macd_histogram")
    news = sentiment.select("symbol", "date", "avg_sentiment", "positive_percentage",
                            "negative_percentage",
                            F.col("trading_signal").alias("news_trading_signal"))
    ahead = forecasts.select(
        "symbol", F.col("prediction_date").alias("date"), "predicted_close",
        F.col("prediction_direction").alias("forecast_direction"), "actual_close",
        "prediction_error", "error_percentage")
    out = base.join(news, ["symbol", "date"], "left").join(ahead, ["symbol", "date"], "left")
    gap = F.col("predicted_close") - F.col("close")
    return out.withColumns({
        "prediction_gap": gap,
        "prediction_gap_pct": gap / F.nullif(F.col("close"), F.lit(0.0)) * 100,
        "final_signal": final_label()})
