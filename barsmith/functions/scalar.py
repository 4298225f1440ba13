"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barsmith.params import TIMEFRAMES, Timeframe

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den as double; NULL on a zero divisor (ANSI mode would raise)."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def first_match(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Ordered CASE: value of the first condition that holds."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def at_least(c: ColumnLike, steps: Sequence[tuple[float, object]], default: object) -> Column:
    """Step function: value of the first threshold reached, highest first."""
    return first_match([(col(c) >= t, v) for t, v in steps], default)


def at_most(c: ColumnLike, steps: Sequence[tuple[float, object]], default: object) -> Column:
    return first_match([(col(c) <= t, v) for t, v in steps], default)


def clamp(c: ColumnLike, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (LEAST and GREATEST would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


# --- percent changes -------------------------------------------------------


def pct_change_or_zero(cur: ColumnLike, prev: ColumnLike) -> Column:
    """Percent change, 0 where the base is zero or missing."""
    return F.coalesce((col(cur) - col(prev)) / F.nullif(col(prev), F.lit(0.0)) * 100, F.lit(0.0))


def pct_change(cur: ColumnLike, prev: ColumnLike) -> Column:
    """Percent change, NULL where the base is zero or missing."""
    return (col(cur) - col(prev)) / F.nullif(col(prev), F.lit(0.0)) * 100


def return_fraction(cur: ColumnLike, prev: ColumnLike) -> Column:
    """Return as a fraction; 0 unless the base is positive."""
    return F.when(col(prev) > 0, (col(cur) - col(prev)) / col(prev)).otherwise(F.lit(0.0))


# --- order flow ------------------------------------------------------------


def foreign_net(buy: ColumnLike = "foreign_buy", sell: ColumnLike = "foreign_sell") -> Column:
    return col(buy) - col(sell)


def foreign_in_lots(side: ColumnLike, buy: ColumnLike = "foreign_buy",
                    sell: ColumnLike = "foreign_sell", volume: ColumnLike = "volume") -> Column:
    """Foreign volume in the unit of ``volume``.

    When both sides together exceed the traded volume the feed reported
    shares, so one hundredth of it is lots.
    """
    side = col(side).cast("double")
    return F.when(col(buy) + col(sell) > col(volume), side / 100.0).otherwise(side)


def foreign_share(buy: ColumnLike = "foreign_buy", sell: ColumnLike = "foreign_sell",
                  volume: ColumnLike = "volume") -> Column:
    """Foreign participation as a fraction of volume, unit-corrected; 0 without volume."""
    total = (F.coalesce(col(buy), F.lit(0)) + F.coalesce(col(sell), F.lit(0))).cast("double")
    part = ratio(total, volume)
    return F.when(col(volume) > 0, F.when(part <= 1.0, part).otherwise(part / 100.0)).otherwise(
        F.lit(0.0))


def buy_sell_ratio(buy: ColumnLike = "foreign_buy", sell: ColumnLike = "foreign_sell") -> Column:
    """Buy over sell; 999.99 stands for an infinite ratio."""
    buy, sell = F.coalesce(col(buy), F.lit(0)), F.coalesce(col(sell), F.lit(0))
    return first_match([(sell > 0, ratio(buy, sell)), (buy > 0, 999.99)], 0.0)


def bid_ask_ratio(bid: ColumnLike = "bid_volume", offer: ColumnLike = "offer_volume") -> Column:
    return F.when(col(offer) > 0, ratio(bid, offer))


def price_impact(close: ColumnLike = "close", open_: ColumnLike = "open_price") -> Column:
    return F.abs(col(close) - col(open_)) / F.nullif(col(open_), F.lit(0.0)) * 100


def large_block(volume: ColumnLike = "volume", shares: ColumnLike = "listed_shares") -> Column:
    return F.when(col(volume) > col(shares) * 0.005, F.lit(1)).otherwise(F.lit(0))


# --- levels, labels --------------------------------------------------------


def trade_levels(close: ColumnLike, tf: Timeframe | str) -> dict[str, Column]:
    """Take-profit and stop levels of a timeframe."""
    tf = TIMEFRAMES[tf] if isinstance(tf, str) else tf
    c = col(close)
    return {"tp1": c * tf.take_profit_1, "tp2": c * tf.take_profit_2, "stop_loss": c * tf.stop_loss}


def price_action_label(prev_high: Column) -> Column:
    """Shape of the bar relative to its range and the previous high."""
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    return first_match(
        [
            ((close > F.col("open_price")) & (close >= high * 0.95), "Strong Close"),
            (close > (high + low) / 2, "Above Midpoint"),
            (low > prev_high, "Gap Up"),
        ],
        "Neutral",
    )


def expected_rebound(change: ColumnLike, score: ColumnLike) -> Column:
    """Share of the decline expected back, capped by conviction."""
    drop = F.abs(col(change))
    return first_match(
        [
            (col(score) >= 15, F.least(drop * 0.4, F.lit(15.0))),
            (col(score) >= 10, F.least(drop * 0.3, F.lit(10.0))),
        ],
        F.least(drop * 0.2, F.lit(5.0)),
    )


def next_business_day(d: ColumnLike) -> Column:
    """Following weekday; Saturdays and Sundays are skipped."""
    d = col(d)
    step = first_match([(F.weekday(d) == 4, 3), (F.weekday(d) == 5, 2)], 1)
    return F.date_add(d, step)


def text_of(value: ColumnLike) -> Column:
    """String form for labels; a missing value reads as the empty string."""
    return F.coalesce(col(value).cast("string"), F.lit(""))


def cut(c: ColumnLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with the lowest edge included; NULL outside."""
    c = col(c)
    inside = (c >= edges[0]) & (c <= edges[-1])
    return F.when(inside, first_match([(c <= e, lab) for e, lab in zip(edges[1:], labels)], None))
