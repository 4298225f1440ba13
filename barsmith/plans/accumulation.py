"""Accumulation, institutional flow and smart-money queries."""

from __future__ import annotations

from barsmith.operators import accumulation as A
from barsmith.plans.indicators import ATR, FLOW
from barsmith.plans.inputs import bars, latest_date
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import bars_sql

LATEST = "(SELECT d FROM anchor)"


def _score_cte(source):
    """The eight components rebuilt over ``source`` (a filtered bars CTE)."""
    return f""", sc0 AS (
  SELECT *, row_number() OVER o AS rn,
    CASE WHEN prev_close > 0 THEN (close - prev_close) / prev_close * 100 ELSE 0 END AS pc,
    foreign_buy / (foreign_buy + foreign_sell + 1e-9) AS fbr,
    ((close - low) - (high - close)) / (high - low + 1e-9) * volume
      * (foreign_buy / (foreign_buy + foreign_sell + 1e-9)) AS mfv,
    CASE WHEN prev_close IS NOT NULL
         THEN greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS tr,
    min(low) OVER (o ROWS 19 PRECEDING) AS lo20, list(low) OVER (o ROWS 19 PRECEDING) AS lows,
    volume / (avg(volume) OVER (o ROWS 19 PRECEDING) + 1e-9) AS relative_volume
  FROM {source} WINDOW o AS (PARTITION BY symbol ORDER BY date)
), sc1 AS (
  SELECT *, avg(tr) OVER (o ROWS 13 PRECEDING) AS atr, sum(mfv) OVER (o ROWS UNBOUNDED PRECEDING)
      AS ad_line,
    coalesce(sum(mfv * foreign_buy / (volume + 1e-9)) OVER (o ROWS 19 PRECEDING)
      / sum(volume) OVER (o ROWS 19 PRECEDING), 0) AS cmf,
    (foreign_buy - foreign_sell) / (volume + 1e-9) AS ofi,
    CASE WHEN rn > 20 THEN least(1e0, len(list_filter(lows, lambda x: x - lo20 <= lo20 * 2e-2)) / 5e0)
         ELSE 0e0 END AS support_strength
  FROM sc0 WINDOW o AS (PARTITION BY symbol ORDER BY date)
), sc2 AS (
  SELECT *, coalesce(CAST(atr - lag(atr, 5) OVER (PARTITION BY symbol ORDER BY date) < 0 AS INT), 0)
      AS contraction, (high - low) / (atr + 1e-9) AS price_tightening,
    (rank() OVER (PARTITION BY date ORDER BY pc) + (count(*) OVER (PARTITION BY date, pc) - 1) / 2e0)
      / count(*) OVER (PARTITION BY date) AS rs
  FROM sc1
), score AS (
  SELECT *, least(1, greatest(0, relative_volume / 3)) * 20
    + least(1, greatest(0, ofi * 10 + 0.5e0)) * 10 + contraction * 15 + support_strength * 10
    + least(1, greatest(0, fbr * 2)) * 15 + CASE WHEN volume * 200 > listed_shares THEN 10 ELSE 0 END
    + rs * 15 + least(1, greatest(0, cmf * 10 + 0.5e0)) * 5 AS accumulation_score
  FROM sc2)"""


BAND = ("CASE WHEN accumulation_score <= 40 THEN 'No Signal' WHEN accumulation_score <= 60 "
        "THEN 'Weak' WHEN accumulation_score <= 80 THEN 'Moderate' ELSE 'Strong' END")


@query("accumulation_score", bars_sql(f"""
SELECT symbol, date, accumulation_score, {BAND} AS signal_strength, rs AS relative_strength
FROM score""", _score_cte("bars")), "accumulation_score relative_strength")
def _(spark, sf):
    return A.accumulation_score(bars(spark, sf)).select(
        "symbol", "date", "accumulation_score", "signal_strength", "relative_strength")


UNIVERSE = f""", base AS (SELECT * FROM bars WHERE date >= {LATEST} - 60 AND volume > 0
                            AND value >= 5e9),
univ AS (SELECT * FROM base WHERE symbol IN (SELECT symbol FROM base WHERE date = {LATEST}
         GROUP BY symbol HAVING max(close * listed_shares) >= 1e12))"""

SCREEN = UNIVERSE + _score_cte("univ") + f""", screen AS (
  SELECT symbol, name, date AS analysis_date, accumulation_score, {BAND} AS signal_strength,
         foreign_buy - foreign_sell AS foreign_net, relative_volume, ad_line, cmf, ofi,
         price_tightening, support_strength, close AS close_price
  FROM score WHERE date = {LATEST} AND value >= 15e9 AND accumulation_score >= 50
    AND foreign_buy > foreign_sell AND relative_volume > 1)"""

SCREEN_ROUND = "accumulation_score relative_volume ad_line:2 cmf ofi price_tightening"


def screen(spark, sf):
    # Score and volume bounds a little below the defaults, for more hits.
    return A.accumulation_screen(bars(spark, sf), latest_date(spark, sf),
                                 min_score=50, min_volume=1.0)


@query("accumulation_screen", bars_sql("SELECT * EXCLUDE (name) FROM screen", SCREEN), SCREEN_ROUND)
def _(spark, sf):
    return screen(spark, sf)


@query("accumulation_overview", bars_sql("""
SELECT count(*) AS total_stocks_analyzed, count(*) FILTER (accumulation_score >= 80)
         AS strong_signals, count(*) FILTER (accumulation_score >= 60) AS moderate_plus_signals,
       avg(foreign_net) AS avg_foreign_net, avg(relative_volume) AS avg_relative_volume
FROM screen""", SCREEN), "avg_foreign_net avg_relative_volume")
def _(spark, sf):
    return A.accumulation_overview(screen(spark, sf))


@query("accumulation_top", bars_sql("""
SELECT symbol, name, accumulation_score, signal_strength, foreign_net, relative_volume, close_price,
       cmf, ofi, CASE WHEN accumulation_score >= 80 THEN 'hot' WHEN accumulation_score >= 60
                      THEN 'active' ELSE 'watch' END AS score_band
FROM screen ORDER BY accumulation_score DESC, symbol LIMIT 15""", SCREEN),
       "accumulation_score relative_volume cmf ofi")
def _(spark, sf):
    return A.accumulation_top(screen(spark, sf), bars(spark, sf))


@query("top_net_buyers", bars_sql(f"""
SELECT symbol, name, close, foreign_buy - foreign_sell AS foreign_net, volume FROM bars
WHERE date = {LATEST} AND foreign_buy > foreign_sell AND volume > 0
ORDER BY foreign_net DESC, symbol LIMIT 10"""))
def _(spark, sf):
    return A.top_net_buyers(bars(spark, sf), latest_date(spark, sf))


FOREIGN = f""", ff AS (
  SELECT symbol, name, foreign_buy, foreign_sell, foreign_buy - foreign_sell AS foreign_net, volume,
    close, value, (foreign_buy + foreign_sell) / CAST(volume AS DOUBLE) AS share,
    CASE WHEN foreign_sell > 0 THEN foreign_buy / CAST(foreign_sell AS DOUBLE) ELSE 999.99e0 END
      AS buy_sell_ratio
  FROM bars WHERE date = {LATEST} AND volume > 0 AND foreign_buy + foreign_sell > 0
), flowtab AS (
  SELECT symbol, name, foreign_buy, foreign_sell, foreign_net, volume, close, value,
    share AS foreign_participation_method1, share * 100 AS foreign_participation_method2,
    share * CASE WHEN share <= 1 THEN 100 ELSE 1 END AS foreign_participation, buy_sell_ratio,
    rank() OVER (ORDER BY foreign_net DESC) AS net_rank,
    rank() OVER (ORDER BY share * CASE WHEN share <= 1 THEN 100 ELSE 1 END DESC)
      AS participation_rank,
    CASE WHEN foreign_net = 0 OR (foreign_net < 0 AND share * 100 <= 0.15) THEN 'Weak Distribution'
         ELSE CASE WHEN share * 100 > 0.3 THEN 'Strong' WHEN share * 100 > 0.15 THEN 'Moderate'
                   ELSE 'Weak' END
              || CASE WHEN foreign_net > 0 THEN ' Accumulation' ELSE ' Distribution' END END
      AS flow_pattern
  FROM ff)"""
FLOW_ROUND = ("foreign_participation_method1 foreign_participation_method2 foreign_participation "
              "buy_sell_ratio")


@query("foreign_flow", bars_sql("SELECT * FROM flowtab", FOREIGN), FLOW_ROUND)
def _(spark, sf):
    return A.foreign_flow(bars(spark, sf), latest_date(spark, sf))


@query("institutional_flow", bars_sql("""
SELECT * FROM flowtab WHERE abs(foreign_net) > 1000 ORDER BY foreign_net DESC, symbol LIMIT 20""",
                                      FOREIGN), FLOW_ROUND)
def _(spark, sf):
    return A.institutional_flow(bars(spark, sf), latest_date(spark, sf))


@query("flow_summary", bars_sql("""
SELECT CAST(sum(foreign_net) AS BIGINT) AS total_net_flow,
       avg(least(foreign_participation, 100)) AS avg_participation,
       count(*) FILTER (foreign_net > 0) AS accumulating,
       count(*) FILTER (foreign_net < 0) AS distributing FROM flowtab""", FOREIGN),
       "avg_participation")
def _(spark, sf):
    return A.flow_summary(A.foreign_flow(bars(spark, sf), latest_date(spark, sf)))


def _smart_cte(where=""):
    return f""", sm0 AS (
  SELECT *, volume / nullif(avg(volume) OVER w, 0) AS volume_ratio,
    value / nullif(avg(value) OVER w, 0) AS value_ratio,
    (foreign_buy + foreign_sell) / CAST(volume AS DOUBLE) AS foreign_participation,
    CASE WHEN volume * 200 > listed_shares THEN 1 ELSE 0 END AS large_block,
    abs(close - open_price) / nullif(open_price, 0) * 100 AS price_impact
  FROM bars WHERE volume > 0 {where} WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)
), sm AS (
  SELECT symbol, name, date, volume, value, close, volume_ratio, value_ratio, foreign_participation,
    large_block, price_impact,
    CASE WHEN volume_ratio > 2 AND foreign_participation > 0.2 AND price_impact < 2 THEN 3
         WHEN volume_ratio > 1.5 AND foreign_participation > 0.15 THEN 2
         WHEN volume_ratio > 1.2 THEN 1 ELSE 0 END AS smart_money_score
  FROM sm0)"""


SMART_ROUND = "volume_ratio value_ratio foreign_participation price_impact"


@query("smart_money", bars_sql(f"""
SELECT * FROM sm WHERE date = {LATEST} AND smart_money_score > 0
ORDER BY smart_money_score DESC, volume_ratio DESC, symbol LIMIT 15""",
                               _smart_cte(f"AND date >= {LATEST} - 25")), SMART_ROUND)
def _(spark, sf):
    return A.smart_money(bars(spark, sf), latest_date(spark, sf))


@query("hidden_accumulation", bars_sql("""
SELECT * EXCLUDE (name) FROM sm WHERE volume_ratio > 1.5 AND price_impact < 1.5
  AND foreign_participation > 0.2""", _smart_cte()), SMART_ROUND)
def _(spark, sf):
    smart = A.with_smart_money(bars(spark, sf)).select(
        *[c for c in A.SMART_COLUMNS if c != "name"])
    return A.hidden_accumulation(smart)


@query("ad_leaders", bars_sql(f"""
, m AS (SELECT symbol, date, name, close, CASE WHEN high = low THEN 0 ELSE
          ((close - low) - (high - close)) / nullif(high - low, 0) * volume END AS money_flow_volume
        FROM bars WHERE date >= {LATEST} - 40),
a AS (SELECT *, sum(money_flow_volume) OVER (PARTITION BY symbol ORDER BY date
                                             ROWS UNBOUNDED PRECEDING) AS ad_line FROM m)
SELECT symbol, date, name, close, money_flow_volume, ad_line, type FROM (
  (SELECT *, 'accumulation' AS type FROM a WHERE date = {LATEST} AND money_flow_volume > 0
   ORDER BY ad_line DESC, symbol LIMIT 10) UNION ALL
  (SELECT *, 'distribution' AS type FROM a WHERE date = {LATEST} AND money_flow_volume < 0
   ORDER BY ad_line, symbol LIMIT 10))"""), "money_flow_volume ad_line", 2)
def _(spark, sf):
    return A.ad_leaders(bars(spark, sf), latest_date(spark, sf))


@query("accumulation_indicators", bars_sql("""
SELECT m.symbol, m.date, m.mfv AS money_flow_volume, a.atr_14 FROM mflow m
JOIN atr_tab a USING (symbol, date)""", FLOW, ATR), "money_flow_volume atr_14", 2)
def _(spark, sf):
    return A.with_accumulation_indicators(bars(spark, sf)).select(
        "symbol", "date", "money_flow_volume", "atr_14")
