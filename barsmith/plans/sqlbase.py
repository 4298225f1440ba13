"""DuckDB text shared by the check queries."""

from __future__ import annotations

BARS = """
ticks AS (
  SELECT 'S' || l_suppkey AS symbol, l_suppkey AS supp,
         date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS d,
         5000 + floor(l_extendedprice / l_quantity / 10) AS p,
         CAST(l_quantity * 100000 AS BIGINT) AS vol,
         floor(l_extendedprice) * 100000 AS amt,
         l_orderkey AS k1, l_linenumber AS k2, l_partkey % 1024 AS k3,
         l_returnflag AS rf, l_linestatus AS ls
  FROM lineitem
), folded AS (
  SELECT symbol, supp, DATE '2000-01-01' + CAST(d // 7 AS INTEGER) AS date,
         first(p ORDER BY d, k1, k2, k3) AS open_price, max(p) AS high, min(p) AS low,
         last(p ORDER BY d, k1, k2, k3) AS close,
         CAST(sum(vol) AS BIGINT) AS volume, sum(amt) AS value,
         CAST(count(*) AS INTEGER) AS frequency,
         CAST(coalesce(sum(vol) FILTER (rf = 'R'), 0) AS BIGINT) AS foreign_buy,
         CAST(coalesce(sum(vol) FILTER (rf = 'A'), 0) AS BIGINT) AS foreign_sell,
         CAST(coalesce(sum(vol) FILTER (ls = 'O'), 0) AS BIGINT) AS bid_volume,
         CAST(coalesce(sum(vol) FILTER (ls = 'F'), 0) AS BIGINT) AS offer_volume
  FROM ticks GROUP BY symbol, supp, DATE '2000-01-01' + CAST(d // 7 AS INTEGER)
), bars AS MATERIALIZED (
  SELECT f.symbol, s.s_name AS name, f.date,
         lag(f.close) OVER (PARTITION BY f.symbol ORDER BY f.date) AS prev_close,
         f.open_price, f.high, f.low, f.close,
         f.close - lag(f.close) OVER (PARTITION BY f.symbol ORDER BY f.date) AS change,
         f.volume, f.value, f.frequency, f.foreign_buy, f.foreign_sell,
         f.high AS offer, f.offer_volume, f.low AS bid, f.bid_volume,
         (f.supp % 10 + 1) * 100000000 AS listed_shares,
         (f.supp % 10 + 1) * 80000000 AS tradable_shares
  FROM folded f LEFT JOIN supplier s ON s.s_suppkey = f.supp
), anchor AS (SELECT max(date) AS d FROM bars)"""

METRICS = """, metrics AS (
  SELECT *, (close - prev_close) / nullif(prev_close, 0) * 100 AS percent_change,
         foreign_buy - foreign_sell AS foreign_net
  FROM bars)"""

RSI = """, rsi_step AS (
  SELECT symbol, date, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS chg
  FROM bars
), rsi_mean AS (
  SELECT symbol, date, close,
         avg(greatest(chg, 0)) OVER w AS up, avg(greatest(-chg, 0)) OVER w AS dn
  FROM rsi_step WHERE chg IS NOT NULL
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)
), rsi_tab AS (
  SELECT symbol, date, close, rsi,
         CASE WHEN rsi > 70 THEN 'Overbought' WHEN rsi < 30 THEN 'Oversold' ELSE 'Neutral' END
           AS rsi_signal
  FROM (SELECT symbol, date, close,
               CASE WHEN dn = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + up / dn) END AS rsi
        FROM rsi_mean))"""

MACD = """, macd_line_tab AS (
  SELECT symbol, date, close,
         avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 11 PRECEDING)
       - avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 25 PRECEDING) AS macd_line
  FROM bars
), macd_sig_tab AS (
  SELECT *, avg(macd_line) OVER (PARTITION BY symbol ORDER BY date ROWS 8 PRECEDING)
              AS signal_line
  FROM macd_line_tab
), macd_tab AS (
  SELECT *, macd_line - signal_line AS macd_histogram,
         CASE WHEN macd_line > signal_line THEN 'Bullish'
              WHEN macd_line < signal_line THEN 'Bearish' ELSE 'Neutral' END AS macd_signal
  FROM macd_sig_tab)"""


def ewm_macd(source: str, fast: int, slow: int, signal: int, name: str = "em") -> str:
    """Recursive-CTE MACD over ``source`` (symbol, date, close)."""
    return f""", {name}_ord AS MATERIALIZED (
  SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM {source}
), {name}_rec AS (
  SELECT symbol, date, rn, n, close, close AS f, close AS s, 0.0::DOUBLE AS sig
  FROM {name}_ord WHERE rn = 1
  UNION ALL
  SELECT o.symbol, o.date, o.rn, o.n, o.close,
         r.f + (o.close - r.f) * 2e0 / {fast + 1},
         r.s + (o.close - r.s) * 2e0 / {slow + 1},
         r.sig + ((r.f + (o.close - r.f) * 2e0 / {fast + 1})
                - (r.s + (o.close - r.s) * 2e0 / {slow + 1}) - r.sig) * 2e0 / {signal + 1}
  FROM {name}_rec r JOIN {name}_ord o ON o.symbol = r.symbol AND o.rn = r.rn + 1
), {name} AS (
  SELECT symbol, date, rn, n, close, f - s AS macd_line, sig AS signal_line,
         f - s - sig AS macd_histogram,
         lag(f - s - sig) OVER (PARTITION BY symbol ORDER BY date) AS prev_hist
  FROM {name}_rec)"""


def bars_sql(body: str, *parts: str) -> str:
    """WITH bars plus the given CTE parts, then ``body``.

    ``body`` is a SELECT, or starts with a comma and more CTEs.
    """
    return "WITH RECURSIVE " + BARS.strip() + "".join(parts) + "\n" + body.strip("\n")
