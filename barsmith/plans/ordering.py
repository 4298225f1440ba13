"""Order, limit, distinct and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.functions.scalar import pct_change
from barsmith.operators import ranking as K
from barsmith.plans.inputs import bars
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import METRICS, bars_sql


def _plain(spark, sf):
    return bars(spark, sf)


@query("distinct_on_latest", bars_sql("""
SELECT symbol, date, close, volume FROM bars b
WHERE date = (SELECT max(date) FROM bars l WHERE l.symbol = b.symbol)"""))
def _(spark, sf):
    return K.latest_per(_plain(spark, sf).select("symbol", "date", "close", "volume"))


@query("top_k", bars_sql(
    "SELECT symbol, date, value FROM bars ORDER BY value DESC, symbol, date LIMIT 30"))
def _(spark, sf):
    rows = _plain(spark, sf).select("symbol", "date", "value")
    return K.top_k(rows, [F.col("value").desc_nulls_last(), F.col("symbol").asc()], 30, "date")


@query("tail_n_per_symbol", bars_sql("""
SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol
  ORDER BY date DESC) AS r FROM bars) WHERE r <= 10"""))
def _(spark, sf):
    return K.tail_n(_plain(spark, sf).select("symbol", "date", "close"), 10)


@query("order_by_expr_nulls", bars_sql("""
SELECT symbol, date, percent_change FROM metrics
ORDER BY abs(percent_change) DESC NULLS LAST, symbol, date LIMIT 50""", METRICS), "percent_change")
def _(spark, sf):
    rows = _plain(spark, sf).select("symbol", "date",
                                    pct_change("close", "prev_close").alias("percent_change"))
    return K.top_k(rows, [K.abs_desc("percent_change"), F.col("symbol").asc()], 50, "date")


@query("union_limited", bars_sql("""
SELECT * FROM (SELECT symbol, date, close FROM bars ORDER BY close DESC, symbol, date LIMIT 3)
UNION ALL
SELECT * FROM (SELECT symbol, date, close FROM bars ORDER BY close, symbol, date LIMIT 3)"""))
def _(spark, sf):
    b = _plain(spark, sf).select("symbol", "date", "close")
    s = F.col("symbol").asc()
    return K.top_k(b, [F.col("close").desc(), s], 3, "date").unionByName(
        K.top_k(b, [F.col("close").asc(), s], 3, "date"))


@query("union_tagged_stages", bars_sql("""
SELECT symbol, date, 'UP' AS stage FROM bars WHERE change > 0 UNION ALL
SELECT symbol, date, 'DOWN' FROM bars WHERE change < 0 UNION ALL
SELECT symbol, date, 'FLAT' FROM bars WHERE change = 0"""))
def _(spark, sf):
    b = _plain(spark, sf).select("symbol", "date", "change")
    return K.union_tagged({"UP": b.filter("change > 0"), "DOWN": b.filter("change < 0"),
                           "FLAT": b.filter("change = 0")}, "stage").drop("change")


@query("distinct_rows", bars_sql("SELECT DISTINCT symbol, name FROM bars"))
def _(spark, sf):
    return bars(spark, sf).select("symbol", "name").distinct()


@query("set_membership", bars_sql("""
, tag AS (SELECT symbol, 'Active' AS t FROM bars WHERE volume > 15000000
          UNION ALL SELECT symbol, 'Jump' FROM metrics WHERE percent_change > 15
          UNION ALL SELECT symbol, 'Drop' FROM metrics WHERE percent_change < -14)
SELECT symbol, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM tag GROUP BY symbol
HAVING count(DISTINCT t) > 1""", METRICS))
def _(spark, sf):
    b = _plain(spark, sf)
    pc = pct_change("close", "prev_close")
    tagged = K.union_tagged({"Active": b.filter("volume > 15000000").select("symbol"),
                             "Jump": b.filter(pc > 15).select("symbol"),
                             "Drop": b.filter(pc < -14).select("symbol")}, "tag")
    return K.set_membership(tagged, "symbol", "tag").select(
        "symbol", F.array_join("tags", ",").alias("tags"))


@query("disjoint_mask_union", bars_sql("""
SELECT symbol, date, percent_change FROM metrics WHERE percent_change > 5 OR percent_change < -5""",
                                       METRICS), "percent_change")
def _(spark, sf):
    pc = F.col("percent_change")
    return _plain(spark, sf).select(
        "symbol", "date", pct_change("close", "prev_close").alias("percent_change")).filter(
        (pc > 5) | (pc < -5))
