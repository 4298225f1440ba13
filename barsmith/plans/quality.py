"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import quality as Q
from barsmith.plans.inputs import bars, derive_bars, table
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import bars_sql
from barsmith.operators.market import dim_companies


def _verdict(check, failures):
    return (f"SELECT '{check}' AS check_name, failures, failures <> 0 AS should_warn, "
            f"failures <> 0 AS should_error FROM ({failures})")


@query("check_not_null", bars_sql(
    _verdict("not_null_prev_close",
             "SELECT count(*) AS failures FROM bars WHERE prev_close IS NULL") + " UNION ALL "
    + _verdict("not_null_symbol", "SELECT count(*) AS failures FROM bars WHERE symbol IS NULL")))
def _(spark, sf):
    b = bars(spark, sf)
    return Q.check_not_null(b, "prev_close").unionByName(Q.check_not_null(b, "symbol"))


@query("check_unique", bars_sql(
    _verdict("unique_symbol_date", "SELECT count(*) AS failures FROM (SELECT 1 FROM bars "
             "GROUP BY symbol, date HAVING count(*) > 1)") + " UNION ALL "
    + _verdict("unique_close", "SELECT count(*) AS failures FROM (SELECT 1 FROM bars "
               "GROUP BY close HAVING count(*) > 1)")))
def _(spark, sf):
    b = bars(spark, sf)
    return Q.check_unique(b, "symbol", "date").unionByName(Q.check_unique(b, "close"))


@query("check_companies", bars_sql(
    _verdict("unique_symbol", "SELECT 0 AS failures") + " UNION ALL "
    + _verdict("not_null_symbol",
               "SELECT count(*) AS failures FROM bars WHERE symbol IS NULL")))
def _(spark, sf):
    dim = dim_companies(bars(spark, sf))
    return Q.check_unique(dim, "symbol").unionByName(Q.check_not_null(dim, "symbol"))


@query("check_source_tables", """
SELECT table_name, n AS records FROM (
  SELECT 'lineitem' AS table_name, count(*) AS n FROM lineitem
  UNION ALL SELECT 'supplier', count(*) FROM supplier
  UNION ALL SELECT 'documents', count(*) FROM documents)""")
def _(spark, sf):
    """Register the source tables, list none missing, and count their records."""
    names = ["lineitem", "supplier", "documents"]
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(n)
    missing = Q.missing_tables(spark, names)
    if missing:
        raise ValueError(f"missing source tables: {missing}")
    out = None
    for n in names:
        part = spark.table(n).agg(F.count("*").alias("records")).select(
            F.lit(n).alias("table_name"), "records")
        out = part if out is None else out.unionByName(part)
    return out


@query("bars_from_ticks", bars_sql("""
SELECT symbol, name, date, open_price, high, low, close, volume, value, frequency, foreign_buy,
       foreign_sell, bid_volume, offer_volume, listed_shares, tradable_shares FROM bars"""))
def _(spark, sf):
    """The fold from ticks to bars itself, without the stored table."""
    return derive_bars(spark, sf).select(
        "symbol", "name", "date", "open_price", "high", "low", "close", "volume", "value",
        "frequency", "foreign_buy", "foreign_sell", "bid_volume", "offer_volume", "listed_shares",
        "tradable_shares")
