"""Ingest and table-maintenance queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from barsmith.operators import relational as R
from barsmith.operators.ranking import latest_per
from barsmith.plans.inputs import articles, bars, fingerprint, forecasts, pieces
from barsmith.plans.market import FORECASTS
from barsmith.plans.news import ARTICLES
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import METRICS, bars_sql
from barsmith.session import shared_dir
from barsmith.sources import bars as B
from barsmith.sources import news as NS
from barsmith.sources import tables as T

CUT, OVERLAP = dt.date(2000, 7, 1), dt.date(2000, 6, 20)
KEYS = ["symbol", "date"]

SPLIT = """, target AS (SELECT symbol, date, close, volume FROM bars WHERE date < DATE '2000-07-01'),
updates AS (SELECT symbol, date, close + 1 AS close, volume + 1 AS volume FROM bars
            WHERE date >= DATE '2000-06-20')"""


def split(spark, sf):
    b = bars(spark, sf).select(*KEYS, "close", "volume")
    fresh = b.filter(F.col("date") >= F.lit(OVERLAP)).withColumns(
        {"close": F.col("close") + 1, "volume": F.col("volume") + 1})
    return b.filter(F.col("date") < F.lit(CUT)), fresh


def work_dir(spark, name):
    """A new folder under the shared one; nothing is overwritten or removed."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


RAW = {"symbol": "Kode Saham", "prev_close": "Sebelumnya", "open_price": "Open Price",
       "high": "Tertinggi", "low": "Terendah", "close": "Penutupan", "change": "Selisih",
       "volume": " Volume ", "value": "Nilai", "frequency": "Frekuensi",
       "foreign_buy": "Foreign Buy", "foreign_sell": "Foreign Sell"}


BROKEN = "Ringkasan Saham-19000101.csv"
_FOLDERS: dict[tuple, str] = {}


def summary_folder(spark, sf):
    """The exchange's summary files of all bars: a CSV file a date, named after it.

    Headers come in two orders. Files of a 13th carry no valid date in their name, and one file
    more holds bytes that are no text. Spark writes a folder a date; the files are then moved out
    under their names, through the file system that holds the folder.
    """
    marks = fingerprint(spark, sf, "lineitem", "supplier")
    key = (spark.sparkContext.applicationId, marks)
    if key in _FOLDERS:
        return _FOLDERS[key]
    written, folder = work_dir(spark, "written"), work_dir(spark, "summaries")
    raw = bars(spark, sf).select(
        *[F.col(c).cast("string").alias(h) for c, h in RAW.items()],
        F.date_format("date", "yyyyMMdd").alias("_day"), (F.dayofmonth("date") % 2).alias("_odd"))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for odd in (0, 1):
        headers = list(RAW.values())[::-1 if odd else 1]
        part = raw.where(F.col("_odd") == odd).select(*headers, "_day")
        # A task sorts its dates: with more bars it gets fewer of them.
        part.repartition(pieces(spark, marks[0]), "_day").write.option("header", True).partitionBy("_day").csv(
            f"{written}/{odd}")
        for day in fs.listStatus(path(f"{written}/{odd}")):
            if not day.isDirectory():
                continue
            stamp = day.getPath().getName().partition("=")[2]
            mark = "x" if stamp.endswith("13") else ""
            for file in fs.listStatus(day.getPath()):
                fs.rename(file.getPath(), path(f"{folder}/Ringkasan Saham-{mark}{stamp}.csv"))
    out = fs.create(path(f"{folder}/{BROKEN}"))
    out.write(bytearray(b"Kode Saham,Volume\nS1,\xff\xfe\n"))
    out.close()
    _FOLDERS[key] = folder
    return folder


@query("read_bars", bars_sql(f"SELECT {', '.join(RAW)}, date FROM bars"))
def _(spark, sf):
    """Write every bar to CSV files under the exchange's headers, then read the folder back."""
    path = work_dir(spark, "bars")
    b = bars(spark, sf)
    raw = b.select(*[F.col(c).cast("string").alias(h) for c, h in RAW.items()], "date")
    raw.write.option("header", True).csv(path)
    return B.read_bars(spark, path).select(*RAW, F.col("date").cast("date"))


@query("with_file_date", bars_sql(
    "SELECT symbol, date, close FROM bars WHERE day(date) <> 13"))
def _(spark, sf):
    """Dates from the names of real files, read with Spark's own CSV reader."""
    headers = ", ".join(f"`{h.strip()}` string" for h in list(RAW.values())[::-1])
    odd = spark.read.option("header", True).option("pathGlobFilter", "*[13579].csv").schema(
        headers).csv(summary_folder(spark, sf))
    even = spark.read.option("header", True).option("pathGlobFilter", "*[02468].csv").schema(
        ", ".join(f"`{h.strip()}` string" for h in RAW.values())).csv(summary_folder(spark, sf))
    dated = [B.normalise_headers(B.with_file_date(df.select("*", "_metadata")))
             .select("symbol", "date", "close", "upload_file") for df in (odd, even)]
    return dated[0].union(dated[1]).where(F.col("upload_file") != BROKEN).select(
        "symbol", "date", "close")


@query("latest_file_only", bars_sql(
    "SELECT symbol, date, close FROM bars WHERE day(date) <> 13 QUALIFY date = max(date) OVER ()"))
def _(spark, sf):
    rows, _ = B.bulk_load(spark, summary_folder(spark, sf))
    return B.latest_file_only(rows).select("symbol", "date", "close")


@query("bulk_load", bars_sql(f"""
SELECT CASE WHEN day(date) = 13 THEN 'Ringkasan Saham-x' ELSE 'Ringkasan Saham-' END
         || strftime(date, '%Y%m%d') || '.csv' AS file_name,
       CASE WHEN day(date) = 13 THEN 0 ELSE count(*) END AS records_processed,
       CASE WHEN day(date) = 13 THEN 'ERROR' ELSE 'SUCCESS' END AS status,
       CASE WHEN day(date) = 13 THEN 0 ELSE round(sum(close), 2) END AS total_close
FROM bars GROUP BY date
UNION ALL SELECT '{BROKEN}', 0, 'ERROR', 0"""))
def _(spark, sf):
    """Real files, good and bad: bars of the good ones, a log row for each."""
    rows, log = B.bulk_load(spark, summary_folder(spark, sf))
    sums = rows.groupBy(F.col("upload_file").alias("file_name")).agg(
        F.round(F.sum("close"), 2).alias("total_close"))
    return log.join(sums, "file_name", "left").select(
        "file_name", "records_processed", "status",
        F.coalesce("total_close", F.lit(0.0)).alias("total_close"))


@query("upsert", bars_sql("""
SELECT * FROM updates UNION ALL
SELECT * FROM target WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM updates)""", SPLIT))
def _(spark, sf):
    target, fresh = split(spark, sf)
    return T.upsert(target, fresh, KEYS)


@query("upsert_keep_columns", bars_sql("""
SELECT coalesce(t.symbol, u.symbol) AS symbol, coalesce(t.date, u.date) AS date,
       CASE WHEN t.symbol IS NULL THEN u.close ELSE t.close END AS close,
       coalesce(u.volume, t.volume) AS volume
FROM target t FULL JOIN updates u ON u.symbol = t.symbol AND u.date = t.date""", SPLIT))
def _(spark, sf):
    target, fresh = split(spark, sf)
    return T.upsert(target, fresh, KEYS, update_cols=["volume"])


@query("insert_ignore", bars_sql("""
SELECT * FROM target UNION ALL
SELECT * FROM updates WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM target)""", SPLIT))
def _(spark, sf):
    target, fresh = split(spark, sf)
    return T.insert_ignore(target, fresh, KEYS)


@query("replace_dates", bars_sql("""
SELECT * FROM updates WHERE close > 5100 UNION ALL
SELECT * FROM target WHERE date NOT IN (SELECT date FROM updates WHERE close > 5100)""", SPLIT))
def _(spark, sf):
    target, fresh = split(spark, sf)
    return T.replace_dates(target, fresh.filter("close > 5100"))


@query("full_refresh", bars_sql("SELECT symbol, date, close, volume FROM updates", SPLIT))
def _(spark, sf):
    """Store one table, replace it by another, read it back."""
    path = work_dir(spark, "refresh")
    target, fresh = split(spark, sf)
    T.full_refresh(target, path)
    T.full_refresh(fresh, path)
    return spark.read.parquet(path)


@query("replace_partitions", bars_sql("""
SELECT symbol, close, volume, date FROM updates WHERE month(date) = 6 UNION ALL
SELECT symbol, close, volume, date FROM target WHERE date < DATE '2000-06-20'
   OR date >= DATE '2000-07-01'""", SPLIT))
def _(spark, sf):
    """Dynamic partition overwrite: only the months in the new data change."""
    path = work_dir(spark, "months")
    target, fresh = split(spark, sf)
    T.overwrite_partitions(target.withColumn("month", F.trunc("date", "month")), path, ["month"])
    stored = spark.read.parquet(path).drop("month")
    june = T.replace_dates(stored.filter("date >= DATE '2000-06-01'").select(*target.columns),
                           fresh.filter("month(date) = 6"))
    again = work_dir(spark, "june")
    T.full_refresh(june, again)
    T.overwrite_partitions(spark.read.parquet(again).withColumn("month", F.trunc("date", "month")),
                           path, ["month"])
    return spark.read.parquet(path).select("symbol", "close", "volume", "date")


@query("update_from", bars_sql("""
SELECT t.symbol, t.date, CASE WHEN u.symbol IS NOT NULL AND t.volume < 5000000
         THEN u.close ELSE t.close END AS close, t.volume
FROM target t LEFT JOIN updates u ON u.symbol = t.symbol AND u.date = t.date""", SPLIT))
def _(spark, sf):
    target, fresh = split(spark, sf)
    other = fresh.select(*KEYS, F.col("close").alias("new_close"))
    return T.update_from(target, other, KEYS, {"close": F.col("new_close")},
                         F.col("volume") < 5000000)


@query("staging_view", bars_sql("SELECT symbol, date, name, close, volume FROM bars"))
def _(spark, sf):
    B.staging_view(bars(spark, sf), "stg_daily_bars")
    return spark.sql("SELECT symbol, date, name, close, volume FROM stg_daily_bars")


@query("ensure_table", bars_sql("SELECT symbol, date, close FROM bars"))
def _(spark, sf):
    b = bars(spark, sf).select("symbol", "date", "close")
    empty = T.ensure_table(spark, "barsmith_signals_store", b.schema)
    return empty.limit(0).unionByName(b)


@query("processing_log", bars_sql("""
SELECT 'bulk_load' AS process_name, strftime(date, '%Y%m%d') AS file_name,
       count(*) AS records_processed,
       CASE WHEN count(*) FILTER (prev_close IS NULL) = 0 THEN 'SUCCESS' ELSE 'PARTIAL' END AS status,
       CASE WHEN count(*) FILTER (prev_close IS NULL) > 0
            THEN count(*) FILTER (prev_close IS NULL) || ' bad rows' END AS error_message
FROM bars GROUP BY date"""))
def _(spark, sf):
    b = bars(spark, sf).withColumn("upload_file", F.date_format("date", "yyyyMMdd"))
    return T.processing_log(b, "bulk_load", F.lit(None).cast("timestamp"),
                            bad=F.col("prev_close").isNull()).drop("process_date")


@query("processing_summary", bars_sql("""
, log AS (SELECT date, count(*) AS n, count(*) FILTER (prev_close IS NULL) AS bad FROM bars
          GROUP BY date)
SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS records_processed,
       count(*) FILTER (bad = 0) AS succeeded, count(*) FILTER (bad > 0) AS failed FROM log"""))
def _(spark, sf):
    b = bars(spark, sf).withColumn("upload_file", F.date_format("date", "yyyyMMdd"))
    return T.log_summary(T.processing_log(b, "bulk_load", F.lit(None).cast("timestamp"),
                                          bad=F.col("prev_close").isNull()))


@query("read_news_json", bars_sql(
    "SELECT ticker, title, url FROM art WHERE length(title) > 0", ARTICLES))
def _(spark, sf):
    """Articles rendered as JSON text, some without a title, parsed and validated."""
    a = articles(spark, sf).select("ticker", F.nullif("title", F.lit("")).alias("title"), "url",
                                   F.col("published").cast("string").alias("published_at"))
    return NS.parse_articles(a.select(F.to_json(F.struct("*")).alias("value"))).select(
        "ticker", "title", "url")


@query("dim_upsert", bars_sql("""
SELECT 'S' || s_suppkey AS symbol, s_name AS name FROM supplier"""))
def _(spark, sf):
    b = bars(spark, sf)
    old = b.filter(F.col("date") < F.lit(CUT)).groupBy("symbol").agg(
        F.concat(F.max("name"), F.lit(" (old)")).alias("name"))
    return T.dim_upsert(old, b)


@query("latest_date", bars_sql("SELECT d AS latest_date FROM anchor"))
def _(spark, sf):
    return R.latest_date(bars(spark, sf), dt.date(1999, 12, 31))


@query("temp_table", bars_sql("""
SELECT symbol, count(*) AS bars, max(close) AS top_close FROM bars GROUP BY symbol"""))
def _(spark, sf):
    T.temp_table(bars(spark, sf).select("symbol", "date", "close"), "barsmith_closes")
    return spark.sql("SELECT symbol, count(*) AS bars, max(close) AS top_close "
                     "FROM barsmith_closes GROUP BY symbol")


@query("ingest_metrics", bars_sql("""
SELECT '{"source":"bars","processed":' || (SELECT count(*) FROM updates) || ',"inserted":'
       || (SELECT count(*) FROM updates WHERE date >= DATE '2000-07-01') || '}' AS metrics""", SPLIT))
def _(spark, sf):
    target, fresh = split(spark, sf)
    return T.ingest_metrics(fresh, R.anti_join_new_rows(fresh, target, KEYS), "bars")


@query("fill_actuals", bars_sql("""
SELECT f.symbol, f.prediction_date, f.predicted_close, coalesce(f.actual_close, b.close)
         AS actual_close
FROM fc f LEFT JOIN bars b ON b.symbol = f.symbol AND b.date = f.prediction_date""", METRICS,
                                FORECASTS), "predicted_close")
def _(spark, sf):
    b = bars(spark, sf)
    f = forecasts(b).select("symbol", "prediction_date", "predicted_close", "actual_close")
    seen = b.select("symbol", F.col("date").alias("prediction_date"), F.col("close").alias("seen"))
    return T.update_from(f, seen, ["symbol", "prediction_date"], {"actual_close": F.col("seen")},
                         F.col("actual_close").isNull())


@query("snapshot_dimension", bars_sql("""
SELECT symbol, last(close ORDER BY date) AS close, max(date) AS date FROM bars
WHERE date < DATE '2000-07-01' GROUP BY symbol"""))
def _(spark, sf):
    b = bars(spark, sf).filter(F.col("date") < F.lit(CUT))
    return latest_per(b.select("symbol", "date", "close"))
