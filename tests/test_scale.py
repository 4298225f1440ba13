"""Distributed algorithms against brute force, and the shape of the plans."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from helpers import closes
from pyspark.sql import functions as F

from barsmith.operators import ewm as E
from barsmith.operators import ranking as K
from barsmith.plans import load_all

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group and one value."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"symbol": [f"S{i}" for i in range(3000)],
                        "g": rng.integers(0, 4, 3000), "v": rng.normal(0, 2, 3000).round(1)})
    pdf.loc[:999, ["g", "v"]] = (0, 0.0)
    pdf.loc[rng.integers(1000, 3000, 40), "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return pdf, df


@pytest.mark.parametrize("splits", [None, [], [0.0], [-1.0, 0.0, 0.5, 9.0]])
def test_ranks_match_pandas(skewed, splits):
    pdf, df = skewed
    got = K.with_rank(df, "v", "r", by=["g"], descending=True, splits=splits)
    got = K.with_pct_rank_avg(got, "v", "p", by=["g"], splits=splits).toPandas().set_index("symbol")
    want = pdf.set_index("symbol")
    by = want.groupby("g")["v"]
    pd.testing.assert_series_equal(got["r"].sort_index().astype(float),
                                   by.rank(method="min", ascending=False).sort_index(),
                                   check_names=False)
    pd.testing.assert_series_equal(got["p"].sort_index(), by.rank(pct=True).sort_index(),
                                   check_names=False)


def test_rank_uses_no_unpartitioned_pass_over_rows(skewed):
    _, df = skewed
    plan = K.with_rank(df, "v", "r", splits=[0.0])._jdf.queryExecution().executedPlan().toString()
    single = re.findall(r"Exchange SinglePartition", plan)
    # Only the range totals (two rows here) are gathered.
    assert len(single) <= 1


def test_ewm_survives_batch_borders(spark, make_bars):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = []
        for s, n in (("A", 40), ("B", 3), ("C", 29), ("D", 1)):
            rows += closes([100 + 9 * math.sin(i * 1.7 + n) for i in range(n)], s)
        bars = make_bars(rows)
        got = E.with_macd(bars, 12, 26, 9).toPandas().sort_values(["symbol", "date"])
        one = E.ewm(bars, "close", 12).toPandas().sort_values(["symbol", "date"])
        pdf = bars.select("symbol", "date", "close").toPandas().sort_values(["symbol", "date"])
        for s, part in pdf.groupby("symbol"):
            fast = part.close.ewm(span=12, adjust=False).mean()
            line = fast - part.close.ewm(span=26, adjust=False).mean()
            sig = line.ewm(span=9, adjust=False).mean()
            mine = got[got.symbol == s]
            np.testing.assert_allclose(one[one.symbol == s]["ewm"], fast, rtol=1e-12)
            np.testing.assert_allclose(mine.macd_line, line, rtol=1e-9, atol=1e-9)
            np.testing.assert_allclose(mine.signal_line, sig, rtol=1e-9, atol=1e-9)
            np.testing.assert_allclose(mine.prev_macd_histogram.to_numpy()[1:],
                                       (line - sig).to_numpy()[:-1], rtol=1e-9, atol=1e-9)
            assert np.isnan(mine.prev_macd_histogram.to_numpy(dtype=float)[0])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def plan_of(spark, name):
    df = load_all()[name].plan(spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rsi_sql", "moving_averages", "wave_signal", "bandar_history",
                                  "technical_recommendation", "signal_history", "lifecycle"])
def test_stored_bars_need_no_exchange(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"(?<!Broadcast)\bExchange (hash|range|Single)", plan), plan
    assert "CartesianProduct" not in plan


def test_ticks_are_folded_before_the_shuffle(spark):
    plan = plan_of(spark, "bars_from_ticks")
    assert "partial_max_by" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, date#\d+", plan)) == 1


def test_scan_reads_only_needed_columns(spark):
    plan = load_all()["rsi_sql"].plan(spark, SF_DIR)._jdf.queryExecution().toString()
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan)[0]
    assert schema == "symbol:string,date:date,close:double"


def test_look_back_reaches_the_scan(spark):
    plan = load_all()["rsi"].plan(spark, SF_DIR)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date," in plan


def test_cap_per_ticker_limits_before_the_shuffle(spark):
    plan = plan_of(spark, "recency_and_cap")
    assert re.search(r"WindowGroupLimit.*Partial", plan), plan


def test_hot_symbol_folds_to_one_row_per_day_and_task(spark):
    """A third of all ticks in one symbol: the shuffle carries bars, not ticks."""
    from barsmith.sources.bars import bars_from_ticks

    ticks = spark.range(0, 90_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(
            F.concat(F.lit("S"), F.col("id") % 50)).alias("symbol"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("date"),
        (F.col("id") % 97).cast("double").alias("price"), F.lit(1).cast("long").alias("size"),
        F.lit(1.0).alias("amount"), F.col("id").alias("seq"),
        *[F.lit(False).alias(c) for c in ("is_foreign_buy", "is_foreign_sell", "at_bid",
                                          "at_offer")])
    out = bars_from_ticks(ticks)
    hot = {r.date: r for r in out.filter("symbol = 'HOT'").collect()}
    assert sum(r.frequency for r in hot.values()) == 30_000 and len(hot) == 20
    want = ticks.filter("symbol = 'HOT'").toPandas().sort_values("seq")
    for day, part in want.groupby("date"):
        assert (hot[day].open_price, hot[day].close) == (part.price.iloc[0], part.price.iloc[-1])


def test_tick_order_holds_for_order_keys_beyond_38_bits(spark, tmp_path):
    from barsmith.plans.inputs import ticks
    from barsmith.sources.bars import bars_from_ticks

    rows = [(2 ** 39, "2000-01-03", 300.0), (1, "2000-01-04", 500.0), (2 ** 62, "2000-01-03", 400.0),
            (7, "2000-01-03", 200.0)]
    spark.createDataFrame(rows, "l_orderkey long, d string, p double").selectExpr(
        "l_orderkey", "to_date(d) AS l_shipdate", "1L AS l_suppkey", "1L AS l_partkey",
        "1 AS l_linenumber", "1.0D AS l_quantity", "p AS l_extendedprice", "'R' AS l_returnflag",
        "'O' AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = bars_from_ticks(ticks(spark, str(tmp_path)))
    # One trading day of seven source days: the later day closes it, whatever the keys.
    assert [(r.open_price, r.close) for r in out.collect()] == [(5020.0, 5050.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_buckets_and_splits_follow_the_size_of_the_ticks(spark, monkeypatch):
    """What a task folds and a bucket holds stays the same on larger tables."""
    from barsmith.plans import inputs

    before = spark.conf.get(inputs.SPLIT_CONF)
    want = {tuple(r) for r in inputs.derive_bars(spark, SF_DIR).select(
        "symbol", "date", "name", "bid", "listed_shares", "upload_file").collect()}
    monkeypatch.setattr(inputs, "fingerprint", lambda *args: (400 << 20, 1, 1, 1))
    bars = inputs.bars(spark, SF_DIR)
    assert "25 buckets" in spark.sql(
        f"describe extended {inputs._STORED[(spark.sparkContext.applicationId, SF_DIR, 400 << 20, 1, 1, 1)]}"
    ).where("col_name = 'Num Buckets'").selectExpr("concat(data_type, ' buckets')").first()[0]
    assert {tuple(r) for r in bars.select("symbol", "date", "name", "bid", "listed_shares",
                                          "upload_file").collect()} == want
    assert spark.conf.get(inputs.SPLIT_CONF) == before


def test_bars_are_joined_to_names_where_they_lie(spark, tmp_path):
    """Two exchanges of bars, no more: the fold's and the one into the buckets."""
    from barsmith.plans import inputs
    from barsmith.sources import bars as SB

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = SB.bars_from_ticks(inputs.ticks(spark, SF_DIR)).repartition(5, "symbol")
        out = inputs.described(SB.with_prev_close(spread), inputs.names(spark, SF_DIR, 5))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning(symbol#") == 3  # the third moves the names
    assert len(re.findall(r"Sort \[symbol#\d+ ASC NULLS FIRST, date#", plan)) == 1


def test_fold_partitions_follow_the_size_of_the_ticks(spark, monkeypatch):
    """A session of few shuffle partitions folds a large table in as many as it has buckets."""
    from barsmith.plans import inputs

    plans, store = [], inputs.store_bucketed

    def spy(folded, *args):
        plans.append(folded._jdf.queryExecution().executedPlan().toString())
        return store(folded, *args)

    monkeypatch.setattr(inputs, "store_bucketed", spy)
    monkeypatch.setattr(inputs, "fingerprint", lambda *args: (480 << 20, 2, 2, 2))
    before = spark.conf.get(inputs.FOLD_CONF)
    inputs.bars(spark, SF_DIR)
    assert re.search(r"Exchange hashpartitioning\(symbol#\d+, date#\d+, 30\)", plans[0]), plans[0]
    assert spark.conf.get(inputs.FOLD_CONF) == before != "30"


def test_crossings_equal_pandas_over_batches_and_missing_closes(spark):
    """A missing close lowers the weight of the past, also over the border of a batch."""
    rng = np.random.default_rng(11)
    rows = [(s, d, None if rng.random() < 0.3 else float(rng.integers(90, 110)))
            for s, n in [("A", 150), ("B", 3), ("C", 80), (None, 60), ("D", 1)] for d in range(n)]
    df = spark.createDataFrame(rows, "symbol string, d int, close double").select(
        "symbol", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")).alias("date"), "close", "d")
    grid = [(2, 5, 3), (3, 6, 4), (2, 6, 4)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = E.bullish_crossings(df, grid, keep=["d"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = sorted((r.symbol or "", r.d, r.fast_period, r.slow_period, r.signal_period) for r in found)
    pdf = pd.DataFrame(rows, columns=["s", "d", "close"]).fillna({"s": ""}).astype({"close": float})
    want = []
    for s, part in pdf.groupby("s"):
        for f, w, g in grid:
            mean = {n: part.close.ewm(span=n, adjust=False).mean() for n in (f, w)}
            line = mean[f] - mean[w]
            hist = (line - line.ewm(span=g, adjust=False).mean()).to_numpy()
            want += [(s, int(d), f, w, g) for d in range(1, len(hist)) if hist[d] > 0 >= hist[d - 1]]
    assert got == sorted(want) and len(want) > 30


def test_partitions_of_the_summary_files_follow_the_size(spark, monkeypatch):
    """Each task sorts the dates it writes, so more bars go to more tasks, a date to one."""
    from barsmith.plans import inputs, storage

    for module in (inputs, storage):
        monkeypatch.setattr(module, "fingerprint", lambda *args: (480 << 20, 3, 3, 3))
    inputs.bars(spark, SF_DIR)
    frame, dealt = type(spark.range(0)), []
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *args: dealt.append(args) or repartition(
        self, *args))
    folder = storage.summary_folder(spark, SF_DIR)
    assert dealt == [(30, "_day")] * 2
    files = spark.read.format("binaryFile").load(folder).count()
    assert files == 1 + inputs.bars(spark, SF_DIR).select("date").distinct().count()
