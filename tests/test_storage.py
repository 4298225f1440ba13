"""Files: ingest, keyed maintenance, streams and models."""

import datetime as dt
import json
import uuid

import pytest
from helpers import closes
from pyspark.sql import functions as F

from barsmith.operators import forecast as P
from barsmith.operators import quality as Q
from barsmith.sources import bars as SB
from barsmith.sources import news as SN
from barsmith.sources import tables as T
from barsmith.streaming import files, messages

HEADER = "Kode Saham,Nama Perusahaan, Penutupan ,Volume"


def test_folder_with_bad_files_and_cells(spark, tmp_path):
    (tmp_path / "Ringkasan Saham-20250102.csv").write_text(f"{HEADER}\nAAA,Alpha,100,5\n")
    (tmp_path / "Ringkasan Saham-20250103.csv").write_text(
        f"{HEADER}\nAAA,Alpha,101,6\nBBB,Beta,n/a,7\n")
    (tmp_path / "Ringkasan Saham-2025xx03.csv").write_text(f"{HEADER}\nCCC,Gamma,1,1\n")
    rows, counts = SB.bulk_load(spark, str(tmp_path))
    got = {(r.symbol, r.date.isoformat(), r.close, r.volume) for r in rows.collect()}
    assert got == {("AAA", "2025-01-02", 100.0, 5), ("AAA", "2025-01-03", 101.0, 6),
                   ("BBB", "2025-01-03", None, 7)}
    assert {(r.file_name[-12:-4], r.records_processed, r.status) for r in counts.collect()} == {
        ("20250102", 1, "SUCCESS"), ("20250103", 2, "PARTIAL"), ("2025xx03", 0, "ERROR")}
    assert SB.latest_file_only(rows).count() == 2


def test_two_hundred_good_files_and_bad_ones(spark, tmp_path):
    orders = (["Kode Saham", "Penutupan", "Volume"], ["Volume", " penutupan ", "KODE SAHAM"])
    for k in range(200):
        cells = {"kode saham": f"S{k}", "penutupan": str(k), "volume": "7"}
        order = orders[k % 2]
        day = f"2024{k // 28 + 1:02d}{k % 28 + 1:02d}"
        (tmp_path / f"Ringkasan Saham {k}-{day}.csv").write_text(
            ",".join(order) + "\n" + ",".join(cells[h.strip().lower()] for h in order) + "\n")
    bad = {"bytes": b"Kode Saham\n\xff\xfe\n", "ragged": b"Kode Saham,Volume\nA,1,2\nB\n",
           "blank": b"\n", "headless": b"a,b\n1,2\n"}
    for name, content in bad.items():
        (tmp_path / f"{name}-20250101.csv").write_bytes(content)
    (tmp_path / "quoted-20250102.csv").write_bytes(
        b'\xef\xbb\xbf"Kode Saham","Nama Perusahaan","Volume"\r\nQ,"two\nlines, one name",5\r\n\r\n')
    (tmp_path / "rowless-20250103.csv").write_text("Kode Saham,Volume\n")
    rows, log = SB.bulk_load(spark, str(tmp_path))
    got = {r.symbol: r for r in rows.collect()}
    assert got.keys() == {f"S{k}" for k in range(200)} | {"Q"}
    assert all(got[f"S{k}"].close == k and got[f"S{k}"].volume == 7 for k in range(200))
    assert (got["Q"].name, got["Q"].volume) == ("two\nlines, one name", 5)
    entries = {r.file_name: r for r in log.collect()}
    assert len(entries) == 206
    assert {f for f, r in entries.items() if r.status == "ERROR"} == {
        f"{name}-20250101.csv" for name in bad}
    assert all(r.error_message for r in entries.values() if r.status == "ERROR")
    assert entries["rowless-20250103.csv"].records_processed == 0
    with pytest.raises(Exception, match="20250101.csv"):
        SB.read_bars(spark, str(tmp_path)).count()


def test_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "Ringkasan Saham-20250102.csv").write_text("Kode Saham,Penutupan,Volume\nAAA,100,5\n")
    (tmp_path / "Ringkasan Saham-20250103.csv").write_text(
        "Kode Saham,Volume,Penutupan,Tertinggi\nAAA,6,101,110\n")
    got = {(r.symbol, r.close, r.volume, r.upload_file)
           for r in SB.read_bars(spark, str(tmp_path)).collect()}
    assert got == {("AAA", 100.0, 5, "Ringkasan Saham-20250102.csv"),
                   ("AAA", 101.0, 6, "Ringkasan Saham-20250103.csv")}


def test_news_array_drops_incomplete(spark, tmp_path):
    full = {"ticker": "A", "title": "t", "url": "u", "published_at": "2025-01-01 00:00:00",
            "sentiment": "Positive", "sentiment_score": 0.5}
    (tmp_path / "a.json").write_text(json.dumps([full, {**full, "url": None}, {"ticker": "B"}]))
    assert [r.url for r in SN.read_news_json(spark, str(tmp_path)).collect()] == ["u"]
    lines = spark.createDataFrame([(json.dumps(full),), ("{broken",)], "value string")
    assert SN.parse_articles(lines).count() == 1


def test_last_write_wins_and_kept_columns(spark):
    old = spark.createDataFrame([("u1", "old title", 0.1), ("u2", "two", 0.2)],
                                "url string, title string, score double")
    new = spark.createDataFrame([("u1", "new title", 0.9, 1), ("u1", "newer", 0.8, 2),
                                 ("u3", "three", 0.3, 1)],
                                "url string, title string, score double, n int")
    def rows(df):
        return sorted(tuple(r) for r in df.select("url", "title", "score").collect())

    last = T.last_write(new, ["url"], "n").drop("n")
    assert rows(T.upsert(old, last, ["url"])) == [("u1", "newer", 0.8), ("u2", "two", 0.2),
                                                  ("u3", "three", 0.3)]
    assert rows(T.upsert(old, last, ["url"], update_cols=["score"])) == [
        ("u1", "old title", 0.8), ("u2", "two", 0.2), ("u3", "three", 0.3)]
    assert rows(T.insert_ignore(old, last, ["url"])) == [
        ("u1", "old title", 0.1), ("u2", "two", 0.2), ("u3", "three", 0.3)]


def test_upsert_path_is_repeatable(spark, make_bars, tmp_path):
    path = str(tmp_path / "bars")
    cols = ["symbol", "date", "close"]
    first = make_bars(closes([1, 2, 3, 4])).select(*cols)
    fix = make_bars(closes([9, 5], start=3)).select(*cols)
    T.upsert_path(spark, path, first, ["symbol", "date"])
    for _ in range(2):
        T.upsert_path(spark, path, fix, ["symbol", "date"])
    got = [r.close for r in spark.read.parquet(path).orderBy("date").collect()]
    assert got == [1.0, 2.0, 3.0, 9.0, 5.0]


def test_refresh_log_and_views(spark, make_bars, tmp_path):
    path = str(tmp_path / "t")
    b = make_bars(closes([1, 2, 3])).select("symbol", "date", "close")
    T.full_refresh(b, path)
    T.full_refresh(b.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    log = T.processing_log(b.withColumn("upload_file", F.lit("f")), "load",
                           F.current_timestamp())
    T.append_log(log, str(tmp_path / "log"))
    T.append_log(log, str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert T.log_summary(stored).first().records_processed == 6
    name = f"v_{uuid.uuid4().hex}"
    assert Q.missing_tables(spark, [name]) == [name]
    assert T.ensure_table(spark, name, b.schema).count() == 0
    assert Q.missing_tables(spark, [name]) == []
    assert T.temp_table(b, name).count() == 3


def test_bucketed_and_monthly_layouts(spark, make_bars, tmp_path):
    b = make_bars(closes(range(1, 50)) + closes(range(1, 9), "B"))
    SB.write_bars(b, str(tmp_path / "monthly"), 2)
    assert spark.read.parquet(str(tmp_path / "monthly")).count() == 57
    name = f"bars_{uuid.uuid4().hex}"
    out = SB.store_bucketed(b, name, str(tmp_path / "bucketed"), 3)
    assert out.count() == 57
    plan = out.groupBy("symbol").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_messages_round_trip(spark):
    sig = spark.createDataFrame([("A", 0.7, 5.0)], "symbol string, winning_probability double, close double")
    sent = messages.encode(sig, "DAILY", F.lit("2025-01-01").cast("timestamp"), ["close"])
    mixed = sent.select("value").unionByName(
        spark.createDataFrame([("{bad",), ("[]",), (None,)], "value string"))
    got = messages.decode(mixed).collect()
    assert [(r.symbol, r.probability, r.data["close"]) for r in got] == [("A", 0.7, "5.0")]
    assert messages.rejected(mixed).count() == 3


def test_consumer_keeps_bad_messages_and_skips_a_replayed_batch(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = [('{"symbol":"A","signal_type":"DAILY","probability":0.5}', "one", 0),
            ('{"symbol":"B"}', "one", 1), ("{bad", "two", 0), (None, "two", 1)]
    schema = "value string, topic string, offset long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    handled = []
    for ckpt in ("c1", "c2"):  # the second sends batch 0 once more
        q = messages.signals_from_kafka(
            spark.readStream.schema(schema).parquet(source),
            lambda df, n: handled.append((n, [r.symbol for r in df.collect()])),
            str(tmp_path / ckpt), log)
        q.processAllAvailable()
        q.stop()
    assert handled == [(0, ["A"])]
    kept = spark.read.parquet(f"{log}/rejected").collect()
    assert sorted((r.topic, r.offset, r.value or "") for r in kept) == [
        ("one", 1, '{"symbol":"B"}'), ("two", 0, "{bad"), ("two", 1, "")]
    counts = spark.read.parquet(f"{log}/batches").collect()
    assert [(r.batch_id, r.received, r.decoded, r.rejected) for r in counts] == [(0, 4, 1, 3)]


def test_consumer_does_a_batch_again_that_failed_half_way(spark, tmp_path):
    source, log, ckpt = (str(tmp_path / n) for n in ("in", "log", "c"))
    spark.createDataFrame([("{bad",)], "value string").write.parquet(source)
    tries = []

    def handle(df, n):
        tries.append(n)
        if len(tries) == 1:
            raise RuntimeError("sink is away")

    def run():
        q = messages.signals_from_kafka(spark.readStream.schema("value string").parquet(source),
                                        handle, ckpt, log)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="sink is away"):
        run()
    run()
    assert tries == [0, 0]
    assert spark.read.parquet(f"{log}/rejected").count() == 1


def test_one_key_twice_keeps_the_last_file_and_row(spark, make_bars, tmp_path):
    folder = str(tmp_path / "in")
    cols = ["symbol", "date", "close"]
    day = make_bars(closes([1])).select(*cols)
    twice = day.unionByName(day.withColumn("close", F.lit(9.0))).unionByName(
        day.withColumn("close", F.lit(5.0)))
    twice.coalesce(1).write.parquet(folder)
    for name in ("a", "b"):  # a second target and checkpoint stand for a replay
        files.watch_bar_files(spark, folder, day.schema, str(tmp_path / name),
                              str(tmp_path / f"{name}-ckpt")).awaitTermination()
        assert [r.close for r in spark.read.parquet(str(tmp_path / name)).collect()] == [5.0]


def test_unordered_updates_keep_the_same_row_in_any_partitions(spark):
    rows = [("A", 1, {"k": "x"}), ("A", 3, {"k": "y"}), ("A", 2, None), ("B", None, None)]
    new = spark.createDataFrame(rows, "s string, v int, m map<string,string>")
    old = spark.createDataFrame([("B", 7, None)], new.schema)
    for n in (1, 3):
        assert {r.s: r.v for r in T.last_write(new.repartition(n), ["s"], None).collect()} == {
            "A": 3, "B": None}
        got = T.insert_ignore(old, new.repartition(n), ["s"]).collect()
        assert {r.s: r.v for r in got} == {"A": 1, "B": 7}


def test_watched_folder(spark, make_bars, tmp_path):
    folder, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    cols = ["symbol", "date", "close"]
    for part in (closes([1, 2]), closes([7, 8], start=1)):
        b = make_bars(part).select(*cols)
        b.coalesce(1).write.mode("append").parquet(folder)
        files.watch_bar_files(spark, folder, b.schema, target, ckpt).awaitTermination()
    got = [r.close for r in spark.read.parquet(target).orderBy("date").collect()]
    assert got == [1.0, 7.0, 8.0]


def test_classifier_refuses_few_rows(spark):
    cols = ", ".join(f"{c} double" for c in P.WIN_FEATURES)
    few = spark.createDataFrame([("A", "2000-01-01", *[0.0] * 7, True)],
                                f"symbol string, date string, {cols}, is_win boolean")
    assert P.train_win_classifier(few) is None


def test_model_versions_count_up(spark, make_bars, tmp_path):
    b = make_bars(closes([1, 2, 3, 4]))
    model = P.fit_scaler(b, ["close"])
    path = str(tmp_path / "m")
    assert [P.save_model_version(spark, model, path) for _ in range(3)] == [1, 2, 3]
    assert (tmp_path / "m" / "latest").exists()


def test_jdbc_reader_is_lazy_about_drivers(spark):
    with pytest.raises(Exception):
        T.read_jdbc(spark, "jdbc:none://x", "SELECT 1").collect()


def test_day_state_is_the_same_in_any_batches():
    import random

    import pandas as pd

    from barsmith.streaming.ticks import _folded
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.randrange(50), float(rng.randrange(9)), 2) for _ in range(60)]
    frame = pd.DataFrame(rows, columns=["at_us", "seq", "price", "size"]).drop_duplicates(
        ["at_us", "seq"])
    whole = _folded(None, frame)
    held = None
    for cut in range(0, len(frame), 7):
        held = _folded(held, frame.iloc[cut:cut + 7])
    assert held == whole
    first, last = min(frame.itertuples(index=False)), max(frame.itertuples(index=False))
    assert (whole[0], whole[5], whole[8], whole[9]) == (
        first.price, last.price, 2 * len(frame), len(frame))


class _Kept:
    """A state variable in memory."""

    def __init__(self):
        self.held = []

    def get(self):
        return iter(self.held) if self.many else (self.held or [None])[0]

    def exists(self):
        return bool(self.held)

    def update(self, value):
        self.held = [value]

    def put(self, values):
        self.held = list(values)

    def appendValue(self, value):
        self.held.append(value)

    def clear(self):
        self.held = []


def test_one_call_keeps_the_days_of_many_symbols():
    """A key is a part of the symbols: one call and one block a batch, merged after some batches."""
    import random

    import pandas as pd

    from barsmith.streaming import ticks as K
    states, timers = {}, []

    def state(name, schema):
        kept = states[name] = _Kept()
        kept.many = name == "blocks"
        return kept

    class Handle:
        getListState = getValueState = staticmethod(state)
        registerTimer = staticmethod(timers.append)

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    keeper, clock, rng = K._DayKeeper(3_600_000, 3_600_000), Clock(), random.Random(5)
    keeper.init(Handle())
    day = dt.date(1970, 1, 2)
    frame = pd.DataFrame([(f"S{rng.randrange(60)}", rng.randrange(40), rng.randrange(30),
                           float(rng.randrange(9)), 2) for _ in range(1000)],
                         columns=["symbol", "at_us", "seq", "price", "size"])
    frame["at"] = pd.Timestamp(day)
    cuts = [frame.iloc[k:k + 40] for k in range(0, len(frame), 40)]
    for cut in cuts:
        assert not list(keeper.handleInputRows((day, 3), iter([cut[:20], cut[20:]]), clock))
        assert len(states["blocks"].held) < K.MOST_BLOCKS
    assert timers == [2 * K.DAY_MS]
    bars = pd.concat(keeper.handleExpiredTimer((day, 3), clock, None))
    assert not states["blocks"].exists() and not states["count"].exists()
    want = {}
    for cut in cuts:
        for symbol, part in cut.groupby("symbol"):
            want[symbol] = K._folded(want.get(symbol), part)
    assert {r.symbol: (r.open_price, r.high, r.low, r.close, r.volume, r.frequency)
            for r in bars.itertuples()} == {
        s: (w[0], w[3], w[4], w[5], w[8], w[9]) for s, w in want.items()}
    assert set(bars.kind) == {"bar"} and set(bars.date) == {day}
    clock.now = 2 * K.DAY_MS
    late = pd.concat(keeper.handleInputRows((day, 3), iter([frame[:200]]), clock))
    assert list(late.symbol) == list(frame.symbol[:200]) and set(late.kind) == {"late"}


def test_large_file_is_parsed_in_blocks():
    """Rows leave block by block; a fault at the end of the file still lets none out."""
    import pyarrow as pa

    rows = [f'S{k},"a, ""name""\nof two lines",{k}' for k in range(300_000)]
    whole = ("\ufeffKode Saham,Nama Perusahaan,Volume\r\n" + "\r\n".join(rows)).encode()
    assert len(whole) > 2 * SB.CSV_BLOCK
    wide = whole + b"\r\nL," + b"x" * (SB.CSV_BLOCK + 9) + b",1"

    def task(*contents):
        files = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(contents))]),
                                            pa.array(contents, pa.binary())], names=["f", "c"])
        return list(SB._parse_task(iter([files]), ["volume", "symbol", "name", "close"]))

    out = task(whole)
    assert len(out) > 2 and max(b.nbytes for b in out) < 4 * SB.CSV_BLOCK
    got = pa.Table.from_batches(out)
    assert got["line"].to_pylist() == list(range(300_001))
    assert got["symbol"].to_pylist() == [None, *(f"S{k}" for k in range(300_000))]
    assert set(got["name"].to_pylist()[1:]) == {'a, "name"\nof two lines'}
    bad = task(whole + b"\r\nX,y", whole + b"\r\nX,y,\xff", wide)
    assert [b.column(1).to_pylist()[0] is None for b in bad[:2]] == [False, False]
    assert bad[1].column(1).to_pylist()[0].startswith("UnicodeDecodeError")
    assert sum(b.num_rows for b in bad[2:]) == 300_002
