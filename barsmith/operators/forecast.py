"""Forecast bookkeeping, feature preparation and Spark ML models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.frames import by_symbol, lag, lead, whole_symbol
from barsmith.functions.scalar import first_match, next_business_day
from barsmith.operators.ranking import latest_per
from barsmith.operators.relational import error_metrics, guarded_ratio


def forecast_direction(forecasts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Forecast against the bar of the calendar day before it.

    direction_correct is NULL while the actual close is unknown.
    """
    prior = metrics.select("symbol", F.date_add("date", 1).alias("prediction_date"),
                           F.col("close").alias("previous_close"), "volume", "percent_change")
    out = forecasts.join(prior, ["symbol", "prediction_date"], "left")
    p, a, c = F.col("predicted_close"), F.col("actual_close"), F.col("previous_close")
    hit = F.coalesce(((p > c) & (a > c)) | ((p < c) & (a < c)), F.lit(False))
    return out.withColumns({
        "prediction_direction": first_match([(p > c, "Bullish"), (p < c, "Bearish")], "Neutral"),
        "direction_correct": F.when(a.isNotNull(), hit)})


def forecast_accuracy(directions: DataFrame) -> DataFrame:
    """Directional accuracy per symbol beside its latest forecast."""
    known = directions.filter(F.col("actual_close").isNotNull())
    total, correct = F.count("*"), F.count_if(F.col("direction_correct"))
    stats = known.groupBy("symbol").agg(
        total.alias("total_predictions"),
        F.count("actual_close").alias("predictions_with_actuals"),
        correct.alias("correct_direction_predictions"),
        F.avg("error_percentage").alias("avg_error_percentage"),
        guarded_ratio(correct, F.count("actual_close")).alias("direction_accuracy_pct"))
    newest = latest_per(directions.select("symbol", "prediction_date", "predicted_close",
                                          "prediction_direction"), order="prediction_date")
    newest = newest.select("symbol", *[F.col(c).alias(f"latest_{c}") for c in newest.columns
                                       if c != "symbol"])
    return stats.join(newest, "symbol", "left")


def backfill_actuals(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """Fill in actual close and errors where the bar has arrived since."""
    seen = bars.select("symbol", F.col("date").alias("prediction_date"), F.col("close").alias("_c"))
    out = forecasts.join(seen, ["symbol", "prediction_date"], "left")
    fill = F.col("actual_close").isNull() & F.col("_c").isNotNull()
    err = F.abs(F.col("predicted_close") - F.col("_c"))
    return out.select(
        "symbol", "prediction_date", "predicted_close",
        F.when(fill, F.col("_c")).otherwise(F.col("actual_close")).alias("actual_close"),
        F.when(fill, err).otherwise(F.col("prediction_error")).alias("prediction_error"),
        F.when(fill, err / F.nullif(F.col("_c"), F.lit(0.0)) * 100).otherwise(
            F.col("error_percentage")).alias("error_percentage"))


def forecast_error_metrics(forecasts: DataFrame) -> DataFrame:
    return error_metrics(forecasts)


# --- features ----------------------------------------------------------------


def minmax_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale each column to [0, 1] within its symbol; a constant column reads 0."""
    bounds = {}
    for c in columns:
        lo, hi = F.min(c).over(whole_symbol()), F.max(c).over(whole_symbol())
        bounds[f"{c}_scaled"] = F.coalesce((F.col(c) - lo) / F.nullif((hi - lo).cast("double"),
                                                                      F.lit(0.0)), F.lit(0.0))
    return df.withColumns(bounds)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """A reusable min-max scaler over the whole frame."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="raw_features", handleInvalid="skip"),
        MinMaxScaler(inputCol="raw_features", outputCol="scaled_features")]).fit(df)


def fill_forward_back(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Last known value, else the next known one, in date order per symbol."""
    ahead = by_symbol().rowsBetween(0, 2**31 - 1)
    behind = by_symbol().rowsBetween(-(2**31 - 1), 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(behind),
                                         F.first(c, ignorenulls=True).over(ahead))
                           for c in columns})


SEQUENCE_FEATURES = ("close", "volume", "percent_change", "macd_line", "rsi")


def sequence_features(df: DataFrame, length: int = 10, train_share: float = 0.8,
                      features: Sequence[str] = SEQUENCE_FEATURES) -> DataFrame:
    """Last ``length`` values of each feature, the next close, and a chronological split.

    Values are LAG columns over one window: no collected lists.
    """
    cols: dict[str, Column] = {}
    for f in features:
        for k in range(length):
            cols[f"{f}_{k}"] = F.col(f).cast("double") if k == 0 else lag(f, k).cast("double")
    ready = df.dropna(subset=list(features)).withColumns({
        **cols, "target": lead("close"), "_rn": F.row_number().over(by_symbol()),
        "_n": F.count("*").over(whole_symbol())})
    pairs = F.col("_n") - length
    keep = (F.col("_rn") >= length) & F.col("target").isNotNull()
    place = F.col("_rn") - length
    return (ready.filter(keep)
            .withColumn("split", F.when(place < F.floor(pairs * train_share), "train")
                        .otherwise("test"))
            .select("symbol", "date", *cols, "target", "split"))


def win_features(signals: DataFrame, results: DataFrame, bars: DataFrame,
                 indicators: DataFrame) -> DataFrame:
    """Signals with outcome and market features at the signal date; gaps become 0."""
    vol = F.avg("volume").over(by_symbol().rowsBetween(-30, -1))
    market = bars.select(
        "symbol", "date",
        F.coalesce(F.col("volume") / F.nullif(vol, F.lit(0.0)), F.lit(1.0)).alias("volume_ratio"),
        F.coalesce((F.col("close") - F.col("prev_close")) /
                   F.nullif(F.col("prev_close"), F.lit(0.0)) * 100, F.lit(0.0))
        .alias("daily_change"))
    outcome = results.select("symbol", F.col("signal_date").alias("date"), "is_win",
                             "percent_change")
    out = (signals.select("symbol", "date", "buy_score").join(outcome, ["symbol", "date"])
           .join(market, ["symbol", "date"], "left")
           .join(indicators.select("symbol", "date", "rsi", "macd_line", "macd_histogram",
                                   "percent_b"), ["symbol", "date"], "left"))
    return out.filter(F.col("is_win").isNotNull()).fillna(0.0)


WIN_FEATURES = ("buy_score", "rsi", "macd_line", "macd_histogram", "percent_b", "volume_ratio",
                "daily_change")


def _part(df: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: the same rows whatever the partitioning or a retry."""
    mark = F.pmod(F.xxhash64("symbol", "date", F.lit(seed)), F.lit(1000)) < int(share * 1000)
    return df.filter(mark), df.filter(~mark)


def train_win_classifier(features: DataFrame, trees: int = 100, depth: int = 5, seed: int = 42,
                         min_rows: int = 50) -> tuple[PipelineModel, DataFrame] | None:
    """Random forest on the win flag; model plus accuracies and importances, or None.

    Training needs ``min_rows`` rows.
    """
    data = features.select("symbol", "date", *WIN_FEATURES,
                           F.col("is_win").cast("double").alias("label"))
    if data.limit(min_rows).count() < min_rows:
        return None
    train, test = _part(data, 0.8, seed)
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(WIN_FEATURES), outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed,
                               subsamplingRate=1.0)]).fit(train)
    score = MulticlassClassificationEvaluator(metricName="accuracy")
    rows = [("train_accuracy", float(score.evaluate(model.transform(train)))),
            ("test_accuracy", float(score.evaluate(model.transform(test))))]
    rows += [(f"importance_{c}", float(w))
             for c, w in zip(WIN_FEATURES, model.stages[-1].featureImportances.toArray())]
    report = features.sparkSession.createDataFrame(rows, "metric string, value double")
    return model, report


def close_model_inputs(length: int = 10) -> dict[str, Column]:
    """Inputs of the next-close model: past closes, MACD, RSI and change relative to the close, so
    that symbols of any price level share it."""
    now = F.nullif(F.col("close_0"), F.lit(0.0))
    out = {f"r{k}": F.col(f"close_{k}") / now - 1 for k in range(1, length)}
    return out | {"m": F.col("macd_line_0") / now, "i": F.col("rsi_0") / 100,
                  "p": F.col("percent_change_0") / 100}


def fit_close_model(sequences: DataFrame, length: int = 10,
                    ridge: float = 0.01) -> dict[str, float] | None:
    """Ridge regression of the next close's change on :func:`close_model_inputs`, in closed form.

    One aggregation gives the sums of products of all training rows, a matrix whose size depends on
    the inputs alone; its solution is the model: a coefficient per input and ``intercept``. The
    penalty of an input is ``ridge`` times its variance for each row; the intercept has none.
    Rows without a complete sequence do not count; without rows there is no model.
    """
    inputs = close_model_inputs(length)
    now = F.nullif(F.col("close_0"), F.lit(0.0))
    rows = sequences.filter("split = 'train'").select(
        F.lit(1.0).alias("intercept"), *[c.alias(f) for f, c in inputs.items()],
        (F.col("target") / now - 1).alias("y")).dropna()
    names = ["intercept", *inputs]
    pairs = [(a, b) for k, a in enumerate(names) for b in [*names[k:], "y"]]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs]).first()
    n = sums["intercept*intercept"]
    if not n:
        return None
    gram = np.array([[sums[f"{a}*{b}" if names.index(a) <= names.index(b) else f"{b}*{a}"]
                      for b in names] for a in names])
    mean = gram[0] / n
    gram[np.diag_indices(len(names))] += ridge * n * (np.diag(gram) / n - mean ** 2)
    found = np.linalg.solve(gram, np.array([sums[f"{a}*y"] for a in names]))
    return dict(zip(names, map(float, found), strict=True))


def predict_close(model: dict[str, float], length: int = 10) -> Column:
    """The close that follows a sequence."""
    change = F.lit(model["intercept"])
    for f, c in close_model_inputs(length).items():
        change = change + F.lit(model[f]) * c
    return (change + 1) * F.col("close_0")


def next_close_forecast(df: DataFrame, length: int = 10) -> DataFrame:
    """Next business day's close per symbol from its newest complete sequence; none without one."""
    model = fit_close_model(sequence_features(df, length), length)
    cols = {f"close_{k}": (F.col("close") if k == 0 else lag("close", k)) for k in range(length)}
    newest = df.dropna(subset=list(SEQUENCE_FEATURES)).withColumns(cols).withColumns({
        f"{c}_0": F.col(c) for c in ("macd_line", "rsi", "percent_change")})
    newest = latest_per(newest.select("symbol", "date", *cols, "macd_line_0", "rsi_0",
                                      "percent_change_0")).dropna(subset=list(cols))
    close = predict_close(model, length) if model else F.lit(None).cast("double")
    return newest.select("symbol", next_business_day("date").alias("prediction_date"),
                         close.alias("predicted_close")).where("predicted_close is not null")


def save_model_version(spark: SparkSession, model: PipelineModel, path: str) -> int:
    """Write under the next free version number and refresh the ``latest`` copy."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = []
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v="):
                taken.append(int(name[2:]))
    version = max(taken, default=0) + 1
    model.write().overwrite().save(f"{path}/v={version}")
    model.write().overwrite().save(f"{path}/latest")
    return version
