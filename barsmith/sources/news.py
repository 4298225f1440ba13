"""News readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields of a stored article.
ARTICLE_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("positive_count", T.IntegerType()),
    T.StructField("negative_count", T.IntegerType()),
    T.StructField("scrape_date", T.DateType()),
])
REQUIRED = ["ticker", "title", "url", "published_at"]


def valid_articles(df: DataFrame) -> DataFrame:
    """Drop articles that lack a required field."""
    return df.dropna(subset=REQUIRED)


def read_news_json(spark: SparkSession, path: str) -> DataFrame:
    """Read files that hold arrays of article objects; the schema is given, not inferred."""
    raw = (spark.read.schema(ARTICLE_SCHEMA).option("multiLine", True)
           .option("mode", "PERMISSIVE").json(path))
    return valid_articles(raw)


def parse_articles(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from JSON text, one object per row; malformed text is dropped."""
    return valid_articles(lines.select(
        F.from_json(column, ARTICLE_SCHEMA, {"mode": "PERMISSIVE"}).alias("a")).select("a.*"))
