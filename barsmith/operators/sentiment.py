"""News: lexicon sentiment, aggregation and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.frames import since
from barsmith.functions.lexicon import (DEFAULT_NEGATIVE, DEFAULT_POSITIVE, entries_found, hits,
                                        sentiment_columns)
from barsmith.functions.scalar import first_match, ratio
from barsmith.operators.ranking import top_k

SNIPPET_LENGTH = 300


def lexicon_sentiment(articles: DataFrame, text: str = "content",
                      positive: Sequence[str] = DEFAULT_POSITIVE,
                      negative: Sequence[str] = DEFAULT_NEGATIVE) -> DataFrame:
    """Score the whole text against two word lists; one pass a text, JVM-side."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = articles.withColumn("_found", entries_found(body, [*positive, *negative]))
    out = out.withColumns({"positive_count": hits(F.col("_found"), positive),
                           "negative_count": hits(F.col("_found"), negative)})
    return out.withColumns(sentiment_columns("positive_count", "negative_count")).drop("_found")


def relevance_filter(articles: DataFrame, text: str = "content", ticker: str = "ticker",
                     topic: str = "saham") -> DataFrame:
    """Articles that mention their ticker or the general topic word."""
    body = F.lower(F.col(text))
    return articles.filter(body.contains(F.lower(F.col(ticker))) | body.contains(topic))


def recency_and_cap(articles: DataFrame, as_of=None, days: int = 7, per_ticker: int = 5,
                    published: str = "published") -> DataFrame:
    """Recent articles, newest few per ticker.

    The rank limit is applied inside each task before the shuffle, so a ticker
    with very many articles sends only ``per_ticker`` rows per task.
    """
    newest = Window.partitionBy("ticker").orderBy(F.col(published).desc(), F.col("url").asc())
    recent = since(articles, days, as_of, date_col=published)
    return (recent.withColumn("_rn", F.row_number().over(newest))
            .filter(F.col("_rn") <= per_ticker).drop("_rn"))


# Patterns for pulling text out of markup; no parser runs per row.
NOISE = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
TAG = r"<[^>]*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain_text(markup: Column) -> Column:
    """Markup without tags, entities resolved, white space collapsed."""
    t = F.regexp_replace(markup, TAG, " ")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def article_extract(pages: DataFrame, html: str = "html", paragraphs: int = 3,
                    length: int = SNIPPET_LENGTH) -> DataFrame:
    """Title, full text of all paragraphs, and the snippet shown in lists.

    The snippet joins the first paragraphs and is shortened with an ellipsis;
    the text itself is kept whole.
    """
    clean = F.regexp_replace(F.col(html), NOISE, "")
    parts = F.transform(F.regexp_extract_all(clean, F.lit(PARAGRAPH), 1), plain_text)
    out = pages.withColumns({"title": plain_text(F.regexp_extract(clean, TITLE, 1)),
                             "_parts": parts})
    lead_in = F.array_join(F.slice("_parts", 1, paragraphs), " ")
    snippet = F.when(F.char_length(lead_in) > length,
                     F.concat(F.substring(lead_in, 1, length), F.lit("..."))).otherwise(lead_in)
    return out.withColumns({"content": F.array_join("_parts", " "), "snippet": snippet,
                            "paragraph_count": F.size("_parts")}).drop("_parts", html)


def ticker_sentiment(articles: DataFrame, date_col: str = "published") -> DataFrame:
    """Counts and mean score per ticker and day; map-side combined.

    The mean is rounded to nine digits: a sum's last bits follow the order of the partitions, and
    labels compare it with 0.2 and 0.5.
    """
    label = F.col("sentiment")
    return articles.groupBy("ticker", F.col(date_col).cast("date").alias("date")).agg(
        F.count("*").alias("news_count"),
        F.round(F.avg("sentiment_score"), 9).alias("avg_sentiment"),
        F.count_if(label == "Positive").alias("positive_count"),
        F.count_if(label == "Negative").alias("negative_count"),
        F.count_if(label == "Neutral").alias("neutral_count"))


def share_of(count: str) -> Column:
    return F.when(F.col("news_count") > 0, ratio(count, "news_count") * 100).otherwise(F.lit(0.0))


def report_label(c: str = "avg_sentiment") -> Column:
    s = F.col(c)
    return first_match([(s > 0.5, "Strong Buy"), (s > 0.2, "Buy"), (s < -0.5, "Strong Sell"),
                        (s < -0.2, "Sell")], "Hold/No Signal")


def latest_news_date(sentiment: DataFrame) -> DataFrame:
    return sentiment.filter(F.col("news_count") >= 1).agg(F.max("date").alias("_day"))


def _latest(sentiment: DataFrame) -> DataFrame:
    return (sentiment.crossJoin(F.broadcast(latest_news_date(sentiment)))
            .filter((F.col("date") == F.col("_day")) & (F.col("news_count") >= 1)).drop("_day"))


def sentiment_report(sentiment: DataFrame) -> DataFrame:
    """The latest day with news: share of positive articles and label per ticker."""
    return _latest(sentiment).select(
        F.col("ticker").alias("symbol"), "avg_sentiment", "news_count", "positive_count",
        "negative_count", share_of("positive_count").alias("positive_percentage"),
        report_label().alias("trading_signal"))


def sentiment_extremes(report: DataFrame, k: int = 5) -> DataFrame:
    """k most positive and k most negative tickers."""
    s = F.col("avg_sentiment")
    best = top_k(report.filter(s > 0), [s.desc()], k).withColumn("side", F.lit("positive"))
    worst = top_k(report.filter(s < 0), [s.asc()], k).withColumn("side", F.lit("negative"))
    return best.unionByName(worst)


def combined_sentiment(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tickers that both feeds cover on their latest day; equal weights."""
    a = _latest(first).select(F.col("ticker").alias("symbol"),
                              F.col("avg_sentiment").alias("first_sentiment"),
                              F.col("news_count").alias("first_count"))
    b = _latest(second).select(F.col("ticker").alias("symbol"),
                               F.col("avg_sentiment").alias("second_sentiment"),
                               F.col("news_count").alias("second_count"))
    x, y = F.col("first_sentiment"), F.col("second_sentiment")
    return a.join(b, "symbol").withColumns({
        "combined_sentiment": x * 0.5 + y * 0.5,
        "contradictory": ((x > 0.2) & (y < -0.2)) | ((x < -0.2) & (y > 0.2))})


def latest_headlines(first: DataFrame, second: DataFrame, per_feed: int = 3, k: int = 5,
                     published: str = "published",
                     score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Newest few of each feed, newest k of the union.

    ``score`` adds ``sentiment`` to articles that have none yet: only the k that are shown are
    scored.
    """
    cols = ["ticker", "title", "url", published, "content" if score else "sentiment", "feed"]
    newest = [F.col(published).desc()]
    both = top_k(first.select(*cols), newest, per_feed, "url").unionByName(
        top_k(second.select(*cols), newest, per_feed, "url"))
    shown = top_k(both, newest, k, "url")
    shown = score(shown) if score else shown
    return shown.select("ticker", "title", "url", published, "sentiment", "feed")


def latest_day_headlines(articles: DataFrame, k: int = 5, published: str = "published") -> DataFrame:
    """k articles of the latest day, strongest score first."""
    day = articles.agg(F.max(F.col(published)).alias("_day"))
    rows = articles.crossJoin(F.broadcast(day)).filter(F.col(published) == F.col("_day"))
    return top_k(rows.select("ticker", "title", "url", published, "sentiment", "sentiment_score"),
                 [F.abs("sentiment_score").desc()], k, "url")


def sentiment_price(sentiment: DataFrame, metrics: DataFrame, companies: DataFrame, as_of=None,
                    days_in: int = 90, days_out: int = 30) -> DataFrame:
    """News sentiment beside price moves; both sides kept."""
    news = since(sentiment, days_in, as_of).select(
        F.col("ticker").alias("symbol"), "date", "avg_sentiment", "news_count", "positive_count",
        "negative_count", "neutral_count",
        share_of("positive_count").alias("positive_percentage"),
        share_of("negative_count").alias("negative_percentage"),
        (F.col("news_count") >= 2).alias("has_sufficient_data"))
    price = since(metrics, days_in, as_of).select("symbol", "date", "close", "percent_change")
    out = since(price.join(news, ["symbol", "date"], "full"), days_out, as_of)
    out = out.join(companies.select("symbol", "name"), "symbol", "left")
    s, n, move = F.col("avg_sentiment"), F.col("news_count"), F.col("percent_change")
    enough = F.coalesce(F.col("has_sufficient_data"), F.lit(False))
    alignment = first_match(
        [
            ((s > 0.25) & (move > 1), "Positive Alignment"),
            ((s < -0.25) & (move < -1), "Negative Alignment"),
            ((s > 0.25) & (move < -1), "Sentiment-Price Divergence (Bearish)"),
            ((s < -0.25) & (move > 1), "Sentiment-Price Divergence (Bullish)"),
        ],
        "Neutral/No Strong Signal",
    )
    trade = first_match(
        [
            ((s > 0.4) & (n >= 3), "Strong Buy Signal"),
            ((s > 0.2) & (n >= 2), "Buy Signal"),
            ((s < -0.4) & (n >= 3), "Strong Sell Signal"),
            ((s < -0.2) & (n >= 2), "Sell Signal"),
        ],
        "Hold/No Signal",
    )
    return out.withColumns({
        "sentiment_price_signal": F.when(enough & move.isNotNull(), alignment).otherwise(
            F.lit("Insufficient Data")),
        "trading_signal": F.when(enough, trade).otherwise(F.lit("Insufficient Data")),
    }).select("symbol", "name", "date", "close", "percent_change", "avg_sentiment", "news_count",
              "positive_count", "negative_count", "neutral_count", "positive_percentage",
              "negative_percentage", "has_sufficient_data", "sentiment_price_signal",
              "trading_signal")


def sentiment_history(first: DataFrame, second: DataFrame, symbol: str, as_of=None,
                      days: int = 30) -> DataFrame:
    """Both feeds of one ticker by day."""
    def recent(df: DataFrame) -> DataFrame:
        return since(df, days, as_of).filter(
            (F.col("ticker") == symbol) & (F.col("news_count") >= 1))

    a = recent(first).select(
        F.col("ticker").alias("symbol"), "date", F.col("avg_sentiment").alias("first_sentiment"),
        F.col("news_count").alias("first_count"), "positive_count", "negative_count",
        share_of("positive_count").alias("positive_percentage"),
        report_label().alias("trading_signal"))
    b = recent(second).select(
        F.col("ticker").alias("symbol"), "date", F.col("avg_sentiment").alias("second_sentiment"),
        F.col("news_count").alias("second_count"))
    return a.join(b, ["symbol", "date"], "full")
