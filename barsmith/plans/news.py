"""News and sentiment queries. Sentiment reads the whole text of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.functions.lexicon import (BILINGUAL_NEGATIVE, BILINGUAL_POSITIVE, DEFAULT_NEGATIVE,
                                        DEFAULT_POSITIVE, parse_published)
from barsmith.operators import market as M
from barsmith.operators import sentiment as N
from barsmith.plans.inputs import (TEST_NEGATIVE, TEST_POSITIVE, articles, bars, latest_date,
                                   spread, table)
from barsmith.plans.registry import query
from barsmith.plans.sqlbase import METRICS, bars_sql

ARTICLES = """, art AS (
  SELECT doc_id, 'S' || (doc_id % (SELECT count(*) FROM supplier)) AS ticker,
         split_part(text, chr(10), 1) AS title, text AS content, 'doc://' || doc_id AS url,
         (SELECT d FROM anchor) - CAST(doc_id % 30 AS INTEGER) AS published,
         CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS feed
  FROM documents)"""


def _quote(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def scored_sql(positive, negative, source="art", name="scored") -> str:
    pos = "[" + ", ".join(_quote(w) for w in positive) + "]"
    neg = "[" + ", ".join(_quote(w) for w in negative) + "]"
    return f""", {name}_n AS (
  SELECT *, len(list_filter({pos}, lambda w: contains(lower(content), w))) AS positive_count,
         len(list_filter({neg}, lambda w: contains(lower(content), w))) AS negative_count
  FROM {source}
), {name} AS (
  SELECT *, CASE WHEN positive_count > negative_count THEN 'Positive'
                 WHEN negative_count > positive_count THEN 'Negative' ELSE 'Neutral' END
              AS sentiment,
         CASE WHEN positive_count = negative_count THEN 0e0
              WHEN positive_count > negative_count
                THEN positive_count / CAST(positive_count + negative_count AS DOUBLE)
              ELSE -negative_count / CAST(positive_count + negative_count AS DOUBLE) END
           AS sentiment_score
  FROM {name}_n)"""


SENTIMENT = ARTICLES + scored_sql(TEST_POSITIVE, TEST_NEGATIVE) + """, senti AS (
  SELECT ticker, published AS date, feed, count(*) AS news_count,
         round(avg(sentiment_score), 9) AS avg_sentiment,
         count(*) FILTER (sentiment = 'Positive') AS positive_count,
         count(*) FILTER (sentiment = 'Negative') AS negative_count,
         count(*) FILTER (sentiment = 'Neutral') AS neutral_count
  FROM scored GROUP BY ticker, published, feed)"""

# Labels of moods (3 * sentiment + price, each -1, 0 or 1) and of strengths.
MOODS = {4: "Positive Alignment", -4: "Negative Alignment",
         2: "Sentiment-Price Divergence (Bearish)", -2: "Sentiment-Price Divergence (Bullish)"}
STRENGTHS = ["Strong Sell Signal", "Sell Signal", "Hold/No Signal", "Buy Signal",
             "Strong Buy Signal"]

SENTIMENT_PRICE = f""", told AS (SELECT * FROM senti WHERE feed = 'A'),
days AS (
  SELECT symbol, date FROM metrics UNION SELECT ticker, date FROM told
), met AS (
  SELECT symbol, date, m.close, m.percent_change, t.avg_sentiment, t.news_count, t.positive_count,
         t.negative_count, t.neutral_count, t.news_count >= 2 AS has_sufficient_data,
         (avg_sentiment > 0.25)::INT - (avg_sentiment < -0.25)::INT AS mood,
         (percent_change > 1)::INT - (percent_change < -1)::INT AS move,
         (avg_sentiment > 0.2)::INT - (avg_sentiment < -0.2)::INT AS side,
         (abs(avg_sentiment) > 0.4 AND news_count >= 3)::INT AS sure
  FROM days LEFT JOIN metrics m USING (symbol, date)
  LEFT JOIN (SELECT ticker AS symbol, * EXCLUDE ticker FROM told) t USING (symbol, date)
  WHERE date >= (SELECT d FROM anchor) - 30
), senti_price AS (
  SELECT symbol, name, date, close, percent_change, avg_sentiment, news_count, positive_count,
         negative_count, neutral_count, positive_count * 1e2 / news_count AS positive_percentage,
         negative_count * 1e2 / news_count AS negative_percentage, has_sufficient_data,
         CASE WHEN has_sufficient_data AND percent_change IS NOT NULL
              THEN coalesce(MAP {MOODS}[3 * mood + move], 'Neutral/No Strong Signal')
              ELSE 'Insufficient Data' END AS sentiment_price_signal,
         CASE WHEN has_sufficient_data THEN {STRENGTHS}[3 + side * (1 + sure)]
              ELSE 'Insufficient Data' END AS trading_signal
  FROM met LEFT JOIN dim USING (symbol))"""

DIM = """, dim AS (SELECT symbol, last(name ORDER BY date) AS name FROM bars GROUP BY symbol)"""


def scored_articles(spark, sf, positive=TEST_POSITIVE, negative=TEST_NEGATIVE):
    return N.lexicon_sentiment(articles(spark, sf), "content", positive, negative)


def sentiment_table(scored, feed):
    return N.ticker_sentiment(scored.filter(F.col("feed") == feed))


SCORE_COLUMNS = "url, ticker, sentiment, sentiment_score, positive_count, negative_count"


for _name, _pos, _neg in (("lexicon_sentiment", TEST_POSITIVE, TEST_NEGATIVE),
                          ("lexicon_sentiment_default", DEFAULT_POSITIVE, DEFAULT_NEGATIVE),
                          ("lexicon_sentiment_bilingual", BILINGUAL_POSITIVE,
                           BILINGUAL_NEGATIVE)):
    @query(_name, bars_sql(f"SELECT {SCORE_COLUMNS} FROM scored", ARTICLES,
                           scored_sql(_pos, _neg)), "sentiment_score")
    def _(spark, sf, _pos=_pos, _neg=_neg):
        return scored_articles(spark, sf, _pos, _neg).select(*SCORE_COLUMNS.split(", "))


@query("relevance_filter", bars_sql("""
SELECT url, ticker FROM art
WHERE contains(lower(content), lower(ticker)) OR contains(lower(content), 'saham')
   OR contains(lower(content), 'der')""", ARTICLES))
def _(spark, sf):
    a = articles(spark, sf)
    strict = N.relevance_filter(a).select("url", "ticker")
    # A second topic word, so that the synthetic texts have hits.
    return strict.unionByName(N.relevance_filter(a, topic="der").select("url", "ticker")).distinct()


@query("recency_and_cap", bars_sql("""
, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published DESC, url) AS rn
        FROM art WHERE published >= (SELECT d FROM anchor) - 7)
SELECT ticker, url, published FROM r WHERE rn <= 2""", ARTICLES))
def _(spark, sf):
    return N.recency_and_cap(articles(spark, sf), latest_date(spark, sf), per_ticker=2).select(
        "ticker", "url", "published")


def _plain_sql(expr: str) -> str:
    t = f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')"
    for entity, char in N.ENTITIES.items():
        t = f"replace({t}, {_quote(entity)}, {_quote(char)})"
    return f"trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g'))"


@query("article_extract", f"""
WITH c AS (
  SELECT page_id, url, regexp_replace(html, {_quote(N.NOISE)}, '', 'g') AS h FROM pages
), p AS (
  SELECT page_id, url, {_plain_sql(f"regexp_extract(h, {_quote(N.TITLE)}, 1)")} AS title,
         list_transform(regexp_extract_all(h, {_quote(N.PARAGRAPH)}, 1),
                        lambda x: {_plain_sql("x")}) AS parts
  FROM c
), s AS (SELECT *, array_to_string(parts[1:3], ' ') AS lead_in FROM p)
SELECT page_id, url, title, array_to_string(parts, ' ') AS content,
       CASE WHEN length(lead_in) > 300 THEN substring(lead_in, 1, 300) || '...' ELSE lead_in END
         AS snippet, len(parts) AS paragraph_count
FROM s""")
def _(spark, sf):
    return N.article_extract(spread(table(spark, sf, "pages")))


MONTH_NAMES = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus",
               "September", "Oktober", "November", "Desember"]


@query("parse_published_at", f"""
SELECT event_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS published_at FROM events""")
def _(spark, sf):
    """Render every event time the way the news site does, then parse it back."""
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    ts = F.col("ts").cast("timestamp")
    local = F.concat_ws(" ", F.dayofmonth(ts), F.element_at(months, F.month(ts)), F.year(ts),
                        F.date_format(ts, "HH:mm"))
    text = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Senin, "), local, F.lit(" WIB")))
            .when(F.col("event_id") % 3 == 1, F.concat(local, F.lit(" WIB"))).otherwise(local))
    return table(spark, sf, "events").select(
        "event_id", parse_published(text).cast("timestamp_ntz").alias("published_at"))


@query("ticker_sentiment", bars_sql(
    "SELECT ticker, date, CAST(sum(news_count) AS BIGINT) AS news_count, "
    "sum(avg_sentiment * news_count) / sum(news_count) AS avg_sentiment, "
    "CAST(sum(positive_count) AS BIGINT) AS positive_count, "
    "CAST(sum(negative_count) AS BIGINT) AS negative_count, "
    "CAST(sum(neutral_count) AS BIGINT) AS neutral_count FROM senti GROUP BY ticker, date",
    SENTIMENT), "avg_sentiment")
def _(spark, sf):
    return N.ticker_sentiment(scored_articles(spark, sf))


REPORT = """, rep AS (
  SELECT ticker AS symbol, avg_sentiment, news_count, positive_count, negative_count,
         positive_count * 1e2 / news_count AS positive_percentage,
         CASE WHEN avg_sentiment > 0.5 THEN 'Strong Buy' WHEN avg_sentiment > 0.2 THEN 'Buy'
              WHEN avg_sentiment < -0.5 THEN 'Strong Sell' WHEN avg_sentiment < -0.2 THEN 'Sell'
              ELSE 'Hold/No Signal' END AS trading_signal
  FROM senti WHERE feed = 'A' AND date = (SELECT max(date) FROM senti WHERE feed = 'A'))"""


@query("sentiment_report", bars_sql("SELECT * FROM rep", SENTIMENT, REPORT),
       "avg_sentiment positive_percentage")
def _(spark, sf):
    return N.sentiment_report(sentiment_table(scored_articles(spark, sf), "A"))


@query("sentiment_extremes", bars_sql("""
SELECT * FROM (SELECT *, 'positive' AS side FROM rep WHERE avg_sentiment > 0
               ORDER BY avg_sentiment DESC, symbol LIMIT 5)
UNION ALL
SELECT * FROM (SELECT *, 'negative' FROM rep WHERE avg_sentiment < 0
               ORDER BY avg_sentiment, symbol LIMIT 5)""", SENTIMENT, REPORT),
       "avg_sentiment positive_percentage")
def _(spark, sf):
    report = N.sentiment_report(sentiment_table(scored_articles(spark, sf), "A"))
    return N.sentiment_extremes(report)


@query("combined_sentiment", bars_sql("""
, sc2 AS (SELECT s.*, d.k FROM scored s
          JOIN (SELECT doc_id, doc_id // 2 AS k FROM art) d USING (doc_id))
, dated AS (SELECT *, (SELECT d FROM anchor) - CAST(k % 30 AS INTEGER) AS day FROM sc2)
, f AS (SELECT 'S' || (k % (SELECT count(*) FROM supplier)) AS symbol,
               round(avg(sentiment_score), 9) AS first_sentiment, count(*) AS first_count
        FROM dated WHERE feed = 'A' AND day = (SELECT max(day) FROM dated) GROUP BY 1)
, g AS (SELECT 'S' || (k % (SELECT count(*) FROM supplier)) AS symbol,
               round(avg(sentiment_score), 9) AS second_sentiment, count(*) AS second_count
        FROM dated WHERE feed = 'B' AND day = (SELECT max(day) FROM dated) GROUP BY 1)
SELECT *, first_sentiment * 5e-1 + second_sentiment * 5e-1 AS combined_sentiment,
       (first_sentiment > 0.2 AND second_sentiment < -0.2)
       OR (first_sentiment < -0.2 AND second_sentiment > 0.2) AS contradictory
FROM f JOIN g USING (symbol)""",
                                      ARTICLES, scored_sql(TEST_POSITIVE, TEST_NEGATIVE)),
       "first_sentiment second_sentiment combined_sentiment")
def _(spark, sf):
    """Both feeds number their own articles, so that they cover the same tickers and days."""
    listed = table(spark, sf, "supplier").agg(F.count("*").alias("_n"))
    k = F.expr("doc_id div 2")
    scored = scored_articles(spark, sf).crossJoin(F.broadcast(listed)).withColumns({
        "ticker": F.concat(F.lit("S"), (k % F.col("_n"))),
        "published": F.date_sub(F.lit(latest_date(spark, sf)), (k % 30).cast("int"))})
    return N.combined_sentiment(sentiment_table(scored, "A"), sentiment_table(scored, "B"))


@query("latest_headlines", bars_sql("""
SELECT ticker, title, url, published, sentiment, feed FROM (
  (SELECT * FROM scored WHERE feed = 'A' ORDER BY published DESC, url LIMIT 3) UNION ALL
  (SELECT * FROM scored WHERE feed = 'B' ORDER BY published DESC, url LIMIT 3))
ORDER BY published DESC, url LIMIT 5""", ARTICLES, scored_sql(TEST_POSITIVE, TEST_NEGATIVE)))
def _(spark, sf):
    a = articles(spark, sf)
    return N.latest_headlines(a.filter("feed = 'A'"), a.filter("feed = 'B'"), score=lambda shown: (
        N.lexicon_sentiment(shown, "content", TEST_POSITIVE, TEST_NEGATIVE)))


@query("latest_day_headlines", bars_sql("""
SELECT ticker, title, url, published, sentiment, sentiment_score FROM scored
WHERE published = (SELECT max(published) FROM scored)
ORDER BY abs(sentiment_score) DESC, url LIMIT 5""", ARTICLES,
                                        scored_sql(TEST_POSITIVE, TEST_NEGATIVE)),
       "sentiment_score")
def _(spark, sf):
    return N.latest_day_headlines(scored_articles(spark, sf))


@query("sentiment_price", bars_sql("SELECT * FROM senti_price", METRICS, DIM, SENTIMENT,
                                   SENTIMENT_PRICE),
       "percent_change avg_sentiment positive_percentage negative_percentage")
def _(spark, sf):
    b = bars(spark, sf)
    return N.sentiment_price(sentiment_table(scored_articles(spark, sf), "A"), M.daily_metrics(b),
                             M.dim_companies(b), latest_date(spark, sf))


@query("sentiment_history", bars_sql("""
, a AS (SELECT * FROM senti WHERE feed = 'A' AND ticker IN ('S2', 'S3')),
b AS (SELECT * FROM senti WHERE feed = 'B' AND ticker IN ('S2', 'S3'))
SELECT coalesce(a.ticker, b.ticker) AS symbol, coalesce(a.date, b.date) AS date,
       a.avg_sentiment AS first_sentiment, a.news_count AS first_count, a.positive_count,
       a.negative_count, a.positive_count * 1e2 / a.news_count AS positive_percentage,
       CASE WHEN a.ticker IS NULL THEN NULL
            WHEN a.avg_sentiment > 0.5 THEN 'Strong Buy' WHEN a.avg_sentiment > 0.2 THEN 'Buy'
            WHEN a.avg_sentiment < -0.5 THEN 'Strong Sell' WHEN a.avg_sentiment < -0.2 THEN 'Sell'
            ELSE 'Hold/No Signal' END AS trading_signal,
       b.avg_sentiment AS second_sentiment, b.news_count AS second_count
FROM a FULL JOIN b ON a.ticker = b.ticker AND a.date = b.date""", SENTIMENT),
       "first_sentiment positive_percentage second_sentiment")
def _(spark, sf):
    s, as_of = scored_articles(spark, sf), latest_date(spark, sf)
    first, second = sentiment_table(s, "A"), sentiment_table(s, "B")
    return N.sentiment_history(first, second, "S2", as_of).unionByName(
        N.sentiment_history(first, second, "S3", as_of))
