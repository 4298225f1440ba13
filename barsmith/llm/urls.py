"""URL filters by association rules.

Labelled pages become transactions of URL tokens. Spark FP-growth mines the token combinations of
the bad ones with at least MIN_SUPPORT of all labelled pages; a rule ``tokens -> bad`` is kept if
its confidence is at least MIN_CONFIDENCE, surely above MIN_LOWER, and no kept rule of fewer of its
tokens is as confident. Rules are matched by an inverted index: pages and rules are joined on single tokens,
and a rule holds where all of its tokens are met. Fixed prefix rules come before mined ones.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.store import stored, table

# Prefix rules, host and path.
PREFIX_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: The lower end of the confidence's Wilson interval (z = 2) must reach this: few pages prove little.
MIN_LOWER = 0.5
MAX_TOKENS = 3
LABEL = "label=bad"


def host(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path(url: F.Column) -> F.Column:
    """From the host on up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prefix_rule(host_: F.Column, path_: F.Column, rules=PREFIX_RULES) -> tuple[F.Column, F.Column]:
    """Verdict and name of the longest rule whose host is the page's or above it, or nulls."""
    verdict = name = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = (((host_ == h) | F.endswith(host_, F.lit(f".{h}")))
                & F.startswith(path_, F.lit(p)))
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
    return verdict, name


def tokens(host_: F.Column, path_: F.Column, url: F.Column) -> F.Column:
    """Distinct tokens: host suffixes and the words of host labels, path parts, file ending, query
    keys and scheme. Numbers count as one token."""
    parts = F.filter(F.split(path_, "/"), lambda x: x != "")
    labels = F.filter(F.split(host_, r"\."), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != "")
    words = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.transform(words, lambda x: F.concat(F.lit("word="), x)),
        F.transform(parts, lambda x: F.concat(F.lit("path="), F.regexp_replace(
            x, r"\d+", "0"))),
        F.transform(query, lambda x: F.concat(F.lit("key="), F.split(x, "=")[0])),
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))))


def mine(transactions: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``rule, token, n_tokens, confidence`` from ``(tokens, bad)``: a row per token of a rule.

    Supports are shares of the labelled pages, so there are at most
    ``1 / min_support * C(tokens a page, MAX_TOKENS)`` rules whatever the number of pages.
    """
    with_label = transactions.where("tokens is not null and bad is not null").select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(LABEL))).otherwise(F.col("tokens"))
        .alias("items"))
    often = stored(FPGrowth(itemsCol="items", minSupport=min_support).fit(with_label)
                   .freqItemsets.where(F.size("items") <= MAX_TOKENS + 1), "itemsets")
    bad = (often.where(F.array_contains("items", LABEL))
           .select(F.array_sort(F.array_remove("items", LABEL)).alias("items"),
                   F.col("freq").alias("n_bad")).where(F.size("items") > 0))
    plain = (often.where(~F.array_contains("items", LABEL))
             .select(F.array_sort("items").alias("items"), "freq"))
    rules = stored(bad.join(plain, "items").withColumn("confidence", F.col("n_bad") / F.col("freq"))
                   .where(F.col("confidence") >= min_confidence)
                   .where((F.col("confidence") + 2 / F.col("freq") - 2 * F.sqrt(
                       F.col("confidence") * (1 - F.col("confidence")) / F.col("freq")
                       + 1 / F.col("freq") / F.col("freq"))) >= MIN_LOWER * (1 + 4 / F.col("freq")))
                   .select(F.xxhash64("items").alias("rule"), "items", "confidence",
                           F.size("items").alias("n_tokens")), "rules")
    listed = rules.select("rule", F.explode("items").alias("token"), "n_tokens", "confidence")
    # A rule is spare if a part of its tokens is a rule already and as confident.
    wide, part = listed.alias("w"), listed.alias("p")
    spare = (wide.join(part, F.col("w.token") == F.col("p.token"))
             .where("p.n_tokens < w.n_tokens and p.confidence >= w.confidence")
             .groupBy("w.rule", "p.rule").agg(F.count("*").alias("n"),
                                              F.first("p.n_tokens").alias("m"))
             .where("n = m").select(F.col("w.rule").alias("rule")).distinct())
    return stored(listed.join(spare, "rule", "left_anti"), "kept-rules")


def match(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key, confidence`` of rows of ``(key, tokens)`` that meet all tokens of a rule."""
    met = pages.select(key, F.explode("tokens").alias("token")).join(rules, "token")
    return (met.groupBy(key, "rule").agg(F.count("*").alias("n"), F.max("n_tokens").alias("m"),
                                         F.max("confidence").alias("confidence"))
            .where("n = m").groupBy(key).agg(F.max("confidence").alias("confidence")))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence``, a row per input row.

    A page with a prefix rule has its verdict; otherwise it is blocked if a mined rule holds and
    allowed if none does. Labels belong to pages by ``doc_id = page_id``; bad is quality 0 or
    toxic 1, null labels are skipped, and a page with contradicting labels is bad. A null url,
    and one without ``://``, has empty host and path and no tokens, and is allowed. Equal urls
    are matched once. Without labels no rule is mined.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    verdict, name = prefix_rule(F.col("host"), F.col("path"))
    rows = (pages.select("page_id", "url", h.alias("host"), p.alias("path"))
            .withColumn("rule", name).withColumn("fixed", verdict)
            .withColumn("tokens", F.when(F.col("host") != "",
                                         tokens(F.col("host"), F.col("path"), F.col("url")))))
    bad = (labels.where("doc_id is not null")
           .select(F.col("doc_id").alias("page_id"),
                   F.coalesce(F.col("quality") == 0, F.col("toxic") == 1).alias("a"),
                   F.coalesce(F.col("toxic") == 1, F.col("quality") == 0).alias("b"))
           .where("a is not null").groupBy("page_id").agg(F.max(F.expr("a or b")).alias("bad")))
    # FP-growth reads its input more than once.
    known = stored(rows.where("tokens is not null").select("page_id", "tokens").join(bad, "page_id")
                   .select("tokens", "bad"), "transactions")
    if known.isEmpty():
        hit = pages.sparkSession.createDataFrame([], "tokens_hash long, confidence double")
    else:
        sets = (rows.where("tokens is not null and fixed is null")
                .select(F.xxhash64("tokens").alias("tokens_hash"), "tokens")
                .dropDuplicates(["tokens_hash"]))
        hit = match(sets, mine(known), "tokens_hash")
    return (rows.withColumn("tokens_hash", F.when(F.col("fixed").isNull(), F.xxhash64("tokens")))
            .join(hit, "tokens_hash", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), "block")
                               .otherwise("allow")).alias("verdict"), "confidence"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
