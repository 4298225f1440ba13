"""Secret scan: fixed patterns and a battery of randomness tests, in SQL functions only.

Three fixed kinds are searched by pattern. Other long runs of encoding characters are candidates:
their encoding is inferred (hex, base32, base64), and three tests ask whether they could be drawn
evenly from its alphabet: chi-squared on the letter counts, runs above and below the middle, and
serial correlation of neighbours. The p-values are joined by Fisher's rule. Within each encoding
and octave of length the false-discovery rate of calling a candidate *not* random is held at
FALSE_DISCOVERY (Benjamini-Hochberg over a histogram of p-values, so a stratum of any size costs a
few hundred counts); what is left is random enough to be a key. Long words of a language are far
from even and go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barsmith.llm.store import documents, stored

# The patterns of the base kinds.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: A candidate has a digit: letters alone are taken for words, and few keys of 20 letters have none.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
FALSE_DISCOVERY = 0.05
#: Bins of the p-value histogram: BIN_STEP to a power of ten, LAST_BIN for all below.
BIN_STEP, LAST_BIN = 20, 400
OPEN, CLOSE, OTHER = "", "", ""
HEX_LETTERS = "0123456789abcdef"
BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SPANS = "array<struct<s:int,e:int,t:string>>"


def spans(text: F.Column, pattern: str) -> F.Column:
    """Leftmost matches that do not overlap: start, end (exclusive, code points) and string.

    Matches are put between two private characters, which the text must not hold, and the text is
    split at these: every other part is a match.
    """
    marked = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")
    parts = F.split(marked, f"[{OPEN}{CLOSE}]")
    empty = F.from_json(F.lit("[]"), SPANS)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), empty.alias("out"))
    walked = F.aggregate(parts, start, lambda a, x: F.struct(
        (a["at"] + F.length(x)).alias("at"), (~a["odd"]).alias("odd"),
        F.when(a["odd"], F.array_append(a["out"], F.struct(
            a["at"].alias("s"), (a["at"] + F.length(x)).alias("e"), x.alias("t"))))
        .otherwise(a["out"]).alias("out")))
    return F.when(text.rlike(pattern), walked["out"]).otherwise(empty)


def _upper_tail(z: F.Column) -> F.Column:
    """1 - Phi(z) for z >= 0, to 7 decimals (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937
                                                       + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) / 2.5066282746310002 * poly, F.lit(1e-30))


def _encoding(body: F.Column) -> F.Column:
    """0 hex, 1 base32, 2 base64; null for digits alone."""
    return (F.when(body.rlike("^[0-9]*$"), F.lit(None).cast("int"))
            .when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 0)
            .when(body.rlike("^[A-Z2-7]+$"), 1).otherwise(2))


def _then(items: F.Column, **fields) -> F.Column:
    """Adds fields to the structs of an array. A lambda's argument is evaluated once, so chained
    steps stay small where nested expressions would be written out again at each use."""
    return F.transform(items, lambda c: F.struct(
        c["s"].alias("s"), c["e"].alias("e"), *(f(c).alias(k) for k, f in fields.items())))


def battery(candidates: F.Column) -> F.Column:
    """From ``array<struct<s, e, t>>``: structs of s, e, encoding, length and histogram bin.

    Digits alone and bodies under 16 characters are left out.
    """
    sets = (HEX_LETTERS, BASE32_LETTERS, BASE64_LETTERS)
    each = _then(candidates, raw=lambda c: F.translate(F.regexp_replace(c["t"], "=+$", ""),
                                                       "-_=", "+/"))
    each = _then(each, raw=lambda c: c["raw"], code=lambda c: _encoding(c["raw"]))
    each = F.filter(each, lambda c: c["code"].isNotNull() & (F.length(c["raw"]) >= 16))
    each = _then(each, code=lambda c: c["code"], body=lambda c: F.when(
        c["code"] == 0, F.lower(c["raw"])).otherwise(c["raw"]))

    def of_code(c, values):
        return F.when(c["code"] == 0, values[0]).when(c["code"] == 1, values[1]).otherwise(values[2])

    each = _then(
        each, code=lambda c: c["code"], body=lambda c: c["body"],
        n=lambda c: F.length(c["body"]).cast("double"), chars=lambda c: F.split(c["body"], ""),
        k=lambda c: of_code(c, [F.lit(float(len(x))) for x in sets]),
        halves=lambda c: of_code(c, [F.translate(
            c["body"], x, "0" * (len(x) // 2) + "1" * (len(x) // 2)) for x in sets]))
    each = _then(
        each, code=lambda c: c["code"], n=lambda c: c["n"], k=lambda c: c["k"],
        squares=lambda c: F.aggregate(F.array_distinct(c["chars"]), F.lit(0.0), lambda a, x: a + F.pow(
            c["n"] - F.length(F.replace(c["body"], x, F.lit(""))), F.lit(2.0))),
        ones=lambda c: c["n"] - F.length(F.replace(c["halves"], F.lit("1"), F.lit(""))),
        turns=lambda c: sum((c["n"] - F.length(F.replace(c["halves"], F.lit(x), F.lit("")))) / 2
                            for x in ("01", "10")),
        values=lambda c: F.transform(c["chars"], lambda x: F.instr(
            of_code(c, [F.lit(y) for y in sets]), x) - (c["k"] + 1) / 2))
    each = _then(
        each, code=lambda c: c["code"], n=lambda c: c["n"], df=lambda c: c["k"] - 1,
        chi=lambda c: F.greatest(c["k"] / c["n"] * c["squares"] - c["n"], F.lit(0.0)),
        runs=lambda c: 1 + c["turns"], mean=lambda c: 2 * c["ones"] * (c["n"] - c["ones"]) / c["n"] + 1,
        total=lambda c: F.aggregate(c["values"], F.lit(0.0), lambda a, v: a + v * v),
        products=lambda c: F.aggregate(
            F.zip_with(F.slice(c["values"], 1, F.size(c["values"]) - 1),
                       F.slice(c["values"], 2, F.size(c["values"]) - 1), lambda x, y: x * y),
            F.lit(0.0), lambda a, v: a + v))
    each = _then(
        each, code=lambda c: c["code"], n=lambda c: c["n"],
        # Wilson and Hilferty's cube root makes chi-squared normal.
        even=lambda c: (F.pow(c["chi"] / c["df"], F.lit(1 / 3)) - (1 - 2 / (9 * c["df"])))
        / F.sqrt(2 / (9 * c["df"])),
        runs=lambda c: F.when(c["mean"] > 2, F.abs(c["runs"] - c["mean"]) / F.sqrt(
            (c["mean"] - 1) * (c["mean"] - 2) / (c["n"] - 1))).otherwise(F.sqrt(c["n"])),
        serial=lambda c: F.abs(c["products"]) / F.greatest(c["total"], F.lit(1e-9)) * F.sqrt(c["n"]))
    each = _then(
        each, code=lambda c: c["code"], n=lambda c: c["n"],
        even=lambda c: _upper_tail(F.abs(c["even"])), right=lambda c: c["even"] >= 0,
        runs=lambda c: _upper_tail(c["runs"]), serial=lambda c: _upper_tail(c["serial"]))
    each = _then(
        each, code=lambda c: c["code"], n=lambda c: c["n"], half=lambda c: -(
            F.log(F.when(c["right"], c["even"]).otherwise(1 - c["even"]))
            + F.log(F.least(2 * c["runs"], F.lit(1.0))) + F.log(F.least(2 * c["serial"], F.lit(1.0)))))
    each = _then(each, code=lambda c: c["code"], n=lambda c: c["n"], p=lambda c: F.exp(-c["half"]) * (
        1 + c["half"] + c["half"] * c["half"] / 2))
    return _then(
        each, code=lambda c: c["code"], n=lambda c: c["n"].cast("int"),
        bin=lambda c: F.least(F.floor(-BIN_STEP * F.log10(F.greatest(c["p"], F.lit(1e-30)))),
                              F.lit(LAST_BIN)).cast("int"))


def _stratum(code: F.Column, n: F.Column) -> F.Column:
    return (code * 64 + F.floor(F.log2(n.cast("double")))).cast("int")


def _first_rejected(found: DataFrame) -> dict[int, int]:
    """Smallest rejected histogram bin of each stratum; at most 3 x 31 strata."""
    counts = (found.select(F.explode("random").alias("c"))
              .groupBy(_stratum(F.col("c.code"), F.col("c.n")).alias("stratum"),
                       F.col("c.bin").alias("bin")).agg(F.count("*").alias("n")))
    by = W.partitionBy("stratum")
    ranked = counts.select("stratum", "bin", F.sum("n").over(by.orderBy(F.desc("bin"))).alias("rank"),
                           F.sum("n").over(by).alias("m"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / BIN_STEP)
                          <= FALSE_DISCOVERY * F.col("rank") / F.col("m"))
    return {r.stratum: r.bin for r in passed.groupBy("stratum").agg(
        F.min("bin").alias("bin")).collect()}


def _of_kind(i: int):
    return lambda m: F.struct(m["s"].alias("s"), F.lit(i).alias("k"), m["e"].alias("e"))


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every whole text, a row per input row; a null text counts as empty.

    ``n_assign``, ``n_access``, ``n_hex``, ``n_random`` count spans; ``base_sha256`` is the digest
    of the base spans and ``spans`` lists all as ``kind:start:end`` by start and kind.
    Kinds may overlap each other, random spans overlap no base span. Candidates of digits alone
    are not judged.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), OPEN + CLOSE, OTHER * 2)
    rows = docs.select(F.col("doc_id"), text.alias("x"))
    rows = rows.select(
        "doc_id", F.filter(spans(F.col("x"), ASSIGN), lambda m: F.length(
            F.regexp_extract(m["t"], ASSIGN, 2)) >= 8).alias("assign"),
        spans(F.col("x"), ACCESS).alias("access"), spans(F.col("x"), HEX).alias("hex"),
        spans(F.col("x"), CANDIDATE).alias("candidates"))
    # Written before use: an expression under a lambda would be evaluated at each step.
    rows = stored(rows, "matches")
    base = F.concat(*(F.transform(F.col(k), _of_kind(i)) for i, k in enumerate(KINDS[:3])))
    rows = rows.withColumn("base", F.array_sort(base))
    free = F.filter("candidates", lambda c: ~F.exists(
        F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    found = stored(rows.select(
        "doc_id", "base", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        battery(free).alias("random")), "spans")
    rejected = _first_rejected(found)
    limit = F.create_map(*(F.lit(x) for kv in rejected.items() for x in kv)) if rejected else \
        F.create_map().cast("map<int,int>")
    left = F.filter("random", lambda c: F.coalesce(
        c["bin"] < F.element_at(limit, _stratum(c["code"], c["n"])), F.lit(True)))
    names = F.array(*(F.lit(k) for k in KINDS))

    def listed(column):
        return F.array_join(F.transform(column, lambda m: F.concat_ws(
            ":", F.element_at(names, m["k"] + 1), m["s"], m["e"])), ",")

    more = F.transform("left", lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"),
                                                  c["e"].alias("e")))
    return found.withColumn("left", left).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias(
            "base_sha256"), listed(F.array_sort(F.concat("base", more))).alias("spans"),
        F.size("left").cast("long").alias("n_random"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
