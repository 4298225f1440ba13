"""Language identification by interpolated Kneser-Ney character models.

Texts are read as lower-case letters and marks; anything else is a space, and runs of spaces are
one. Grams of four characters are counted per language over all learning rows. Lower orders use
continuation counts: of how many longer grams a gram is the end. Every order has the discount
``n1 / (n1 + 2 n2)`` and gives the freed mass to the next lower order.

A gram is four 16-bit codes in a long, spread by a bijection into its hash. Every gram of the
learning rows counts. A model of at most HELD_CELLS is broadcast whole, as sorted hash arrays with one
row of log probabilities for all languages. Of a larger one only the most frequent grams are; those a
text has beside them are joined with the tables of the model, each distinct one once, and their logs
are added to the sums of the text.

Learning rows with crc32 remainder 3 are not counted but calibrate the rejection.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import textscan as ts
from barsmith.llm.store import documents, stored, unused

ORDER = 4
#: Most distinct longest grams times languages that are broadcast; the rest of a larger model is joined.
HELD_CELLS = 1 << 22
#: More languages than this are refused: it bounds the rows of the model.
MAX_LANGUAGES = 256
#: Least probability of a gram that some language has, and least weight of a context.
LEAST, LEAST_WEIGHT = 1e-12, 1e-6
COUNTED_AT_ONCE = 1 << 21
POSITIONS_AT_ONCE = 1 << 18
#: A text is rejected when it lies more than so many calibrated deviations, and nats a character,
#: above the mean of its best language.
REJECT_DEVIATIONS = 8.0
REJECT_NATS = 1.0
#: Characters that count as independent evidence in the score.
EVIDENCE = 40
START, SPACE, OTHER = 1, 32, 0xFFFF
MASK = (1 << 48) - 1


@lru_cache(maxsize=1)
def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """Code of each character below 65536 (lower case, or space) and whether it is a letter."""
    code = np.full(1 << 16, SPACE, dtype=np.uint16)
    letter = np.zeros(1 << 16, dtype=bool)
    for c in range(128, 1 << 16):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            code[c] = ord(low[0]) if ord(low[0]) < OTHER else OTHER
            letter[c] = kind == "L"
    for c in range(65, 91):
        code[c] = code[c + 32] = c + 32
        letter[c] = letter[c + 32] = True
    return code, letter


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and letter marks of UTF-8 bytes, a slice at a time."""
    table, letters = _code_table()
    codes, marks, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + ts.SLICE_BYTES)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        points = np.frombuffer(data[at:end].tobytes().decode("utf-8", "replace").encode(
            "utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = np.minimum(points, OTHER)
        code, mark = table[low], letters[low]
        for i in np.flatnonzero(points > 0xFFFF):
            kind = unicodedata.category(chr(points[i]))[0]
            code[i], mark[i] = (OTHER if kind in "LM" else SPACE), kind == "L"
        codes.append(code)
        marks.append(mark)
        at = end
    if not codes:
        return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=bool)
    return np.concatenate(codes), np.concatenate(marks)


def _texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised codes of many texts, where each begins (one more at the end), and letter counts."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    code, letter = _characters(part)
    heads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    first = heads[offsets - lo]
    n_letters = np.concatenate([[0], np.cumsum(letter)])[first]
    space = code == SPACE
    drop = space.copy()
    drop[1:] &= space[:-1]
    starts = first[:-1][first[:-1] < first[1:]]
    drop[starts] = space[starts]
    keep = ~drop
    where = np.concatenate([[0], np.cumsum(keep)])[first]
    return code[keep], where, np.diff(n_letters)


def _grams(code: np.ndarray, first: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Grams that end at positions lo to hi; characters before a text are start marks."""
    key = code[lo:hi].astype(np.uint64)
    heads = first[:-1][np.diff(first) > 0]
    for k in range(1, ORDER):
        before = np.full(hi - lo, START, dtype=np.uint64)
        from_ = max(0, lo - k)
        src = code[from_:hi - k] if hi - k > from_ else code[:0]
        if len(src):
            before[len(before) - len(src):] = src
        for j in range(k):
            at = heads + j - lo
            at = at[(at >= 0) & (at < hi - lo)]
            before[at] = START
        key |= before << np.uint64(16 * k)
    return key


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    n = 0

    def report() -> pa.RecordBatch:
        names, keys, counts = [], [], []
        for lang, parts in held.items():
            k, c = np.unique(np.concatenate(parts), return_counts=True)
            names += [lang] * len(k)
            keys.append(k)
            counts.append(c)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.concatenate(keys).view(np.int64)),
             pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

    for batch in batches:
        data, offsets, _ = ts.buffers(batch.column(0))
        langs = batch.column(1).to_pylist()
        for a, b in ts.groups(offsets):
            code, first, _ = _texts(data, offsets[a:b + 1])
            for lo in range(0, len(code), POSITIONS_AT_ONCE):
                hi = min(len(code), lo + POSITIONS_AT_ONCE)
                keys = _grams(code, first, lo, hi)
                for r in range(b - a):
                    x, y = max(lo, first[r]) - lo, min(hi, first[r + 1]) - lo
                    if x < y:
                        held.setdefault(langs[a + r], []).append(keys[x:y])
                n += hi - lo
                if n >= COUNTED_AT_ONCE:
                    yield report()
                    held, n = {}, 0
    if n:
        yield report()


@dataclass
class Model:
    """Log probabilities of grams and log weights of contexts by order, a row per language.

    A model held in part has one table, of frequent grams of the highest order, and no contexts.
    """

    languages: list[str]
    grams: list[ts.SortedHashes] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[ts.SortedHashes] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    deviation: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of grams of an order (the low 16 bits are the character): languages x grams."""
        if order == 0:
            return np.repeat(self.floor[:, None], len(keys), axis=1)
        at = self.grams[order - 1].find(keys)
        out = self.logs[order - 1][:, at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[:, miss] = self.backed_off(keys[miss], order)
        return out

    def backed_off(self, keys: np.ndarray, order: int) -> np.ndarray:
        low = np.uint64((1 << (16 * (order - 1))) - 1)
        out = self.log_probabilities(keys & low, order - 1)
        at = self.contexts[order - 1].find(keys >> np.uint64(16))
        known = at >= 0
        out[:, known] += self.weights[order - 1][:, at[known]]
        return out


def gram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all rows of ``(text, lang)``."""
    return (rows.mapInArrow(_count_task, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Order:
    """``gram, i, direct`` and ``ctx, i, weight`` of an order; ``i`` is the place of the language."""

    grams: DataFrame
    contexts: DataFrame


@dataclass
class Learned:
    """A broadcast Model, and the tables it is a part of if it does not hold all grams."""

    model: Broadcast
    orders: list[Order] | None = None


def fit(rows: DataFrame) -> tuple[Model, list[Order] | None]:
    """Model of the languages of ``(text, lang)``, lang not null; its tables if held in part."""
    counts = stored(gram_counts(rows), "grams")
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(
        MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = Model(languages, mean=np.zeros(len(languages)), deviation=np.zeros(len(languages)))
    if not languages:
        return model, None
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    level = longest = counts.select(place.cast("int").alias("i"), "gram", "n")
    orders = []
    for order in range(ORDER, 0, -1):
        rare = {r.i: r for r in level.groupBy("i").agg(
            F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
        discount = F.get(F.array(*(F.lit(float(np.clip(
            rare[i].n1 / max(1, rare[i].n1 + 2 * rare[i].n2), 0.1, 0.95)))
            for i in range(len(languages)))), F.col("i"))
        ctx = F.shiftrightunsigned("gram", 16)
        sums = stored(level.groupBy("i", ctx.alias("ctx")).agg(
            F.sum("n").alias("ctx_n"), F.count("*").alias("grams")), "contexts")
        grams = stored(level.withColumn("ctx", ctx).join(sums, ["i", "ctx"]).select(
            "gram", "i", ((F.col("n") - discount) / F.col("ctx_n")).alias("direct")), "gram-shares")
        orders.insert(0, Order(grams, sums.select("ctx", "i", F.greatest(
            discount * F.col("grams") / F.col("ctx_n"), F.lit(LEAST_WEIGHT)).alias("weight"))))
        if order > 1:
            level = stored(level.groupBy("i", F.col("gram").bitwiseAND(F.lit(_mask(order - 1)))
                                         .alias("gram")).agg(F.count("*").alias("n")), "grams")
    alphabet = 1 + max(r[0] for r in orders[0].grams.groupBy("i").count().select("count").collect())
    model.floor = np.full(len(languages), -np.log(alphabet))
    if longest.select("gram").distinct().count() * len(languages) > HELD_CELLS:
        _hold_frequent(model, orders, longest)
        return model, orders
    _hold_all(model, orders)
    return model, None


def _mask(order: int) -> int:
    return (1 << (16 * order)) - 1


def _hold_all(model: Model, orders: list[Order]) -> None:
    n_lang = len(model.languages)
    for order in range(1, ORDER + 1):
        frame = orders[order - 1].contexts.toPandas()
        ctx_keys, ctx_of = np.unique(frame["ctx"].to_numpy(dtype=np.int64).view(np.uint64),
                                     return_inverse=True)
        weight = np.zeros((n_lang, len(ctx_keys)))
        weight[frame["i"].to_numpy(), ctx_of] = np.log(frame["weight"].to_numpy())
        contexts = ts.SortedHashes(ctx_keys)
        model.contexts.append(contexts)
        model.weights.append(weight[:, contexts.order])
        frame = orders[order - 1].grams.toPandas()
        grams, gram_of = np.unique(frame["gram"].to_numpy(dtype=np.int64).view(np.uint64),
                                   return_inverse=True)
        lower = np.exp(model.backed_off(grams, order))
        lower[frame["i"].to_numpy(), gram_of] += frame["direct"].to_numpy()
        table = ts.SortedHashes(grams)
        model.grams.append(table)
        model.logs.append(np.log(np.maximum(lower, LEAST))[:, table.order].astype(np.float32))


def _hold_frequent(model: Model, orders: list[Order], longest: DataFrame) -> None:
    """As many grams as HELD_CELLS admits, those of the highest powers of two of their count."""
    n_lang = len(model.languages)
    totals = longest.groupBy("gram").agg(F.sum("n").alias("n"))
    power = F.floor(F.log2("n")).cast("int")
    sizes = dict(totals.groupBy(power.alias("power")).count().collect())
    least, held = max(sizes) + 1, 0
    while least > 0 and (held + sizes.get(least - 1, 0)) * n_lang <= HELD_CELLS:
        least -= 1
        held += sizes.get(least, 0)
    found = log_rows(model, orders, totals.where(power >= least).select("gram")).select(
        "gram", F.col("logs").cast("array<float>").alias("logs")).toArrow().combine_chunks()
    keys = np.asarray(found["gram"], dtype=np.int64).view(np.uint64)
    logs = np.asarray(pa.concat_arrays([c.flatten() for c in found["logs"].chunks])
                      if len(keys) else [], dtype=np.float32)
    table = ts.SortedHashes(keys)
    model.grams.append(table)
    model.logs.append(np.ascontiguousarray(logs.reshape(-1, n_lang).T[:, table.order]))


def _by_language(rows: DataFrame, key: str, value: str, n: int, missing: float) -> DataFrame:
    """``key`` and an array of the value in each of n languages, ``missing`` where there is no row."""
    values = F.map_from_entries(F.collect_list(F.struct("i", value)))
    return rows.groupBy(key).agg(values.alias("of")).select(key, F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.coalesce(F.try_element_at("of", i), F.lit(missing))).alias(value))


def log_rows(model: Model, orders: list[Order], keys: DataFrame) -> DataFrame:
    """``gram, logs`` of distinct grams of the highest order: their log probabilities by language."""
    n = len(model.languages)
    wanted = {ORDER: keys}
    for order in range(ORDER - 1, 0, -1):
        wanted[order] = wanted[order + 1].select(
            F.col("gram").bitwiseAND(F.lit(_mask(order))).alias("gram")).distinct()
    below = None
    for order in range(1, ORDER + 1):
        rows = (wanted[order].withColumn("ctx", F.shiftrightunsigned("gram", 16))
                .withColumn("low", F.col("gram").bitwiseAND(F.lit(_mask(order - 1))))
                .join(_by_language(orders[order - 1].grams, "gram", "direct", n, 0.0), "gram", "left")
                .join(_by_language(orders[order - 1].contexts, "ctx", "weight", n, 1.0), "ctx", "left"))
        if below is None:
            rows = rows.withColumn("lower", F.array(*(F.lit(float(np.exp(x))) for x in model.floor)))
        else:
            rows = rows.join(below.select(F.col("gram").alias("low"), F.col("p").alias("lower")), "low")
        weighed = F.when(F.col("weight").isNull(), F.col("lower")).otherwise(
            F.zip_with("weight", "lower", lambda w, p: w * p))
        below = rows.withColumn("p", weighed).select("gram", F.when(
            F.col("direct").isNull(), F.col("p")).otherwise(F.zip_with(
                "direct", "p", lambda d, p: F.greatest(d + p, F.lit(LEAST)))).alias("p"))
    return below.select("gram", F.transform("p", lambda p: F.log(p)).alias("logs"))


def entropies(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nats a character of each text in each language, its normalised length, its letters."""
    data, offsets, _ = ts.buffers(column)
    n = len(column)
    sums = np.zeros((len(model.languages), n))
    length = np.zeros(n, dtype=np.int64)
    letters = np.zeros(n, dtype=np.int64)
    for a, b in ts.groups(offsets):
        code, first, letters[a:b] = _texts(data, offsets[a:b + 1])
        length[a:b] = np.diff(first)
        if not len(model.languages):
            continue
        for lo in range(0, len(code), POSITIONS_AT_ONCE):
            hi = min(len(code), lo + POSITIONS_AT_ONCE)
            logs = model.log_probabilities(_grams(code, first, lo, hi))
            r = np.flatnonzero((first[:-1] < hi) & (first[1:] > lo) & (np.diff(first) > 0))
            at = np.maximum(first[r], lo) - lo
            sums[:, a + r] -= np.add.reduceat(logs, at, axis=1, dtype=np.float64)
    return sums / np.maximum(length, 1), length, letters


def predict(model, column: pa.Array) -> pa.StructArray:
    return judge(model.value, *entropies(model.value, column))


def judge(m: Model, h: np.ndarray, length: np.ndarray, letters: np.ndarray) -> pa.StructArray:
    n = len(length)
    if not m.languages or not n:
        return pa.StructArray.from_arrays(
            [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64()),
             pa.array(np.ones(n, dtype=bool)), pa.array(length)],
            names=["lang_pred", "score", "nats", "rejected", "length"])
    best = np.argmin(h, axis=0)
    low = h[best, np.arange(n)]
    score = 1 / np.exp(-(h - low) * np.minimum(length, EVIDENCE)).sum(axis=0)
    none = letters == 0
    excess = low - m.mean[best]
    far = ((excess * np.sqrt(length) > REJECT_DEVIATIONS * m.deviation[best])
           & (excess > REJECT_NATS))
    names = np.array([*m.languages, "und"], dtype=object)
    return pa.StructArray.from_arrays(
        [pa.array(names[np.where(none, len(m.languages), best)], pa.string()),
         pa.array(np.where(none, 0.0, score)), pa.array(low, mask=none),
         pa.array(none | far), pa.array(length)],
        names=["lang_pred", "score", "nats", "rejected", "length"])


GUESS = "struct<lang_pred string, score double, nats double, rejected boolean, length long>"


def guess(model, text) -> F.Column:
    """A struct of the language, score, nats a character, rejection and length of a text column.

    ``model`` is a broadcast Model. Null, empty and letterless texts are ``und``, score 0,
    rejected. Ties go to the language that sorts first.
    """
    def run(column: pa.Array) -> pa.Array:
        return predict(model, column)

    return F.arrow_udf(run, returnType=GUESS)(text)


#: A text by two hashes; texts with equal keys are equal.
KEY = ("k0", "k1")
PARTIAL = "k0 long, k1 long, gram long, n long, sums array<double>, length long, letters long"


def _partial_task(model):
    """``sums, length, letters`` of each text over the grams that the model holds, and a row ``gram, n``
    for every other distinct gram of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets, _ = ts.buffers(batch.column(2))
            for a, b in ts.groups(offsets):
                code, first, letters = _texts(data, offsets[a:b + 1])
                sums = np.zeros((b - a, len(m.languages)))
                texts, grams, counts = [], [], []
                for r in range(b - a):
                    keys, n = _text_grams(code, first, r)
                    at = m.grams[0].find(keys)
                    held = at >= 0
                    sums[r] = m.logs[0][:, at[held]] @ n[held].astype(np.float64)
                    texts.append(np.full(len(keys) - held.sum(), a + r))
                    grams.append(keys[~held])
                    counts.append(n[~held])
                texts, grams, counts = map(np.concatenate, (texts, grams, counts))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(a, b - a) for k in (0, 1)),
                    pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.int64()),
                    pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32),
                                             pa.array(sums.ravel())),
                    pa.array(np.diff(first)), pa.array(letters)], schema=schema)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).take(pa.array(texts)) for k in (0, 1)),
                    pa.array(grams.view(np.int64)), pa.array(counts),
                    *(pa.nulls(len(texts), schema.field(k).type) for k in (4, 5, 6))], schema=schema)

    schema = pa.schema([*((c, pa.int64()) for c in (*KEY, "gram", "n")),
                        ("sums", pa.list_(pa.float64())), ("length", pa.int64()),
                        ("letters", pa.int64())])
    return run


def _text_grams(code: np.ndarray, first: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a text and their counts, some positions at a time."""
    keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for lo in range(int(first[r]), int(first[r + 1]), POSITIONS_AT_ONCE):
        hi = min(int(first[r + 1]), lo + POSITIONS_AT_ONCE)
        more, n = np.unique(_grams(code, first, lo, hi), return_counts=True)
        keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    return keys, counts


def with_guess(docs: DataFrame, learned: Learned, text: str, name: str) -> DataFrame:
    """``docs`` and the struct of :func:`guess`, whether the model is held whole or in part."""
    if learned.orders is None:
        return docs.withColumn(name, guess(learned.model, F.col(text)))
    model, n_lang = learned.model, len(learned.model.value.languages)
    keys = [F.xxhash64(F.lit(salt), F.col(text)).alias(k) for salt, k in enumerate(KEY)]
    found = stored(docs.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("text"))
                   .mapInArrow(_partial_task(model), PARTIAL), "partial-sums")
    # Equal texts give equal rows, so any of them stands for all.
    lost = stored(found.where("gram is not null").groupBy(*KEY, "gram").agg(F.max("n").alias("n")),
                  "lost-grams")
    logs = stored(log_rows(model.value, learned.orders, lost.select("gram").distinct()), "gram-logs")
    rest = lost.join(logs, "gram").groupBy(*KEY).agg(F.array(*(
        F.sum(F.col("n") * F.get("logs", F.lit(i))) for i in range(n_lang))).alias("rest"))
    whole = found.where("gram is null").dropDuplicates([*KEY]).join(rest, [*KEY], "left")
    sums = F.when(F.col("rest").isNull(), F.col("sums")).otherwise(
        F.zip_with("sums", "rest", lambda a, b: a + b))

    def run(sums: pa.Array, length: pa.Array, letters: pa.Array) -> pa.Array:
        n = np.asarray(length)
        h = -np.asarray(sums.flatten()).reshape(len(n), -1).T / np.maximum(n, 1)
        return judge(model.value, h, n, np.asarray(letters))

    key, other = unused(docs, *KEY)
    guesses = stored(whole.select(*KEY, F.arrow_udf(run, returnType=GUESS)(
        sums, "length", "letters").alias(name)), "guesses").toDF(key, other, name)
    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                       F.lit(None).cast("double").alias("nats"), F.lit(True).alias("rejected"),
                       F.lit(0).cast("long").alias("length"))
    return (docs.withColumns({key: keys[0], other: keys[1]}).join(guesses, [key, other], "left")
            .withColumn(name, F.when(F.col(text).isNull(), nothing).otherwise(F.col(name)))
            .drop(key, other))


def remainder(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
    """A calibrated model, Learned from the rows that are not held out.

    Rows without doc_id, text or language are not learned from. Without any learning row the
    model knows no language and every text is ``und``.
    """
    rows = (docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(text).alias("text"), F.col(lang).alias("lang"),
                    remainder(doc_id).alias("r")))
    model, orders = fit(rows.where("r in (0, 1)").select("text", "lang"))
    spark = docs.sparkSession
    rough = Learned(spark.sparkContext.broadcast(model), orders)
    if not model.languages:
        return rough
    own = stored(with_guess(rows.where("r = 3"), rough, "text", "g")
                 .where("g.lang_pred = lang and g.length > 0")
                 .select("lang", "g.nats", "g.length"), "calibration")
    mean = {r[0]: r[1] for r in own.groupBy("lang").agg(F.expr(
        "sum(nats * length) / sum(length)")).collect()}
    model.mean = np.array([mean.get(x, np.inf) for x in model.languages])
    means = own.groupBy("lang").agg(F.expr("sum(nats * length) / sum(length)").alias("mean"))
    spread = {r[0]: r[1] for r in own.join(F.broadcast(means), "lang").groupBy("lang").agg(
        F.expr("sqrt(avg(pow(nats - mean, 2) * length))")).collect()}
    model.deviation = np.array([spread.get(x, 0.0) for x in model.languages])
    return Learned(spark.sparkContext.broadcast(model), orders)


def identify(docs: DataFrame, model: Learned | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected, nats``, a row per input row.

    ``held_out`` is whether crc32 of the id, mod 4, is 2; false without an id.
    """
    return with_guess(docs.select("doc_id", "text"), model or learn(docs), "text", "g").select(
        "doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"),
        "g.lang_pred", "g.score", "g.rejected", "g.nats")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose text is not rejected, unchanged; null and letterless texts go."""
    g, = unused(docs, "g")
    return with_guess(docs, learn(docs), "text", g).where(~F.col(g)["rejected"]).drop(g)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
