"""Language identification by interpolated Kneser-Ney character models.

The letters of a text with their combining marks (lower-cased, everything else a single space) are read as 4-grams. The counts of all training
documents are gathered by language with partial aggregation; only the 4-grams are counted, as the lower orders need but
their distinct types. Continuation counts, context totals and discounts are Spark aggregates over those types. Each language's probabilities
and back-off weights are kept in arrays sorted by a 64-bit hash of the gram and searched by bisection.
A text gets the language with the lowest cross-entropy per character. It is marked rejected where that cross-entropy
is beyond what training documents of the language have (mean and deviation over all of them).

Every gram that was counted is in the model. A model of at most `max_grams` 4-grams is broadcast (the lower orders have fewer
types still). A larger one stays in tables: the distinct grams of the texts are joined with it order by order, and their
log-probabilities with each text's grams. Both ways give the same results.

Defined results: null texts, and texts without a letter, are `und` with score 0; so is every text when nothing could be
learnt. Between equal languages the first by name wins. A null lang is not learnt from. Repeated rows are learnt from
and judged each for itself. Characters beyond the basic plane count as one letter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import crc_mod, mix64, ship, spill

ORDER = 4
#: Most 4-grams in a model that is broadcast; deviations beyond which a text is rejected.
MAX_GRAMS, DEVIATIONS = 2_000_000, 6.0
#: Characters that count for the score's certainty at most, and text handled at once.
CERTAIN_CHARS, CHUNK = 60, 2 << 20
FOLDS, HELD_OUT = 4, 2

_letters: list[np.ndarray] = []


def _letter_table() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> itself for letters and the marks that combine with them, else a space (0xFFFD stands for those beyond the basic plane); and whether it is a letter."""
    if not _letters:
        table, letter = np.full(0x110000, 32, dtype=np.uint16), np.zeros(0x110000, dtype=bool)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000:
                letter[c] = chr(c).isalpha()
                if letter[c] or unicodedata.category(chr(c))[0] == "M":
                    table[c] = c if c < 0x10000 else 0xFFFD
        _letters.extend((table, letter))
    return _letters[0], _letters[1]


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' characters one after the other, each text led by ORDER - 1 spaces, and each text's number of characters after them."""
    (table, is_letter), out, sizes = _letter_table(), [], []
    lead = np.full(ORDER - 1, 32, dtype=np.uint16)
    for t in texts:
        points = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        c = table[points]
        letter = (c != 32) & is_letter[points].any()  # marks alone are no text
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each run of letters
        c = c[keep]
        out += [lead, c]
        sizes.append(len(c))
    return (np.concatenate(out) if out else lead[:0]), np.array(sizes, dtype=np.int64)


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams that end at each character (16 bits a character), and each text's number of them."""
    codes, sizes = codes_of(texts)
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), sizes
    wide = codes.astype(np.uint64)
    gram = np.zeros(max(0, len(wide) - ORDER + 1), dtype=np.uint64)
    for i in range(ORDER):
        gram = gram << np.uint64(16) | wide[i : len(wide) - ORDER + 1 + i]
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    keep = np.ones(len(gram) + ORDER - 1, dtype=bool)
    for k in range(ORDER - 1):
        # a gram is placed by its first character: those that begin with the next text's lead end a text before it
        keep[starts[1:] - 1 - k] = False
    keep = keep[: len(gram)]
    return gram[keep], sizes


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(grams, return_inverse=True), by direct addressing where the alphabet is small."""
    chars = [(grams >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.uint16) for k in range(ORDER)]
    present = np.zeros(0x10000, dtype=bool)
    for c in chars:
        present[c] = True
    alphabet = np.flatnonzero(present)
    a = len(alphabet)
    if a**ORDER > 1 << 25:
        return np.unique(grams, return_inverse=True)
    small = np.zeros(0x10000, dtype=np.int32)
    small[alphabet] = np.arange(a)
    code = small[chars[3]]
    for k in (2, 1, 0):
        code = code * a + small[chars[k]]
    flags = np.zeros(a**ORDER, dtype=bool)
    flags[code] = True
    used = np.flatnonzero(flags)
    place = np.zeros(a**ORDER, dtype=np.int32)
    place[used] = np.arange(len(used))
    back, gram = used.copy(), np.zeros(len(used), dtype=np.uint64)
    for k in range(ORDER):
        gram |= alphabet[back % a].astype(np.uint64) << np.uint64(16 * k)
        back //= a
    return gram, place[code]


def _chunks(batches: Iterator[pa.RecordBatch], texts_at: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of about CHUNK characters."""
    for b in batches:
        sizes = np.cumsum([len(x or "") for x in b.column(texts_at).to_pylist()])
        at = 0
        while at < b.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + CHUNK, side="right")))
            yield b.slice(at, end - at)
            at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's documents, summed within the task as far as it comes."""
    for b in _chunks(batches, 0):
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        cols: list[list] = [[], [], []]
        for lang in sorted(set(langs)):
            grams, _ = grams_of([t for t, own in zip(texts, langs, strict=True) if own == lang])
            if len(grams):
                gram, at = distinct(grams)
                cols[0] += [lang] * len(gram)
                cols[1].append(gram.view(np.int64))
                cols[2].append(np.bincount(at, minlength=len(gram)))
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(np.concatenate(cols[1])), pa.array(np.concatenate(cols[2]))], names=["lang", "gram", "n"])


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all documents that have a lang."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    return rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Values of grams in arrays sorted by the grams' hash."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        h = mix64(grams)
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order]

    def get(self, grams: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(grams), missing)
        h = mix64(grams)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], missing)


class Language:
    """Interpolated Kneser-Ney of one language over the alphabet of all: for each order the discounted share of a gram, and the weight that its context leaves to the order below."""

    def __init__(self, orders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alphabet: int):
        # order -> (grams, discounted shares, contexts, weights left)
        self.floor = 1.0 / (alphabet + 1)
        self.shares = {k: Table(x[0], x[1]) for k, x in orders.items()}
        self.weights = {k: Table(x[2], x[3]) for k, x in orders.items()}

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.floor)
        for k in range(1, ORDER + 1):
            own = grams & np.uint64((1 << 16 * k) - 1)
            # an unseen context leaves everything to the order below
            p = self.shares[k].get(own, 0.0) + self.weights[k].get(own >> np.uint64(16), 1.0) * p
        return np.log(p)


def _orders(counts: DataFrame) -> Iterator[tuple[int, DataFrame, dict[str, float]]]:
    """Of each order, from the highest: all its grams (lang, gram, context, n, total) and each language's discount."""
    t = counts
    for k in range(ORDER, 0, -1):
        # count-of-counts give the discount; contexts their total
        ones = t.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        discount = {r["lang"]: min(0.95, max(0.05, r["n1"] / max(1, r["n1"] + 2 * r["n2"]))) for r in ones.collect()}
        own = t.withColumn("context", F.shiftrightunsigned("gram", 16))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"))
        yield k, own.join(contexts, ["lang", "context"]).select("lang", "gram", "context", "n", "total"), discount
        if k > 1:
            # continuation counts: in how many types of the order above the gram ends
            t = spill(t.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "lang-grams")


def build(counts: DataFrame) -> dict[str, Language]:
    """The model from (lang, gram, n), in memory."""
    parts: dict[str, dict[int, tuple]] = {}
    alphabet: set[int] = set()
    for k, kept, discount in _orders(spill(counts, "lang-grams")):
        for lang, x in kept.toPandas().groupby("lang"):
            d = discount[lang]
            grams = x.gram.to_numpy().view(np.uint64)
            own = x.drop_duplicates("context")
            parts.setdefault(lang, {})[k] = (grams, np.maximum(x.n.to_numpy() - d, 0) / x.total.to_numpy(), own.context.to_numpy().view(np.uint64), _left(x, own, d))
            if k == 1:
                alphabet.update(x.gram.tolist())
    empty = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))
    return {lang: Language({k: p.get(k, empty) for k in range(1, ORDER + 1)}, len(alphabet)) for lang, p in sorted(parts.items())}


def _left(kept, own, d: float) -> np.ndarray:
    """1 less the shares of the context's grams: what was discounted."""
    kept = kept.assign(share=np.maximum(kept.n - d, 0) / kept.total)
    return np.clip(1.0 - own.context.map(kept.groupby("context").share.sum()).to_numpy(), 1e-9, 1.0)


def mean_log_p(texts: list[str | None], model: dict[str, Language]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) mean log-probability a character, and each text's number of characters."""
    grams, sizes = grams_of(texts)
    out = np.zeros((len(texts), len(model)))
    if len(grams):
        gram, at = distinct(grams)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for j, language in enumerate(model.values()):
            total = np.concatenate([[0.0], np.cumsum(language.log_p(gram)[at])])
            out[:, j] = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(sizes, 1)
    return out, sizes


_JUDGED = "doc_id long, trained boolean, lang_pred string, score double, cross_entropy double, none boolean"


def _verdicts(ids: pa.Array, trained: pa.Array, mean: np.ndarray, sizes: np.ndarray, langs: list[str]) -> pa.RecordBatch:
    none = (sizes == 0) | (not langs)
    if not langs:
        mean = np.zeros((len(sizes), 1))
    best = mean.argmax(axis=1)
    top = mean[np.arange(len(mean)), best]
    certain = np.minimum(sizes, CERTAIN_CHARS)[:, None]
    score = np.where(none, 0.0, 1 / np.exp(np.clip(certain * (mean - top[:, None]), -700, 0)).sum(axis=1))
    pred = ["und" if n else langs[k] for n, k in zip(none, best, strict=True)]
    cols = [ids, trained, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(-top, pa.float64()), pa.array(none)]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "trained", "lang_pred", "score", "cross_entropy", "none"])


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in _chunks(batches, 2):
            mean, sizes = mean_log_p(b.column(2).to_pylist(), model)
            yield _verdicts(b.column(0), b.column(1), mean, sizes, list(model))

    return run


def _judge_means(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean = np.array(b.column(3).to_pylist(), dtype=np.float64).reshape(b.num_rows, len(langs))
            yield _verdicts(b.column(0), b.column(1), mean, b.column(2).to_numpy(), langs)

    return run


def _grams_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _chunks(batches, 1):
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            gram, n = np.unique(grams_of([text])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), row, dtype=np.int64)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["row", "gram", "n"])


def _judge_by_tables(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The verdicts on rows (doc_id, trained, text) by a model that stays in tables."""
    spark = rows.sparkSession
    rows = spill(rows.withColumn("row", F.monotonically_increasing_id()), "lang-rows")
    seen = spill(rows.select("row", "text").mapInArrow(_grams_by_row, "row long, gram long, n long"), "lang-row-grams")
    orders = {}
    for k, t, discount in _orders(counts):
        d = spark.createDataFrame(list(discount.items()), "lang string, d double")
        orders[k] = spill(t.join(F.broadcast(d), "lang").select("lang", F.col("gram").alias("own"), "context", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("share")), "lang-shares")
    langs = sorted(r["lang"] for r in orders[1].select("lang").distinct().collect())
    floor = 1.0 / (orders[1].select("own").distinct().count() + 1)
    names = spark.createDataFrame([(x, j, floor) for j, x in enumerate(langs)], "lang string, j int, p double")
    kinds = seen.select("gram").distinct().crossJoin(F.broadcast(names))
    for k in range(1, ORDER + 1):
        left = orders[k].groupBy("lang", "context").agg(F.greatest(F.lit(1e-9), F.least(F.lit(1.0), 1 - F.sum("share"))).alias("left"))
        kinds = kinds.withColumn("own", F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < ORDER else F.col("gram")).withColumn("context", F.shiftrightunsigned("own", 16))
        # an unseen context leaves everything to the order below
        kinds = kinds.join(orders[k].drop("context"), ["lang", "own"], "left").join(left, ["lang", "context"], "left")
        kinds = kinds.select("gram", "lang", "j", (F.coalesce("share", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("p")).alias("p"))
    logs = spill(kinds.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("j", F.log("p").alias("log_p")))).getField("log_p").alias("logs")), "lang-logs")
    sums = seen.join(logs, "gram").groupBy("row").agg(F.sum("n").alias("size"), *(F.sum(F.col("n") * F.col("logs")[j]).alias(f"s{j}") for j in range(len(langs))))
    means = F.array(*(F.coalesce(F.col(f"s{j}") / F.col("size"), F.lit(0.0)) for j in range(len(langs))))
    both = rows.select("row", "doc_id", "trained").join(sums, "row", "left")
    return both.select("doc_id", "trained", F.coalesce("size", F.lit(0)).cast("long").alias("size"), means.alias("means")).mapInArrow(_judge_means(langs), _JUDGED)


def learn_and_predict(docs: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Learn from documents outside the held-out fold, judge every document."""
    spark = docs.sparkSession
    ship(spark)
    trained = F.coalesce((crc_mod("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull(), F.lit(False))
    counts = spill(count_grams(docs.select("doc_id", "text", "lang").filter(trained)), "lang-grams")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), trained.alias("trained"), F.col("text").cast("string").alias("text"))
    if counts.count() <= max_grams:
        found = rows.mapInArrow(_judge(spark.sparkContext.broadcast(build(counts))), _JUDGED)
    else:
        found = _judge_by_tables(rows, counts)
    found = spill(found, "lang-judged")
    # per language the cross-entropy beyond which a text is rejected
    seen = found.filter("trained and not none").groupBy("lang_pred").agg(F.avg("cross_entropy").alias("mean"), F.stddev_pop("cross_entropy").alias("sd"))
    limits = seen.select("lang_pred", (F.col("mean") + DEVIATIONS * (F.col("sd") + 0.05)).alias("most"))
    out = found.join(F.broadcast(limits), "lang_pred", "left")
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rejected = F.col("none") | F.coalesce(F.col("cross_entropy") > F.col("most"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", rejected.alias("rejected"))
