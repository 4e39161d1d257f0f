"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashed words, pairs of neighbouring words and pairs with one word between them, each
present or not. Every coordinate has its own learning rate and L1 keeps most weights at zero, so the model is a short list of
(index, weight) that any task can hold: at most 2^HASH_BITS entries, whatever the corpus.

Training takes at most `max_rows` labelled rows, chosen by a hash of doc_id (all of them if there are fewer). They are dealt to
tasks of about `shard_rows` rows, and fewer where texts are long, as hashed features of at most 4 MB a text; each runs FTRL over its share for some epochs, and the weights are averaged over the tasks.

Defined results: a null or empty text has no features and gets the score of the intercept alone. Without labelled rows, or with one
class only, every score is the share of toxic rows (0 if there are none). Of several labels of one doc_id the largest
counts; null labels are no labels. Rows that repeat a doc_id are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import crc_mod, id_and_bytes, mix64, parts, ship, spill

HASH_BITS = 20
#: Most labelled rows to learn from; rows and features (4 bytes each) for a task to learn from, about; passes over a task's rows.
MAX_ROWS, SHARD_ROWS, SHARD_FEATURES, EPOCHS = 40_000, 10_000, 1 << 25, 6
#: L1 is high: of the word pairs of a text nearly all occur nowhere else and must not get a weight.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.05
#: Documents whose crc32 of the id leaves HELD_OUT modulo FOLDS are not learnt from.
FOLDS, HELD_OUT = 5, 0

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_K = np.uint64(0x9E3779B97F4A7C15)
INTERCEPT = 0


def features(raw: bytes | None, bits: int = HASH_BITS) -> np.ndarray:
    """Distinct hashed indices of a text, the intercept among them."""
    words = (raw or b"").decode("utf-8", "replace").lower().encode().translate(_FOLD).split()
    if not words:
        return np.array([INTERCEPT])
    seen = dict.fromkeys(words)
    for w in seen:
        seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        every = np.concatenate([mix64(h), mix64(h[:-1] * _K + h[1:] + np.uint64(1)), mix64(h[:-2] * _K + h[2:] + np.uint64(2))])
    index = (every >> np.uint64(64 - bits)).astype(np.int64)
    return np.unique(np.append(index, INTERCEPT))


def ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, bits: int = HASH_BITS) -> np.ndarray:
    """The weights after the epochs; rows are visited in an order that is fixed by their number."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    order = np.random.RandomState(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            w = _weights(z[i], n[i])
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            was = n[i]
            now = was + g * g
            z[i] += g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w
            n[i] = now
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, number of features, their indices): what a text weighs in training is its features, not its length."""
    for b in parts(batches):
        rows = [features(x).astype("<i4") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(map(len, rows)), pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["doc_id", "toxic", "n", "features"])


def _train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id", kind="stable")
    w = ftrl([np.frombuffer(x, dtype="<i4") for x in pdf.features], pdf.toxic.tolist())
    at = np.flatnonzero(w)
    return pd.DataFrame({"i": at, "w": w[at]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS, shard_features: int = SHARD_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The model: sorted indices and their weights."""
    ship(docs.sparkSession)
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) != 0).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, positive = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = positive / total if total else 0.0
    if not 0 < rate < 1:
        return np.array([INTERCEPT]), np.array([np.log((rate + 1e-12) / (1 - rate + 1e-12))])
    span, shards = 1 << 32, -(-min(total, max_rows) // shard_rows)
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * min(1.0, 0.98 * max_rows / total))) if total > max_rows else own
    # about max_rows ids and labels at most: small whatever the corpus
    raw = id_and_bytes(docs, id_col, text_col).join(F.broadcast(own), "doc_id")
    rows = spill(raw.mapInArrow(_features, "doc_id long, toxic int, n long, features binary"), "toxicity-features", "lz4")
    shards = max(shards, -(-(rows.agg(F.sum("n").alias("n")).first()["n"] or 0) // shard_features))
    found = rows.groupBy(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard")).applyInPandas(_train_shard, "i long, w double").groupBy("i").agg((F.sum("w") / shards).alias("w")).orderBy("i").toPandas()
    return found.i.to_numpy(), found.w.to_numpy()


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        dense = np.zeros(1 << HASH_BITS)
        dense[at] = w
        for b in batches:
            sums = np.array([dense[features(x)].sum() for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    spark = docs.sparkSession
    ship(spark)
    out = id_and_bytes(docs, id_col, text_col).mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learn_and_score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Learn from the labels outside the held-out fold, score every document."""
    return score(docs, train(docs, labels.filter(crc_mod("doc_id", FOLDS) != HELD_OUT), max_rows=max_rows))
