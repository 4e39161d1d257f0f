"""Line dedup across documents.

Lines are keyed (stripped of ASCII white space, A-Z lower-cased) and hashed to 128 bits; a key of at
least `min_chars` code points that at least `min_docs` documents hold loses its lines everywhere but in
the largest doc_id holding it. The votes are counted with map-side partial aggregation, so a line that a
third of all documents share is one small row per task; distinct documents are counted for the lines alone that have
rows enough. The join that carries a verdict back to its
documents is a plain equi-join, which adaptive execution splits where a key is hot.

Defined results: a null or empty text is one empty line. Rows that repeat a doc_id are one document with one
vote and share its verdicts. A row without doc_id is a document of its own, which votes but never loses a line. Columns other
than the id and the text are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import SPACE, id_and_bytes, parts, ship, spill

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte digest of a line's key, or None for keys of fewer than min_chars code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes.lower() changes A-Z only


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ids, digests, counts = b.column(0), [], []
            for raw in b.column(1).to_pylist():
                own = {k for line in (raw or b"").split(b"\n") if (k := line_key(line, min_chars))}
                digests.extend(own)
                counts.append(len(own))
            pair = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            rows = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["doc_id", "h1", "h2"])

    return run


def _reassemble(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts, n_lines, n_dropped = [], [], []
            for raw, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = raw or b""
                if not gone:
                    texts.append(raw)
                    n_lines.append(raw.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                lines = raw.split(b"\n")
                bad = {gone[i : i + 16] for i in range(0, len(gone), 16)}
                kept = [x for x in lines if line_key(x, min_chars) not in bad]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "kept", "n_lines", "n_dropped"])

    return run


def _gone(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, gone): the digests, one after the other, of the keys that a document loses; only documents that lose any."""
    keys = spill(id_and_bytes(docs, id_col, text_col).mapInArrow(_keys(min_chars), "doc_id long, h1 long, h2 long"), "line-keys", "lz4")
    votes = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("home"))
    # rows first; of the few keys with enough of them the distinct documents are counted
    many = spill(votes.filter(F.col("n") >= min_docs).select("h1", "h2", "home"), "line-votes")
    # written, so that adaptive execution can split a hot line here and the counts below are dealt by document as well
    found = spill(keys.join(many.hint("merge"), ["h1", "h2"]), "line-found", "lz4")
    docs_of = found.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless"), F.max("home").alias("home"))
    bad = spill(docs_of.filter(F.col("n") + F.col("nameless") >= min_docs).select("h1", "h2", "home"), "line-bad")
    lost = found.drop("home").join(bad.hint("merge"), ["h1", "h2"]).filter(F.col("doc_id") != F.col("home"))
    return spill(lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")).mapInArrow(_join_digests, "doc_id long, gone binary"), "line-gone")


def _join_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [np.array([(x["h1"], x["h2"]) for x in own], dtype="<i8").tobytes() for own in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], names=["doc_id", "gone"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each document with the lines that stay, in their order."""
    ship(docs.sparkSession)
    raw = id_and_bytes(docs, id_col, text_col)
    gone = _gone(docs, id_col, text_col, min_chars, min_docs)
    # one plan at every size: the verdicts' side grows with the corpus, so it is never broadcast
    out = raw.join(gone.hint("merge"), "doc_id", "left").mapInArrow(_reassemble(min_chars), "doc_id long, kept binary, n_lines long, n_dropped long")
    return out.select("doc_id", F.col("kept").cast("string").alias("text"), "n_lines", "n_dropped")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with all their columns and rows, the text without the lines that go, and length_col (if there is one) its length. A null text stays null."""
    ship(docs.sparkSession)
    taken = {c.lower() for c in docs.columns}
    name = next(x for x in (f"__gone{i}" for i in count()) if x not in taken and f"{x}_id" not in taken)
    gone = _gone(docs, id_col, text_col, min_chars, min_docs).select(F.col("doc_id").alias(f"{name}_id"), F.col("gone").alias(name))

    @F.pandas_udf("binary")
    def kept(raw, lost):
        import pandas as pd

        out = []
        for x, y in zip(raw, lost, strict=True):
            bad = {y[i : i + 16] for i in range(0, len(y), 16)}
            out.append(b"\n".join(line for line in x.split(b"\n") if line_key(line, min_chars) not in bad))
        return pd.Series(out)

    both = docs.join(gone.hint("merge"), docs[id_col].cast("long") == F.col(f"{name}_id"), "left")
    # only texts that lose something go through Python
    lost = F.col(name).isNotNull()
    text = F.when(lost, kept(F.when(lost, F.col(text_col).cast("binary")).otherwise(F.lit(b"")), F.coalesce(name, F.lit(b""))).cast("string")).otherwise(F.col(text_col))
    out = both.withColumn(text_col, text)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(lost, F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.select(docs.columns)
