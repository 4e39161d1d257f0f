"""What the operators share: word splitting and 64-bit mixing, and from the library scratch tables and code shipping."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.shared import filesystem, scratch_path, scratch_root, ship, spill

__all__ = ["filesystem", "scratch_path", "scratch_root", "ship", "spill"]

#: ASCII white space, as `[\x20\x09-\x0D]`; bytes.split() and bytes.strip(SPACE) use this very set.
SPACE = b" \t\n\x0b\x0c\r"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, raw): the whole text as UTF-8 bytes. Any other column, of whatever name, stays out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the decimal text of an id, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def parts(batches, bytes_at: int = 1, limit: int = 1 << 20):
    """Record batches cut into parts of about limit bytes of column bytes_at, so that a task's Python lists stay small."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(bytes_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
            yield b.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and odd multipliers) over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate values[starts[i] : starts[i] + lengths[i]] over i, without a loop."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    offset = np.repeat(starts - (ends - lengths), lengths)
    return values[offset + np.arange(total)]
