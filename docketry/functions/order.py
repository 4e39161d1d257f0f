"""Order as data: row numbers, running totals and greedy packing over rows of any number, without a task that sees them all.

Rows are dealt by ranges of their order and written once, so that every later step sees the same ranges. What goes from range to
range is a number each. Orders are made total by a hash of the row, so that ties may number any share of the rows; rows that are
equal in every column share their places in any way.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.sources.shared import ship, spill

#: Rows of a range, about; the place in a partition takes the low bits of Spark's increasing ids.
RANGE_ROWS, PLACE_BITS = 1 << 18, 33
#: Rows whose batches a task works out at once, by place: 2^BLOCK_BITS.
BLOCK_BITS = 16


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "position", within: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with name: 1, 2, ... in the order (in each group of `within`, if given). The result is a table of its own."""
    keys = [*(F.col(c) for c in within), *(F.col(c) if isinstance(c, str) else c for c in order), F.xxhash64(*df.columns)]
    # counted, sampled and dealt from a table, not worked out three times
    df = spill(df, "to-number")
    parts = max(1, -(-df.count() // range_rows))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = spill(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    # one count a range
    before, starts = 0, []
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["part"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    out = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_before", "_at")
    if not within:
        return out
    # groups are stretches of the whole order; the first place of each is taken off. A group can hold most rows: the join can be split
    first = out.groupBy(*within).agg(F.min(name).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    first = first.select(*(F.col(c).alias(f"_{c}") for c in within), "_first").hint("merge")
    return out.join(first, same).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", *(f"_{c}" for c in within))


def chunks(df: DataFrame, order: Sequence[Column | str], size: int, name: str = "chunk") -> DataFrame:
    """df with name: 1, 2, ... for each size rows in the order."""
    return numbered(df, order, "_position").withColumn(name, F.floor((F.col("_position") - 1) / size) + 1).drop("_position")


def _pointers(sizes: np.ndarray, most_rows: int, most_size: int) -> np.ndarray:
    """For each row as the first of a batch the first row of the next one; a batch has at least one row."""
    total = np.cumsum(sizes)
    by_size = np.searchsorted(total, total - sizes + most_size, side="right")
    at = np.arange(len(sizes))
    return np.maximum(at + 1, np.minimum(by_size, at + most_rows))


def _exits(next_: np.ndarray, end: int) -> np.ndarray:
    """Where the chain of batches from each row first reaches `end` or more, by pointer doubling."""
    out = next_[:end].copy()
    while (inside := np.flatnonzero(out < end)).size:
        out[inside] = out[out[inside]]
    return out


def packed(df: DataFrame, order: Sequence[Column | str], size: Column, most_rows: int, most_size: int, name: str = "batch", block_bits: int = BLOCK_BITS) -> DataFrame:
    """df with name: 1, 2, ..., batches packed greedily in the order: a batch takes rows until the next one would be row most_rows + 1
    or bring it over most_size; a larger row is a batch of its own. Null sizes count as 0.

    Where the next batch begins depends on a row and the few behind it only, so each block of rows knows where a batch that begins
    with any of its rows leads to in the next block. A batch can begin in a block with its first most_rows rows at most; those pointers
    are doubled until they lead from the first row through all blocks, and each block follows its own from where it is entered.
    """
    if most_rows < 1 or most_size < 0:
        raise ValueError("a batch has at least one row")
    while 1 << block_bits < most_rows:
        block_bits += 1
    ship(df.sparkSession)
    block, width = F.shiftright(F.col("_position") - 1, block_bits), 1 << block_bits
    rows = numbered(df.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))), order, "_position")
    rows = spill(rows.withColumn("_block", block), "packed")
    own = rows.select("_position", "_size", F.col("_block").alias("block"))
    # the rows behind a block that its last batches may take
    halo = own.filter((F.col("block") > 0) & ((F.col("_position") - 1) % width < most_rows)).withColumn("block", F.col("block") - 1)
    both = own.unionByName(halo)

    def pointers(pdf: pd.DataFrame) -> tuple[int, int, np.ndarray]:
        """(first place, rows of the block itself, pointers); a batch that all rows at hand may belong to leads behind them."""
        pdf = pdf.sort_values("_position")
        first = int(pdf["_position"].iat[0])
        end = min(len(pdf), (((first - 1) >> block_bits) + 1 << block_bits) - first + 1)
        return first, end, _pointers(pdf["_size"].to_numpy(), most_rows, most_size)

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        first, end, next_ = pointers(pdf)
        out = _exits(next_, end)[:most_rows]
        return pd.DataFrame({"at": first + np.arange(len(out)), "to": first + out})

    jump = spill(both.groupBy("block").applyInPandas(entries, "at long, to long"), "packed-jumps")
    last = rows.agg(F.max("_position").alias("n")).first()["n"] or 0
    # entered: where each block is entered; 2^k steps at a time
    entered = df.sparkSession.createDataFrame([(1,)] if last else [], "at long")
    jumps = [jump]
    for _ in range(max(0, int(last >> block_bits).bit_length() - 1)):
        ahead = jumps[-1].select(F.col("at").alias("to"), F.col("to").alias("further"))
        jumps.append(spill(jumps[-1].join(ahead, "to").select("at", F.col("further").alias("to")), "packed-jumps"))
    for step in reversed(jumps):
        entered = spill(entered.union(entered.join(step, "at").select(F.col("to").alias("at")).filter(F.col("at") <= last)).distinct(), "packed-entries")
    entered = entered.withColumn("block", F.shiftright(F.col("at") - 1, block_bits))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        """The batches that begin in the block, from 1; rows in front of its entry belong to the batch before, 0."""
        first, end, next_ = pointers(pdf)
        at, begins = int(pdf["entry"].iat[0]) - first, np.zeros(end, dtype=np.int64)
        while at < end:
            begins[at] = 1
            at = int(next_[at])
        return pd.DataFrame({"_position": first + np.arange(end), "_batch": np.cumsum(begins)})

    found = both.join(entered.select("block", F.col("at").alias("entry")), "block").groupBy("block").applyInPandas(follow, "_position long, _batch long")
    found = spill(found.withColumn("_block", block), "packed-batches")
    # one number a block
    counts = found.groupBy("_block").agg(F.max("_batch").alias("n"))
    before = counts.select("_block", F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    batch = found.join(before, "_block").select("_position", (F.col("_batch") + F.col("_before")).alias(name))
    return rows.drop("_block", "_size").join(batch, "_position").drop("_position")
