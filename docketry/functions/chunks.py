"""Windows over long ordered groups, worked out in chunks.

A statement may hold a third of all rows, so no task gets one whole: rows are dealt by (group, chunk), a chunk being a stretch of
`ord` of fixed width, and only one small row a chunk goes on to a window over the group. The chunks of a
group are at most its rows and at most the width of its `ord` over 2^CHUNK_BITS.

Rows without a group belong to nothing and are left out. Rows that share a place in a group come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunks are stretches of 2^CHUNK_BITS values of ord.
CHUNK_BITS = 16


def _chunked(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn("_chunk", F.shiftright(F.col("ord").cast("long"), bits))


def _earlier(group: str):
    return Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _inside(group: str):
    return Window.partitionBy(group, "_chunk").orderBy("ord")


def carried_down(rows: DataFrame, value: Column, name: str, group: str, bits: int = CHUNK_BITS) -> DataFrame:
    """rows with name: the last value that is not null at or before a row of its group, in the order of ord; null if there is none."""
    own = _chunked(rows, bits)
    ends = own.groupBy(group, "_chunk").agg(F.max_by(value, F.when(value.isNotNull(), F.col("ord"))).alias("_end"))
    prior = ends.select(group, "_chunk", F.last("_end", ignorenulls=True).over(_earlier(group)).alias("_prior"))
    here = F.last(value, ignorenulls=True).over(_inside(group).rowsBetween(Window.unboundedPreceding, 0))
    return own.join(prior, [group, "_chunk"]).withColumn(name, F.coalesce(here, "_prior")).drop("_chunk", "_prior")


def running_total(rows: DataFrame, value: Column, name: str, group: str, bits: int = CHUNK_BITS) -> DataFrame:
    """rows with name: the sum of value up to and with a row of its group, in the order of ord."""
    own = _chunked(rows, bits)
    prior = own.groupBy(group, "_chunk").agg(F.sum(value).alias("_sum")).select(group, "_chunk", F.coalesce(F.sum("_sum").over(_earlier(group)), F.lit(0)).alias("_prior"))
    here = F.sum(value).over(_inside(group).rowsBetween(Window.unboundedPreceding, 0))
    return own.join(prior, [group, "_chunk"]).withColumn(name, here + F.col("_prior")).drop("_chunk", "_prior")


def neighbours(rows: DataFrame, value: Column, agree: Column, group: str, bits: int = CHUNK_BITS) -> DataFrame:
    """(group, checked, agreed) over the pairs of neighbouring rows: how many have agree not null, and how many have it true.

    agree: a condition on a row and `_before`, the value of the row before it (null for the first one).
    """
    chunk = _inside(group)
    own = _chunked(rows, bits).withColumns({"_value": value, "_before": F.lag(value).over(chunk), "_n": F.row_number().over(chunk)})
    # the first row of a chunk waits for the last value of the chunk before
    at_start = F.col("_n") == 1
    need = [c for c in rows.columns if c != group]
    parts = own.groupBy(group, "_chunk").agg(
        F.count(F.when(~at_start, agree)).alias("_checked"), F.count_if(~at_start & agree).alias("_agreed"),
        F.max(F.when(at_start, F.struct(*need))).alias("_first"), F.max_by(F.struct("_value"), "ord").alias("_last"),
    )
    starts = parts.withColumn("_before", F.lag("_last").over(Window.partitionBy(group).orderBy("_chunk"))["_value"])
    flat = starts.select(group, "_checked", "_agreed", "_before", *(F.col("_first")[c].alias(c) for c in need)).withColumn("_agree", agree)
    return flat.groupBy(group).agg((F.sum("_checked") + F.count("_agree")).alias("checked"), (F.sum("_agreed") + F.count_if("_agree")).alias("agreed"))
