"""Results of files by cache_key: a generation bucketed by the key, and the batches since.

A batch adds three small tables. After COMPACT_AFTER batches a new generation is written: the last outcome of each file state in each
session, and the commitments and statements that belong to it, in BUCKETS buckets sorted by cache_key. A listing is joined with a generation
bucket by bucket, so what is known is never shuffled, however much it is. A generation counts once the log has its entry; the
entry names the batches that went into it, so batches that came meanwhile stay. Older generations and batches are deleted when two newer ones are there,
as readers may still be at them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.streaming.log import Log

KINDS = ("done", "found", "statements")
BUCKETS, COMPACT_AFTER = 64, 32
LAST = "struct<status:string,candidates:bigint,warning:string,updated_at:timestamp,batch:string>"


def write(df: DataFrame, state: str, kind: str, batch: str) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{state}/batches/{batch}/{kind}")


def _last_generation(entries: list[dict]) -> dict | None:
    return next((e for e in reversed(entries) if e["kind"] == "generation"), None)


def _since(entries: list[dict]) -> list[str]:
    """Batches that count and are in no generation."""
    merged = {b for e in entries if e["kind"] == "generation" for b in e["batches"]}
    return [e["name"] for e in entries if e["kind"] == "batch" and e["name"] not in merged]


def _table_name(folder: str) -> str:
    return "docketry_" + hashlib.sha256(folder.encode()).hexdigest()[:24]


def _bucketed(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """A generation's table. The catalogue of this session may not know it, so that it is told where it lies and how it is bucketed."""
    name = _table_name(folder)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def parts(spark: SparkSession, state: str, kind: str, entries: list[dict]) -> list[DataFrame]:
    """The generation and the batches since, each if there is any."""
    out, generation, since = [], _last_generation(entries), _since(entries)
    if generation is not None:
        out.append(_bucketed(spark, f"{state}/generations/{generation['name']}/{kind}", generation["buckets"]))
    if since:
        out.append(spark.read.parquet(*(f"{state}/batches/{b}/{kind}" for b in since)))
    return out


def known(spark: SparkSession, state: str, entries: list[dict], scan_id: str) -> list[DataFrame]:
    """(cache_key, own, known) of the generation, then of the batches since: the last outcome in the session, and the last without a warning in any."""
    out = []
    for done in parts(spark, state, "done", entries):
        last = F.struct("status", "candidates", "warning", "updated_at", "batch").cast(LAST)
        own, good = F.col("scan_id") == scan_id, F.col("warning").isNull()
        out.append(done.groupBy("cache_key").agg(F.max_by(last, F.when(own, F.col("batch"))).alias("own"), F.max_by(last, F.when(good, F.col("batch"))).alias("known")))
    return out


def compact_if_due(spark: SparkSession, state: str, log: Log, after: int = COMPACT_AFTER, buckets: int = BUCKETS) -> bool:
    """Write a new generation if `after` batches have come since the last one; whether it was the first to be in the log."""
    entries = log.entries()
    since, before = _since(entries), _last_generation(entries)
    if len(since) < after:
        return False
    number = (before["number"] if before else 0) + 1
    name = f"{number:06d}-{since[-1]}"
    done = reduce(DataFrame.unionByName, parts(spark, state, "done", entries))
    last = done.groupBy("cache_key", "scan_id").agg(F.max_by(F.struct(*(c for c in done.columns if c not in ("cache_key", "scan_id"))), "batch").alias("x")).select("cache_key", "scan_id", "x.*")
    _write_generation(last, f"{state}/generations/{name}/done", buckets)
    kept = spark.read.parquet(f"{state}/generations/{name}/done").filter("warning is null").select("cache_key", "batch").distinct()
    for kind in KINDS[1:]:
        rows = reduce(DataFrame.unionByName, parts(spark, state, kind, entries))
        _write_generation(rows.join(kept, ["cache_key", "batch"], "left_semi"), f"{state}/generations/{name}/{kind}", buckets)

    def decide(now: list[dict]) -> dict | None:
        other = _last_generation(now)
        return {"kind": "generation", "name": name, "number": number, "buckets": buckets, "batches": since} if (other["number"] if other else 0) < number else None

    if log.append(decide) is None:
        _delete(spark, f"{state}/generations/{name}")
        return False
    old = [e for e in entries if e["kind"] == "generation"]
    if len(old) > 1:
        # two newer ones are there
        _delete(spark, f"{state}/generations/{old[-2]['name']}")
        for b in old[-2]["batches"]:
            _delete(spark, f"{state}/batches/{b}")
    return True


def _write_generation(df: DataFrame, folder: str, buckets: int) -> None:
    df.repartition(buckets, "cache_key").write.bucketBy(buckets, "cache_key").sortBy("cache_key").option("path", folder).mode("overwrite").saveAsTable(_table_name(folder))


def _delete(spark: SparkSession, folder: str) -> None:
    for kind in KINDS:
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(f'{folder}/{kind}')}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
