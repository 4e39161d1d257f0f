"""Resumable scans: sessions over a folder that reuse what is known of unchanged files, and a file stream whose checkpoint is the session."""

from __future__ import annotations

import threading
import time
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.functions import fixed_values as V
from docketry.functions.order import packed
from docketry.operators import results
from docketry.operators.policy import file_warning
from docketry.operators.scan import scan
from docketry.sources.files import decode, ignored_root, relative
from docketry.streaming import store
from docketry.streaming.log import Log

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ENGINE = "docketry-1"
SESSION = "scan_id string, scan_key string, month_first boolean, total long, status string, created_at timestamp, updated_at timestamp"
#: One batch holds at most so many files, and so many bytes unless a single file has more.
BATCH_FILES, BATCH_BYTES = 2000, 1 << 30


class Fenced(RuntimeError):
    """Another driver has taken the session over; what this one did since doesn't count."""


def listing(spark: SparkSession, folder: str, month_first: bool = False) -> DataFrame:
    """(location, path, size, modified, fingerprint, cache_key) of a folder's files that may be read; no bytes are read for it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    size, changed = F.col("length"), F.unix_millis("modificationTime")
    own = raw.select(F.col("path").alias("location"), relative(folder).alias("path"), size.alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), changed.alias("_changed"))
    own = own.filter(file_warning(F.col("path"), F.lit(0), F.lit(None).cast("string")).isNull() & F.lit(not ignored_root(folder)))
    own = own.withColumn("fingerprint", results.fingerprint(ENGINE, F.col("path"), F.col("size"), F.col("_changed"))).drop("_changed")
    return own.withColumn("cache_key", results.cache_key(ENGINE, month_first, F.col("path"), F.col("fingerprint")))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _log(spark: SparkSession, state: str) -> Log:
    return Log(spark, f"{state}/log")


def _sessions(entries: list[dict]) -> dict[str, dict]:
    """The last entry of each session."""
    return {e["scan_id"]: e for e in entries if e["kind"] == "session"}


def sessions_of(spark: SparkSession, state: str) -> DataFrame:
    """One row a session, as its log says."""
    names = [f.split()[0] for f in SESSION.split(", ")]
    rows = [tuple(datetime.fromisoformat(e[n]) if n.endswith("_at") else e[n] for n in names) for e in _sessions(_log(spark, state).entries()).values()]
    return spark.createDataFrame(rows, SESSION)


def _resumable(entries: list[dict], key: str, month_first: bool) -> dict | None:
    """The newest session over a listing that runs or was cancelled."""
    open_ = [e for e in _sessions(entries).values() if e["scan_key"] == key and e["month_first"] == month_first and e["status"] in ("running", "cancelled")]
    return max(open_, key=lambda e: (e["updated_at"], e["scan_id"]), default=None)


def start(spark: SparkSession, folder: str, state: str, month_first: bool = False, owner: str = "") -> tuple[str, bool]:
    """(scan_id, whether it was there): the newest session over the same listing and date order that isn't complete, else a new one.
    The session belongs to owner from now on.

    The listing is written once, so that a session goes on over the files that it began with. Two drivers that start at once agree on one session.
    """
    found = listing(spark, folder, month_first)
    key = results.scan_key(found.select("path", "size", "fingerprint"), folder).first()["scan_key"]
    log, scan_id, made = _log(spark, state), uuid.uuid4().hex, []

    def decide(entries: list[dict]) -> dict:
        there = _resumable(entries, key, month_first)
        if there is not None:
            return there | {"status": "running", "owner": owner, "updated_at": _now()}
        if not made:
            found.write.mode("overwrite").parquet(f"{state}/manifests/scan_id={scan_id}")
            made.append(spark.read.parquet(f"{state}/manifests/scan_id={scan_id}").count())
        return {"kind": "session", "scan_id": scan_id, "scan_key": key, "month_first": month_first, "total": made[0], "status": "running", "owner": owner, "created_at": _now(), "updated_at": _now()}

    entry = log.append(decide)
    return entry["scan_id"], entry["scan_id"] != scan_id


def set_status(spark: SparkSession, state: str, scan_id: str, status: str, owner: str | None = None) -> None:
    """`cancelled` or `complete`, for a session that there is; anything else is a ValueError. With an owner: only while the session is its own, or it is Fenced."""

    def decide(entries: list[dict]) -> dict:
        row = _sessions(entries).get(scan_id)
        if row is None or status not in ("running", "cancelled", "complete"):
            raise ValueError(f"unknown scan or status: {scan_id}, {status}")
        if owner is not None and row["owner"] != owner:
            raise Fenced(scan_id)
        return row | {"status": status, "updated_at": _now()}

    _log(spark, state).append(decide)


def cancel(spark: SparkSession, state: str, scan_id: str) -> None:
    """Stop a session, wherever its driver runs: it looks at the log all the time and ends the jobs of its batch. resume() goes on with what is pending."""
    set_status(spark, state, scan_id, "cancelled")


def _watch(spark: SparkSession, state: str, scan_id: str, owner: str, over: threading.Event, every: float = 1.0) -> None:
    """End the session's jobs as soon as it is cancelled or has another owner."""
    log = _log(spark, state)
    while not over.wait(every):
        row = _sessions(log.entries())[scan_id]
        if row["status"] == "cancelled" or row["owner"] != owner:
            spark.sparkContext.cancelJobsWithTag(f"docketry-{scan_id}-{owner}")


def files_of(spark: SparkSession, state: str, scan_id: str) -> DataFrame:
    """The session's files (manifest columns, status, candidates, warning, updated_at, batch): finished ones keep their outcome, those
    known from any session without a warning are `cached`, all others `pending`; skipped files are tried again by other sessions only."""
    manifest = spark.read.parquet(f"{state}/manifests/scan_id={scan_id}")
    out = manifest.withColumns({"own": F.lit(None).cast(store.LAST), "k": F.lit(None).cast(store.LAST)})
    for n, known in enumerate(store.known(spark, state, _log(spark, state).entries(), scan_id)):
        out = out.join(known.select("cache_key", F.col("own").alias(f"_own{n}"), F.col("known").alias(f"_known{n}")), "cache_key", "left")
        out = out.withColumns({"own": F.coalesce(f"_own{n}", "own"), "k": F.coalesce(f"_known{n}", "k")}).drop(f"_own{n}", f"_known{n}")
    status = F.coalesce("own.status", F.when(F.col("k").isNotNull(), "cached").otherwise("pending"))
    return out.select("cache_key", "location", "path", "size", "modified", "fingerprint", status.alias("status"), F.coalesce("own.candidates", "k.candidates", F.lit(0)).alias("candidates"), "own.warning", F.coalesce("own.updated_at", "k.updated_at").alias("updated_at"), F.coalesce("own.batch", "k.batch").alias("batch"))


def work_of(pending: DataFrame, folder: str, most_files: int = BATCH_FILES, most_bytes: int = BATCH_BYTES) -> int:
    """Write pending files (location, path, size, cache_key) to folder, a partition for each bounded batch; gives the number of batches.
    The driver sees counts only."""
    own = pending.select("location", "path", "size", "cache_key")
    all_ = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if not all_["n"]:
        return 0
    dealt = own.withColumn("batch", F.lit(1).cast("long")) if all_["n"] <= most_files and all_["bytes"] <= most_bytes else packed(own, ["path"], F.col("size"), most_files, most_bytes)
    dealt.repartition("batch").write.partitionBy("batch").parquet(folder)
    return dealt.agg(F.max("batch").alias("n")).first()["n"] if all_["n"] > 1 else 1


def resume(spark: SparkSession, folder: str, state: str, today, month_first: bool = False, most_files: int = BATCH_FILES, most_bytes: int = BATCH_BYTES, stop=lambda: False, seconds_a_file: float = V.READER_SECONDS) -> str:
    """Scan what the folder's session waits for and return its id. Only pending files are read; unchanged ones of any session are reused.

    Each batch writes its results under a name of its own and counts once its entry is in the log, so a batch that was lost midway
    is done again. Who resumes a session takes it over: batches of a driver that had it before don't count any more, and it gets Fenced.
    stop() is asked before each batch: if it says yes, the session is cancelled and can be resumed; cancel() ends a running batch, too.
    A file that takes longer than seconds_a_file to read gets a warning.
    """
    owner = uuid.uuid4().hex
    scan_id, _ = start(spark, folder, state, month_first, owner)
    log, tag, over = _log(spark, state), f"docketry-{scan_id}-{owner}", threading.Event()
    watcher = threading.Thread(target=_watch, args=(spark, state, scan_id, owner, over), daemon=True)
    watcher.start()
    spark.sparkContext.addJobTag(tag)
    try:
        work = f"{state}/work/{scan_id}-{owner}"
        for n in range(1, work_of(files_of(spark, state, scan_id).filter("status = 'pending'"), work, most_files, most_bytes) + 1):
            if stop():
                set_status(spark, state, scan_id, "cancelled", owner)
                return scan_id
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
            _scan_batch(spark, folder, state, spark.read.parquet(f"{work}/batch={n}"), scan_id, name, today, month_first, seconds_a_file)

            def decide(entries: list[dict], name: str = name) -> dict:
                row = _sessions(entries)[scan_id]
                if row["owner"] != owner:
                    raise Fenced(scan_id)
                if row["status"] == "cancelled":
                    raise InterruptedError(scan_id)
                return {"kind": "batch", "scan_id": scan_id, "name": name, "updated_at": _now()}

            log.append(decide)
            store.compact_if_due(spark, state, log)
        set_status(spark, state, scan_id, "complete", owner)
    except Exception:
        row = _sessions(log.entries())[scan_id]
        if row["owner"] != owner:
            raise Fenced(scan_id) from None
        if row["status"] != "cancelled":
            raise
    finally:
        over.set()
        spark.sparkContext.removeJobTag(tag)
        watcher.join()
    return scan_id


def _scan_batch(spark: SparkSession, folder: str, state: str, listed: DataFrame, scan_id: str, name: str, today, month_first: bool, seconds: float) -> None:
    """Read and scan one batch of files; its tables count once the log has its name."""
    locations = [r["location"] for r in listed.select("location").collect()]  # a batch is bounded
    raw = spark.read.format("binaryFile").load(locations).withColumn("path", relative(folder))
    # a file that has grown past the limit is listed with its size and never read: the filter is pushed to the scan
    small = raw.filter(F.col("length") <= V.MAX_FILE_BYTES).select("path", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), "content", F.lit(None).cast("string").alias("warning"))
    large = raw.filter(F.col("length") > V.MAX_FILE_BYTES).select("path", F.lit(None).cast("string").alias("modified"), F.lit(None).cast("binary").alias("content"), file_warning(F.col("path"), F.col("length"), F.lit(None).cast("string")).alias("warning"))
    files = decode(small.unionByName(large), seconds).persist()
    found = scan(files, today, month_first)
    try:
        keys = listed.select("path", "cache_key")
        store.write(found.commitments.join(keys, "path"), state, "found", name)
        store.write(found.statements.join(keys, "path"), state, "statements", name)
        done = found.outcomes.join(keys, "path").select(F.lit(scan_id).alias("scan_id"), "path", "cache_key", F.when(F.col("warning").isNull(), "done").otherwise("skipped").alias("status"), F.col("candidates").cast("long").alias("candidates"), F.col("commitments").cast("long").alias("commitments"), "warning", F.current_timestamp().alias("updated_at"))
        store.write(done, state, "done", name)
    finally:
        found.release()
        files.unpersist()


def report(spark: SparkSession, state: str, scan_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row about the session, its commitments without repeats in their order, summaries of its bank statements)."""
    files = files_of(spark, state, scan_id).withColumn("scan_id", F.lit(scan_id))
    good = files.filter("warning is null and batch is not null").select("cache_key", "batch", F.col("updated_at").alias("done_at"))
    entries = _log(spark, state).entries()

    def of(name: str) -> DataFrame:
        parts = [p.join(good, ["cache_key", "batch"]).drop("cache_key", "batch") for p in store.parts(spark, state, name, entries)]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "path string")

    found = of("found")
    if "date" not in found.columns:  # no batch has counted so far
        found = scan(spark.createDataFrame([], "path string, content string, modified string"), "2000-01-01").commitments.withColumn("done_at", F.lit(None).cast("timestamp"))
    found = found.withColumn("scan_id", F.lit(scan_id))
    row = results.session_report(sessions_of(spark, state).filter(F.col("scan_id") == scan_id), files, found.drop("done_at"))
    kept = results.deduplicate(found, ("scan_id",))
    return row, results.in_session_order(kept, "done_at").drop("done_at"), of("statements").drop("done_at")


def watch(spark: SparkSession, folder: str, files_a_batch: int = 12) -> DataFrame:
    """New files of a folder as a stream of bounded batches."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)


def run(spark: SparkSession, folder: str, state: str, today, month_first: bool = False, files_a_batch: int = 12) -> StreamingQuery:
    """Scan what is there and not yet scanned, then stop. Stopping midway is a cancel; running again goes on from the checkpoint.

    Each batch writes its own partition of the tables `commitments` and `outcomes` and overwrites it if it is repeated, so a
    batch that ran twice counts once. Files with a warning are in outcomes and have no commitments.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        listed = batch.withColumn("path", relative(folder)).select("path", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), "content", file_warning(F.col("path"), F.col("length"), F.lit(None).cast("string")).alias("warning"))
        files = decode(listed).persist()  # three branches read it
        found = scan(files, today, month_first)
        found.commitments.write.mode("overwrite").parquet(f"{state}/commitments/batch={batch_id}")
        found.outcomes.withColumn("status", F.when(F.col("warning").isNull(), "done").otherwise("skipped")).write.mode("overwrite").parquet(f"{state}/outcomes/batch={batch_id}")
        found.release()
        files.unpersist()

    return watch(spark, folder, files_a_batch).writeStream.foreachBatch(store).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()


def state_of(spark: SparkSession, state: str) -> tuple[DataFrame, DataFrame]:
    """(commitments, outcomes) so far; a path that was scanned again counts by its last batch."""
    commitments, outcomes = spark.read.parquet(f"{state}/commitments"), spark.read.parquet(f"{state}/outcomes")
    last = outcomes.groupBy("path").agg(F.max("batch").alias("batch"))
    return commitments.join(last, ["path", "batch"], "left_semi"), outcomes.join(last, ["path", "batch"], "left_semi")


def event_counts(events: DataFrame, minutes: int = 60, late_minutes: int = 30) -> DataFrame:
    """Counts by event type in windows of event time; works on a stream (with a watermark) and on a table."""
    stamped = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source = stamped.withWatermark("ts", f"{late_minutes} minutes") if events.isStreaming else stamped
    return source.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
