"""Sessions' status as a stream: counts, rate and time left, kept up to date by each session's state.

Events are (scan_id, path, status, candidates, total, updated_at): one for each file that is listed (`pending`) or gets another status, and
one without a path for the session itself (`running`, `cancelled`, `complete`, with its total and the time at which it began or changed). Events come in any order. State holds the last status of each file, so a repeated
event changes nothing, and totals that are kept in step. Files lie in chunks of about CHUNK_FILES by their path's hash, which are split
one at a time as a session grows (linear hashing): a call of the state store costs more than the file itself, so each chunk is read and
written once for all that comes for it, and no session's files are ever gathered. A session that runs and hears nothing for STALL_SECONDS of event time is told as `stalled`, by a timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from itertools import islice
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import Row

from docketry.sources.shared import ship

EVENTS = "scan_id string, path string, status string, candidates long, total long, updated_at timestamp"
STATUS = "scan_id string, status string, total long, files_processed long, files_cached long, files_skipped long, dates_reviewed long, rate double, eta_seconds long, updated_at timestamp"
STALL_SECONDS = 600
#: Files of a chunk, about, and events that are dealt to chunks at once. The first chunk lies beside the counts, which small sessions need no other for.
CHUNK_FILES, BLOCK_EVENTS = 128, 1 << 16
_COUNTS = "status string, total long, processed long, cached long, skipped long, candidates long, changed double, created double, updated double, timer long, files long, chunks long, first string"
_FINISHED = ("done", "cached", "skipped")
#: Of two statuses of a session at one time the later one here holds.
_ORDER = ("running", "cancelled", "complete")


def _chunk(path: str, chunks: int) -> int:
    """A path's chunk: its hash by the next power of two, or by the one before where that chunk isn't there yet."""
    top = 1 << chunks.bit_length()
    number = crc32(path.encode("utf-8", "surrogatepass")) % top
    return number if number < chunks else number - top // 2


class SessionStatus(StatefulProcessor):
    def __init__(self, stall_seconds: float = STALL_SECONDS):
        self.stall_seconds = stall_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk long", "files string")
        self.counts = handle.getValueState("counts", _COUNTS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        c = self._counts()
        while block := list(islice(rows, BLOCK_EVENTS)):
            own: dict[str, list] = {}
            for r in block:
                at = r.updated_at.timestamp()
                if r.path is None:
                    c["created"] = at if c["created"] is None else min(c["created"], at)
                    if (at, _ORDER.index(r.status)) >= (c["changed"] or 0, _ORDER.index(c["status"]) if c["status"] else 0):
                        c["status"], c["total"], c["changed"] = r.status, r.total if r.total is not None else c["total"], at
                    c["updated"] = at if c["updated"] is None else max(c["updated"], at)
                else:
                    own.setdefault(r.path, []).append((r.status, r.candidates or 0, at))
            self._take(c, own)
        self._set_timer(c)
        yield self._row(key[0], c, c["status"])

    def _take(self, c: dict, own: dict[str, list]) -> None:
        """Bring files up to date with their events, chunk by chunk."""
        self._grow(c, len(own))
        chunks: dict[int, list] = {}
        for path in own:
            chunks.setdefault(_chunk(path, c["chunks"]), []).append(path)
        for number, paths in chunks.items():
            files = self._load(c, number)
            for path in paths:
                for status, candidates, at in own[path]:
                    before = files.get(path)
                    if before is not None and (before[2], before[0] in _FINISHED) > (at, status in _FINISHED):
                        continue  # a later status is known already
                    for was, n, sign in ((before[0], before[1], -1) if before else (None, 0, 0), (status, candidates, 1)):
                        c["processed"] += sign * (was in _FINISHED)
                        c["cached"] += sign * (was == "cached")
                        c["skipped"] += sign * (was == "skipped")
                        c["candidates"] += sign * n
                    c["files"] += before is None
                    c["updated"] = at if c["updated"] is None else max(c["updated"], at)
                    files[path] = [status, candidates, at]
            self._store(c, number, files)

    def _grow(self, c: dict, more: int) -> None:
        """Split chunks until they have room for so many more files."""
        while c["files"] + more > CHUNK_FILES * c["chunks"]:
            new, c["chunks"] = c["chunks"], c["chunks"] + 1
            number = new - (1 << new.bit_length() - 1)
            files = self._load(c, number)
            moved = {p: v for p, v in files.items() if _chunk(p, c["chunks"]) == new}
            if moved:
                self._store(c, number, {p: v for p, v in files.items() if p not in moved})
                self._store(c, new, moved)

    def _load(self, c: dict, number: int) -> dict[str, list]:
        if number:
            known = self.chunks.getValue((number,)) if self.chunks.containsKey((number,)) else None
            return json.loads(known[0]) if known else {}
        return json.loads(c["first"])

    def _store(self, c: dict, number: int, files: dict[str, list]) -> None:
        if number:
            self.chunks.updateValue((number,), (json.dumps(files),))
        else:
            c["first"] = json.dumps(files)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        c = self._counts()
        if c["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            c["timer"] = None
            self._keep(c)
            if c["status"] == "running":
                yield self._row(key[0], c, "stalled")

    def close(self) -> None:
        pass

    def _counts(self) -> dict:
        names = [x.split()[0] for x in _COUNTS.split(", ")]
        known = self.counts.get() if self.counts.exists() else (None, None, 0, 0, 0, 0, None, None, None, None, 0, 1, "{}")
        return dict(zip(names, known, strict=True))

    def _keep(self, c: dict) -> None:
        self.counts.update(tuple(c.values()))

    def _set_timer(self, c: dict) -> None:
        if c["timer"] is not None:
            self.handle.deleteTimer(c["timer"])
        c["timer"] = int((c["updated"] + self.stall_seconds) * 1000) if c["status"] == "running" else None
        if c["timer"] is not None:
            self.handle.registerTimer(c["timer"])
        self._keep(c)

    @staticmethod
    def _row(scan_id: str, c: dict, status: str | None) -> Row:
        total, updated = c["total"] or 0, c["updated"]
        rate = c["processed"] / max(updated - (c["created"] if c["created"] is not None else updated), 0.001)
        left = round(max(total - c["processed"], 0) / rate) if rate > 0 else None
        return Row(scan_id=scan_id, status=status, total=total, files_processed=c["processed"], files_cached=c["cached"], files_skipped=c["skipped"], dates_reviewed=c["candidates"], rate=round(rate, 1), eta_seconds=left, updated_at=datetime.fromtimestamp(updated))


def statuses(events: DataFrame, late_minutes: int = 10, stall_seconds: float = STALL_SECONDS) -> DataFrame:
    """A stream of events to a stream of STATUS rows, one for a session whenever something came for it or it stalled."""
    ship(events.sparkSession)
    own = events.withWatermark("updated_at", f"{late_minutes} minutes")
    return own.groupBy("scan_id").transformWithState(statefulProcessor=SessionStatus(stall_seconds), outputStructType=STATUS, outputMode="Update", timeMode="EventTime")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int = 12, late_minutes: int = 10, stall_seconds: float = STALL_SECONDS) -> StreamingQuery:
    """Read events from the Parquet files of a folder, as far as they are there, and write each batch's rows to out; goes on from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    query = statuses(events, late_minutes, stall_seconds).writeStream.outputMode("update").foreachBatch(store)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last STATUS row of each session."""
    rows = spark.read.parquet(out).drop("part")
    return rows.groupBy("scan_id").agg(F.max_by(F.struct(*rows.columns), "batch").alias("x")).select("x.*").drop("batch")
