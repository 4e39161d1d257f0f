"""Sessions: the log, drivers at once, cancelling, deadlines, and what is known by cache_key."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from docketry.sources.files import Unreadable, deadline, decode
from docketry.streaming import sessions, store
from docketry.streaming.log import Log

TEXT = "Subject: Renewal\n\nYour health insurance policy renewal: premium is due by 2026-10-15. Policy number 7."


def test_writers_of_a_log_see_all_before_them(spark, tmp_path):
    folder = str(tmp_path / "log")

    def write(who):
        log = Log(spark, folder)
        for _ in range(8):
            log.append(lambda entries: {"who": who, "seen": len(entries)})

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    entries = Log(spark, folder).entries()
    assert [e["seen"] for e in entries] == list(range(24)) and {e["who"] for e in entries} == {0, 1, 2}
    assert Log(spark, folder).append(lambda entries: None) is None and len(Log(spark, folder).entries()) == 24
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("_draft")]


def test_a_log_where_hadoop_renames(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./here", f"file://{tmp_path}")
    one, other = (Log(spark, "viewfs://logs/here/log") for _ in range(2))
    for log in (one, other, one):
        log.append(lambda entries: {"seen": len(entries)})
    assert [e["seen"] for e in other.entries()] == [0, 1, 2]
    assert not one._create(2, b"{}") and [e["seen"] for e in Log(spark, "viewfs://logs/here/log").entries()] == [0, 1, 2]


def test_two_drivers_of_a_session_count_each_file_once(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.eml").write_text(TEXT.replace("10-15", f"1{i}-15"))
    got = []

    def go():
        try:
            got.append(sessions.resume(spark, str(folder), state, "2026-08-13"))
        except sessions.Fenced:
            got.append(None)

    threads = [threading.Thread(target=go) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = Log(spark, f"{state}/log").entries()
    scans = {e["scan_id"] for e in log if e["kind"] == "session"}
    assert len(scans) == 1 and set(got) - {None} == scans
    row, found, _ = sessions.report(spark, state, scans.pop())
    row = row.first()
    assert (row.status, row.total, row.files_processed, row.files_scanned) == ("complete", 3, 3, 3)
    assert [str(r.date) for r in found.collect()] == ["2026-10-15", "2026-11-15", "2026-12-15"]
    # the log has a batch of one owner only
    assert len([e for e in log if e["kind"] == "batch"]) == 1


def test_cancel_ends_a_running_batch(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.eml").write_text(TEXT)
    took = []

    def go():
        began = time.time()
        sessions.resume(spark, str(folder), state, "2026-08-13")
        took.append(time.time() - began)

    thread = threading.Thread(target=go)
    thread.start()
    log = Log(spark, f"{state}/log")
    while not log.entries():
        time.sleep(0.1)
    scan_id = log.entries()[0]["scan_id"]
    sessions.cancel(spark, state, scan_id)
    thread.join()
    assert sessions.sessions_of(spark, state).first().status == "cancelled" and not [e for e in log.entries() if e["kind"] == "batch"]
    row, found, banks = sessions.report(spark, state, scan_id)
    assert row.first().files_pending == 1 and found.collect() == [] == banks.collect()
    assert sessions.resume(spark, str(folder), state, "2026-08-13") == scan_id
    assert sessions.report(spark, state, scan_id)[1].count() == 1


def test_a_file_that_takes_too_long_gets_a_warning(spark):
    with pytest.raises(Unreadable, match="exceeded the 0.2 second"), deadline(0.2):
        while True:
            pass
    with deadline(5):
        pass
    slow = bytes(range(128, 256)) * 60_000  # three codecs are tried
    files = spark.createDataFrame([("a.csv", None, None, slow), ("b.csv", None, None, b"due")], "path string, modified string, warning string, content binary")
    got = {r.path: (r.content, r.warning) for r in decode(files, 0.002).collect()}
    assert got == {"a.csv": (None, "a.csv: reader exceeded the 0.002 second safety limit"), "b.csv": ("due", None)}


def _batch(spark, state, log, scan_id, rows):
    name = f"{len(log.entries()):020d}"
    done = spark.createDataFrame([(scan_id, k, k, s, 1, 1, w) for k, s, w in rows], "scan_id string, path string, cache_key string, status string, candidates long, commitments long, warning string").withColumn("updated_at", F.current_timestamp())
    store.write(done, state, "done", name)
    for kind in ("found", "statements"):
        store.write(done.select("path", "cache_key", F.lit(name).alias("value")), state, kind, name)
    log.append(lambda entries: {"kind": "batch", "scan_id": scan_id, "name": name})


def test_generations_keep_the_last_and_join_without_a_shuffle(spark, tmp_path):
    state, log = str(tmp_path), Log(spark, str(tmp_path / "log"))
    keys = [f"k{i:03d}" for i in range(60)]
    spark.createDataFrame([("x", k, 1, "", "f", k) for k in keys], "location string, path string, size long, modified string, fingerprint string, cache_key string").write.parquet(f"{state}/manifests/scan_id=s2")

    def files():
        return {r.path: (r.status, r.warning, r.batch) for r in sessions.files_of(spark, state, "s2").collect()}

    def found():
        return sorted((r.path, r.value) for p in store.parts(spark, state, "found", log.entries()) for r in p.join(sessions.files_of(spark, state, "s2").filter("warning is null and batch is not null"), ["cache_key", "batch"]).select("value", p["path"]).collect())

    _batch(spark, state, log, "s1", [(k, "done", None) for k in keys[:20]])
    _batch(spark, state, log, "s1", [(k, "skipped", "bad") for k in keys[20:25]])
    _batch(spark, state, log, "s2", [(k, "done", None) for k in keys[10:15]] + [(keys[30], "skipped", "bad")])
    before, all_ = files(), found()
    assert [before[k][0] for k in (keys[0], keys[12], keys[22], keys[30], keys[40])] == ["cached", "done", "pending", "skipped", "pending"]
    assert not store.compact_if_due(spark, state, log, after=4) and store.compact_if_due(spark, state, log, after=3, buckets=8)
    assert files() == before and found() == all_
    _batch(spark, state, log, "s2", [(keys[40], "done", None)])
    assert files() == before | {keys[40]: ("done", None, files()[keys[40]][2])}
    # of what is known nothing is shuffled: the listing is, to the buckets
    done = store.known(spark, state, [e for e in log.entries() if e["kind"] == "generation"], "s2")[0]
    listing = spark.read.parquet(f"{state}/manifests/scan_id=s2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = listing.join(done, "cache_key", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first, second = [i for i in range(len(plan)) if plan.startswith("FileScan", i)]
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < first and "Bucketed: true" in plan[second:]
    # later generations take over, what is two generations old goes
    for k in keys[50:53]:
        _batch(spark, state, log, "s2", [(k, "done", None)])
        assert store.compact_if_due(spark, state, log, after=1, buckets=8)
    assert len(list((tmp_path / "generations").iterdir())) == 2 and files()[keys[12]] == before[keys[12]] and files()[keys[52]][0] == "done"


def test_status_is_followed_across_restarts_and_stalls(spark, tmp_path):
    from datetime import datetime

    from docketry.streaming import status

    def at(minute, second=0):
        return datetime(2026, 8, 13, 9, minute, second)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    paths = [str(tmp_path / x) for x in ("events", "rows", "checkpoint")]

    def come(*events):
        spark.createDataFrame(list(events), status.EVENTS).coalesce(1).write.mode("append").parquet(paths[0])
        status.follow(spark, *paths).awaitTermination()
        return {r.scan_id: r for r in status.latest(spark, paths[1]).collect()}

    try:
        got = come(("s", "a", "done", 4, None, at(0, 30)), ("s", None, "running", None, 3, at(0)), ("s", "a", "pending", 0, None, at(0)), ("s", "b", "skipped", 2, None, at(1)), ("t", None, "running", None, 1, at(0)))
        assert (got["s"].status, got["s"].files_processed, got["s"].files_skipped, got["s"].dates_reviewed, got["s"].eta_seconds) == ("running", 2, 1, 6, 30)
        # the checkpoint knows a; an earlier status of it, and the same one again, change nothing
        got = come(("s", "c", "cached", 1, None, at(40)), ("s", "a", "done", 4, None, at(0, 30)), ("s", "b", "pending", 0, None, at(0, 50)), ("s", None, "complete", None, 3, at(41)))
        assert (got["s"].status, got["s"].total, got["s"].files_processed, got["s"].files_cached, got["s"].files_skipped, got["s"].dates_reviewed, got["s"].eta_seconds) == ("complete", 3, 3, 1, 1, 7, 0)
        # t runs and has said nothing for longer than the limit
        assert got["t"].status == "stalled"
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
