"""Queries over what sessions keep: results by cache_key across batches and a compacted generation, and what changed between listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import changes, results
from docketry.plans import views
from docketry.plans.catalog import query
from docketry.plans.views import MANIFEST
from docketry.sources.shared import scratch_path
from docketry.streaming import sessions, status, store
from docketry.streaming.log import Log

#: (session, which documents its batch holds, which of them have a warning), in the order of the batches; two of them are compacted before the third comes.
_BATCHES = (("s1", 3, 9), ("s2", 5, 25), ("s2", 7, 49))


@query(f"""WITH {MANIFEST}, b AS (SELECT path, doc_id, n, scan_id, bad, CASE WHEN bad THEN 'skipped' ELSE 'done' END AS status FROM manifest,
  LATERAL (VALUES {", ".join(f"({n}, '{s}', doc_id % {m} = 0, doc_id % {w} = 0)" for n, (s, m, w) in enumerate(_BATCHES))}) v(n, scan_id, there, bad) WHERE there),
own AS (SELECT path, arg_max(status, n) AS status, arg_max(doc_id % 10 + n, n) AS candidates FROM b WHERE scan_id = 's2' GROUP BY path),
k AS (SELECT path, arg_max(doc_id % 10 + n, n) AS candidates FROM b WHERE NOT bad GROUP BY path)
SELECT m.path, coalesce(own.status, CASE WHEN k.path IS NOT NULL THEN 'cached' ELSE 'pending' END) AS status, CAST(coalesce(own.candidates, k.candidates, 0) AS BIGINT) AS candidates FROM manifest m LEFT JOIN own USING (path) LEFT JOIN k USING (path)""")
def store_merge(spark, sf_dir):
    state = scratch_path(spark, "session-state")
    m = views.manifest(spark, sf_dir)
    m = m.withColumn("cache_key", results.cache_key("e1", False, F.col("path"), F.col("fingerprint")))
    m.select(F.col("path").alias("location"), "path", "size", F.lit("").alias("modified"), "fingerprint", "cache_key").write.parquet(f"{state}/manifests/scan_id=s2")
    log = Log(spark, f"{state}/log")
    for n, (scan_id, of, bad) in enumerate(_BATCHES):
        rows = m.filter(F.col("doc_id") % of == 0)
        warning = F.when(F.col("doc_id") % bad == 0, "unreadable")
        done = rows.select(F.lit(scan_id).alias("scan_id"), "path", "cache_key", F.when(warning.isNull(), "done").otherwise("skipped").alias("status"), (F.col("doc_id") % 10 + n).alias("candidates"), F.lit(0).cast("long").alias("commitments"), warning.alias("warning"), F.current_timestamp().alias("updated_at"))
        for kind in store.KINDS:
            store.write(done if kind == "done" else done.select("path", "cache_key"), state, kind, f"b{n}")
        entry = {"kind": "batch", "scan_id": scan_id, "name": f"b{n}"}
        log.append(lambda entries, entry=entry: entry)
        store.compact_if_due(spark, state, log, after=2)
    return sessions.files_of(spark, state, "s2").select("path", "status", "candidates")


#: The second state of a listing: some files are gone, some differ, some came in folders of their own; most folders are as they were.
_STATES = f"""{MANIFEST}, old AS (SELECT path, size, fingerprint, doc_id FROM manifest),
new AS (SELECT path, size, CASE WHEN doc_id % 14 = 0 AND path LIKE 'home/venv/%' THEN fingerprint || '+' ELSE fingerprint END AS fingerprint FROM old WHERE NOT (doc_id % 34 = 0 AND path LIKE 'home/.git/%')
  UNION ALL SELECT 'home/new/' || (doc_id % 3) || '/doc_' || doc_id, size, fingerprint FROM old WHERE doc_id % 41 = 0)"""


def _states(spark, sf_dir):
    old = views.manifest(spark, sf_dir)
    i, path = F.col("doc_id"), F.col("path")
    kept = old.filter(~((i % 34 == 0) & path.startswith("home/.git/")))
    kept = kept.select("path", "size", F.when((i % 14 == 0) & path.startswith("home/venv/"), F.concat("fingerprint", F.lit("+"))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    came = old.filter(i % 41 == 0).select(F.concat(F.lit("home/new/"), (i % 3).cast("string"), F.lit("/doc_"), i.cast("string")).alias("path"), "size", "fingerprint")
    return old.select("path", "size", "fingerprint"), kept.unionByName(came)


@query(f"""WITH {_STATES} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.fingerprint <> n.fingerprint""")
def folder_changes(spark, sf_dir):
    return changes.changes(*_states(spark, sf_dir))


@query(f"""WITH {_STATES}, f AS (SELECT path, size, regexp_replace(path, '/[^/]*$', '') AS dir FROM new), l AS (SELECT size, string_split(dir, '/') AS p FROM f), u AS (SELECT size, p, unnest(range(0, len(p) + 1)) AS depth FROM l)
SELECT array_to_string(p[1:depth], '/') AS folder, CAST(depth AS INT) AS depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM u GROUP BY 1, 2""")
def folder_sums(spark, sf_dir):
    return changes.tree(_states(spark, sf_dir)[1]).select("folder", "depth", "files", "bytes")


@query(f"""WITH {_STATES}, c AS (SELECT coalesce(o.path, n.path) AS path FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.fingerprint <> n.fingerprint),
a AS (SELECT path FROM old UNION SELECT path FROM new), up AS (SELECT path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS p FROM a), f AS (SELECT path, p, unnest(range(0, len(p) + 1)) AS depth FROM up),
d AS (SELECT array_to_string(p[1:depth], '/') AS folder, depth, CASE WHEN depth > 0 THEN array_to_string(p[1:depth - 1], '/') END AS parent, bool_or(c.path IS NOT NULL) AS differs, bool_or(c.path IS NOT NULL AND depth = len(p)) AS own_differs FROM f LEFT JOIN c USING (path) GROUP BY 1, 2, 3)
SELECT d.folder, CAST(d.depth AS INT) AS depth, d.differs, d.own_differs FROM d LEFT JOIN d x ON d.parent = x.folder WHERE d.depth = 0 OR x.differs""")
def folders_looked_at(spark, sf_dir):
    old, new = _states(spark, sf_dir)
    return changes.levels(changes.tree(old), changes.tree(new))


# ---- status as a stream

@query("""WITH f AS (SELECT o_custkey, o_orderkey % 900 AS t, (['pending', 'done', 'cached', 'skipped'])[o_orderkey % 4 + 1] AS s, o_orderkey % 6 AS c FROM orders),
g AS (SELECT o_custkey, max(t) AS t, count(*) FILTER (s <> 'pending') AS processed, count(*) FILTER (s = 'cached') AS cached, count(*) FILTER (s = 'skipped') AS skipped, sum(c) FILTER (s <> 'pending') AS dates FROM f GROUP BY 1),
x AS (SELECT c_custkey, CAST(c_custkey % 50 + 5 AS BIGINT) AS total, coalesce(processed, 0) AS processed, coalesce(cached, 0) AS cached, coalesce(skipped, 0) AS skipped, CAST(coalesce(dates, 0) AS BIGINT) AS dates, coalesce(processed, 0) / greatest(CAST(coalesce(t, 0) AS DOUBLE), 0.001) AS rate FROM customer LEFT JOIN g ON o_custkey = c_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS scan_id, 'cancelled' AS status, total, processed AS files_processed, cached AS files_cached, skipped AS files_skipped, dates AS dates_reviewed, CASE WHEN rate > 0 THEN CAST(round_even(greatest(total - processed, 0) / rate, 0) AS BIGINT) END AS eta_seconds FROM x""")
def session_stream(spark, sf_dir):
    """Events of all files, followed as a stream; it is stopped after the first half and goes on from its checkpoint."""
    k, begun = F.col("o_orderkey"), F.lit("2026-08-13 09:00:00").cast("timestamp")
    final = F.element_at(F.array(*(F.lit(s) for s in ("pending", "done", "cached", "skipped"))), (k % 4 + 1).cast("int"))
    later = F.timestamp_add("SECOND", (k % 900).cast("int"), begun)
    files = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("scan_id"), k.cast("string").alias("path"), F.explode(F.array(F.struct(F.lit("pending").alias("status"), F.lit(0).cast("long").alias("candidates"), begun.alias("updated_at")), F.struct(final.alias("status"), F.when(final == "pending", 0).otherwise(k % 6).cast("long").alias("candidates"), later.alias("updated_at")))).alias("x"))
    files = files.select("scan_id", "path", "x.status", "x.candidates", F.lit(None).cast("long").alias("total"), "x.updated_at")
    c = F.col("c_custkey")
    own = views.table(spark, sf_dir, "customer").select(c.cast("string").alias("scan_id"), F.lit(None).cast("string").alias("path"), F.lit("cancelled").alias("status"), F.lit(None).cast("long").alias("candidates"), (c % 50 + 5).cast("long").alias("total"), begun.alias("updated_at"))
    base = scratch_path(spark, "status")
    half = F.pmod(F.xxhash64("scan_id", "path", "status"), F.lit(2)) == 0
    for part in (half, ~half):
        files.unionByName(own).filter(part).write.mode("append").parquet(f"{base}/events")
        status.follow(spark, f"{base}/events", f"{base}/rows", f"{base}/checkpoint", late_minutes=60).awaitTermination()
    return status.latest(spark, f"{base}/rows").drop("rate", "updated_at")
