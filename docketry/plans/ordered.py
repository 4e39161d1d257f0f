"""Queries over order: places of results, of hits and of files, batches packed in order, and files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import dates, order
from docketry.functions import fixed_values as V
from docketry.operators import exports, horizon, results
from docketry.plans import views
from docketry.plans.catalog import ORACLE_SQL, expected, judged, query, told
from docketry.plans.views import MANIFEST, TODAY
from docketry.sources import sinks
from docketry.sources.shared import scratch_path, spill


@query(f"""WITH {expected}, d AS (SELECT *, row_number() OVER (PARTITION BY date, category, lower(title), document_id ORDER BY confidence DESC, path) AS k FROM good)
SELECT path, date, row_number() OVER (ORDER BY date, confidence DESC, path) AS position FROM d WHERE k = 1""")
def result_order(spark, sf_dir):
    good = judged(spark, sf_dir).filter("rejected_as is null").drop("rejected_as")
    return results.with_positions(results.deduplicate(good.select("path", *results.BASIS))).select("path", "date", "position")


@query(f"""WITH {expected}, d AS (SELECT *, row_number() OVER (PARTITION BY document_id, date, category, lower(title) ORDER BY confidence DESC, path) AS k FROM good)
SELECT path, document_id AS scan_id, row_number() OVER (PARTITION BY document_id ORDER BY date, confidence DESC, key // 3, path) AS position FROM d WHERE k = 1""")
def session_order(spark, sf_dir):
    files = views.notices(spark, sf_dir).select("path", F.floor(F.col("key") / 3).alias("updated_at"))
    found = judged(spark, sf_dir).filter("rejected_as is null").drop("rejected_as").withColumn("scan_id", F.col("document_id"))
    kept = results.deduplicate(found.select("path", "scan_id", *results.BASIS), ("scan_id",)).join(files, "path")
    return results.with_session_positions(kept).select("path", "scan_id", "position")


@query(f"SELECT key, raw, CAST(row_number() OVER (PARTITION BY key ORDER BY start) AS INT) AS position FROM ({ORACLE_SQL['phrase_dates']})")
def hit_order(spark, sf_dir):
    hits = dates.find_dates(F.col("content"), F.col("anchor"), month_first=True)
    h = views.phrases(spark, sf_dir).select("key", F.posexplode(hits).alias("at", "h"))
    return h.select("key", F.col("h.raw").alias("raw"), (F.col("at") + 1).alias("position"))


#: Scanned pages take about a hundred times their characters.
_BYTES = 100


@query(f"""WITH RECURSIVE {MANIFEST}, r AS (SELECT path, least(size * {_BYTES}, {V.MAX_FILE_BYTES}) AS s, row_number() OVER (ORDER BY path) AS i FROM manifest),
g AS (SELECT i, 1 AS batch, 1 AS files, s AS total FROM r WHERE i = 1 UNION ALL
  SELECT r.i, CASE WHEN files >= {V.UPLOAD_FILES} OR total + s > {V.UPLOAD_BYTES} THEN batch + 1 ELSE batch END, CASE WHEN files >= {V.UPLOAD_FILES} OR total + s > {V.UPLOAD_BYTES} THEN 1 ELSE files + 1 END, CASE WHEN files >= {V.UPLOAD_FILES} OR total + s > {V.UPLOAD_BYTES} THEN s ELSE total + s END FROM g JOIN r ON r.i = g.i + 1)
SELECT path, CAST(batch AS BIGINT) AS batch FROM r JOIN g USING (i)""")
def upload_batches(spark, sf_dir):
    size = F.least(F.col("size") * _BYTES, F.lit(V.MAX_FILE_BYTES))
    return order.packed(views.manifest(spark, sf_dir).select("path", "size"), ["path"], size, V.UPLOAD_FILES, V.UPLOAD_BYTES).select("path", "batch")


@query(f"WITH {MANIFEST} SELECT path, (row_number() OVER (ORDER BY path) - 1) // {V.CHUNK_FILES} + 1 AS chunk FROM manifest")
def manifest_chunks(spark, sf_dir):
    return order.chunks(views.manifest(spark, sf_dir).select("path"), ["path"], V.CHUNK_FILES)


# ---- files to take away, written and read back

_EVENT = ORACLE_SQL["calendar_events"].partition("array_to_string(")[2].rpartition(" AS event")[0]


@query(f"""WITH {told}, lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY date < DATE '{TODAY}', date, confidence DESC, path) AS k FROM told) WHERE k = 1),
b AS (SELECT *, upper(category[1]) || category[2:] AS kind_name, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM lead), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY date, path) AS i FROM b)
SELECT slug || CASE WHEN i > 1 THEN '_' || i ELSE '' END || '.ics' AS name, sha256(array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:{exports.PRODUCT}', 'CALSCALE:GREGORIAN', 'X-WR-CALNAME:' || title, array_to_string({_EVENT}, 'END:VCALENDAR', ''], chr(13) || chr(10))) AS content FROM n""")
def calendar_files(spark, sf_dir):
    found = judged(spark, sf_dir).filter("rejected_as is null").drop("rejected_as").withColumns({"source_": F.col("source"), "id": F.col("path"), "source": F.col("document_id")})
    leads = horizon.bundle_items(found, TODAY).filter("leads").withColumn("source", F.col("source_"))
    folder = scratch_path(spark, "calendars")
    sinks.write_files(exports.event_files(leads, "20260101T000000Z"), folder, deep=True)
    return sinks.read_files(spark, folder, deep=True).select("name", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


_ROW = ORACLE_SQL["csv_export"].partition("SELECT path, ")[2].rpartition(" AS row FROM told")[0]


@query(f"""WITH {told}, own AS (SELECT document_id, date, path, {_ROW} AS row FROM told)
SELECT document_id || '.csv' AS name, sha256('{exports.CSV_HEAD}' || chr(13) || chr(10) || string_agg(row, chr(13) || chr(10) ORDER BY date, path)) AS content FROM own GROUP BY document_id""")
def document_files(spark, sf_dir):
    found = judged(spark, sf_dir).filter("rejected_as is null").drop("rejected_as").withColumn("id", F.col("path"))
    own = exports.document_files(spill(found.select("id", "document_id", "snippet", *exports.CSV_COLUMNS), "found"), by="document_id")  # heads and rows read it
    folder = scratch_path(spark, "tables")
    sinks.write_files(own, folder, ["ord"], deep=True)
    return sinks.read_files(spark, folder, deep=True).select("name", F.sha2(F.col("content").cast("binary"), 256).alias("content"))
