"""From judged mentions to results: deduplication, order, envelope, sessions' bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.order import numbered


def title_key(title: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(title), r"(?U)\s+", " ")), 1, 80)


#: What tells repeats apart and which of them is kept; who needs no more of commitments selects these before deduplication, as they are sorted.
BASIS = ("date", "category", "title", "document_id", "confidence", "source", "line", "segment_no", "hit_no")


def same(within: tuple[str, ...] = ()) -> list[Column | str]:
    """What repeats of a commitment share: date, category, title and document (and the columns `within`)."""
    identity = F.coalesce(F.nullif("document_id", F.lit("")), "source")
    return [*within, "date", "category", title_key(F.col("title")).alias("_title"), identity.alias("_identity")]


def deduplicate(commitments: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """The most confident of the commitments that share date, category, title and document (and the columns `within`); ties go to the first by place.

    Equal documents under different paths share their document_id. A partition holds one obligation's repeats within one
    document, so no partition grows with the corpus but by copies of a document; those are cut down to one row a path first.
    """
    rank = F.struct((-F.col("confidence")).alias("c"), "source", "line", "segment_no", "hit_no")
    # an aggregate, not a window: it combines on the map side, so copies of a document do not meet in one task
    best = commitments.groupBy(*same(within)).agg(F.min_by(F.struct(*commitments.columns), rank).alias("best"))
    return best.select("best.*")


def ordered(commitments: DataFrame) -> DataFrame:
    """By date, falling confidence, source; a range sort."""
    return commitments.orderBy("date", F.desc("confidence"), "source", "line", "segment_no", "hit_no")


#: Where a commitment stands in its document.
PLACE = ("line", "segment_no", "hit_no")


def with_positions(commitments: DataFrame) -> DataFrame:
    """commitments with position: their place in the order of results, from 1."""
    return numbered(commitments, ["date", F.desc("confidence"), "source", *PLACE])


def in_session_order(commitments: DataFrame, done_at: str) -> DataFrame:
    """By date and falling confidence, then as their files were done; a range sort."""
    return commitments.orderBy("date", F.desc("confidence"), done_at, "source", *PLACE)


def with_session_positions(commitments: DataFrame) -> DataFrame:
    """commitments (with scan_id and their file's updated_at) with position: their place in their session: by date and falling confidence, then as files were done."""
    return numbered(commitments, ["date", F.desc("confidence"), "updated_at", "source", *PLACE], within=["scan_id"])


def rejections(judged: DataFrame) -> DataFrame:
    """(path, reason, n) of mentions that are no commitments."""
    return judged.filter("rejected_as is not null").groupBy("path", F.col("rejected_as").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def document_outcomes(docs: DataFrame, judged: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """(path, candidates, commitments, warning): each document's count and why it has nothing to show, if it has nothing."""
    counts = judged.groupBy("path").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("rejected_as").isNull()).alias("commitments"), F.count_if(F.col("rejected_as") == V.HISTORICAL).alias("historical"))
    out = docs.join(counts, "path", "left").fillna(0, ["candidates", "commitments", "historical"])
    has_statement = F.lit(False)
    if statements is not None:
        out = out.join(statements.select("path").distinct().withColumn("_statement", F.lit(True)), "path", "left")
        has_statement = F.coalesce("_statement", F.lit(False))
    reason = F.when(F.col("historical") > 0, V.HISTORICAL).otherwise(V.NO_ACTION)
    warning = F.when((F.col("commitments") == 0) & ~has_statement, F.concat(reason, F.lit(": "), "path"))
    return out.withColumn("warning", F.coalesce("warning", warning) if "warning" in docs.columns else warning).select("path", "candidates", "commitments", "historical", "warning")


def duplicates_warning(n: Column) -> Column:
    """The warning about n commitments that were left out as repeats; null for none."""
    return F.when(n > 0, F.concat(F.lit(f"{V.DUPLICATE}: "), n.cast("string"), F.lit(" repeated commitment(s)")))


def _in_order(rows: Column) -> Column:
    return F.transform(F.array_sort(rows), lambda x: x["warning"])


def envelope(outcomes: DataFrame, found: DataFrame, kept: DataFrame, today, warnings: int = 12) -> DataFrame:
    """One row about a scan: today, files_scanned, files_skipped, dates_reviewed (of documents without a warning), noise_removed,
    commitments, duplicates, and its first warnings by path, after them the one about repeats.

    outcomes: one row a document; found: its commitments, repeats too; kept: those that are left.
    """
    ok = F.col("warning").isNull()
    totals = outcomes.agg(F.count_if(ok).alias("files_scanned"), F.count_if(~ok).alias("files_skipped"), F.coalesce(F.sum(F.when(ok, F.col("candidates"))), F.lit(0)).alias("dates_reviewed"))
    first = outcomes.filter(~ok).orderBy("path", "warning").limit(warnings).agg(F.collect_list(F.struct("path", "warning")).alias("_first"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = totals.withColumn("_one", F.lit(1))
    for side in (first, one(found, "_found"), one(kept, "commitments")):
        out = out.join(side.withColumn("_one", F.lit(1)), "_one")
    repeats = F.col("_found") - F.col("commitments")
    told = F.array_compact(F.concat(_in_order(F.col("_first")), F.array(duplicates_warning(repeats))))
    return out.select(
        F.lit(today).cast("date").alias("today"), "files_scanned", "files_skipped", "dates_reviewed", F.greatest(F.col("dates_reviewed") - F.col("commitments"), F.lit(0)).alias("noise_removed"),
        "commitments", repeats.alias("duplicates"), F.slice(told, 1, warnings).alias("warnings"),
    )


# ---- bookkeeping of sessions

def cache_key(engine: str, month_first: bool, path: Column, fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(engine), F.lit("month-first" if month_first else "day-first"), path, fingerprint).cast("binary"), 256)


def register(manifest: DataFrame, files: DataFrame, cache: DataFrame) -> DataFrame:
    """The session's file table after a manifest (path, size, fingerprint, cache_key): finished files with an unchanged key stay as
    they are, files known to the cache are `cached`, all others `pending`. Entries without fingerprint are left out."""
    new = manifest.filter(F.coalesce("fingerprint", F.lit("")) != "").select("path", "size", "fingerprint", F.col("cache_key").alias("new_key"))
    known = cache.select(F.col("cache_key").alias("new_key"), F.lit(True).alias("is_cached"))
    old = files.select("path", F.col("cache_key").alias("old_key"), F.col("status").alias("old_status"))
    both = new.join(known, "new_key", "left").join(old, "path", "full_outer")
    same = F.col("old_status").isin("done", "cached") & (F.col("old_key") == F.col("new_key"))
    status = F.when(F.col("new_key").isNull() | same, F.col("old_status")).when(F.col("is_cached"), "cached").otherwise("pending")
    return both.select("path", F.coalesce("new_key", "old_key").alias("cache_key"), "size", "fingerprint", status.alias("status"))


def pending(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Uploads whose fingerprint the session waits for."""
    return uploads.join(files.filter("status = 'pending'").select("fingerprint"), "fingerprint", "left_semi")


def snapshot(files: DataFrame) -> DataFrame:
    """Per scan_id: counts by status; candidates of all files, the skipped ones too."""
    return files.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "pending").alias("processed"), F.count_if(F.col("status") == "cached").alias("cached"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status").isin("done", "cached")).alias("files_scanned"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("dates_reviewed"),
    )


def session_report(sessions: DataFrame, files: DataFrame, found: DataFrame, warnings: int = 24) -> DataFrame:
    """What is shown of sessions (scan_id, status, total, created_at, updated_at), one row each: counts by status, dates reviewed,
    commitments after deduplication within the session, warnings in the order in which files were done, files a second and seconds left.

    files: scan_id, path, status, candidates, warning, updated_at. found: commitments with scan_id. Sessions without files have zeros.
    Only the first warnings of a session are gathered, so no task holds all of them.
    """
    counts = snapshot(files)
    order = Window.partitionBy("scan_id").orderBy("updated_at", "path")
    first = files.filter("warning is not null").select("scan_id", "updated_at", "path", "warning").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= warnings)
    first = first.groupBy("scan_id").agg(F.collect_list(F.struct("n", "warning")).alias("_first"))
    # found is read once: its repeats are counted where they are told apart
    again = found.groupBy(*same(("scan_id",))).agg(F.count(F.lit(1)).alias("_n"))
    kept = again.groupBy("scan_id").agg(F.sum("_n").alias("_found"), F.count(F.lit(1)).alias("commitments"))
    out = sessions.select("scan_id", "status", F.col("total").cast("long").alias("_total"), "created_at", "updated_at")
    for side in (counts.withColumnRenamed("total", "_listed"), first, kept):
        out = out.join(side, "scan_id", "left")
    out = out.fillna(0, ["_listed", "processed", "cached", "skipped", "files_scanned", "dates_reviewed", "_found", "commitments"])
    seconds = F.col("updated_at").cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")
    rate, left = progress(F.col("processed"), F.col("_total"), seconds)
    told = F.array_compact(F.concat(F.coalesce(_in_order(F.col("_first")), F.array().cast("array<string>")), F.array(duplicates_warning(F.col("_found") - F.col("commitments")))))
    return out.select(
        "scan_id", "status", F.col("_total").alias("total"), (F.col("processed") - F.col("skipped")).alias("files_scanned"), F.col("processed").alias("files_processed"), F.col("cached").alias("files_cached"), F.col("skipped").alias("files_skipped"),
        (F.col("_listed") - F.col("processed")).alias("files_pending"), "dates_reviewed", F.greatest(F.col("dates_reviewed") - F.col("commitments"), F.lit(0)).alias("noise_removed"), "commitments",
        F.slice(told, 1, warnings).alias("warnings"), F.bround(rate, 1).alias("rate"), left.alias("eta_seconds"),
    )


def latest_resumable(sessions: DataFrame) -> DataFrame:
    """Per scan_key and date order the newest session that runs or was cancelled."""
    newest = Window.partitionBy("scan_key", "month_first").orderBy(F.desc("updated_at"), F.desc("scan_id"))
    return sessions.filter(F.col("status").isin("running", "cancelled")).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def progress(processed: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """(files a second, seconds left; null as long as nothing is done)."""
    rate = processed / F.greatest(seconds, F.lit(0.001))
    return rate, F.when(rate > 0, F.rint(F.greatest(total - processed, F.lit(0)) / rate)).cast("long")


def fingerprint(revision: str, path: Column, size: Column, modified: Column) -> Column:
    """What tells one state of a file from another without reading it: revision, path, size and time, with U+0000 between."""
    return F.concat_ws("\u0000", F.lit(revision), path, size.cast("string"), modified.cast("string"))


def scan_key(manifest: DataFrame, root: str) -> DataFrame:
    """(scan_key): one digest over all fingerprints in order, with the root, the number of files and their bytes."""
    each = F.xxhash64("path", "fingerprint")
    # order-free sums of row hashes stand for the listing, so no task sees all of it
    sums = manifest.agg(F.sum(each.cast("decimal(38,0)")).alias("a"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return sums.select(F.sha2(F.concat_ws(":", F.lit(root), "n", "bytes", "a").cast("binary"), 256).alias("scan_key"))
