"""What is shown of commitments: filters, buckets, bundles, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Filters that stand for several categories.
EXPIRY = ("expiry", "renewal", "warranty", "vehicle", "travel")
MONEY = ("money", "billing", "utilities", "banking")
SOON_DAYS = 30


def matches(name: str, today) -> Column:
    """The condition of a named filter: `all`, `soon`, `expiry`, `money`, or a category or domain."""
    days = F.datediff("date", F.lit(today).cast("date"))
    if name == "all":
        return F.lit(True)
    if name == "soon":
        return days.between(0, SOON_DAYS)
    groups = {"expiry": EXPIRY, "money": MONEY}
    return F.col("category").isin(*groups[name]) if name in groups else (F.col("category") == name) | F.coalesce(F.col("domain") == name, F.lit(False))


def visible(commitments: DataFrame, dismissed: DataFrame, name: str, today) -> DataFrame:
    return commitments.filter(matches(name, today)).join(dismissed.select("id"), "id", "left_anti")


def bucket(date: Column, today) -> Column:
    days = F.datediff(date, F.lit(today).cast("date"))
    return F.when(days < 0, "Overdue").when(days <= SOON_DAYS, "Next 30 days").otherwise("Later")


def _place(today) -> list[Column]:
    """The order of commitments within a document, those to come before those past; the first of it leads."""
    return [F.col("date") < F.lit(today).cast("date"), F.col("date"), -F.col("confidence"), F.col("id")]


def bundles(commitments: DataFrame, today) -> DataFrame:
    """(source, n, lead_date, lead_id, lead_title, bucket): a document's commitments, led by the first that is not past, else by the earliest."""
    lead = F.min_by(F.struct("date", "id", "title"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(_place(today)))))
    found = commitments.groupBy("source").agg(F.count(F.lit(1)).alias("n"), lead.alias("x"))
    return found.select("source", "n", F.col("x.date").alias("lead_date"), F.col("x.id").alias("lead_id"), F.col("x.title").alias("lead_title"), bucket(F.col("x.date"), today).alias("bucket"))


def bundle_items(commitments: DataFrame, today) -> DataFrame:
    """commitments with position (by date within their document, from 1) and leads. Rows, not lists, so a document may have any number."""
    own = Window.partitionBy("source")
    by_date, by_lead = own.orderBy("date", F.desc("confidence"), "id"), own.orderBy(*_place(today))
    return commitments.withColumns({"position": F.row_number().over(by_date), "leads": F.row_number().over(by_lead) == 1})


def selected(commitments: DataFrame, chosen: DataFrame) -> DataFrame:
    """The commitments whose id is among chosen's, as an export of a selection takes them."""
    return commitments.join(chosen.select("id"), "id", "left_semi")


def with_source(commitments: DataFrame, files: DataFrame) -> DataFrame:
    """commitments with opens: their file's path, with the page for PDF files that have one; null where files (path) lacks it."""
    known = files.select(F.col("path").alias("_path")).distinct()
    paged = (F.col("page") > 0) & F.lower("source").endswith(".pdf")
    target = F.concat("_path", F.when(F.coalesce(paged, F.lit(False)), F.concat(F.lit("#page="), F.col("page").cast("string"))).otherwise(""))
    return commitments.join(known, F.col("source") == F.col("_path"), "left").withColumn("opens", target).drop("_path")


def relative_label(date: Column, today) -> Column:
    days = F.datediff(date, F.lit(today).cast("date"))
    return F.when(days == 0, "Today").when(days == 1, "Tomorrow").when(days == -1, "Yesterday").when(days < 0, F.concat(F.abs(days), F.lit(" days overdue"))).otherwise(F.concat(F.lit("In "), days, F.lit(" days")))


def totals(commitments: DataFrame, statements: DataFrame, today) -> DataFrame:
    """One row: distinct sources of commitments and statements, milestones, and the nearest date to come."""
    day = F.lit(today).cast("date")
    coming = F.when(F.col("date") >= day, F.col("date"))
    both = commitments.select("source", F.lit(1).alias("n"), coming.alias("date")).union(statements.select("source", F.lit(0), F.lit(None).cast("date")))
    # one row a source, so that no distinct count has to be expanded; a null source is none
    own = both.groupBy("source").agg(F.sum("n").alias("n"), F.min("date").alias("date"))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("milestones"), F.min("date").alias("nearest"), F.count("source").alias("sources"))


def document_label(path: Column) -> Column:
    """The file's name without suffix, separators as spaces, runs of ASCII letters and digits capitalised; `Untitled document` if nothing is left."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", ""), r"(?U)[_\-\s]+", " "))
    runs = F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    words = F.transform(runs, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))).otherwise(w))
    return F.coalesce(F.nullif(F.array_join(words, ""), F.lit("")), F.lit("Untitled document"))


# ---- figures as they are shown

def bytes_label(n: Column) -> Column:
    """Bytes, whole KB from 1024 on, MB with one digit from 1024 KB on; halves go up."""
    tenths = F.floor((n * 10 + 524_288) / 1_048_576)
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1_048_576, F.concat(F.floor((n + 512) / 1024).cast("string"), F.lit(" KB"))).otherwise(mb)


def eta_label(seconds: Column) -> Column:
    """Seconds left: whole seconds (one at least), minutes or hours and minutes, the last unit rounded up."""
    minutes = lambda s: F.ceil(s / 60).cast("string")
    whole = F.greatest(F.lit(1), F.floor(seconds + 0.5)).cast("string")
    hours = F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" hr "), minutes(seconds % 3600), F.lit(" min"))
    return F.when(seconds < 60, F.concat(whole, F.lit(" sec"))).when(seconds < 3600, F.concat(minutes(seconds), F.lit(" min"))).otherwise(hours)


def date_label(date: Column) -> Column:
    return F.date_format(date, "MMM d, yyyy")


def money_label(amount: Column, symbol: Column) -> Column:
    """The amount without its sign, two digits, thousands apart."""
    return F.concat(symbol, F.format_number(F.round(F.abs(amount), 2), 2))
