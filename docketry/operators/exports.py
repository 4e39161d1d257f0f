"""Calendar and CSV exports, as string columns and text writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import title_case
from docketry.sources.sinks import numbered_names

CRLF = "\r\n"
PRODUCT = "-//Docketry//Commitments//EN"


def escape(value: Column) -> Column:
    """Text as iCalendar wants it: line ends as \\n, then backslash, semicolon and comma escaped."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"\r\n?", "\n")
    for plain, safe in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def event(stamp: str) -> Column:
    """One VEVENT with alarms seven days and one day before; null for rows whose date is no date of four-digit years."""
    date = F.when(F.year("date").between(1, 9999), F.date_format("date", "yyyyMMdd"))
    text = lambda name, other="": F.coalesce(F.col(name).cast("string"), F.lit(other))
    place = F.concat(text("source"), F.when(F.col("page") > 0, F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise(""))
    base = F.regexp_replace(F.concat(F.lit("Found in "), place, F.lit(". "), text("reason")), r"(?U)^\s+|\s+$", "")
    about = F.concat(base, F.when(F.col("notice_days") > 0, F.concat(F.lit(" | Requires "), F.col("notice_days").cast("string"), F.lit("-day notice"))).otherwise(""))
    uid = F.substring(F.sha2(F.coalesce(F.col("id").cast("string"), date).cast("binary"), 256), 1, 24)
    title = escape(text("title", "Commitment"))
    alarm = lambda days, when: ["BEGIN:VALARM", "ACTION:DISPLAY", F.concat(F.lit("DESCRIPTION:"), title, F.lit(f" ({when} reminder)")), f"TRIGGER:-P{days}D", "END:VALARM"]
    lines = ["BEGIN:VEVENT", F.concat(F.lit("UID:"), uid, F.lit("@docketry")), f"DTSTAMP:{stamp}", F.concat(F.lit("DTSTART;VALUE=DATE:"), date), F.concat(F.lit("SUMMARY:"), title), F.concat(F.lit("DESCRIPTION:"), escape(about)), F.concat(F.lit("CATEGORIES:"), escape(title_case(text("category", "action")))), "TRANSP:TRANSPARENT", *alarm(7, "1 week"), *alarm(1, "1 day"), "END:VEVENT"]
    return F.when(date.isNotNull(), F.concat_ws(CRLF, *(F.lit(x) if isinstance(x, str) else x for x in lines)))


def _head(name: Column) -> Column:
    return F.concat(F.lit(CRLF.join(("BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{PRODUCT}", "CALSCALE:GREGORIAN", "X-WR-CALNAME:"))), escape(name), F.lit(CRLF))


FOOT = "END:VCALENDAR" + CRLF


def event_files(commitments: DataFrame, stamp: str) -> DataFrame:
    """(name, block): a calendar of its own for each commitment with a date, named by its title's slug; titles that share one are numbered by date and id."""
    own = commitments.withColumn("_event", event(stamp)).filter("_event is not null")
    block = F.concat(_head(F.coalesce("title", F.lit("Commitment"))), "_event", F.lit(CRLF), F.lit(FOOT))
    # what names and blocks are made of is not carried through the tables that number them
    own = own.select("date", "id", file_slug(F.coalesce("title", F.lit(""))).alias("slug"), block.alias("block"))
    return numbered_names(own, F.col("slug"), ".ics", ["date", "id"]).select(F.col("file").alias("name"), "block")


def document_files(commitments: DataFrame, by: str = "source") -> DataFrame:
    """(name, ord, block): a table for each document (what `by` names), named by its slug: the head line, then its rows by date and id."""
    documents = numbered_names(commitments.select(F.coalesce(by, F.lit("")).alias("_by")).distinct(), file_slug(F.col("_by")), ".csv", ["_by"])
    place = F.struct(F.lit(1).alias("part"), F.col("date"), F.col("id").cast("string").alias("id")).alias("ord")
    rows = csv_rows(commitments, by).select(F.coalesce(by, F.lit("")).alias("_by"), place, F.concat(F.lit(CRLF), "row").alias("block"))
    first = F.struct(F.lit(0).alias("part"), F.lit(None).cast("date").alias("date"), F.lit("").alias("id")).alias("ord")
    heads = documents.select(F.col("file").alias("name"), first, F.lit(CSV_HEAD).alias("block"))
    # a document can have any share of the rows: the join can be split
    return heads.unionByName(rows.join(documents.hint("merge"), "_by").select(F.col("file").alias("name"), "ord", "block"))


def calendar(commitments: DataFrame, name: str, stamp: str) -> DataFrame:
    """(ord, block): head, one block an event in the order of date, foot. Blocks end with CRLF; written in order they are the file."""
    spark = commitments.sparkSession
    ends = spark.createDataFrame([(0, None, ""), (2, None, "")], "ord int, date date, id string")
    ends = ends.withColumn("block", F.when(F.col("ord") == 0, _head(F.lit(name))).otherwise(FOOT))
    events = commitments.withColumn("block", F.concat(event(stamp), F.lit(CRLF))).filter("block is not null").select(F.lit(1).alias("ord"), "date", F.col("id").cast("string").alias("id"), "block")
    return ends.union(events).orderBy("ord", "date", "id").select("ord", "block")


def file_slug(title: Column) -> Column:
    """A title as a file name: small letters and digits, other runs one dash, none at the ends; `docketry-event` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit("")), F.lit("docketry-event"))


# The columns of the export, in their order.
CSV_COLUMNS = {"date": "Date", "category": "Category", "title": "Title", "periodicity": "Periodicity", "notice_days": "Notice Days", "action_date": "Action Date", "summary": "Summary", "source": "Source", "confidence": "Confidence", "reason": "Reason"}
CSV_HEAD, CSV_NUMBERS = ",".join(CSV_COLUMNS.values()), ("notice_days", "confidence")


def csv_rows(commitments: DataFrame, *more: str) -> DataFrame:
    """(id, date, row, and the columns `more`): numbers plain, other fields quoted with quotes doubled; an empty summary falls back to the snippet."""
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    quote = lambda c: F.concat(F.lit('"'), F.replace(plain(c), F.lit('"'), F.lit('""')), F.lit('"'))
    cols = {c: F.coalesce(F.nullif("summary", F.lit("")), "snippet") if c == "summary" else F.col(c) for c in CSV_COLUMNS}
    return commitments.select("id", "date", F.concat_ws(",", *(plain(x) if c in CSV_NUMBERS else quote(x) for c, x in cols.items())).alias("row"), *more)


# The fields of a commitment in machine-readable results, in their order.
FIELDS = ("id", "date", "title", "category", "source", "line", "snippet", "confidence", "reason", "original", "ambiguous", "page", "document_id", "domain", "entity", "periodicity", "summary", "notice_days", "action_date")


def json_rows(commitments: DataFrame, *more: str) -> DataFrame:
    """(id, date, row, and the columns `more`): each commitment as a JSON object with all its fields, nulls too."""
    return commitments.select("id", "date", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("row"), *more)


def _block() -> Column:
    below = F.concat_ws(" · ", "source", "category", F.concat(F.col("confidence").cast("string"), F.lit("%")))
    return F.concat(F.col("date").cast("string"), F.lit("  "), F.col("title"), F.lit("\n" + " " * 12), below, F.lit("\n\n"))


def report_rows(commitments: DataFrame) -> DataFrame:
    """(id, date, block): what a console shows of a commitment: date and title, and below the source, category and confidence, then a blank line."""
    return commitments.select("id", "date", _block().alias("block"))


def report_text(commitments: DataFrame, files_scanned: Column) -> DataFrame:
    """(ord, block): a head that counts commitments and files, then a block each, by date, falling confidence and id. Written in order they are the report."""
    head = F.concat(F.lit("Docketry found "), F.count(F.lit(1)).cast("string"), F.lit(" commitments in "), files_scanned.cast("string"), F.lit(" files.\n\n"))
    first = commitments.agg(head.alias("block")).select(F.lit(0).alias("ord"), F.lit(None).cast("date").alias("date"), F.lit(0).alias("least"), F.lit("").alias("id"), "block")
    rows = commitments.select(F.lit(1), "date", -F.col("confidence"), F.col("id").cast("string"), _block())
    return first.union(rows).orderBy("ord", "date", "least", "id").select("ord", "block")


def csv_text(commitments: DataFrame) -> DataFrame:
    """(ord, block): the head line, then one block a commitment, by date and id. Written in order they are the file: each row begins with CRLF, and none ends it."""
    spark = commitments.sparkSession
    head = spark.createDataFrame([(0, None, "", CSV_HEAD)], "ord int, date date, id string, block string")
    return head.union(csv_rows(commitments).select(F.lit(1), "date", F.col("id").cast("string"), F.concat(F.lit(CRLF), "row"))).orderBy("ord", "date", "id").select("ord", "block")
