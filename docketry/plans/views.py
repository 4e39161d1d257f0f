"""Text and ledger views over the given tables: what the engine works on where a folder of files is not at hand.

Each view is stated twice, for Spark and as SQL for the counterpart queries; both derive it row by row from whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.chunks import running_total
from docketry.sources import shared

TODAY = "2026-08-13"
#: Days by which order dates are moved: 27 years.
SHIFT = 9862


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task works on, about, where a view makes a text of each: their files are small for the time that they take.
TASK_ROWS = 1 << 16


def spread(df: DataFrame) -> DataFrame:
    """df over all cores and in tasks of a bounded number of rows, however few files, splits or row groups it lies in."""
    return shared.spread(df, TASK_ROWS)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, kind, due, content, modified, document_id, domain): a short notice for each order, in eight wordings."""
    d = F.date_add(F.to_date("o_orderdate"), SHIFT)
    texts = [
        F.concat(F.lit("Your payment is due by "), d.cast("string"), F.lit(".")),
        F.concat(F.lit("The subscription renews on "), F.date_format(d, "MMMM d, yyyy"), F.lit(".")),
        F.concat(F.lit("Cancel the membership by "), F.date_format(d, "d/M/yyyy"), F.lit(".")),
        F.concat(F.lit("Please respond within "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" business days.")),
        F.concat(F.lit("Statement date: "), d.cast("string"), F.lit(".")),
        F.concat(F.lit("Unpaid and overdue premium from "), F.date_format(d, "d MMM yyyy"), F.lit(".")),
        F.concat(F.lit("Annual contract expires "), d.cast("string"), F.lit("; at least 30 days notice required.")),
        F.concat(F.lit("Coverage period from "), d.cast("string"), F.lit(" to "), F.date_add(d, 364).cast("string"), F.lit(" expires.")),
    ]
    kind = F.col("o_orderkey") % 8
    content = texts[-1]
    for i, t in reversed(list(enumerate(texts[:-1]))):
        content = F.when(kind == i, t).otherwise(content)
    path = F.concat(F.lit("box"), (F.col("o_custkey") % 50).cast("string"), F.lit("/order_"), F.col("o_orderkey").cast("string"), F.lit(".eml"))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    return orders.select(
        path.alias("path"), kind.alias("kind"), d.alias("due"), content.alias("content"), F.concat(d.cast("string"), F.lit("T09:30:00")).alias("modified"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("document_id"), F.lit(None).cast("string").alias("domain"), F.col("o_orderkey").alias("key"),
    )


NOTICES = f"""notices AS (
  SELECT 'box' || (o_custkey % 50) || '/order_' || o_orderkey || '.eml' AS path, o_orderkey % 8 AS kind, due, o_orderkey AS key, 'c' || o_custkey AS document_id,
    CASE o_orderkey % 8
      WHEN 0 THEN 'Your payment is due by ' || strftime(due, '%Y-%m-%d') || '.'
      WHEN 1 THEN 'The subscription renews on ' || strftime(due, '%B %-d, %Y') || '.'
      WHEN 2 THEN 'Cancel the membership by ' || strftime(due, '%-d/%-m/%Y') || '.'
      WHEN 3 THEN 'Please respond within ' || (o_orderkey % 9 + 1) || ' business days.'
      WHEN 4 THEN 'Statement date: ' || strftime(due, '%Y-%m-%d') || '.'
      WHEN 5 THEN 'Unpaid and overdue premium from ' || strftime(due, '%-d %b %Y') || '.'
      WHEN 6 THEN 'Annual contract expires ' || strftime(due, '%Y-%m-%d') || '; at least 30 days notice required.'
      ELSE 'Coverage period from ' || strftime(due, '%Y-%m-%d') || ' to ' || strftime(due + 364, '%Y-%m-%d') || ' expires.' END AS content
  FROM (SELECT *, CAST(o_orderdate AS DATE) + {SHIFT} AS due FROM orders))"""


def _event(cases: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in cases.items():
        out = F.when(F.col("event_type") == k, F.lit(v)).otherwise(out)
    return out


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement_id, ord, date, description, amount, tx_type, balance): a bank statement for each user of events."""
    cents = (F.floor(F.abs(F.coalesce("value", F.lit(0.0))) * 10) * 10 + F.col("event_id") % 10 + 1).cast("long")
    tx_type = F.when(F.col("event_type").isin("signup", "view"), "credit").otherwise("debit")
    text = F.concat(_event({"purchase": "Amazon order", "error": "Late rent", "click": "Uber trip", "view": "Salary ACME"}, "Interest credit"), F.lit(" "), (F.col("event_id") % 4).cast("string"))
    own = table(spark, sf_dir, "events").filter("user_id is not null").select(F.col("user_id").alias("statement_id"), F.col("event_id").alias("ord"), F.to_date("ts").alias("date"), text.alias("description"), cents.alias("cents"), tx_type.alias("tx_type"))
    own = running_total(own, F.when(F.col("tx_type") == "credit", F.col("cents")).otherwise(-F.col("cents")), "total", "statement_id")
    # one row in eleven has no balance, one in seven a wrong one
    shown = F.when(F.col("ord") % 11 == 0, None).otherwise((100_000 + F.col("total") + F.when(F.col("ord") % 7 == 0, 500).otherwise(0)) / 100)
    return own.select("statement_id", "ord", "date", "description", (F.col("cents") / 100).alias("amount"), "tx_type", shown.cast("double").alias("balance"))


LEDGER = """ledger AS (
  SELECT statement_id, ord, date, description, cents / 100 AS amount, tx_type,
    CASE WHEN ord % 11 = 0 THEN NULL ELSE (100000 + sum(CASE WHEN tx_type = 'credit' THEN cents ELSE -cents END) OVER (PARTITION BY statement_id ORDER BY ord ROWS UNBOUNDED PRECEDING) + CASE WHEN ord % 7 = 0 THEN 500 ELSE 0 END)::DOUBLE / 100 END AS balance
  FROM (SELECT user_id AS statement_id, event_id AS ord, CAST(ts AS DATE) AS date,
      CASE event_type WHEN 'purchase' THEN 'Amazon order' WHEN 'error' THEN 'Late rent' WHEN 'click' THEN 'Uber trip' WHEN 'view' THEN 'Salary ACME' ELSE 'Interest credit' END || ' ' || (event_id % 4) AS description,
      CAST(floor(abs(coalesce(value, 0.0)) * 10) * 10 + event_id % 10 + 1 AS BIGINT) AS cents,
      CASE WHEN event_type IN ('signup', 'view') THEN 'credit' ELSE 'debit' END AS tx_type
    FROM events WHERE user_id IS NOT NULL))"""


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement_id, ord, line): each ledger as a text table with a header, commas or pipes by statement, and a bad row after each 50th.

    Lines stay rows, so that a statement may have a third of them all. The head has negative places.
    """
    pipe = F.col("statement_id") % 2 == 0
    sep = F.when(pipe, " | ").otherwise(",")
    number = F.format_string("%.2f", "amount")
    day = F.date_format("date", "dd/MM/yyyy")
    line = F.concat_ws("", day, sep, "description", sep, F.when(F.col("tx_type") == "debit", number).otherwise(""), sep, F.when(F.col("tx_type") == "credit", number).otherwise(""), sep, F.coalesce(F.format_string("%.2f", "balance"), F.lit("")))
    bad = F.when(F.col("ord") % 50 == 0, F.concat(day, sep, F.lit("broken row"), sep, sep, sep))
    own = ledger(spark, sf_dir)
    rows = own.select("statement_id", F.explode(F.filter(F.array(F.struct((F.col("ord") * 2).alias("ord"), line.alias("line")), F.struct((F.col("ord") * 2 + 1).alias("ord"), bad.alias("line"))), lambda x: x["line"].isNotNull())).alias("x")).select("statement_id", "x.*")
    names = F.when(pipe, "Txn Date | Narration | Withdrawal Amt | Deposit Amt | Balance").otherwise("Date,Description,Debit,Credit,Running Balance")
    head = own.select("statement_id").distinct().select("statement_id", F.posexplode(F.array(F.lit("Account statement"), F.lit("USD"), names)).alias("n", "line"))
    return head.select("statement_id", (F.col("n") - 3).cast("long").alias("ord"), "line").unionByName(rows.withColumn("ord", F.col("ord").cast("long")))


def statement_heads(spark: SparkSession, sf_dir: str, lines: int = 700) -> DataFrame:
    """(statement_id, content): the first lines of each statement, more than the relevance sample's words; a line has two at least."""
    first = Window.partitionBy("statement_id").orderBy("ord")
    few = statement_lines(spark, sf_dir).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= lines)
    packed = few.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return packed.select("statement_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, path, due, content, modified, document_id, domain): a letter of several lines and pages for each order; one in forty has a very long line."""
    d = F.date_add(F.to_date("o_orderdate"), SHIFT)
    k = F.col("o_orderkey")
    long_ = F.concat(F.lit("\n"), F.repeat(F.lit("Please note that this holds for all. "), 80), F.lit("The fee is due by "), F.date_add(d, 9).cast("string"), F.lit("! Thank you."))
    content = F.concat(
        F.lit("Subject: Order "), k.cast("string"), F.lit("\n[[PAGE:1]]\n  Dear   customer,\n\nYour policy  expires on "), d.cast("string"), F.lit(".\n[[PAGE:"), (k % 7 + 2).cast("string"),
        F.lit("]]\nReference A\nPlease renew before "), F.date_format(d, "MMMM d, yyyy"), F.lit(" or by "), F.date_format(F.date_add(d, 30), "d MMM yyyy"), F.lit(".\nThank you."), F.when(k % 40 == 0, long_).otherwise(""),
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    return orders.select(k.alias("key"), F.concat(F.lit("letter_"), k.cast("string"), F.lit(".eml")).alias("path"), d.alias("due"), content.alias("content"), F.concat(d.cast("string"), F.lit("T09:30:00")).alias("modified"), k.cast("string").alias("document_id"), F.lit(None).cast("string").alias("domain"))


LETTERS = f"""letters AS (
  SELECT key, due, 'Subject: Order ' || key || chr(10) || '[[PAGE:1]]' || chr(10) || '  Dear   customer,' || chr(10) || chr(10) || 'Your policy  expires on ' || strftime(due, '%Y-%m-%d') || '.' || chr(10) || '[[PAGE:' || (key % 7 + 2)
    || ']]' || chr(10) || 'Reference A' || chr(10) || 'Please renew before ' || strftime(due, '%B %-d, %Y') || ' or by ' || strftime(due + 30, '%-d %b %Y') || '.' || chr(10) || 'Thank you.'
    || CASE WHEN key % 40 = 0 THEN chr(10) || repeat('Please note that this holds for all. ', 80) || 'The fee is due by ' || strftime(due + 9, '%Y-%m-%d') || '! Thank you.' ELSE '' END AS content
  FROM (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) + {SHIFT} AS due FROM orders))"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, anchor, content): a phrase for each order that names a date in one of ten further ways, and the day on which it was written."""
    d = F.date_add(F.to_date("o_orderdate"), SHIFT)
    anchor = F.date_add(d, (F.col("o_custkey") % 400).cast("int"))
    n = (F.col("o_orderkey") % 23 + 1).cast("string")
    texts = [
        F.concat(F.lit("Renew by "), F.date_format(d, "MMMM d"), F.lit(", please.")), F.lit("It is due Today"), F.lit("The visit is tomorrow."), F.concat(F.lit("Reply in "), n, F.lit(" weeks.")),
        F.concat(F.lit("Valid within "), n, F.lit(" months")), F.concat(F.lit("Payment due in "), n, F.lit(" days.")), F.concat(F.lit("Read "), F.date_format(d, "M/d/yyyy"), F.lit(" there.")),
        F.concat(F.lit("On the "), F.date_format(d, "d"), F.lit("th of "), F.date_format(d, "MMMM yyyy"), F.lit(" or "), d.cast("string")), F.lit("Never on 2027-02-30, nor 13/13/2027."), F.concat(F.lit("From "), F.date_format(d, "yyyy.MM.dd"), F.lit(" and "), F.date_format(d, "yyyy/MM/dd")),
    ]
    content = texts[-1]
    for i, t in reversed(list(enumerate(texts[:-1]))):
        content = F.when(F.col("o_orderkey") % 10 == i, t).otherwise(content)
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(F.col("o_orderkey").alias("key"), anchor.alias("anchor"), content.alias("content"))


PHRASES = f"""phrases AS (
  SELECT key, kind, anchor, due, n, (['Renew by ' || strftime(due, '%B %-d') || ', please.', 'It is due Today', 'The visit is tomorrow.', 'Reply in ' || n || ' weeks.', 'Valid within ' || n || ' months', 'Payment due in ' || n || ' days.',
    'Read ' || strftime(due, '%-m/%-d/%Y') || ' there.', 'On the ' || day(due) || 'th of ' || strftime(due, '%B %Y') || ' or ' || strftime(due, '%Y-%m-%d'), 'Never on 2027-02-30, nor 13/13/2027.', 'From ' || strftime(due, '%Y.%m.%d') || ' and ' || strftime(due, '%Y/%m/%d')])[kind + 1] AS content
  FROM (SELECT o_orderkey AS key, o_orderkey % 10 AS kind, CAST(o_orderdate AS DATE) + {SHIFT} AS due, CAST(o_orderdate AS DATE) + {SHIFT} + CAST(o_custkey % 400 AS INT) AS anchor, CAST(o_orderkey % 23 + 1 AS INT) AS n FROM orders))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size, fingerprint): a listing of documents as files of many kinds in many folders."""
    i = F.col("doc_id")
    folder = F.when(i % 13 == 0, "venv").when(i % 17 == 0, ".git").when(i % 19 == 0, "Build").otherwise(F.coalesce("source", F.lit("")))
    kind = F.element_at(F.array(*(F.lit(x) for x in (".pdf", ".txt", ".EML", ".csv", ".xlsx", "", ".png", ".zip"))), (i % 8 + 1).cast("int"))
    name = F.concat(F.when(i % 23 == 0, ".").otherwise(""), F.lit("doc_"), i.cast("string"), kind)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("home/"), folder, F.lit("/"), name).alias("path"), F.col("n_chars").alias("size"), F.when(i % 29 == 0, "").otherwise(F.concat(i.cast("string"), F.lit(":"), F.col("n_chars").cast("string"))).alias("fingerprint"))


MANIFEST = """manifest AS (
  SELECT doc_id, 'home/' || CASE WHEN doc_id % 13 = 0 THEN 'venv' WHEN doc_id % 17 = 0 THEN '.git' WHEN doc_id % 19 = 0 THEN 'Build' ELSE coalesce(source, '') END || '/'
      || CASE WHEN doc_id % 23 = 0 THEN '.' ELSE '' END || 'doc_' || doc_id || (['.pdf', '.txt', '.EML', '.csv', '.xlsx', '', '.png', '.zip'])[doc_id % 8 + 1] AS path,
    n_chars AS size, CASE WHEN doc_id % 29 = 0 THEN '' ELSE doc_id || ':' || n_chars END AS fingerprint
  FROM documents)"""
