"""Queries over papers: documents that reach the gates which notices and letters don't, with their real ids and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.operators.scan import scan
from docketry.plans import views
from docketry.plans.catalog import query
from docketry.plans.views import SHIFT, TODAY


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, modified): a paper for each order: course material, with code or without, an example, a bank statement, an update that is no deadline, a policy, an empty file."""
    k, d = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), SHIFT)
    iso = d.cast("string")
    texts = [
        F.concat(F.lit("A textbook and tutorial: the insurance policy renewal, premium due by "), iso, F.lit(".")),
        F.concat(F.lit("This tutorial does import policy. Health insurance policy renewal, premium due by "), iso, F.lit(".")),
        F.concat(F.lit("Its isbn is known. Insurance policy renewal: premium due by "), iso, F.lit(", policy number "), k.cast("string"), F.lit(".")),
        F.concat(F.lit("For example, the insurance policy renewal of policy number "), k.cast("string"), F.lit(" has its premium due by "), iso, F.lit(".")),
        F.concat(F.lit("Account statement\nAccount number "), k.cast("string"), F.lit("\nOpening balance 20.00\nClosing balance 19.00\nDate | Description | Debit | Credit | Balance\n"), F.date_format(d, "dd/MM/yyyy"), F.lit(" | Payment due | 1.00 | | 19.00\nStatement period, payment due by "), iso, F.lit("\nThe fee is payable by "), F.date_add(d, 30).cast("string")),
        F.concat(F.lit("Insurance policy number "), k.cast("string"), F.lit(": premium last updated August 20, please renew.")),
        F.concat(F.lit("Health insurance policy renewal: premium is due by "), iso, F.lit(". Policy number "), k.cast("string"), F.lit(".")),
    ]
    content = F.lit("")
    for i, t in enumerate(texts):
        content = F.when(k % 8 == i, t).otherwise(content)
    orders = views.spread(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    return orders.select(F.concat(F.lit("papers/p_"), k.cast("string"), F.lit(".eml")).alias("path"), content.alias("content"), F.lit("2026-08-01T09:30:00").alias("modified"))


_PAPERS = f"""papers AS (SELECT key, key % 8 AS kind, 'papers/p_' || key || '.eml' AS path, due, CASE key % 8
    WHEN 0 THEN 'A textbook and tutorial: the insurance policy renewal, premium due by ' || strftime(due, '%Y-%m-%d') || '.'
    WHEN 1 THEN 'This tutorial does import policy. Health insurance policy renewal, premium due by ' || strftime(due, '%Y-%m-%d') || '.'
    WHEN 2 THEN 'Its isbn is known. Insurance policy renewal: premium due by ' || strftime(due, '%Y-%m-%d') || ', policy number ' || key || '.'
    WHEN 3 THEN 'For example, the insurance policy renewal of policy number ' || key || ' has its premium due by ' || strftime(due, '%Y-%m-%d') || '.'
    WHEN 4 THEN 'Account statement Account number ' || key || ' Opening balance 20.00 Closing balance 19.00 Date | Description | Debit | Credit | Balance ' || strftime(due, '%d/%m/%Y') || ' | Payment due | 1.00 | | 19.00 Statement period, payment due by ' || strftime(due, '%Y-%m-%d') || ' The fee is payable by ' || strftime(due + 30, '%Y-%m-%d')
    WHEN 5 THEN 'Insurance policy number ' || key || ': premium last updated August 20, please renew.'
    WHEN 6 THEN 'Health insurance policy renewal: premium is due by ' || strftime(due, '%Y-%m-%d') || '. Policy number ' || key || '.' ELSE '' END AS flat
  FROM (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) + {SHIFT} AS due FROM orders)),
dated AS (SELECT *, 1 AS line, due AS date, strftime(due, '%Y-%m-%d') AS raw, CASE kind WHEN 3 THEN '{V.REFERENCE}' END AS gate FROM papers WHERE kind IN (2, 3, 6)
  UNION ALL SELECT *, 6, due, strftime(due, '%d/%m/%Y'), '{V.HISTORICAL}' FROM papers WHERE kind = 4
  UNION ALL SELECT *, 7, due, strftime(due, '%Y-%m-%d'), '{V.HISTORICAL}' FROM papers WHERE kind = 4
  UNION ALL SELECT *, 8, due + 30, strftime(due + 30, '%Y-%m-%d'), NULL FROM papers WHERE kind = 4
  UNION ALL SELECT *, 1, DATE '2026-08-20', 'August 20', '{V.NO_ACTION}' FROM papers WHERE kind = 5),
mentions AS (SELECT *, substr(sha256(flat), 1, 20) AS document_id, coalesce(gate, CASE WHEN date < DATE '{TODAY}' - 45 THEN '{V.HISTORICAL}' END) AS rejected_as FROM dated)"""


@query(f"""WITH {_PAPERS} SELECT path, CAST(line AS INT) AS line, date, raw AS original, rejected_as, CASE kind WHEN 4 THEN 'banking' ELSE 'insurance' END AS domain, document_id,
  substr(sha256(document_id || ':' || line || ':' || strftime(date, '%Y-%m-%d') || ':' || raw), 1, 12) AS id, CAST(CASE WHEN rejected_as IS NULL THEN CASE WHEN date >= DATE '{TODAY}' THEN 90 ELSE 80 END END AS INT) AS confidence FROM mentions""")
def paper_mentions(spark, sf_dir):
    judged = scan(papers(spark, sf_dir), TODAY).mentions
    return judged.select("path", "line", "date", "original", "rejected_as", "domain", "document_id", "id", F.when(F.col("rejected_as").isNull(), F.col("confidence")).alias("confidence"))


@query(f"""WITH {_PAPERS}, n AS (SELECT path, count(*) AS candidates, count(*) FILTER (rejected_as IS NULL) AS commitments, count(*) FILTER (rejected_as = '{V.HISTORICAL}') AS historical FROM mentions GROUP BY path)
SELECT path, coalesce(candidates, 0) AS candidates, coalesce(commitments, 0) AS commitments, coalesce(historical, 0) AS historical,
  CASE WHEN kind IN (0, 1) THEN '{V.IRRELEVANT}: ' || path WHEN kind = 7 THEN '{V.NO_ACTION}: ' || path || ': empty file' WHEN commitments = 0 THEN CASE WHEN historical > 0 THEN '{V.HISTORICAL}: ' ELSE '{V.NO_ACTION}: ' END || path END AS warning
FROM papers LEFT JOIN n USING (path)""")
def paper_outcomes(spark, sf_dir):
    return scan(papers(spark, sf_dir), TODAY).outcomes
