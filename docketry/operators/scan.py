"""The whole scan: file policy, relevance, statements, commitments."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.operators import commitments, policy, relevance, results, statements
from docketry.sources.shared import let_go, spill, spread

#: Documents, and bytes of text, that a task looks through for dates or for transactions, about.
TASK_DOCUMENTS, TASK_BYTES = 1 << 15, 1 << 26


class Scan:
    """What a scan of documents gives: commitments, judged, statements, outcomes. Each is worked out when it is first asked for, and what it needs but once.

    kept: the tables that they read.
    """

    def __init__(self, files: DataFrame, today, month_first: bool = False):
        self._files, self._today, self._month_first = files, today, month_first
        self.kept: list[DataFrame] = []

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        out = spill(df, name)
        self.kept.append(out)
        return out

    @cached_property
    def _seen(self) -> DataFrame:
        """Documents that passed the gates or have a warning. Gates stand before costly work: paths first, then emptiness, then relevance; only what passes is parsed."""
        files = self._files
        size = F.coalesce(F.octet_length("content"), F.lit(0))
        skip = F.col("warning") if "warning" in files.columns else F.lit(None).cast("string")
        gated = files.select("path", "content", "modified", policy.file_warning(F.col("path"), size, skip).alias("warning"))
        empty = policy.rejection(F.lit(V.NO_ACTION), F.col("path"), F.lit("empty file"))
        gated = gated.withColumn("warning", F.coalesce("warning", F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, empty)))
        seen = relevance.classify(gated.withColumn("content", F.when(F.col("warning").isNull(), F.col("content"))))
        seen = seen.withColumn("warning", F.coalesce("warning", F.when(~F.col("relevant"), policy.rejection(F.lit(V.IRRELEVANT), F.col("path")))))
        seen = seen.select("path", F.when(F.col("warning").isNull(), F.col("content")).alias("content"), "modified", "warning", "relevance_domain", "bank_score")
        # several branches read the classified documents, the mentions and the summaries: tables cut their plans and survive lost executors
        return self._table(seen, "classified")

    @cached_property
    def _good(self) -> DataFrame:
        return self._seen.filter("warning is null").select("path", "content", "modified", F.col("relevance_domain").alias("domain"))

    @cached_property
    def _docs(self) -> DataFrame:
        return self._good.withColumn("document_id", commitments.document_id(F.col("content")))

    def _dealt(self, df: DataFrame) -> DataFrame:
        """Rows of the table of classified documents, dealt anew: its files are small for the time that their texts take."""
        return spread(df, TASK_DOCUMENTS, F.octet_length("content"), TASK_BYTES)

    @cached_property
    def mentions(self) -> DataFrame:
        """judged for one reader: no table is written, and only the columns that are asked for are worked out."""
        return commitments.extract(self._dealt(self._docs), self._today, self._month_first)

    @cached_property
    def judged(self) -> DataFrame:
        return self._table(self.mentions, "mentions")

    @cached_property
    def _banks(self) -> DataFrame:
        banks = self._seen.filter("warning is null").filter(F.col("bank_score") >= relevance.STATEMENT_SCORE).select(F.col("path").alias("statement_id"), "content")
        return self._table(statements.promising(banks), "banks")

    @cached_property
    def statements(self) -> DataFrame:
        ids = self._docs.select("path", F.col("document_id").alias("id"))
        found = statements.analyze(self._dealt(self._banks), kept=self.kept).withColumnRenamed("statement_id", "path").join(ids, "path")
        return self._table(found.withColumn("title", F.lit(V.STATEMENT_TITLE)), "summaries")

    @cached_property
    def outcomes(self) -> DataFrame:
        """Asked for before commitments or statements, it works out no more of them than it needs."""
        known = vars(self)
        mentions = self.judged if "judged" in known else commitments.verdicts(self._dealt(self._good.select("path", "content", "modified", "domain")), self._today, self._month_first)
        banks = self.statements.select("path") if "statements" in known else statements.with_summary(self._dealt(self._banks)).withColumnRenamed("statement_id", "path")
        return results.document_outcomes(self._seen.select("path", "warning"), mentions, banks)

    @cached_property
    def commitments(self) -> DataFrame:
        return results.ordered(results.deduplicate(self.judged.filter("rejected_as is null").drop("rejected_as")))

    def release(self) -> None:
        """Delete those tables, once the results are written."""
        for df in self.kept:
            let_go(df)


def scan(files: DataFrame, today, month_first: bool = False) -> Scan:
    """files: path, content (cleaned text; null if unreadable), modified, and perhaps warning. Nothing is collected; what several results read is written to tables in the shared folder."""
    return Scan(files, today, month_first)
