"""Bank statements: text tables to transactions, transactions to a reconciled summary.

Rows of a statement keep their order in `ord`. Headers and delimiters are carried down, and neighbouring balances compared, in
chunks of a statement, so that no task holds a long one; all else is expressions on single rows, aggregates that combine
before the shuffle, and ranks that need the first few rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.chunks import carried_down, neighbours
from docketry.functions.dates import statement_date
from docketry.functions.money import currency_of, named_amount, parse_number
from docketry.functions.text import LINE_END, contains_any
from docketry.sources.shared import spill


#: Statements of fewer transactions have no summary.
MIN_ROWS = 2


# ---- single rows

def delimiter_of(line: Column) -> Column:
    """The most frequent of pipe, tab and comma if there are two of it; `spaces` for three or more fields apart by wide gaps; else pipe."""
    pipes, tabs, commas = (F.regexp_count(line, F.lit(p)) for p in (r"\|", "\t", ","))
    most = F.greatest(pipes, tabs, commas)
    wide = F.size(F.split(F.trim(line), r"(?U)\s{2,}")) >= 3
    return F.when(most < 2, F.when(wide, "spaces").otherwise("|")).when(pipes == most, "|").when(tabs == most, "\t").otherwise(",")


def split_row(line: Column, delimiter: Column) -> Column:
    """The cells of a line. Commas inside double quotes do not split; quotes are taken off and doubled ones undone."""
    def unquote(c):
        x = F.regexp_replace(c, "^ +", "")
        return F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)

    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    # looking ahead for pairs of quotes costs the square of a line's length; most lines have none
    commas = F.when(line.contains('"'), F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), unquote)).otherwise(F.transform(F.split(line, ",", -1), lambda c: F.regexp_replace(c, "^ +", "")))
    return (
        F.when(delimiter == ",", commas)
        .when(delimiter == "spaces", F.transform(F.split(F.trim(line), r"(?U)\s{2,}", -1), strip))
        .when(delimiter == "\t", F.transform(F.split(line, "\t", -1), strip))
        .otherwise(F.transform(F.split(line, r"\|", -1), strip))
    )


def header_name(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(cell), "[^a-z0-9/]+", " "))


def header_map(cells: Column) -> Column:
    """map<field, 0-based column>: the first column of each field whose name is one of its aliases."""
    fields = F.create_map(*(x for field, names in V.HEADER_ALIASES.items() for n in names for x in (F.lit(n), F.lit(field))))
    named = F.transform(cells, lambda c: F.coalesce(F.try_element_at(fields, header_name(c)), F.lit("")))
    first = F.array(*(F.struct(F.lit(f).alias("field"), (F.array_position(named, f) - 1).cast("int").alias("i")) for f in V.HEADER_ALIASES))
    return F.map_from_entries(F.filter(first, lambda x: x["i"] >= 0))


def is_header(fields: Column) -> Column:
    has = lambda f: F.map_contains_key(fields, f)
    return has("date") & has("description") & (has("debit") | has("credit") | has("amount"))


def could_be_header(line: Column) -> Column:
    """Whether a line holds the longest word of a date's alias and of a description's: every header does, hardly any other line."""
    low = F.lower(line)
    holds = lambda f: contains_any(low, sorted({max(n.split(), key=len) for n in V.HEADER_ALIASES[f]}))
    return holds("date") & holds("description")


def cell(cells: Column, index: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.try_element_at(cells, (index + 1).cast("int")), r"(?U)^\s+|\s+$", ""), F.lit(""))


def spending_category(description: Column, tx_type: Column) -> Column:
    low, out = F.lower(description), F.lit(V.OTHER_SPENDING)
    for name, words in reversed(V.SPENDING.items()):
        out = F.when(contains_any(low, words), name).otherwise(out)
    return F.when(tx_type == "credit", V.INCOME).otherwise(out)


def payee_key(description: Column) -> Column:
    """What tells payees apart: letters only, without noise words; null if fewer than three characters are left."""
    text = F.regexp_replace(F.lower(description), r"(?U:\b)[0-9]+(?U:\b)|[^a-z ]+", " ")
    text = F.regexp_replace(text, r"\b(?:" + "|".join(V.PAYEE_NOISE) + r")\b", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(text) >= 3, F.substring(text, 1, 60))


_TX = "struct<date:date,description:string,amount:double,tx_type:string,balance:double>"


def _tx(date, description, amount, tx_type, balance=None) -> Column:
    return F.struct(date.alias("date"), description.alias("description"), amount.alias("amount"), tx_type.alias("tx_type"), (F.lit(None) if balance is None else balance).cast("double").alias("balance")).cast(_TX)


def with_column_transaction(rows: DataFrame) -> DataFrame:
    """rows with _tx from _cells and _fields: the transaction of a row under a header, or null.

    The parts are columns of their own, so that each is computed once.
    """
    get = lambda f: cell(F.col("_cells"), F.try_element_at("_fields", F.lit(f)))
    x = rows.withColumns({"_date": statement_date(get("date")), "_text": F.trim(F.substring(get("description"), 1, 100)), "_debit": parse_number(get("debit")), "_credit": parse_number(get("credit")), "_amount": parse_number(get("amount")), "_kind": F.lower(get("type")), "_balance": parse_number(get("balance"))})
    debit, credit, amount, kind = F.col("_debit"), F.col("_credit"), F.col("_amount"), F.col("_kind")
    only_credit, only_debit = credit.isNotNull() & debit.isNull(), debit.isNotNull() & credit.isNull()
    tx_type = (
        F.when(only_credit, "credit")
        .when(only_debit, "debit")
        .when((amount < 0) | (amount.isNotNull() & kind.rlike(r"\b(?:dr|debit|withdrawal)\b")), "debit")
        .when(amount.isNotNull() & kind.rlike(r"\b(?:cr|credit|deposit)\b"), "credit")
    )
    x = x.withColumns({"_type": tx_type, "_value": F.when(only_credit, credit).when(only_debit, debit).otherwise(F.abs(amount))})
    good = F.col("_date").isNotNull() & (F.col("_text") != "") & F.col("_type").isNotNull() & (F.col("_value") > 0)
    out = x.withColumn("_tx", F.when(good, _tx(F.col("_date"), F.col("_text"), F.col("_value"), F.col("_type"), F.col("_balance"))))
    return out.drop("_date", "_text", "_debit", "_credit", "_amount", "_kind", "_balance", "_type", "_value")


def with_flagged_transaction(rows: DataFrame) -> DataFrame:
    """rows with _tx from _cells: the transaction of a row without a header, a date first, then an amount with CR or DR in its cell or in one of its own."""
    x = rows.withColumns({"_date": statement_date(F.try_element_at("_cells", F.lit(1))), "_rest": F.transform(F.slice("_cells", 2, 1 << 20), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))})
    x = x.withColumns({"_both": F.try_element_at(F.filter("_rest", lambda r: r["c"].rlike(V.FLAGGED)), F.lit(1)), "_flag": F.try_element_at(F.filter("_rest", lambda r: F.trim(r["c"]).rlike(V.FLAG)), F.lit(1))})
    numbers = F.filter(F.transform("_rest", lambda r: F.struct(F.abs(r["i"] - F.col("_flag.i")).alias("away"), r["i"].alias("i"), parse_number(r["c"]).alias("v"))), lambda r: r["v"].isNotNull())
    x = x.withColumns({"_near": F.array_min(numbers), "_amount": parse_number(F.regexp_extract("_both.c", V.FLAGGED, 1))})
    kind = lambda t: F.when(F.lower(F.trim(t)).isin("cr", "credit"), "credit").otherwise("debit")
    skip = lambda i: F.when(F.col("_both").isNotNull(), i == F.col("_both.i")).otherwise((i == F.col("_flag.i")) | (i == F.col("_near.i")))
    text = F.substring(F.trim(F.array_join(F.transform(F.filter("_rest", lambda r: ~skip(r["i"])), lambda r: r["c"]), " ")), 1, 100)
    x = x.withColumn("_text", F.coalesce(F.nullif(text, F.lit("")), F.lit("Transaction")))
    first = F.when(F.col("_amount").isNotNull(), _tx(F.col("_date"), F.col("_text"), F.abs("_amount"), kind(F.regexp_extract("_both.c", V.FLAGGED, 2))))
    second = F.when(F.col("_flag").isNotNull() & F.col("_near").isNotNull(), _tx(F.col("_date"), F.col("_text"), F.abs("_near.v"), kind(F.col("_flag.c"))))
    good = (F.size("_cells") >= 3) & F.col("_date").isNotNull()
    return x.withColumn("_tx", F.when(good, F.when(F.col("_both").isNotNull(), first).otherwise(second))).drop("_date", "_rest", "_both", "_flag", "_near", "_amount", "_text")


# ---- tables

def rows_of(statements: DataFrame) -> DataFrame:
    """(statement_id, ord, line): lines with something in them, page marks left out, from (statement_id, content)."""
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), LINE_END), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return statements.select("statement_id", F.posexplode(lines).alias("ord", "line")).filter((F.col("line") != "") & ~F.col("line").startswith("[[PAGE:"))


def parse_rows(rows: DataFrame) -> DataFrame:
    """rows but headers, with tx (null for other lines) and rejected (rows under a header that look like transactions but aren't)."""
    own = rows.withColumn("_delimiter", delimiter_of(F.col("line")))
    own = own.withColumn("_cells", split_row(F.col("line"), F.col("_delimiter")))
    own = own.withColumn("_fields", F.when(could_be_header(F.col("line")), header_map(F.col("_cells")))).withColumn("_is_header", F.coalesce(is_header(F.col("_fields")), F.lit(False)))
    own = carried_down(own, F.when(F.col("_is_header"), F.struct("_fields", "_delimiter")), "_header", "statement_id").filter(~F.col("_is_header"))
    base = own.select("statement_id", "ord", "line", "_cells", F.col("_header._fields").alias("_fields"), F.col("_header._delimiter").alias("_delimiter"), F.try_element_at("_cells", F.lit(1)).alias("_first"))
    under = with_column_transaction(base.filter("_fields is not null").withColumn("_cells", split_row(F.col("line"), F.col("_delimiter"))))
    free = with_flagged_transaction(base.filter("_fields is null"))
    both = under.unionByName(free)
    looks = F.col("_fields").isNotNull() & F.col("_tx").isNull() & statement_date(F.col("_first")).isNotNull()
    return both.select("statement_id", "ord", "line", F.col("_tx").alias("tx"), looks.alias("rejected"))


def distinct_transactions(parsed: DataFrame) -> DataFrame:
    """(statement_id, ord, date, description, amount, tx_type, category, balance): the first of equal transactions."""
    tx = parsed.filter(F.col("tx").isNotNull()).select("statement_id", "ord", "tx.*")
    key = F.regexp_replace(F.lower("description"), r"(?U)\s+", " ").alias("_key")
    first = tx.groupBy("statement_id", "date", key, "amount", "tx_type").agg(F.min(F.struct("ord", "description", "balance")).alias("x"))
    kept = first.select("statement_id", "x.ord", "date", "x.description", "amount", "tx_type", "x.balance")
    return kept.withColumn("category", spending_category(F.col("description"), F.col("tx_type")))


# ---- summaries of (statement_id, ord, date, description, amount, tx_type, category, balance)

def exact_sum(amount: Column) -> Column:
    """The sum without the last digits' noise, which depends on the order of rows and would tip a tie when the sum is rounded further."""
    return F.round(F.sum(amount), 6)


def category_totals(tx: DataFrame) -> DataFrame:
    """(statement_id, category, amount, percentage, count) of spending."""
    debits = tx.filter("tx_type = 'debit'").groupBy("statement_id", "category").agg(exact_sum(F.col("amount")).alias("raw"), F.count(F.lit(1)).alias("count"))
    total = F.sum("raw").over(Window.partitionBy("statement_id"))
    return debits.select("statement_id", "category", F.round("raw", 2).alias("amount"), F.when(total != 0, F.round(F.col("raw") / total * 100, 1)).otherwise(0.0).alias("percentage"), "count")


def top_expenses(tx: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("statement_id").orderBy(F.desc("amount"), "ord")
    ranked = tx.filter("tx_type = 'debit'").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("statement_id", "rank", "date", "description", F.round("amount", 2).alias("amount"), "category")


def largest_credit(tx: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("date", "description", F.round("amount", 2).alias("amount")), F.struct("amount", -F.col("ord")))
    return tx.filter("tx_type = 'credit'").groupBy("statement_id").agg(best.alias("x")).select("statement_id", "x.*")


def recurring_payments(tx: DataFrame, n: int = 5) -> DataFrame:
    keyed = tx.filter("tx_type = 'debit'").withColumns({"key": payee_key(F.col("description")), "cents": F.round("amount", 2)}).filter("key is not null")
    groups = keyed.groupBy("statement_id", "key", "cents").agg(F.count(F.lit(1)).alias("count"), F.min_by("description", "ord").alias("description"), F.min("ord").alias("first")).filter("count >= 2")
    rank = F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc(F.col("cents") * F.col("count")), "first"))
    return groups.withColumn("rank", rank).filter(F.col("rank") <= n).select("statement_id", "rank", "description", F.col("cents").alias("amount"), "count")


def balance_pairs(tx: DataFrame) -> DataFrame:
    """(statement_id, checked, balanced): neighbouring transactions whose balances follow from each other. A missing balance breaks the chain."""
    signed = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    follows = F.abs(F.col("_before") + signed - F.col("balance")) <= 0.02
    return neighbours(tx.select("statement_id", "ord", "amount", "tx_type", "balance"), F.col("balance"), follows, "statement_id").withColumnRenamed("agreed", "balanced")


def summarize(tx: DataFrame, named: DataFrame | None = None, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row a statement: totals, dates, balances and their verification.

    named: (statement_id, opening, closing, currency) from the text, if there is text. Balances not named are derived from the first and last
    transaction that has one. Statements of fewer than min_rows transactions have no summary.
    """
    credit, debit, signed = (F.when(F.col("tx_type") == k, F.col("amount")) for k in ("credit", "debit", "credit"))
    signed = F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    known = F.col("balance").isNotNull()
    totals = tx.groupBy("statement_id").agg(
        F.min("date").alias("statement_start"), F.max("date").alias("statement_end"),
        F.coalesce(exact_sum(credit), F.lit(0.0)).alias("income"), F.coalesce(exact_sum(debit), F.lit(0.0)).alias("expense"),
        F.count(F.lit(1)).alias("transaction_count"), F.count(credit).alias("credit_count"), F.count(debit).alias("debit_count"),
        F.min_by(F.col("balance") - signed, F.when(known, F.col("ord"))).alias("first"), F.max_by("balance", F.when(known, F.col("ord"))).alias("last"),
    ).filter(F.col("transaction_count") >= min_rows)
    all_ = totals.join(balance_pairs(tx), "statement_id")
    if named is not None:
        all_ = all_.join(named.select("statement_id", F.col("opening").alias("_opening"), F.col("closing").alias("_closing"), F.col("currency").alias("_currency")), "statement_id", "left")
    else:
        all_ = all_.withColumns({"_opening": F.lit(None).cast("double"), "_closing": F.lit(None).cast("double"), "_currency": F.lit("$")})
    opening, closing = F.coalesce("_opening", "first"), F.coalesce("_closing", "last")
    both = opening.isNotNull() & closing.isNotNull()
    verdict = (
        F.when(both & (F.abs(opening + F.col("income") - F.col("expense") - closing) <= 0.05), "verified")
        .when(F.col("checked") == 0, F.when(both, "discrepancy").otherwise("unverifiable"))
        .when(F.col("balanced") / F.col("checked") >= 0.8, "verified")
        .otherwise("discrepancy")
    )
    return all_.select(
        "statement_id", "statement_start", "statement_end", F.round(opening, 2).alias("opening_balance"), F.round(closing, 2).alias("closing_balance"), F.round(closing - opening, 2).alias("balance_change"),
        F.round("income", 2).alias("total_income"), F.round("expense", 2).alias("total_expense"), F.round(F.col("income") - F.col("expense"), 2).alias("net_cashflow"),
        "transaction_count", "credit_count", "debit_count", F.when(F.col("debit_count") > 0, F.round(F.col("expense") / F.col("debit_count"), 2)).otherwise(0.0).alias("average_expense"),
        F.col("_currency").alias("currency"), verdict.alias("verification"),
    )


def with_summary(statements: DataFrame) -> DataFrame:
    """statement_id of those of (statement_id, content) that analyze() gives a summary."""
    own = distinct_transactions(parse_rows(rows_of(statements))).groupBy("statement_id").agg(F.count(F.lit(1)).alias("n"))
    return own.filter(F.col("n") >= MIN_ROWS).select("statement_id")


def promising(statements: DataFrame) -> DataFrame:
    """Those of (statement_id, content) that have as many lines with a cell that may be a date as a summary takes transactions: a look at
    each line, in front of the tables that parsing takes."""
    n = F.size(F.filter(F.split(F.coalesce("content", F.lit("")), LINE_END), lambda x: x.rlike(V.DATED_CELL)))
    own = statements.groupBy("statement_id").agg(F.sum(n).alias("n")).filter(F.col("n") >= MIN_ROWS)
    return statements.join(own.select("statement_id"), "statement_id", "left_semi")


def named_balances(statements: DataFrame, default_currency: str = "$") -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    return statements.select("statement_id", named_amount(text, "opening balance").alias("opening"), named_amount(text, "closing balance").alias("closing"), currency_of(text, default_currency).alias("currency"))


def analyze(statements: DataFrame, default_currency: str = "$", kept: list[DataFrame] | None = None) -> DataFrame:
    """Summaries of (statement_id, content), with rows_rejected and the lists of categories, top expenses, recurring payments and the largest credit."""
    return analyze_rows(rows_of(statements), named_balances(statements, default_currency), kept)


def analyze_rows(rows: DataFrame, named: DataFrame, kept: list[DataFrame] | None = None) -> DataFrame:
    """The same of lines that are rows already (statement_id, ord, line), whatever a statement's length; named: as named_balances gives it.
    The tables that it needs are added to kept, for the caller to let go of."""
    # eight aggregates read the transactions: a table cuts their plans, which would each hold the parsing
    parsed = spill(parse_rows(rows), "statement-rows")
    tx = spill(distinct_transactions(parsed), "transactions")
    if kept is not None:
        kept += [parsed, tx]
    rejected = parsed.groupBy("statement_id").agg(F.count_if("rejected").alias("rows_rejected"))
    out = summarize(tx, named).join(rejected, "statement_id")
    cats = category_totals(tx).join(tx.filter("tx_type = 'debit'").groupBy("statement_id", "category").agg(F.min("ord").alias("_first")), ["statement_id", "category"])
    lists = (
        (cats, "categories", [(-F.col("amount")).alias("k"), F.col("_first").alias("o")], ["category", "amount", "percentage", "count"]),
        (top_expenses(tx), "top_expenses", ["rank"], ["date", "description", "amount", "category"]),
        (recurring_payments(tx), "recurring_payments", ["rank"], ["description", "amount", "count"]),
    )
    for df, name, order, cols in lists:
        packed = df.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*cols).alias("x")))).alias("_l")).select("statement_id", F.transform("_l", lambda y: y["x"]).alias(name))
        out = out.join(packed, "statement_id", "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
    credit = largest_credit(tx).select("statement_id", F.struct("date", "description", "amount").alias("largest_credit"))
    return out.join(credit, "statement_id", "left")
