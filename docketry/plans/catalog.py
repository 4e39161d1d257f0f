"""The registered queries over whole tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import dates, money, terms, text
from docketry.functions import fixed_values as V
from docketry.operators import commitments, exports, horizon, policy, relevance, results, statements
from docketry.operators.scan import scan
from docketry.plans import views
from docketry.plans.views import LEDGER, LETTERS, MANIFEST, NOTICES, PHRASES, TODAY
from docketry.sources.shared import spill
from docketry.streaming.sessions import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- files and text

@query(f"""WITH {MANIFEST}, parts AS (SELECT *, string_split(path, '/') AS p FROM manifest)
SELECT doc_id, regexp_matches(lower(p[len(p)]), '.\\.(pdf|docx|pages|eml|msg|csv|xlsx|png|jpg|jpeg|webp|tiff)$') AS supported,
  CASE WHEN list_bool_or([x LIKE '.%' OR lower(x) IN ({", ".join(repr(x) for x in V.IGNORED_DIRECTORIES)}) FOR x IN p[1:len(p) - 1]]) OR p[len(p)] LIKE '.%' THEN 'ignored_directory' END AS ignored
FROM parts""")
def path_policy(spark, sf_dir):
    m = views.manifest(spark, sf_dir)
    return m.select("doc_id", policy.is_supported(F.col("path")).alias("supported"), policy.ignored_reason(F.col("path")).alias("ignored"))


@query("""SELECT page_id, length(c) AS n_chars, sha256(c) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS c FROM pages)""")
def text_clean(spark, sf_dir):
    c = text.clean(F.col("html"))
    return views.table(spark, sf_dir, "pages").select("page_id", F.length(c).cast("long").alias("n_chars"), F.sha2(c.cast("binary"), 256).alias("digest"))


@query("""SELECT doc_id, len(l) AS n_lines, len([x FOR x IN l IF trim(x, ' ') <> '']) AS n_full, list_max([length(x) FOR x IN l]) AS longest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def text_lines(spark, sf_dir):
    lines = F.split("text", text.LINE_END, -1)
    return views.table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_full"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest"))


@query("SELECT conv_id, turn, length(s) AS n, sha256(s) AS digest FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations)")
def text_squeeze(spark, sf_dir):
    s = text.squeeze(F.col("text"))
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(s).cast("long").alias("n"), F.sha2(s.cast("binary"), 256).alias("digest"))


# ---- dates

def _mentions(spark, sf_dir, *kinds):
    n = views.notices(spark, sf_dir)
    hits = dates.find_dates(F.col("content"), dates.anchor_of(F.col("modified"), F.lit(TODAY).cast("date")))
    out = n.select("key", F.explode(hits).alias("h"))
    return out.filter(F.col("h.prio").isin(*kinds)).select("key", F.col("h.value").alias("value"), F.col("h.raw").alias("raw"), F.col("h.start").cast("long").alias("start"), F.col("h.quality").alias("quality"))


@query(f"""WITH {NOTICES}, found AS (SELECT key, content, unnest(regexp_extract_all(content, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}')) AS raw FROM notices)
SELECT key, CAST(raw AS DATE) AS value, raw, CAST(strpos(content, raw) - 1 AS BIGINT) AS start, CAST(0.95 AS DOUBLE) AS quality FROM found""")
def iso_dates(spark, sf_dir):
    return _mentions(spark, sf_dir, 0)


@query(f"""WITH {NOTICES}, found AS (SELECT key, content, regexp_extract(content, '[A-Z][a-z]+ [0-9]+, 20[0-9]{{2}}') AS a, regexp_extract(content, '[0-9]+ [A-Z][a-z]{{2}} 20[0-9]{{2}}') AS b FROM notices)
SELECT key, CAST(CASE WHEN a <> '' THEN strptime(a, '%B %-d, %Y') ELSE strptime(b, '%-d %b %Y') END AS DATE) AS value, a || b AS raw, CAST(strpos(content, a || b) - 1 AS BIGINT) AS start, CAST(0.92 AS DOUBLE) AS quality FROM found WHERE a || b <> ''""")
def named_dates(spark, sf_dir):
    return _mentions(spark, sf_dir, 1, 2)


@query(f"""WITH {NOTICES}, found AS (SELECT key, content, regexp_extract(content, '[0-9]{{1,2}}/[0-9]{{1,2}}/20[0-9]{{2}}') AS raw FROM notices)
SELECT key, CAST(strptime(raw, '%-d/%-m/%Y') AS DATE) AS value, raw, CAST(strpos(content, raw) - 1 AS BIGINT) AS start,
  CAST(CASE WHEN CAST(split_part(raw, '/', 1) AS INT) <= 12 THEN 0.78 ELSE 0.86 END AS DOUBLE) AS quality FROM found WHERE raw <> ''""")
def numeric_dates(spark, sf_dir):
    return _mentions(spark, sf_dir, 3)


@query(f"""WITH {NOTICES}, found AS (SELECT key, content, due, regexp_extract(content, 'within [0-9]+ business days') AS raw FROM notices),
days AS (SELECT key, raw, content, CAST(split_part(raw, ' ', 2) AS INT) AS n, due, unnest(range(1, 20)) AS i FROM found WHERE raw <> ''),
work AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS k FROM days WHERE isodow(due + CAST(i AS INT)) < 6)
SELECT key, due + CAST(i AS INT) AS value, raw, CAST(strpos(content, raw) - 1 AS BIGINT) AS start, CAST(0.66 AS DOUBLE) AS quality FROM work WHERE k = n""")
def relative_dates(spark, sf_dir):
    return _mentions(spark, sf_dir, 4)


@query("""WITH b AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 24 AS INT) AS n FROM orders),
w AS (SELECT key, n, d, unnest(range(0, 40)) AS i FROM b), k AS (SELECT key, n, d + CAST(i AS INT) AS x, sum(CASE WHEN i > 0 AND isodow(d + CAST(i AS INT)) < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS c, i FROM w)
SELECT b.key, (SELECT min(x) FROM k WHERE k.key = b.key AND k.c = b.n) AS business, CAST(b.d + to_months(b.n) AS DATE) AS months FROM b""")
def date_arithmetic(spark, sf_dir):
    n = (F.col("o_orderkey") % 24).cast("int")
    d = F.to_date("o_orderdate")
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), dates.add_business_days(d, n).alias("business"), F.add_months(d, n).alias("months"))


@query("""WITH b AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS a, month(CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INT)) AS m, day(CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INT)) AS d FROM orders),
c AS (SELECT *, try_cast(year(a) || '-' || m || '-' || d AS DATE) AS this, try_cast((year(a) + 1) || '-' || m || '-' || d AS DATE) AS next FROM b)
SELECT key, CASE WHEN this < a - 14 THEN next ELSE this END AS value FROM c""")
def yearless_dates(spark, sf_dir):
    a = F.to_date("o_orderdate")
    other = F.date_add(a, (F.col("o_custkey") % 400).cast("int"))
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), dates.next_occurrence(F.month(other), F.day(other), a).alias("value"))


@query("""WITH b AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT key, CASE WHEN key % 11 = 10 THEN NULL ELSE d END AS value FROM b""")
def statement_dates(spark, sf_dir):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 11
    forms = ["d/M/yyyy", "dd-MM-yyyy", "d.M.yyyy", "yyyy-MM-dd", "yyyy/M/d", "d/M/yy", "d-M-yy", "d MMM yyyy", "dd MMM yy"]
    cell = F.when(k == 9, F.concat(F.datediff(d, F.lit("1899-12-30").cast("date")), F.lit(".0"))).otherwise(F.lit("n/a 12"))
    for i, f in enumerate(forms):
        cell = F.when(k == i, F.concat(F.lit(" "), F.date_format(d, f))).otherwise(cell)
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), dates.statement_date(cell).alias("value"))


# ---- money

@query("""SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 1 THEN -v WHEN 2 THEN -v ELSE v END AS amount FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT)::DOUBLE AS v FROM lineitem)""")
def money_parse(spark, sf_dir):
    v = F.format_number(F.floor("l_extendedprice"), 0)
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    cell = F.when(k == 0, v).when(k == 1, F.concat(F.lit("("), v, F.lit(")"))).when(k == 2, F.concat(F.lit("-$"), v)).when(k == 3, F.concat(F.lit(" USD "), v, F.lit(".00 "))).when(k == 4, F.concat(F.lit("Rs. "), v, F.lit(".50"))).otherwise("--")
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money.parse_number(cell).alias("amount"))


@query(f"""WITH {LEDGER} SELECT ord, CASE WHEN tx_type = 'credit' THEN 'Salary & Income' WHEN description LIKE 'Late rent%' THEN 'Rent & Housing' WHEN description LIKE 'Amazon%' THEN 'Shopping' WHEN description LIKE 'Uber%' THEN 'Travel & Commute' ELSE 'Other Expenses' END AS category FROM ledger""")
def spend_category(spark, sf_dir):
    return views.ledger(spark, sf_dir).select("ord", statements.spending_category(F.col("description"), F.col("tx_type")).alias("category"))


# ---- statements

def _ledger(spark, sf_dir):
    return views.ledger(spark, sf_dir).withColumn("category", statements.spending_category(F.col("description"), F.col("tx_type")))


_CAT = "CASE WHEN description LIKE 'Late rent%' THEN 'Rent & Housing' WHEN description LIKE 'Amazon%' THEN 'Shopping' WHEN description LIKE 'Uber%' THEN 'Travel & Commute' ELSE 'Other Expenses' END"


@query(f"""WITH {LEDGER}, c AS (SELECT statement_id, {_CAT} AS category, sum(amount) AS raw, count(*) AS "count" FROM ledger WHERE tx_type = 'debit' GROUP BY ALL)
SELECT statement_id, category, round(raw, 2) AS amount, round(raw / sum(raw) OVER (PARTITION BY statement_id) * 100, 1) AS percentage, "count" FROM c""")
def category_totals(spark, sf_dir):
    return statements.category_totals(_ledger(spark, sf_dir))


@query(f"""WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY amount DESC, ord) AS rank FROM ledger WHERE tx_type = 'debit')
SELECT statement_id, CAST(rank AS INT) AS rank, date, description, round(amount, 2) AS amount, {_CAT} AS category FROM r WHERE rank <= 5""")
def top_expenses(spark, sf_dir):
    return statements.top_expenses(_ledger(spark, sf_dir))


@query(f"""WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY amount DESC, ord) AS k FROM ledger WHERE tx_type = 'credit')
SELECT statement_id, date, description, round(amount, 2) AS amount FROM r WHERE k = 1""")
def largest_credit(spark, sf_dir):
    return statements.largest_credit(_ledger(spark, sf_dir))


@query(f"""WITH {LEDGER}, g AS (SELECT statement_id, trim(regexp_replace(lower(description), '[^a-z]+', ' ', 'g')) AS key, round(amount, 2) AS amount, count(*) AS "count", arg_min(description, ord) AS description, min(ord) AS first FROM ledger WHERE tx_type = 'debit' GROUP BY 1, 2, 3 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY amount * "count" DESC, first) AS rank FROM g)
SELECT statement_id, CAST(rank AS INT) AS rank, description, amount, "count" FROM r WHERE rank <= 5""")
def recurring_payments(spark, sf_dir):
    return statements.recurring_payments(_ledger(spark, sf_dir))


_PAIRS = """p AS (SELECT *, abs(lag(balance) OVER (PARTITION BY statement_id ORDER BY ord) + CASE WHEN tx_type = 'credit' THEN amount ELSE -amount END - balance) AS gap FROM ledger),
v AS (SELECT statement_id, count(gap) AS checked, count(*) FILTER (gap <= 0.02) AS balanced FROM p GROUP BY 1)"""


@query(f"WITH {LEDGER}, {_PAIRS} SELECT * FROM v")
def balance_pairs(spark, sf_dir):
    return statements.balance_pairs(_ledger(spark, sf_dir))


#: Floating sums depend on the order of rows; rounded to six decimals they are the sums of the cents, so a tie in the second decimal has one answer.
_SUMMARY = f"""{_PAIRS}, t AS (SELECT statement_id, min(date) AS statement_start, max(date) AS statement_end, round(coalesce(sum(amount) FILTER (tx_type = 'credit'), 0), 6) AS income, round(coalesce(sum(amount) FILTER (tx_type = 'debit'), 0), 6) AS expense,
  count(*) AS transaction_count, count(*) FILTER (tx_type = 'credit') AS credit_count, count(*) FILTER (tx_type = 'debit') AS debit_count,
  arg_min(balance - CASE WHEN tx_type = 'credit' THEN amount ELSE -amount END, ord) FILTER (balance IS NOT NULL) AS o, arg_max(balance, ord) FILTER (balance IS NOT NULL) AS c FROM ledger GROUP BY 1 HAVING count(*) >= 2)
SELECT statement_id, statement_start, statement_end, round(o, 2) AS opening_balance, round(c, 2) AS closing_balance, round(c - o, 2) AS balance_change, round(income, 2) AS total_income, round(expense, 2) AS total_expense, round(income - expense, 2) AS net_cashflow,
  transaction_count, credit_count, debit_count, CASE WHEN debit_count > 0 THEN round(expense / debit_count, 2) ELSE 0.0 END AS average_expense, '$' AS currency,
  CASE WHEN abs(o + income - expense - c) <= 0.05 THEN 'verified' WHEN checked = 0 THEN CASE WHEN o IS NULL OR c IS NULL THEN 'unverifiable' ELSE 'discrepancy' END WHEN balanced / checked >= 0.8 THEN 'verified' ELSE 'discrepancy' END AS verification
FROM t JOIN v USING (statement_id)"""


@query(f"WITH {LEDGER}, {_SUMMARY}")
def statement_summary(spark, sf_dir):
    return statements.summarize(_ledger(spark, sf_dir))


_UNIQUE = f"""u AS (SELECT *, row_number() OVER (PARTITION BY statement_id, date, lower(description), amount, tx_type ORDER BY ord) AS k FROM ledger)"""


@query(f"""WITH {LEDGER}, {_UNIQUE} SELECT statement_id, date, description, amount, tx_type, CASE WHEN tx_type = 'credit' THEN 'Salary & Income' ELSE {_CAT} END AS category, balance FROM u WHERE k = 1""")
def parse_transactions(spark, sf_dir):
    parsed = statements.parse_rows(views.statement_lines(spark, sf_dir))
    return statements.distinct_transactions(parsed).select("statement_id", "date", "description", "amount", "tx_type", "category", "balance")


@query(f"WITH {LEDGER} SELECT statement_id, count(*) FILTER (ord % 50 = 0) AS rejected FROM ledger GROUP BY 1")
def rejected_rows(spark, sf_dir):
    parsed = statements.parse_rows(views.statement_lines(spark, sf_dir))
    return parsed.groupBy("statement_id").agg(F.count_if("rejected").alias("rejected"))


@query(f"""WITH {LEDGER.replace("ledger AS", "every AS", 1)}, {_UNIQUE.replace("FROM ledger", "FROM every")}, ledger AS (SELECT * EXCLUDE (k) FROM u WHERE k = 1), summary AS (WITH {_SUMMARY}),
debits AS (SELECT *, {_CAT} AS category FROM ledger WHERE tx_type = 'debit'),
c AS (SELECT statement_id, category, round(sum(amount), 6) AS raw, count(*) AS n, min(ord) AS first FROM debits GROUP BY ALL), c2 AS (SELECT *, raw / sum(raw) OVER (PARTITION BY statement_id) * 100 AS part FROM c),
cats AS (SELECT statement_id, string_agg(category || ' ' || printf('%.2f', round(raw, 2)) || ' ' || printf('%.1f', round(part, 1)) || ' ' || n, '; ' ORDER BY round(raw, 2) DESC, first) AS categories FROM c2 GROUP BY 1),
tops AS (SELECT statement_id, string_agg(strftime(date, '%Y-%m-%d') || ' ' || description || ' ' || printf('%.2f', amount) || ' ' || category, '; ' ORDER BY r) AS top_expenses FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY amount DESC, ord) AS r FROM debits) WHERE r <= 5 GROUP BY 1),
g AS (SELECT statement_id, trim(regexp_replace(lower(description), '[^a-z]+', ' ', 'g')) AS key, round(amount, 2) AS cents, count(*) AS n, arg_min(description, ord) AS description, min(ord) AS first FROM debits GROUP BY 1, 2, 3 HAVING count(*) >= 2),
again AS (SELECT statement_id, string_agg(description || ' ' || printf('%.2f', cents) || ' ' || n, '; ' ORDER BY r) AS recurring_payments FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY cents * n DESC, first) AS r FROM g) WHERE r <= 5 GROUP BY 1),
most AS (SELECT statement_id, strftime(date, '%Y-%m-%d') || ' ' || description || ' ' || printf('%.2f', amount) AS largest_credit FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY amount DESC, ord) AS r FROM ledger WHERE tx_type = 'credit') WHERE r = 1),
bad AS (SELECT statement_id, count(*) FILTER (ord % 50 = 0) AS rows_rejected FROM every GROUP BY 1)
SELECT summary.*, rows_rejected, coalesce(categories, '') AS categories, coalesce(top_expenses, '') AS top_expenses, coalesce(recurring_payments, '') AS recurring_payments, largest_credit
FROM summary JOIN bad USING (statement_id) LEFT JOIN cats USING (statement_id) LEFT JOIN tops USING (statement_id) LEFT JOIN again USING (statement_id) LEFT JOIN most USING (statement_id)""")
def statement_analysis(spark, sf_dir):
    lines = views.statement_lines(spark, sf_dir)
    head = lines.filter("ord = -2").select("statement_id", F.col("line").alias("content"))
    found = statements.analyze_rows(lines, statements.named_balances(head))
    two = lambda x: F.format_string("%.2f", x)
    told = lambda name, f: F.array_join(F.transform(name, lambda x: F.concat_ws(" ", *f(x))), "; ").alias(name)
    texts = {
        "categories": told("categories", lambda x: (x["category"], two(x["amount"]), F.format_string("%.1f", x["percentage"]), x["count"].cast("string"))),
        "top_expenses": told("top_expenses", lambda x: (x["date"].cast("string"), x["description"], two(x["amount"]), x["category"])),
        "recurring_payments": told("recurring_payments", lambda x: (x["description"], two(x["amount"]), x["count"].cast("string"))),
        "largest_credit": F.when(F.col("largest_credit").isNotNull(), F.concat_ws(" ", F.col("largest_credit.date").cast("string"), "largest_credit.description", two(F.col("largest_credit.amount")))),
    }
    return found.withColumns(texts)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '|' WHEN 1 THEN ',' WHEN 2 THEN 'spaces' ELSE '|' END AS delimiter, CAST(CASE event_id % 4 WHEN 3 THEN 1 ELSE 3 END AS BIGINT) AS n_cells FROM events""")
def delimiter_sniff(spark, sf_dir):
    k = F.col("event_id") % 4
    line = F.when(k == 0, F.concat_ws("|", "event_type", "event_id", "user_id")).when(k == 1, F.concat_ws(",", F.lit('"a, b"'), "event_type", "user_id")).when(k == 2, F.concat_ws("   ", "event_type", "event_id", F.lit("x"))).otherwise(F.col("event_type"))
    d = statements.delimiter_of(line)
    return views.table(spark, sf_dir, "events").select("event_id", d.alias("delimiter"), F.size(statements.split_row(line, d)).cast("long").alias("n_cells"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS date_at, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 0 END AS description_at, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 1 END AS debit_at, event_id % 3 < 2 AS is_header FROM events""")
def header_map(spark, sf_dir):
    k = F.col("event_id") % 3
    cells = F.when(k == 0, F.array(F.lit("Txn. Date"), F.lit(" PARTICULARS "), F.lit("Withdrawal Amt."))).when(k == 1, F.array(F.lit("memo"), F.lit("Money Out"), F.lit("date"))).otherwise(F.array(F.lit("Details"), F.lit("Debit"), F.col("event_type")))
    m = statements.header_map(cells)
    at = lambda f: F.try_element_at(m, F.lit(f))
    return views.table(spark, sf_dir, "events").select("event_id", at("date").alias("date_at"), at("description").alias("description_at"), at("debit").alias("debit_at"), statements.is_header(m).alias("is_header"))


# ---- relevance

def _hits(terms) -> str:
    one = lambda t: "regexp_matches(low, '(^|\\W)" + t.replace(".", "\\.") + "($|\\W)')"
    return " + ".join(f"CAST({one(t)} AS INT) * {2 if ' ' in t else 1}" for t in terms)


@query(f"""WITH {NOTICES}, n AS (SELECT key, lower(content) AS low FROM notices) SELECT key, {", ".join(f"{_hits(t)} AS {d}" for d, t in V.DOMAIN_TERMS.items())} FROM n""")
def domain_scores(spark, sf_dir):
    own = views.notices(spark, sf_dir).select("key", relevance.terms_of(F.lower("content")).alias("terms"))
    return own.select("key", *(terms.score(F.col("terms"), t).alias(d) for d, t in V.DOMAIN_TERMS.items()))


def _any(text, terms) -> str:
    return f"regexp_matches({text}, '(^|\\W)(" + "|".join(t.replace(".", "\\.").replace("'", "''") for t in terms) + ")($|\\W)')"


def _parts(text, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + p.replace("'", "''") + "')" for p in parts) + ")"


def _count(text, terms) -> str:
    return "(" + " + ".join(f"CAST({_any(text, [t])} AS INT)" for t in terms) + ")"


_SCORES = ", ".join(f"{{'d': '{d}', 'i': {i}, 't': {_hits(t)}, 'n': least(3, {_hits(t).replace('(low,', '(name,')}), 'c': {_any('low', t)}}}" for i, (d, t) in enumerate(V.DOMAIN_TERMS.items()))
_HAS_DATE = V.HAS_DATE.replace("(?U:\\b)", "\\b").replace("(?U:\\s)", "\\s")
_DATED = V.DATED_ROW.replace("(?U:\\s*)", "\\s*")
#: Verdicts over notices, whose texts are shorter than the sample. A block is a sentence; its terms are those of the best domain.
_VERDICTS = f"""{NOTICES}, words AS (SELECT key, path, kind, content, lower(content) AS low, lower(regexp_replace(regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', ''), '[_-]+', ' ', 'g')) AS name FROM notices),
scored AS (SELECT *, list_sort([{{'s': -(x.t + x.n), 'i': x.i, 'd': x.d, 't': x.t, 'n': x.n}} FOR x IN [{_SCORES}]])[1] AS top, {_count("low", V.STATEMENT_NAMES)} * 3 + least(2, {_count("low", V.BALANCE_NAMES)}) * 2 + least(4, {_count("low", V.BANK_HEADERS)}) + least(3, len(regexp_extract_all(low, '{_DATED}'))) AS bank,
  {" + ".join(f"CAST({_any('low', [m])} OR {_any('name', [m])} AS INT)" for m in V.REFERENCE_MARKERS)} AS markers, {_any("low", V.ACTION_TERMS)} AND regexp_matches(low, '{_HAS_DATE}') AS acts FROM words),
blocks AS (SELECT key, unnest(regexp_split_to_array(content, '[\n.!?]+')) AS b FROM words),
block AS (SELECT key, lower(regexp_replace(b, '\\s+', ' ', 'g')) AS low FROM blocks), coh AS (SELECT key, [x.d FOR x IN [{_SCORES.replace("(name,", "(low,")}] IF x.c] AS ds FROM block WHERE length(low) <= 800 AND regexp_matches(low, '{_HAS_DATE}') AND {_any("low", V.ACTION_TERMS)}),
coheres AS (SELECT key, list_distinct(flatten(list(ds))) AS ds FROM coh GROUP BY 1),
verdicts AS (SELECT s.*, markers >= 2 OR (markers >= 1 AND {_parts("(' ' || low || ' ')", V.CODE_TOKENS)}) AS reference, bank >= 6 AS by_bank, -top.s AS score, top.t AS t, top.n AS n,
  (coalesce(list_contains(ds, top.d), false) AND -top.s >= 2) OR (top.t >= 4 AND acts) OR (top.n >= 2 AND top.t >= 2 AND acts) AS enough FROM scored s LEFT JOIN coheres USING (key)),
told AS (SELECT *, CASE WHEN reference THEN false WHEN by_bank THEN true ELSE enough END AS relevant FROM verdicts)"""


@query(f"""WITH {_VERDICTS} SELECT key, relevant, CASE WHEN NOT reference AND by_bank THEN 'banking' WHEN relevant THEN top.d END AS relevance_domain,
  CAST(CASE WHEN NOT reference AND by_bank THEN least(99, 72 + bank * 3) WHEN relevant THEN least(96, 54 + score * 7) ELSE 0 END AS INT) AS relevance_confidence,
  CASE WHEN reference THEN 'reference or educational material' WHEN by_bank THEN 'bank statement structure' WHEN relevant THEN 'cohesive document evidence' ELSE 'insufficient corroborating evidence' END AS relevance_reason, CAST(bank AS INT) AS bank_score FROM told""")
def relevance_verdicts(spark, sf_dir):
    return relevance.classify(views.notices(spark, sf_dir)).select("key", "relevant", "relevance_domain", "relevance_confidence", "relevance_reason", "bank_score")


@query(f"""WITH {LEDGER} SELECT statement_id, CAST(3 + 4 + least(3, count(*)) AS INT) AS score FROM ledger GROUP BY 1""")
def bank_signature(spark, sf_dir):
    return views.statement_heads(spark, sf_dir).select("statement_id", F.lower(text.sample(F.col("content"))).alias("low")).select("statement_id", relevance.statement_score(F.col("low"), relevance.terms_of(F.col("low"))).alias("score"))


# ---- commitments

_WORDS = ", ".join("('" + w.replace("'", "''") + f"', {i})" for i, w in enumerate(commitments.ACTION_WORDS))


@query(f"""WITH {NOTICES}, n AS (SELECT key, lower(content) AS low FROM notices), w(word, o) AS (VALUES {_WORDS}),
f AS (SELECT key, word, o, len(word) AS k, low, unnest(range(1, length(low) + 1)) AS i FROM n JOIN w ON contains(low, word)),
h AS (SELECT key, word, o, least(abs(20 - (i - 1)), abs(20 - (i - 1 + k))) AS d FROM f WHERE substr(low, i, k) = word AND NOT regexp_matches(substr(' ' || low, i, 1), '\\w') AND NOT regexp_matches(substr(low || ' ', i + k, 1), '\\w'))
SELECT key, arg_min(word, d * 1000 + o) AS word, CAST(min(d) AS INT) AS distance FROM h GROUP BY 1""")
def nearest_action(spark, sf_dir):
    own = views.notices(spark, sf_dir).select("key", F.lower("content").alias("low"))
    # null just where the filter is false; as a filter of its own the words are looked for once
    found = text.nearest(F.col("low"), F.lit(20), commitments.ACTION_WORDS)
    return own.filter(text.has_any(F.col("low"), commitments.ACTION_WORDS)).select("key", found.alias("x")).select("key", "x.word", "x.distance")


def judged(spark, sf_dir):
    return commitments.extract(views.notices(spark, sf_dir).drop("kind", "due"), TODAY)


#: Of each wording: category, title, the base of its confidence, whether a past date is noise.
expected = f"""{NOTICES}, work AS (SELECT key, due + CAST(i AS INT) AS x, row_number() OVER (PARTITION BY key ORDER BY i) AS k FROM (SELECT key, due, unnest(range(1, 20)) AS i FROM notices WHERE kind = 3) WHERE isodow(due + CAST(i AS INT)) < 6),
facts AS (SELECT n.*, CASE kind WHEN 3 THEN w.x WHEN 7 THEN due + 364 ELSE due END AS date,
    (['money', 'renewal', 'cancellation', 'submission', 'action', 'money', 'expiry', 'warranty'])[kind + 1] AS category,
    (['Document Payment Due', 'Document Renewal', 'Document Cancellation Deadline', 'Document Submission Deadline', '', 'Document Payment Due', 'Agreement Expiry', 'Document Coverage Ends'])[kind + 1] AS title,
    CASE kind WHEN 2 THEN CASE WHEN day(due) <= 12 THEN 70 ELSE 86 END ELSE ([90, 88, 0, 76, 0, 88, 90, 90])[kind + 1] END AS base
  FROM notices n LEFT JOIN work w ON w.key = n.key AND w.k = n.key % 9 + 1),
good AS (SELECT *, CAST(base - CASE WHEN date >= DATE '{TODAY}' THEN 0 ELSE 10 END AS INT) AS confidence FROM facts WHERE kind <> 4 AND (kind = 5 OR date >= DATE '{TODAY}' - 45))"""


@query(f"WITH {expected} SELECT path, date, category, title, confidence, CASE WHEN kind = 6 THEN 30 END AS notice_days, CASE WHEN kind = 6 THEN date - 30 END AS action_date, CASE WHEN kind = 6 THEN 'annual' END AS periodicity FROM good")
def commitments_found(spark, sf_dir):
    return judged(spark, sf_dir).filter("rejected_as is null").select("path", "date", "category", "title", "confidence", "notice_days", "action_date", "periodicity")


@query(f"""WITH {expected} SELECT path, 'historical_noise' AS reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT path FROM facts WHERE kind = 7 UNION ALL SELECT path FROM facts WHERE kind = 4 UNION ALL SELECT path FROM facts WHERE kind NOT IN (4, 5) AND date < DATE '{TODAY}' - 45) GROUP BY 1""")
def rejections(spark, sf_dir):
    return results.rejections(judged(spark, sf_dir))


@query(f"""WITH {expected}, d AS (SELECT *, row_number() OVER (PARTITION BY date, category, lower(title), document_id ORDER BY confidence DESC, path) AS k FROM good) SELECT path, date, category, confidence FROM d WHERE k = 1""")
def dedup_best(spark, sf_dir):
    good = judged(spark, sf_dir).filter("rejected_as is null").drop("rejected_as")
    return results.ordered(results.deduplicate(good.select("path", *results.BASIS))).select("path", "date", "category", "confidence")


@query(f"""WITH {_VERDICTS}, {expected.split("facts AS", 1)[0].split(NOTICES + ", ", 1)[1]}facts AS{expected.split("facts AS", 1)[1]}
SELECT t.path, CAST(CASE WHEN NOT relevant THEN 0 WHEN t.kind = 7 THEN 2 ELSE 1 END AS BIGINT) AS candidates, CAST(CASE WHEN relevant AND g.key IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS commitments,
  CAST(CASE WHEN NOT relevant THEN 0 ELSE CASE WHEN t.kind = 7 THEN 2 ELSE 1 END - CASE WHEN g.key IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS historical,
  CASE WHEN NOT relevant THEN 'irrelevant_document: ' || t.path WHEN g.key IS NULL THEN 'historical_noise: ' || t.path END AS warning FROM told t LEFT JOIN good g USING (key)""")
def full_scan(spark, sf_dir):
    files = views.notices(spark, sf_dir).select("path", "content", "modified")
    return scan(files, TODAY).outcomes


@query(f"""WITH {expected}, r AS (SELECT n.path, n.kind, g.key IS NOT NULL AS has FROM notices n LEFT JOIN good g USING (key)), kept AS (SELECT DISTINCT date, category, lower(title), document_id FROM good),
t AS (SELECT CAST(count(*) FILTER (has) AS BIGINT) AS files_scanned, count(*) FILTER (NOT has) AS files_skipped, CAST(coalesce(sum(CASE WHEN kind = 7 THEN 2 ELSE 1 END) FILTER (has), 0) AS BIGINT) AS dates_reviewed FROM r),
d AS (SELECT (SELECT count(*) FROM good) AS f, (SELECT count(*) FROM kept) AS k), w AS (SELECT list(path ORDER BY path) AS p FROM (SELECT path FROM r WHERE NOT has ORDER BY path LIMIT 12))
SELECT DATE '{TODAY}' AS today, files_scanned, files_skipped, dates_reviewed, greatest(dates_reviewed - k, 0) AS noise_removed, k AS commitments, f - k AS duplicates,
  array_to_string(list_concat(['historical_noise: ' || x FOR x IN p], CASE WHEN f > k THEN ['duplicate_commitment: ' || (f - k) || ' repeated commitment(s)'] ELSE [] END)[1:12], chr(10)) AS warnings FROM t, d, w""")
def envelope(spark, sf_dir):
    # several results read the mentions and the outcomes
    mentions = spill(judged(spark, sf_dir).select("path", "rejected_as", *results.BASIS), "mentions")
    outcomes = spill(results.document_outcomes(views.notices(spark, sf_dir).select("path"), mentions), "outcomes")
    found = mentions.filter("rejected_as is null").drop("rejected_as")
    return results.envelope(outcomes, found, results.deduplicate(found), TODAY).withColumn("warnings", F.array_join("warnings", "\n"))


@query(f"""WITH {LETTERS}, parts AS (SELECT key, string_split(content, chr(10)) AS l FROM letters), lines AS (SELECT key, unnest(l) AS raw, generate_subscripts(l, 1) AS line FROM parts),
s AS (SELECT key, line, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM lines), m AS (SELECT *, regexp_matches(t, '^\\[\\[PAGE:[0-9]+\\]\\]$') AS mark FROM s),
q AS (SELECT *, last_value(CASE WHEN mark THEN CAST(regexp_extract(t, '[0-9]+') AS INT) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY line) AS page,
  lag(CASE WHEN NOT mark THEN nullif(t, '') END) OVER (PARTITION BY key ORDER BY line) AS a, lead(CASE WHEN NOT mark THEN nullif(t, '') END) OVER (PARTITION BY key ORDER BY line) AS z FROM m),
cut AS (SELECT key, line, page, concat_ws(' · ', a, t, z) AS context, unnest(CASE WHEN length(t) > 2500 THEN string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) ELSE [t] END) AS segment FROM q WHERE NOT mark)
SELECT key, CAST(line AS INT) AS line, page, sha256(context) AS context, segment FROM cut WHERE regexp_matches(segment, '[0-9]')""")
def letter_segments(spark, sf_dir):
    return commitments.segments(views.letters(spark, sf_dir)).select("key", "line", "page", F.sha2(F.col("context").cast("binary"), 256).alias("context"), "segment")


@query(f"""WITH {LETTERS}, x AS (SELECT key, due AS date, 5 AS line, 1 AS page, 'expires' AS word FROM letters UNION ALL SELECT key, due, 8, CAST(key % 7 + 2 AS INT), 'renew' FROM letters UNION ALL SELECT key, due + 30, 8, CAST(key % 7 + 2 AS INT), 'by' FROM letters
  UNION ALL SELECT key, due + 9, 10, CAST(key % 7 + 2 AS INT), 'by' FROM letters WHERE key % 40 = 0)
SELECT key, date, line, page, 'Order ' || key AS entity FROM x WHERE date >= DATE '{TODAY}' - 45""")
def letter_commitments(spark, sf_dir):
    found = commitments.extract(views.letters(spark, sf_dir), TODAY).filter("rejected_as is null")
    return found.select(F.col("document_id").cast("long").alias("key"), "date", "line", "page", "entity")


@query(f"""WITH {PHRASES}, y AS (SELECT *, try_cast(year(anchor) || '-' || month(due) || '-' || day(due) AS DATE) AS this, try_cast((year(anchor) + 1) || '-' || month(due) || '-' || day(due) AS DATE) AS next FROM phrases),
f AS (SELECT key, content, CASE kind WHEN 0 THEN CASE WHEN this < anchor - 14 THEN next ELSE this END WHEN 1 THEN anchor WHEN 2 THEN anchor + 1 WHEN 3 THEN anchor + n * 7 WHEN 4 THEN CAST(anchor + to_months(n) AS DATE) WHEN 5 THEN anchor + n ELSE due END AS value,
    CASE kind WHEN 0 THEN strftime(due, '%B %-d') WHEN 1 THEN 'Today' WHEN 2 THEN 'tomorrow' WHEN 3 THEN 'in ' || n || ' weeks' WHEN 4 THEN 'within ' || n || ' months' WHEN 5 THEN 'due in ' || n || ' days' WHEN 6 THEN strftime(due, '%-m/%-d/%Y') WHEN 7 THEN day(due) || 'th of ' || strftime(due, '%B %Y') ELSE strftime(due, '%Y.%m.%d') END AS raw,
    CASE kind WHEN 0 THEN 0.72 WHEN 1 THEN 0.58 WHEN 2 THEN 0.58 WHEN 6 THEN CASE WHEN day(due) <= 12 THEN 0.78 ELSE 0.86 END WHEN 7 THEN 0.92 WHEN 9 THEN 0.95 ELSE 0.66 END AS quality, kind = 6 AND day(due) <= 12 AS ambiguous FROM y WHERE kind <> 8
  UNION ALL SELECT key, content, due, CASE kind WHEN 7 THEN strftime(due, '%Y-%m-%d') ELSE strftime(due, '%Y/%m/%d') END, 0.95, false FROM y WHERE kind IN (7, 9))
SELECT key, value, raw, CAST(strpos(content, raw) - 1 AS BIGINT) AS start, CAST(quality AS DOUBLE) AS quality, ambiguous FROM f WHERE value IS NOT NULL""")
def phrase_dates(spark, sf_dir):
    hits = dates.find_dates(F.col("content"), F.col("anchor"), month_first=True)
    h = views.phrases(spark, sf_dir).select("key", F.explode(hits).alias("h"))
    return h.select("key", F.col("h.value").alias("value"), F.col("h.raw").alias("raw"), F.col("h.start").cast("long").alias("start"), F.col("h.quality").alias("quality"), F.col("h.ambiguous").alias("ambiguous"))


# ---- what is shown

def _shown(spark, sf_dir):
    return judged(spark, sf_dir).filter("rejected_as is null").drop("rejected_as")


def _shown_once(spark, sf_dir, *columns):
    """These columns as a table, for those who read them more than once."""
    return spill(_shown(spark, sf_dir).select(*columns), "shown")


@query(f"""WITH {expected} SELECT path, CASE WHEN date < DATE '{TODAY}' THEN 'Overdue' WHEN date <= DATE '{TODAY}' + 30 THEN 'Next 30 days' ELSE 'Later' END AS bucket,
  CASE date - DATE '{TODAY}' WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow' WHEN -1 THEN 'Yesterday' ELSE CASE WHEN date < DATE '{TODAY}' THEN (DATE '{TODAY}' - date) || ' days overdue' ELSE 'In ' || (date - DATE '{TODAY}') || ' days' END END AS label FROM good""")
def buckets_and_labels(spark, sf_dir):
    return _shown(spark, sf_dir).select("path", horizon.bucket(F.col("date"), TODAY).alias("bucket"), horizon.relative_label(F.col("date"), TODAY).alias("label"))


@query(f"""WITH {expected}, f AS (SELECT path, 'soon' AS name FROM good WHERE date - DATE '{TODAY}' BETWEEN 0 AND 30 UNION ALL SELECT path, 'expiry' FROM good WHERE category IN ('expiry', 'renewal', 'warranty', 'vehicle', 'travel') UNION ALL SELECT path, 'money' FROM good WHERE category IN ('money', 'billing', 'utilities', 'banking') UNION ALL SELECT path, 'cancellation' FROM good WHERE category = 'cancellation')
SELECT name, count(*) AS n FROM f WHERE path NOT LIKE 'box7/%' GROUP BY 1""")
def shown_by_filter(spark, sf_dir):
    good = _shown_once(spark, sf_dir, "path", "id", "date", "category", "domain")
    dismissed = good.filter(F.col("path").startswith("box7/")).select("id")
    kept = horizon.visible(good, dismissed, "all", TODAY)
    names = ("soon", "expiry", "money", "cancellation")
    return kept.select(F.explode(F.array(*(F.when(horizon.matches(n, TODAY), F.lit(n)) for n in names))).alias("name")).filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {expected}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY date < DATE '{TODAY}', date, confidence DESC, path) AS k, count(*) OVER (PARTITION BY document_id) AS n FROM good)
SELECT document_id AS source, n, date AS lead_date, path AS lead_id, title AS lead_title, CASE WHEN date < DATE '{TODAY}' THEN 'Overdue' WHEN date <= DATE '{TODAY}' + 30 THEN 'Next 30 days' ELSE 'Later' END AS bucket FROM o WHERE k = 1""")
def bundles(spark, sf_dir):
    return horizon.bundles(_shown(spark, sf_dir).withColumns({"source": F.col("document_id"), "id": F.col("path")}), TODAY)


@query(f"""WITH {expected} SELECT path, CAST(row_number() OVER (PARTITION BY document_id ORDER BY date, confidence DESC, path) AS INT) AS position, row_number() OVER (PARTITION BY document_id ORDER BY date < DATE '{TODAY}', date, confidence DESC, path) = 1 AS leads FROM good""")
def bundle_items(spark, sf_dir):
    own = _shown(spark, sf_dir).withColumns({"source": F.col("document_id"), "id": F.col("path")})
    return horizon.bundle_items(own, TODAY).select("path", "position", "leads")


@query(f"""WITH {expected} SELECT path, CASE WHEN key % 3 > 0 THEN path END AS opens FROM good WHERE document_id LIKE '%1'""")
def selected_sources(spark, sf_dir):
    shown = _shown_once(spark, sf_dir, "path", "id", "document_id", "source", "page")
    files = views.notices(spark, sf_dir).filter("key % 3 > 0").select("path")
    return horizon.with_source(horizon.selected(shown, shown.filter("document_id like '%1'").select("id")), files).select("path", "opens")


@query("""SELECT o_orderkey AS key, upper(w[1][1]) || w[1][2:] || ' ' || upper(w[2][1]) || w[2][2:] || ' ' || o_orderkey AS label, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CAST(floor(b / 1024 + 0.5) AS BIGINT) || ' KB' ELSE printf('%d.%d', t // 10, t % 10) || ' MB' END AS bytes,
  CASE WHEN s < 60 THEN greatest(1, s) || ' sec' WHEN s < 3600 THEN CAST(ceil(s / 60) AS BIGINT) || ' min' ELSE s // 3600 || ' hr ' || CAST(ceil((s % 3600) / 60) AS BIGINT) || ' min' END AS eta, strftime(CAST(o_orderdate AS DATE), '%b %-d, %Y') AS day, '$' || format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS money
FROM (SELECT *, string_split(lower(o_orderstatus) || 'x ' || 'order', ' ') AS w, o_orderkey * o_orderkey % 9000011 AS b, CAST(floor((o_orderkey * o_orderkey % 9000011 * 10 + 524288) / 1048576) AS BIGINT) AS t, o_orderkey % 9001 AS s, CAST(o_orderkey * 7 AS BIGINT) AS c FROM orders)""")
def labels_shown(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("in/box_1/"), F.lower("o_orderstatus"), F.lit("x_order--"), k.cast("string"), F.lit(".tar"))
    return views.table(spark, sf_dir, "orders").select(
        k.alias("key"), horizon.document_label(path).alias("label"), horizon.bytes_label(k * k % 9_000_011).alias("bytes"), horizon.eta_label(k % 9001).alias("eta"),
        horizon.date_label(F.to_date("o_orderdate")).alias("day"), horizon.money_label(-k * 7 / 100, F.lit("$")).alias("money"),
    )


@query(f"WITH {expected} SELECT count(*) AS milestones, min(date) FILTER (date >= DATE '{TODAY}') AS nearest, count(DISTINCT path) AS sources FROM good")
def totals(spark, sf_dir):
    good = _shown_once(spark, sf_dir, "source", "date")
    return horizon.totals(good, good.select("source"), TODAY)


# ---- exports

#: What the exports say of each wording besides: the word that decided, the notice, the summary.
told = f"""{expected}, told AS (SELECT *, '“' || (['by', 'renews', 'by', 'respond', '', 'premium', 'expires', 'expires'])[kind + 1] || '” appears near this date' AS reason,
    CASE WHEN kind = 6 THEN 30 END AS notice, CASE WHEN kind = 6 THEN 'annual' ELSE '' END AS period,
    title || ' (Order ' || key || ')' || CASE WHEN kind = 6 THEN ' • Notice: 30d prior (Action by ' || strftime(date - 30, '%b %d') || ')' ELSE '' END AS summary FROM good)"""


@query(f"""WITH {told} SELECT path, '"' || strftime(date, '%Y-%m-%d') || '","' || category || '","' || title || '","' || period || '",' || coalesce(CAST(notice AS VARCHAR), '') || ',"'
  || CASE WHEN notice IS NULL THEN '' ELSE strftime(date - notice, '%Y-%m-%d') END || '","' || summary || '","' || path || '",' || confidence || ',"' || reason || '"' AS row FROM told""")
def csv_export(spark, sf_dir):
    return exports.csv_rows(_shown(spark, sf_dir).withColumn("id", F.col("path"))).select(F.col("id").alias("path"), "row")


@query(f"""WITH {told}, b AS (SELECT *, upper(category[1]) || category[2:] AS kind_name FROM told)
SELECT path, array_to_string(['BEGIN:VEVENT', 'UID:' || substr(sha256(path), 1, 24) || '@docketry', 'DTSTAMP:20260101T000000Z', 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d'), 'SUMMARY:' || title,
  'DESCRIPTION:Found in ' || path || '. ' || reason || CASE WHEN notice IS NULL THEN '' ELSE ' | Requires ' || notice || '-day notice' END, 'CATEGORIES:' || kind_name, 'TRANSP:TRANSPARENT',
  'BEGIN:VALARM', 'ACTION:DISPLAY', 'DESCRIPTION:' || title || ' (1 week reminder)', 'TRIGGER:-P7D', 'END:VALARM', 'BEGIN:VALARM', 'ACTION:DISPLAY', 'DESCRIPTION:' || title || ' (1 day reminder)', 'TRIGGER:-P1D', 'END:VALARM', 'END:VEVENT'], chr(13) || chr(10)) AS event FROM b""")
def calendar_events(spark, sf_dir):
    return _shown(spark, sf_dir).withColumn("id", F.col("path")).select("path", exports.event("20260101T000000Z").alias("event"))


@query(f"""WITH {told} SELECT path, strftime(date, '%Y-%m-%d') || '  ' || title || chr(10) || '            ' || path || ' · ' || category || ' · ' || confidence || '%' || chr(10) || chr(10) AS block FROM told""")
def console_report(spark, sf_dir):
    return exports.report_rows(_shown(spark, sf_dir).withColumn("id", F.col("path"))).select(F.col("id").alias("path"), "block")


@query(f"""WITH {told}, n AS (SELECT key, CAST(key % 9 + 1 AS VARCHAR) AS days FROM notices), raws AS (SELECT told.*, CASE kind WHEN 1 THEN strftime(due, '%B %-d, %Y') WHEN 2 THEN strftime(due, '%-d/%-m/%Y') WHEN 3 THEN 'within ' || days || ' business days' WHEN 5 THEN strftime(due, '%-d %b %Y') ELSE strftime(date, '%Y-%m-%d') END AS raw FROM told JOIN n USING (key))
SELECT path, '{{"id":"' || substr(sha256(document_id || ':1:' || strftime(date, '%Y-%m-%d') || ':' || raw), 1, 12) || '","date":"' || strftime(date, '%Y-%m-%d') || '","title":"' || title || '","category":"' || category || '","source":"' || path || '","line":1,"snippet":"' || content || '","confidence":' || confidence || ',"reason":"' || reason
  || '","original":"' || raw || '","ambiguous":' || CASE WHEN kind = 2 AND day(due) <= 12 THEN 'true' ELSE 'false' END || ',"page":null,"document_id":"' || document_id || '","domain":null,"entity":"Order ' || key || '","periodicity":' || CASE WHEN period = '' THEN 'null' ELSE '"annual"' END || ',"summary":"' || summary || '","notice_days":' || coalesce(CAST(notice AS VARCHAR), 'null') || ',"action_date":' || CASE WHEN notice IS NULL THEN 'null' ELSE '"' || strftime(date - notice, '%Y-%m-%d') || '"' END || '}}' AS row FROM raws""")
def json_export(spark, sf_dir):
    return exports.json_rows(_shown(spark, sf_dir), "source").select(F.col("source").alias("path"), "row")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def file_slug(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", exports.file_slug(F.col("p_name")).alias("slug"))


# ---- sessions

def _keyed(spark, sf_dir):
    m = views.manifest(spark, sf_dir)
    return m.withColumn("cache_key", results.cache_key("e1", False, F.col("path"), F.col("fingerprint")))


_KEYED = f"{MANIFEST}, keyed AS (SELECT *, sha256('e1' || chr(0) || 'day-first' || chr(0) || path || chr(0) || fingerprint) AS cache_key FROM manifest)"


@query(f"WITH {_KEYED} SELECT doc_id, cache_key FROM keyed")
def cache_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("doc_id", "cache_key")


@query(f"""WITH {_KEYED} SELECT path, CASE WHEN doc_id % 5 = 0 AND doc_id % 10 = 0 THEN 'done' WHEN doc_id % 3 = 0 THEN 'cached' ELSE 'pending' END AS status FROM keyed WHERE fingerprint <> ''
UNION ALL SELECT path, 'done' FROM keyed WHERE fingerprint = '' AND doc_id % 5 = 0""")
def manifest_merge(spark, sf_dir):
    m = _keyed(spark, sf_dir)
    old = m.filter("doc_id % 5 = 0").select("path", F.when(F.col("doc_id") % 10 == 0, F.col("cache_key")).otherwise("stale").alias("cache_key"), F.lit("done").alias("status"))
    cache = m.filter("doc_id % 3 = 0").select("cache_key")
    return results.register(m, old, cache).select("path", "status")


@query(f"WITH {_KEYED} SELECT doc_id FROM keyed WHERE fingerprint <> '' AND doc_id % 2 = 0")
def pending_uploads(spark, sf_dir):
    m = _keyed(spark, sf_dir)
    files = m.select("fingerprint", F.when((F.col("doc_id") % 2 == 0) & (F.col("fingerprint") != ""), "pending").otherwise("done").alias("status"))
    return results.pending(m, files).filter("fingerprint <> ''").select("doc_id")


@query("""SELECT o_custkey AS scan_id, count(*) AS total, count(*) FILTER (s <> 'pending') AS processed, count(*) FILTER (s = 'cached') AS cached, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s IN ('done', 'cached')) AS files_scanned, CAST(sum(c) AS BIGINT) AS dates_reviewed
FROM (SELECT o_custkey, (['pending', 'done', 'cached', 'skipped'])[o_orderkey % 4 + 1] AS s, o_orderkey % 6 AS c FROM orders) GROUP BY 1""")
def session_snapshot(spark, sf_dir):
    status = F.element_at(F.array(*(F.lit(s) for s in ("pending", "done", "cached", "skipped"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return results.snapshot(views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan_id"), status.alias("status"), (F.col("o_orderkey") % 6).alias("candidates")))


@query(f"""WITH {expected}, files AS (SELECT document_id AS scan_id, path, key, (['pending', 'done', 'cached', 'skipped'])[key % 4 + 1] AS s, key % 6 AS c FROM notices), few AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY key // 3, path) AS r FROM files WHERE s = 'skipped'),
g AS (SELECT scan_id, count(*) AS listed, count(*) FILTER (s <> 'pending') AS processed, count(*) FILTER (s = 'cached') AS cached, count(*) FILTER (s = 'skipped') AS skipped, CAST(sum(c) AS BIGINT) AS dates_reviewed FROM files GROUP BY 1), w AS (SELECT scan_id, list('unsupported_file_type: ' || path ORDER BY r) AS p FROM few WHERE r <= 24 GROUP BY 1),
own AS (SELECT document_id AS scan_id, count(*) AS f, count(DISTINCT (date, category, title)) AS k FROM good GROUP BY 1), n AS (SELECT 'c' || c_custkey AS scan_id, c_custkey % 900 + 0.5 AS seconds, c_custkey % 50 AS total FROM customer),
x AS (SELECT n.*, coalesce(listed, 0) AS listed, coalesce(processed, 0) AS processed, coalesce(cached, 0) AS cached, coalesce(skipped, 0) AS skipped, coalesce(dates_reviewed, 0) AS dates_reviewed, coalesce(k, 0) AS k, coalesce(f, 0) - coalesce(k, 0) AS again, coalesce(p, []) AS p, CAST(coalesce(processed, 0) AS DOUBLE) / seconds AS rate FROM n LEFT JOIN g USING (scan_id) LEFT JOIN own USING (scan_id) LEFT JOIN w USING (scan_id))
SELECT scan_id, 'running' AS status, CAST(total AS BIGINT) AS total, processed - skipped AS files_scanned, processed AS files_processed, cached AS files_cached, skipped AS files_skipped, listed - processed AS files_pending, dates_reviewed, greatest(dates_reviewed - k, 0) AS noise_removed, k AS commitments,
  array_to_string(list_concat(p, CASE WHEN again > 0 THEN ['duplicate_commitment: ' || again || ' repeated commitment(s)'] ELSE [] END)[1:24], chr(10)) AS warnings, CASE WHEN rate > 0 THEN CAST(round_even(greatest(total - processed, 0) / rate, 0) AS BIGINT) END AS eta_seconds, round_even(rate, 1) AS rate FROM x""")
def session_report(spark, sf_dir):
    status = F.element_at(F.array(*(F.lit(s) for s in ("pending", "done", "cached", "skipped"))), (F.col("key") % 4 + 1).cast("int"))
    files = views.notices(spark, sf_dir).select(F.col("document_id").alias("scan_id"), "path", status.alias("status"), (F.col("key") % 6).alias("candidates"), F.floor(F.col("key") / 3).alias("updated_at"))
    files = files.withColumn("warning", F.when(F.col("status") == "skipped", policy.rejection(F.lit(V.UNSUPPORTED_FILE), F.col("path"))))
    begun = F.lit("2026-08-13 09:00:00").cast("timestamp")
    k = F.col("c_custkey")
    sessions = views.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("scan_id"), F.lit("running").alias("status"), (k % 50).alias("total"), begun.alias("created_at"), F.timestamp_add("MILLISECOND", (k % 900 * 1000 + 500).cast("int"), begun).alias("updated_at"))
    found = _shown(spark, sf_dir).withColumn("scan_id", F.col("document_id"))
    return results.session_report(sessions, files, found).withColumn("warnings", F.array_join("warnings", "\n"))


@query("""SELECT o_custkey AS scan_key, max(o_orderkey) AS scan_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'F') WHERE k = 1 GROUP BY 1""")
def latest_session(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("cancelled")
    s = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan_key"), F.lit(False).alias("month_first"), F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("updated_at"), status.alias("status"))
    return results.latest_resumable(s).select("scan_key", "scan_id")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return event_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))
