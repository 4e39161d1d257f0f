"""Bank statements: parsing and summaries."""

from docketry.operators.statements import analyze, distinct_transactions, parse_rows, rows_of

A = """Account statement
Account number 1
Date,Description,Withdrawal,Deposit,Balance
01/08/2026,Salary ACME INR,,"85,000.00",125000.00
02/08/2026,House rent,25000.00,,100000.00
05/08/2026,Electricity board,2400.00,,97600.00
07/08/2026,Swiggy order,850.00,,96750.00
10/08/2026,Netflix,649.00,,96101.00
bad,row,1.00,,2.00
11/08/2026,,1.00,,2.00"""
B = "Account statement\n2026-08-01 | Salary | 4,500.00 | CR\n2026-08-02 | Rent | 1,900.00 | DR\n2026-08-03 | Grocery shop | 80.49 DR\n2026-08-03 | Grocery shop | 80.49 DR"


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "statement_id long, content string")


def test_columns(spark):
    r = analyze(frame(spark, A)).first()
    assert (r.total_income, r.total_expense, r.net_cashflow) == (85000.0, 28899.0, 56101.0)
    assert (r.transaction_count, r.credit_count, r.debit_count, r.rows_rejected) == (5, 1, 4, 1)
    assert (str(r.statement_start), str(r.statement_end)) == ("2026-08-01", "2026-08-10")
    assert (r.opening_balance, r.closing_balance, r.verification, r.currency) == (40000.0, 96101.0, "verified", "₹")
    assert [(c.category, c.amount) for c in r.categories] == [("Rent & Housing", 25000.0), ("Utilities & Bills", 2400.0), ("Food & Groceries", 850.0), ("Subscriptions", 649.0)]
    assert r.top_expenses[0].description == "House rent" and r.largest_credit.amount == 85000.0


def test_flagged_rows(spark):
    r = analyze(frame(spark, B)).first()
    assert (r.total_income, r.total_expense, r.net_cashflow, r.currency, r.verification) == (4500.0, 1980.49, 2519.51, "$", "unverifiable")


def test_serial_dates_recurring_and_blanks(spark):
    text = "Date | Description | Debit | Credit\n46235 | Card 1234 ACME shop | 19.99 |\n46236 | Card 9999 ACME shop | 19.99 |\n46236.0 | In | | 5"
    r = analyze(frame(spark, text, "", None, "prose about banking")).collect()
    assert len(r) == 1 and str(r[0].statement_start) == "2026-08-01"
    assert [(x["count"], x.amount) for x in r[0].recurring_payments] == [(2, 19.99)]


def test_order_and_repeats(spark):
    tx = distinct_transactions(parse_rows(rows_of(frame(spark, B)))).orderBy("ord").collect()
    assert [t.description for t in tx] == ["Salary", "Rent", "Grocery shop"]


def test_two_digit_years(spark):
    text = "Date,Description,Debit,Credit\n01/02/85,a,1,\n01/02/26,b,1,\n3 aug 26,c,2,\n3 Aug 2026,d,2,"
    tx = distinct_transactions(parse_rows(rows_of(frame(spark, text)))).orderBy("ord").collect()
    assert [str(t.date) for t in tx] == ["1985-02-01", "2026-02-01", "2026-08-03", "2026-08-03"]
