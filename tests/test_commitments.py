"""Extraction, relevance and scans on small documents."""

import datetime as dt

import pytest

from docketry.operators.commitments import extract
from docketry.operators.relevance import classify
from docketry.operators.results import deduplicate
from docketry.operators.scan import scan

TODAY = "2026-08-13"


def run(spark, content, today=TODAY, month_first=False, modified=None, domain=None, path="note.eml"):
    docs = spark.createDataFrame([(path, content, modified, "d1", domain)], "path string, content string, modified string, document_id string, domain string")
    rows = extract(docs, today, month_first).orderBy("line", "segment_no", "hit_no").collect()
    return [r for r in rows if r.rejected_as is None], [r.rejected_as for r in rows if r.rejected_as]


def dates(rows):
    return [str(r.date) for r in rows]


def test_sorts_deadlines_from_history(spark):
    good, bad = run(spark, "Statement date: 2026-08-01\nYour plan renews on September 14, 2026\nOffer valid until 2026-10-30\nWork completed on July 4, 2026")
    assert dates(good) == ["2026-09-14", "2026-10-30"]
    assert len(good) + len(bad) == 4


@pytest.mark.parametrize(("month_first", "want"), [(False, "2027-07-04"), (True, "2027-04-07")])
def test_ambiguous_numeric_dates(spark, month_first, want):
    good, _ = run(spark, "Cancel by 04/07/2027.", month_first=month_first)
    assert dates(good) == [want] and good[0].ambiguous and good[0].confidence == 70


def test_business_days_count_from_the_file_date(spark):
    good, _ = run(spark, "You must respond within 5 business days.", modified="2026-08-14T09:30:00")
    assert dates(good) == ["2026-08-21"]


def test_titles_pages_and_domains(spark):
    good, _ = run(spark, "Your mobile number plan is valid till 31.12.2026")
    assert good[0].title == "SIM Plan Expiry"
    good, _ = run(spark, "[[PAGE:3]]\nYour health insurance renews on September 14, 2026")
    assert (good[0].page, good[0].title) == (3, "Health Insurance Renewal")
    good, _ = run(spark, "Tax payable due by 31-07-2026", today="2026-08-15", domain="taxes")
    assert dates(good) == ["2026-07-31"] and "Tax" in good[0].title
    good, _ = run(spark, "FD maturity date 2026-11-25", today="2026-08-15", domain="banking")
    assert "Bank" in good[0].title


def test_periodicity_and_notice(spark):
    good, _ = run(spark, "Your monthly premium is due by 2026-10-15", today="2026-08-15")
    assert good[0].periodicity == "monthly"
    good, _ = run(spark, "The annual subscription renews 2026-11-30; at least 30 days notice prior", today="2026-08-15")
    assert (good[0].notice_days, good[0].action_date, good[0].periodicity) == (30, dt.date(2026, 10, 31), "annual")
    assert "Action by Oct 31" in good[0].summary


def test_past_dates(spark):
    assert not run(spark, "The claim was due on 2025-10-16", today="2026-08-15")[0]
    assert len(run(spark, "The premium payment is unpaid and overdue since 2025-10-16", today="2026-08-15")[0]) == 1
    good, bad = run(spark, "Start date 2018-01-01 and coverage expires 2028-01-01")
    assert dates(good) == ["2028-01-01"] and "historical_noise" in bad
    good, bad = run(spark, "Bill printed on 2026-09-01\nReport generated on 2026-09-02")
    assert not good and bad == ["historical_noise"] * 2


def test_context_of_neighbouring_lines_and_long_lines(spark):
    assert len(run(spark, "Warranty\nExpiry date\n2027-03-01", domain="warranty")[0]) == 1
    good, _ = run(spark, "Nothing of note here. " * 150 + "The contract renews on 2027-06-15. " + "More words follow. " * 20)
    assert dates(good) == ["2027-06-15"]


def test_yearless_dates_follow_the_file_date(spark):
    assert not run(spark, "Payment due by October 15.", today="2026-08-15", modified="2024-03-01T00:00:00Z")[0]
    assert dates(run(spark, "Payment due by October 15.", today="2026-08-15", modified="2026-08-01T00:00:00Z")[0]) == ["2026-10-15"]


@pytest.mark.parametrize("text", ["due 08/31/2026", "due Sept 14, 2026", "due 2026-02-30", "example: due 2027-01-01", "", None])
def test_what_is_no_commitment(spark, text):
    assert not run(spark, text)[0]


def test_null_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([("a.eml", "Pay by 2026-09-01", None, None, None)] * 2 + [("b.eml", None, None, None, None)], "path string, content string, modified string, document_id string, domain string")
    good = extract(docs, TODAY).filter("rejected_as is null").drop("rejected_as")
    assert good.count() == 2 and deduplicate(good).count() == 1


def test_relevance(spark):
    docs = spark.createDataFrame(
        [
            ("a.pdf", "Release notes: version 2 is out on 2026-09-01."),
            ("lease_agreement.pdf", "This lease agreement expires on 2027-01-31. The tenant pays rent."),
            ("python_for_beginners.pdf", "A textbook with practice exercise. import os\nRenewal date 2026-10-01 of the insurance policy"),
            ("s.csv", "Account statement for account number 12\nOpening balance 10.00\nDate,Description,Debit,Credit,Balance\n01/08/2026,x,1.00,,9.00"),
            ("n.pdf", None),
        ],
        "path string, content string",
    )
    got = {r.path: (r.relevant, r.relevance_domain) for r in classify(docs).collect()}
    assert got == {"a.pdf": (False, None), "lease_agreement.pdf": (True, "housing"), "python_for_beginners.pdf": (False, None), "s.csv": (True, "banking"), "n.pdf": (False, None)}


def test_scan_deduplicates_copies_and_reports_the_rest(spark):
    text = "Your health insurance policy renewal: the premium is due by 2026-10-15. Policy number 7."
    files = spark.createDataFrame([("a.eml", text, None), ("b.eml", text, None), ("c.jpg", "", None), ("x/node_modules/d.eml", text, None), ("e.txt", text, None)], "path string, content string, modified string")
    got = scan(files, TODAY)
    assert got.commitments.count() == 1
    warnings = {r.path: r.warning for r in got.outcomes.collect()}
    assert warnings["a.eml"] is None and warnings["c.jpg"].endswith("empty file")
    assert warnings["x/node_modules/d.eml"].startswith("ignored_directory") and warnings["e.txt"].startswith("unsupported_file_type")


def test_plan_is_native(spark):
    docs = spark.createDataFrame([("a.eml", "Pay by 2026-09-01", None, None, None)], "path string, content string, modified string, document_id string, domain string")
    plan = extract(docs, TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
