"""What has to stay bounded or be done once, so that time grows with the input alone."""

import json
import random
import re
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.operators import commitments, scan
from docketry.plans import views


def plan_of(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", str(1 << 28))
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_verdicts_does_not_look_for_dates_and_words_again(spark):
    docs = spark.createDataFrame([("a", "Pay by 2027-01-02.", "2026-01-01", "d", None)], "path string, content string, modified string, document_id string, domain string")
    found = commitments.extract(docs, "2026-08-13").filter("rejected_as is null").select("path", "date")
    plan = plan_of(found)
    assert len(re.findall(r"RLIKE\(segment#[0-9]+, " + re.escape(V.TOMORROW) + r"\)", plan)) == 1
    assert [(r.path, str(r.date)) for r in found.collect()] == [("a", "2027-01-02")]


def test_views_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    # as of a file of one row group: many splits, and all rows in one of them
    lumped = spark.range(0, 5000, 1, 1).union(spark.range(0, 0, 1, 31))
    sizes = views.spread(lumped).rdd.glom().map(len).collect()
    assert sum(sizes) == 5000 and len(sizes) == 50 and max(sizes) <= 110


def test_a_scan_works_out_what_is_asked_for_and_deals_texts_to_bounded_tasks(spark, monkeypatch):
    def analyze(*_, **__):
        raise AssertionError("statements are looked through for mentions")

    monkeypatch.setattr(scan.statements, "analyze", analyze)
    text = "Your health insurance policy renewal: the premium is due by 2026-10-15. Policy number 7."
    files = spark.range(0, 600, 1, 1).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".eml")).alias("path"), F.lit(text).alias("content"), F.lit(None).cast("string").alias("modified"))
    got = scan.scan(files, "2026-08-13")
    assert got.judged.count() == 600
    # the table of classified documents is one small file
    for most in ({"TASK_DOCUMENTS": 60}, {"TASK_DOCUMENTS": 1 << 15, "TASK_BYTES": 60 * len(text)}):
        for name, value in most.items():
            monkeypatch.setattr(scan, name, value)
        sizes = got._dealt(got._docs).rdd.glom().map(len).collect()
        assert sum(sizes) == 600 and len(sizes) == 10 and max(sizes) <= 70


def test_no_row_makes_a_set_of_terms_or_a_pattern_anew(spark):
    from docketry.operators import relevance

    plan = plan_of(relevance.classify(spark.createDataFrame([("a", "Pay by 2027-01-02.")], "path string, content string")))
    assert "array_intersect" not in plan and "INSET" in plan
    assert not re.search(r"RLIKE\([^,]+, element_at", plan, re.I)


class _State:
    """A state store that counts its calls."""

    def __init__(self):
        self.rows, self.value, self.calls = {}, None, 0

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def containsKey(self, key):
        self.calls += 1
        return key in self.rows

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_session_s_state_is_called_by_the_chunk_and_no_chunk_grows_with_the_session():
    from docketry.streaming import status

    begun, dice = datetime(2026, 8, 13, 9), random.Random(7)
    state, known = _State(), {}
    own = status.SessionStatus()
    own.init(state)

    def come(events):
        row = list(own.handleInputRows(("s",), iter(events), None))[0]
        for e in events:
            before = known.get(e.path)
            if before is None or (before.updated_at, before.status in status._FINISHED) <= (e.updated_at, e.status in status._FINISHED):
                known[e.path] = e
        return row

    def event(path):
        return SimpleNamespace(path=path, status=dice.choice(("pending", "done", "cached", "skipped")), candidates=dice.choice((None, 1, 2)), total=None, updated_at=begun + timedelta(seconds=dice.randrange(99)))

    come([event(f"é{dice.randrange(60)}") for _ in range(100)])
    assert state.calls <= 3
    for n in (500, 3000, 3000):
        state.calls = 0
        row = come([event(f"é{dice.randrange(n)}") for _ in range(3000)])
        want = [v.status for v in known.values()]
        assert (row.files_processed, row.files_cached, row.files_skipped) == (len(want) - want.count("pending"), want.count("cached"), want.count("skipped"))
        assert row.dates_reviewed == sum(v.candidates or 0 for v in known.values()) and state.calls < 600
    chunks = [len(json.loads(v[0])) for v in state.rows.values()]
    assert len(chunks) > 15 and max(chunks) < 4 * status.CHUNK_FILES


def test_commitments_are_read_once_for_totals_and_session_reports(spark):
    from docketry.operators import horizon, results

    found = spark.createDataFrame([("s", None, "2026-08-20", "T", "money", "d", 90), ("s", "a", "2026-08-20", "T", "money", "d", 80), ("s", "a", "2026-01-20", "T", "money", "d", 80)], "scan_id string, source string, date string, title string, category string, document_id string, confidence int")
    found = found.withColumns({"date": F.col("date").cast("date"), "line": F.lit(1), "segment_no": F.lit(0), "hit_no": F.lit(0)})
    # rows without a source count, but aren't a source; a statement's source counts alone
    got = horizon.totals(found, spark.createDataFrame([("b",), ("a",)], "source string"), "2026-08-13").first()
    assert (got.milestones, str(got.nearest), got.sources) == (3, "2026-08-20", 2)
    none = horizon.totals(found.limit(0), found.select("source").limit(0), "2026-08-13").first()
    assert (none.milestones, none.nearest, none.sources) == (0, None, 0)
    files = spark.createDataFrame([("s", "a", "done", 3, None, 1)], "scan_id string, path string, status string, candidates long, warning string, updated_at long")
    sessions = spark.createDataFrame([("s", "running", 1), ("t", "running", 1)], "scan_id string, status string, total long").withColumns({"created_at": F.lit("2026-08-13 09:00:00"), "updated_at": F.lit("2026-08-13 09:00:10")})
    report = results.session_report(sessions, files, found.filter(F.coalesce("source", F.lit("")) != "marked"))
    assert plan_of(report).count("marked") == 1
    assert {r.scan_id: (r.commitments, list(r.warnings)) for r in report.collect()} == {"s": (2, ["duplicate_commitment: 1 repeated commitment(s)"]), "t": (0, [])}


def test_outcomes_alone_work_out_no_summaries_and_no_more_of_mentions_than_verdicts(spark, monkeypatch):
    bank = "Account statement\nAccount number 7\nOpening balance 20.00\nDate | Description | Debit | Credit | Balance\n"
    rows = ["01/02/2024 | Tea | 1.00 | | 19.00\n", "02/02/2024 | Cup | 1.00 | | 18.00\n"]
    texts = {
        "two.csv": bank + "".join(rows), "one.csv": bank + rows[0], "same.csv": bank + rows[0] * 2,
        "due.eml": "Health insurance policy renewal: the premium is due by 2026-10-15. Policy number 7.", "old.eml": "Health insurance policy renewal: the premium is due by 2021-10-15. Policy number 7.",
        "none.eml": "Lunch on 2026-10-15.",
    }
    files = spark.createDataFrame([*((p, t, None) for p, t in texts.items()), ("parts.csv", bank + rows[0], None), ("parts.csv", bank + rows[1], None)], "path string, content string, modified string")
    whole = scan.scan(files, "2026-08-13")
    assert {r.path for r in whole.statements.select("path").collect()} == {"two.csv", "parts.csv"} and whole.judged.count() > 0
    want = sorted(map(tuple, whole.outcomes.collect()))

    def unasked(*_, **__):
        raise AssertionError("more is worked out than outcomes need")

    monkeypatch.setattr(scan.statements, "analyze", unasked)
    monkeypatch.setattr(scan.commitments, "extract", unasked)
    assert sorted(map(tuple, scan.scan(files, "2026-08-13").outcomes.collect())) == want
    assert {r[0]: r[4] for r in want} == {"two.csv": None, "one.csv": "historical_noise: one.csv", "same.csv": "historical_noise: same.csv", "due.eml": None, "old.eml": "historical_noise: old.eml", "none.eml": "irrelevant_document: none.eml", "parts.csv": None}


def test_statements_that_may_have_a_summary_are_all_parsed(spark):
    from docketry.operators import statements

    cells = ["01/02/2024", " 1-2-2024 ", "1.2.2024", "2024/2/1", "1/2/24", "01 Feb 2024", "1 FEB 24", "45000", "45000.0"]
    heads = {"|": "Date | Description | Debit | Credit", "\t": "Date\tDescription\tDebit\tCredit", ",": "Date,Description,Debit,Credit", "q": "Date,Description,Debit,Credit"}
    rows = []
    for i, day in enumerate(cells):
        for sep, head in heads.items():
            date, by = (f'"{day}"', ",") if sep == "q" else (day, sep)
            rows.append((f"{sep}{i}", "\n".join([head, *(by.join((date, what, "1.00", "")) for what in ("Tea", "Cup"))])))
        rows.append((f"free{i}", f"{day.strip()}   Tea   1.00 DR\n{day.strip()}   Cup   2.00 CR"))
    own = spark.createDataFrame(rows, "statement_id string, content string")
    found = {r[0] for r in statements.with_summary(own).collect()}
    assert found == {r[0] for r in statements.analyze(own).select("statement_id").collect()} and len(found) > 30
    assert found <= {r[0] for r in statements.promising(own).select("statement_id").collect()}


def test_verdicts_alone_are_those_of_all_columns(spark):
    lines = [
        "Pay by 2027-01-02.", "Issued on 2026-09-01, pay by 2026-10-01", "From 2026-09-01 to 2026-10-01 coverage period", "For example, pay by 2027-01-02", "Unpaid since 2020-01-02", "Pay by 2020-01-02",
        "A walk on 2026-12-24", "version 2026-09-09", "Visit us tomorrow or within 3 weeks", "2026-09-01 | Payment | 1.00 CR", "Statement period until 2026-09-30", "Due date\n03/04/2027\nthanks", "Meet on August 20 or 31 Feb 2027", "renewal 2027-13-40",
    ]
    docs = spark.createDataFrame([(f"{d}{i}", t, "2026-08-01T00:00:00", "d", d) for i, t in enumerate(lines) for d in (None, "banking")], "path string, content string, modified string, document_id string, domain string")
    want = sorted(map(str, commitments.extract(docs, "2026-08-13").select("path", "rejected_as").collect()))
    assert sorted(map(str, commitments.verdicts(docs, "2026-08-13").collect())) == want
    assert len({w.split("rejected_as=")[1] for w in want}) == 4


def test_terms_are_found_whole_at_every_place_and_in_any_script(spark):
    from docketry.functions import terms
    from docketry.operators.relevance import TERMS

    lists = [commitments.ACTION_WORDS, TERMS, V.HISTORICAL_WORDS + V.INFORMATION_WORDS, V.ACTION_TERMS]
    dice = random.Random(3)
    every = [t for own in lists for t in own]
    texts = ["", "payment due date", "prepayment due", "due dates", "pay pay", "élan due", "dueé", "dué", "_due", "due date-due", "auto-renewal", "\U00010400due", "due\U00010400", "renewal\ndate", "payment  due"]
    texts += [dice.choice(("", " ", "-", "x")).join(dice.choice(every) for _ in range(6)) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *(terms.found(F.col("text"), own).alias(f"l{i}") for i, own in enumerate(lists))).collect()
    for row in got:
        for i, own in enumerate(lists):
            assert sorted(row[f"l{i}"]) == sorted({t for t in own if re.search(r"(?<!\w)" + re.escape(t) + r"(?!\w)", row.text)}), (row.text, i)
