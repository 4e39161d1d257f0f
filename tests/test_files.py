"""Files, policy, exports, sessions."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docketry.operators import exports, horizon, policy, results
from docketry.sources.files import Unreadable, read_folder, text_of, uploads
from docketry.streaming import sessions

TEXT = "Subject: Renewal\n\nYour health insurance policy renewal: premium is due by 2026-10-15. Policy number 7."


def xlsx(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join("<row>" + "".join(f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' for r, v in row) + "</row>" for row in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def docx(xml, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_readers():
    assert text_of("a.xlsx", xlsx([[("A1", "Date"), ("C1", "Credit")], []])) == "Date |  | Credit"
    assert text_of("a.docx", docx("<w><p><r><t>Due </t></r><r><t>now</t></r></p></w>")) == "Due now"
    assert text_of("a.csv", "a,ü".encode("cp1252")) == "a,ü"
    assert text_of("a.eml", TEXT.encode()).startswith("Subject: Renewal")
    for path, raw in (("a.docx", docx('<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><w><p><t>&e;</t></p></w>')), ("b.docx", docx("a" * 2_000_000, zipfile.ZIP_DEFLATED)), ("c.csv", b"\x00\x01\x02"), ("d.png", b""), ("e.pdf", b"")):
        with pytest.raises(Unreadable):
            text_of(path, raw)


def test_policy(spark):
    paths = ["a.PDF", "b.txt", ".pdf", "x/venv/a.pdf", "x/.git/b.eml", ".h.eml", "a.b/c.webp", "noext"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: (r.s, r.i) for r in df.select("path", policy.is_supported(F.col("path")).alias("s"), policy.ignored_reason(F.col("path")).isNotNull().alias("i")).collect()}
    assert [p for p in paths if got[p][0]] == ["a.PDF", "x/venv/a.pdf", "x/.git/b.eml", ".h.eml", "a.b/c.webp"]
    assert [p for p in paths if got[p][1]] == [".pdf", "x/venv/a.pdf", "x/.git/b.eml", ".h.eml"]


def test_folder_and_uploads(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, raw in (("a.eml", TEXT.encode()), ("b.md", b"x"), ("node_modules/c.eml", b"x"), ("d.docx", b"not a zip")):
        (tmp_path / name).write_bytes(raw)
    got = {r.path: (r.content, r.warning) for r in read_folder(spark, str(tmp_path)).collect()}
    with open(tmp_path / "E.PDF", "wb") as f:
        f.truncate(9 << 20)  # too large, and a kind that is read in either case
    plan = read_folder(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,8388608)" in plan
    assert {r.path: r.warning for r in read_folder(spark, str(tmp_path)).collect()}["E.PDF"].endswith("larger than 8 MB")
    assert set(got) == {"a.eml", "b.md", "d.docx"} and got["a.eml"][0].startswith("Subject") and "unreadable" in got["d.docx"][1]
    items = spark.createDataFrame([("a.csv", "YQ==", "base64", None, None), ("b.csv", "?", "base64", None, None), ("c.csv", "x", "text", None, "too old")], "path string, content string, encoding string, modified string, skip_reason string")
    assert [r.warning for r in uploads(items).orderBy("path").collect()] == [None, "b.csv: invalid base64 data", "too old"]


BANK = "Account statement\nOpening balance: 100.00\nDate | Description | Debit | Credit | Balance\n01/08/2026 | Salary | | 4500.00 | 4600.00\n02/08/2026 | Rent | 1900.00 | | 2700.00\n"
ROW = "id string, date date, title string, category string, source string, page int, reason string, notice_days int, domain string, entity string, periodicity string, action_date date, summary string, snippet string, confidence int"


def test_calendar_and_csv(spark):
    import datetime as dt

    rows = [("1\r\nATTENDEE:x", dt.date(2026, 9, 10), "Rent, \"due\"\r\nATTENDEE:x", "money", "a.pdf", 4, "r", 3, None, None, None, None, "", "snip", 90), ("2", None, "t", "money", "s", None, "r", None, None, None, None, None, "s", "x", None)]
    df = spark.createDataFrame(rows, ROW)
    text = "".join(r.block for r in exports.calendar(df, "n\r\nX-ODD:1", "20260101T000000Z").orderBy("ord").collect())
    assert "DTSTART;VALUE=DATE:20260910" in text and "Rent\\, " in text and "page 4" in text and text.endswith("END:VCALENDAR\r\n")
    assert "X-WR-CALNAME:n\\nX-ODD:1\r\n" in text and "DESCRIPTION:Found in a.pdf\\, page 4. r | Requires 3-day notice\r\n" in text
    assert "TRANSP:TRANSPARENT" in text and "(1 week reminder)\r\nTRIGGER:-P7D" in text and "(1 day reminder)\r\nTRIGGER:-P1D" in text
    assert not any(line.startswith("ATTENDEE") for line in text.split("\r\n")) and text.count("BEGIN:VEVENT") == 1
    assert "".join(r.block for r in exports.csv_text(df.limit(1)).collect()) == exports.CSV_HEAD + '\r\n"2026-09-10","money","Rent, ""due""\r\nATTENDEE:x","",3,"","snip","a.pdf",90,"r"'
    assert exports.CSV_HEAD == "Date,Category,Title,Periodicity,Notice Days,Action Date,Summary,Source,Confidence,Reason"
    assert df.select(exports.file_slug(F.lit("  My Ünit -- Plan! "))).first()[0] == "my-nit-plan"


def test_horizon(spark):
    df = spark.sql("select date'2026-08-10' d union all select date'2026-08-13' union all select date'2026-08-14' union all select date'2026-10-01'")
    got = [tuple(r) for r in df.orderBy("d").select(horizon.bucket(F.col("d"), "2026-08-13"), horizon.relative_label(F.col("d"), "2026-08-13")).collect()]
    assert got == [("Overdue", "3 days overdue"), ("Next 30 days", "Today"), ("Next 30 days", "Tomorrow"), ("Later", "In 49 days")]


def test_register(spark):
    manifest = spark.createDataFrame([("a", 1, "f", "k1"), ("b", 1, "f", "k2"), ("c", 1, "", "k3"), ("d", 1, "f", "k4")], "path string, size long, fingerprint string, cache_key string")
    files = spark.createDataFrame([("a", "k1", "done"), ("d", "old", "done"), ("z", "k9", "skipped")], "path string, cache_key string, status string")
    cache = spark.createDataFrame([("k2",)], "cache_key string")
    assert {r.path: r.status for r in results.register(manifest, files, cache).collect()} == {"a": "done", "b": "cached", "d": "pending", "z": "skipped"}


def test_session_goes_on_where_it_stopped(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    (folder / "a.eml").write_text(TEXT)
    sessions.run(spark, str(folder), str(state), "2026-08-13").awaitTermination(120)
    (folder / "b.eml").write_text(TEXT.replace("2026-10-15", "2026-11-15"))
    sessions.run(spark, str(folder), str(state), "2026-08-13").awaitTermination(120)
    commitments, outcomes = sessions.state_of(spark, str(state))
    assert sorted(str(r.date) for r in commitments.collect()) == ["2026-10-15", "2026-11-15"] and outcomes.count() == 2


def test_sessions_reuse_what_is_unchanged(spark, tmp_path):
    import os

    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    a, b = folder / "a.eml", folder / "b.eml"
    a.write_text(TEXT)
    b.write_text(TEXT.replace("2026-10-15", "2026-11-15"))
    (folder / "big.csv").write_bytes(b"0" * (8 * 1024 * 1024 + 1))
    (folder / "bank.csv").write_text(BANK)
    (folder / ".hidden.eml").write_text(TEXT)
    asked = iter([False, True])
    first = sessions.resume(spark, str(folder), state, "2026-08-13", most_files=1, stop=lambda: next(asked))
    row = sessions.report(spark, state, first)[0].first()
    assert (row.status, row.total, row.files_processed, row.files_pending) == ("cancelled", 4, 1, 3)
    # the same session goes on
    assert sessions.resume(spark, str(folder), state, "2026-08-13") == first
    row, found, banks = sessions.report(spark, state, first)
    row = row.first()
    assert (row.status, row.files_processed, row.files_skipped, row.files_cached, row.files_pending, row.eta_seconds) == ("complete", 4, 1, 0, 0, 0)
    assert list(row.warnings) == ["big.csv: file is larger than 8 MB"]
    assert sorted(str(r.date) for r in found.collect()) == ["2026-10-15", "2026-11-15"]
    assert [(r.path, r.title, r.total_income) for r in banks.collect()] == [("bank.csv", "Bank Account Statement", 4500.0)]
    # the same name, size and time: not read again; b is new
    stat = a.stat()
    a.write_text(TEXT.replace("2026-10-15", "2026-12-15"))
    os.utime(a, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    b.write_text(TEXT.replace("2026-10-15", "2027-01-15") + " ")
    second = sessions.resume(spark, str(folder), state, "2026-08-13")
    row, found, _ = sessions.report(spark, state, second)
    row = row.first()
    assert second != first and (row.files_cached, row.files_processed, row.files_skipped) == (2, 4, 1)
    assert sorted(str(r.date) for r in found.collect()) == ["2026-10-15", "2027-01-15"]
    with pytest.raises(ValueError):
        sessions.set_status(spark, state, "none", "cancelled")


def test_envelope_and_report_of_nothing(spark):
    judged = spark.createDataFrame([], "path string, source string, line int, segment_no int, hit_no int, date date, category string, title string, document_id string, confidence int, id string, page int, domain string")
    outcomes = spark.createDataFrame([("b", 2, "b: x"), ("a", 3, None)], "path string, candidates long, warning string")
    row = results.envelope(outcomes, judged, judged, "2026-08-13").first()
    assert (row.files_scanned, row.files_skipped, row.dates_reviewed, row.noise_removed, row.commitments, list(row.warnings)) == (1, 1, 3, 3, 0, ["b: x"])
    assert [r.block for r in exports.report_text(judged, F.lit(1)).collect()] == ["Docketry found 0 commitments in 1 files.\n\n"]
    assert results.envelope(outcomes.limit(0), judged, judged, "2026-08-13").count() == 1
    paths = spark.createDataFrame([("a/my_file--x.tar.gz",), ("___.pdf",), ("",), ("a/don't stop.eml",)], "p string")
    assert [r[0] for r in paths.select(horizon.document_label(F.col("p"))).collect()] == ["My File X.Tar", "Untitled document", "Untitled document", "Don'T Stop"]
    shown = spark.range(1).select(horizon.bytes_label(F.lit(1536)), horizon.bytes_label(F.lit(1310720)), horizon.eta_label(F.lit(0.2)), horizon.eta_label(F.lit(61)), horizon.eta_label(F.lit(3700)), horizon.money_label(F.lit(-1234.5), F.lit("$"))).first()
    assert list(shown) == ["2 KB", "1.3 MB", "1 sec", "2 min", "1 hr 2 min", "$1,234.50"]
    items = spark.createDataFrame([("1", "a.PDF", 3), ("2", "b.eml", 3), ("3", "gone.pdf", None)], "id string, source string, page int")
    files = spark.createDataFrame([("a.PDF",), ("b.eml",)], "path string")
    assert {r.id: r.opens for r in horizon.with_source(items, files).collect()} == {"1": "a.PDF#page=3", "2": "b.eml", "3": None}


def test_a_root_with_an_ignored_name_has_no_files(spark, tmp_path):
    root = tmp_path / "node_modules"
    root.mkdir()
    (root / "a.eml").write_bytes(TEXT.encode())
    assert read_folder(spark, str(root)).collect() == [] and sessions.listing(spark, str(root)).collect() == []
    assert read_folder(spark, str(root / "..")).columns == ["path", "content", "modified", "warning"]


def test_folders_are_read_where_executors_lack_the_package(tmp_path):
    """Executors of their own, started elsewhere, with no path to the repository: the package comes with the job."""
    import os
    import subprocess
    import sys

    (tmp_path / "box").mkdir()
    (tmp_path / "box/a.eml").write_bytes(TEXT.encode())
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from docketry.sources.files import read_folder
print("READ", [r.content for r in read_folder(spark, {str(tmp_path / "box")!r}).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    out = subprocess.run(["timeout", "120", sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "READ ['Subject: Renewal" in out.stdout, out.stderr[-2000:]
