"""Folders of files as a DataFrame of texts: Spark lists and reads, small helpers decode inside tasks."""

from __future__ import annotations

import contextlib
import email
import email.policy
import io
import re
import signal
import threading
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.text import clean
from docketry.operators.policy import file_warning
from docketry.sources.shared import ship


class Unreadable(ValueError):
    """A file that can't be read, with the reason that is shown."""


def relative(path: str):
    """The path column of a binary source under the folder `path`, relative to it."""
    root = re.escape(path.rstrip("/") + "/")
    return F.regexp_replace("path", "^(?:[a-z0-9]+:)?(?://[^/]*(?=/))?" + root if path.startswith("/") else "^" + root, "")


def _any_case(suffixes) -> str:
    """A file pattern for names that end with one of the suffixes, in small letters or capitals."""
    return "{" + ",".join("*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in suffixes) + "}"


def ignored_root(path: str) -> bool:
    """Whether a folder's own name is hidden or one of those that are not looked into."""
    name = path.rstrip("/").rpartition("/")[2]
    return name.startswith(".") and name.strip(".") != "" or name.lower() in V.IGNORED_DIRECTORIES


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, modified, warning) of a folder's files. Paths are relative to it. A folder whose own name is ignored has none.

    Two scans: one of the names and sizes of all files, which reads no bytes, for those that are not read; and one of the bytes of
    files of the kinds and sizes that are, as a pattern of names and a pushed filter.
    """
    if ignored_root(path):
        return spark.createDataFrame([], "path string, content string, modified string, warning string")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    every = source.load(path)
    small = source.option("pathGlobFilter", _any_case(V.DOCUMENT_EXTENSIONS + V.IMAGE_EXTENSIONS)).load(path).filter(F.col("length") <= V.MAX_FILE_BYTES)

    def judged(raw: DataFrame, content) -> DataFrame:
        listed = raw.select(relative(path).alias("path"), "length", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), content.alias("content"))
        return listed.withColumn("warning", file_warning(F.col("path"), F.col("length"), F.lit(None).cast("string")))

    unread = judged(every, F.lit(None).cast("binary")).filter(F.col("warning").isNotNull() & ~F.col("warning").startswith(V.IGNORED_DIRECTORY))
    return decode(judged(small, F.col("content")).filter("warning is null").unionByName(unread))


def decode(files: DataFrame, seconds: float = V.READER_SECONDS) -> DataFrame:
    """files (path, modified, content bytes, warning) with the content as clean text; those that can't be read, or not within so many
    seconds, get a warning instead of an error."""
    ship(files.sparkSession)
    own = files.select("path", "modified", "warning", F.when(F.col("warning").isNull(), F.col("content")).alias("content"))
    out = own.mapInPandas(_decode(seconds), "path string, modified string, warning string, content string")
    return out.select("path", clean(F.col("content")).alias("content"), "modified", "warning")


def uploads(items: DataFrame) -> DataFrame:
    """Items (path, content, encoding, modified, skip_reason) as files with bytes: base64 is checked, text is taken as UTF-8."""
    bytes_ = F.when(F.lower("encoding") == "base64", F.call_function("try_to_binary", "content", F.lit("base64"))).otherwise(F.col("content").cast("binary"))
    bad = F.when(bytes_.isNull() & F.col("content").isNotNull(), F.concat("path", F.lit(": invalid base64 data")))
    warning = F.coalesce(file_warning(F.col("path"), F.octet_length(bytes_), F.col("skip_reason")), bad)
    return items.select("path", "modified", warning.alias("warning"), bytes_.alias("content"))


def _decode(seconds: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, warnings = [], []
            for path, raw, warning in zip(f.path, f.content, f.warning, strict=True):
                text = None
                if raw is not None and not warning:
                    try:
                        with deadline(seconds):
                            text = text_of(path, bytes(raw))
                    except Unreadable as e:
                        warning = f"{path}: {e}"
                    except Exception:  # a damaged file must not end the job
                        warning = f"{path}: unreadable file"
                texts.append(text)
                warnings.append(warning or None)
            yield pd.DataFrame({"path": f.path, "modified": f.modified, "warning": warnings, "content": texts})

    return run


@contextlib.contextmanager
def deadline(seconds: float):
    """Unreadable after so many seconds. A worker reads in its main thread, where an alarm can interrupt it."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_) -> None:
        raise Unreadable(V.TOO_SLOW.format(f"{seconds:g}"))

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def text_of(path: str, raw: bytes) -> str:
    kind = path[path.rfind(".") :].lower()
    if kind in V.IMAGE_EXTENSIONS:
        raise Unreadable("image support requires an OCR library")
    readers = {".csv": plain, ".xlsx": sheet, ".docx": document, ".pages": pages, ".eml": mail}
    if kind in (".pdf", ".msg"):
        raise Unreadable(f"{kind[1:].upper()} support requires an optional library")
    if kind not in readers:
        raise Unreadable("unsupported file type")
    return readers[kind](raw)


def plain(raw: bytes) -> str:
    if b"\x00" in raw[:2048] and not raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise Unreadable("binary data")
    for codec in ("utf-8-sig", "utf-16", "cp1252"):
        try:
            return raw.decode(codec)
        except UnicodeError:
            continue
    return raw.decode("utf-8", "replace")


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    """A member of a package, unless it unpacks to something far too large."""
    info = z.getinfo(name)
    if info.file_size > V.MAX_ENTRY_BYTES or info.file_size > V.BOMB_BYTES and info.file_size > V.BOMB_RATIO * max(1, info.compress_size):
        raise Unreadable("archive entry is too large")
    return z.read(name)


def _xml(raw: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise Unreadable("document type declarations are not allowed")
    return ElementTree.fromstring(raw)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def document(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = _xml(_entry(z, "word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in root.iter() if _local(p) == "p")


def sheet(raw: bytes) -> str:
    """The first sheet's rows, cells joined by pipes, blank columns kept by the cells' references."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _xml(_entry(z, "xl/sharedStrings.xml")) if _local(si) == "si"]
        sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
        if not sheets:
            raise Unreadable("no sheets")
        root = _xml(_entry(z, "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in sheets else sheets[0]))
    out = []
    for row in (e for e in root.iter() if _local(e) == "row"):
        cells: list[str] = []
        for c in (e for e in row if _local(e) == "c"):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [""] * (at - len(cells))
            value = next((v.text or "" for v in c if _local(v) == "v"), "")
            if c.get("t") == "s" and value:
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
            cells.append(value.strip())
        if any(cells):
            out.append(" | ".join(cells))
    return "\n".join(out)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def pages(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "index.xml" not in z.namelist():
            raise Unreadable("no readable preview")
        return "\n".join(t.strip() for t in _xml(_entry(z, "index.xml")).itertext() if t.strip())


def mail(raw: bytes) -> str:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    parts = [f"Subject: {message['subject']}"] if message["subject"] else []
    for part in message.walk():
        if part.get_content_type() == "text/plain" and part.get_content_disposition() != "attachment":
            parts.append(part.get_content())
    return "\n".join(parts)
