"""WARC records in ZIP-packaged archives, read by range without extraction.

Writing: each task streams its records into one ZIP of stored members: `archive/data.warc.gz`, each record a gzip member of its own, and
`indexes/index.tsv`, a line a record with offset and length inside the WARC. Offsets that outgrow 32 bits go into ZIP64 records. Of records
with equal payloads the one with the largest page_id is a response, the others are revisits without a body.

Reading: from the end of a file the end record, the ZIP64 locator and end record, and the central directory
are parsed from a few range reads; the stored members give the places of the WARC and the index; the index is
cut into runs of neighbouring records, the runs are dealt to tasks, and each task range-reads only its own.

Defined results: a null html is an empty payload; a null url leaves the target out. Rows that repeat a page_id stay apart; if the
largest page_id of a payload is repeated, all its rows are responses. A null page_id never is the largest unless
all are null; such rows are responses when no id is known. An empty table writes no files and reads no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import filesystem, scratch_path, ship, spill

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
#: Payload bytes that a task writes into one archive at most, about, and record bytes of one run of range reads.
FILE_BYTES, RUN_BYTES = 32 << 20, 4 << 20
#: The fixed date of records, so that a page's record is the same in every run.
DATE = "2024-01-01T00:00:00Z"


# ---- records

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:docketry:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    if not record_id:
        return None
    tail = record_id.rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit (HTTP head only) of the record of refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else "%%%02X" % ord(c) for c in url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(raw: bytes) -> dict:
    """What a record says; a response's digest and length are taken from its payload and must agree with its head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_headers(http)["content-length"]), h["warc-payload-digest"].partition(":")[2]
    if h["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {h['warc-record-id']}")
    return {"page_id": _page_id(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": _page_id(h.get("warc-refers-to")), "payload": payload if h["warc-type"] == "response" else None}


# ---- the ZIP package

END, END64, LOCATOR, ENTRY, LOCAL = (struct.Struct(x) for x in ("<4s4H2IH", "<4sQ2H2I4Q", "<4sIQI", "<4s6H3I5H2I", "<4s5H3I2H"))


def read_range(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Stored member -> (offset of its data, length), from the directories at the end of the file."""
    tail_at = max(0, size - END.size - 0xFFFF)
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, entries, dir_size, dir_at, _ = END.unpack_from(tail, at)
    if at >= LOCATOR.size and tail[at - LOCATOR.size :].startswith(b"PK\x06\x07"):
        end64 = LOCATOR.unpack_from(tail, at - LOCATOR.size)[2]
        x = END64.unpack(read_range(f, end64, END64.size))
        entries, dir_size, dir_at = x[7], x[8], x[9]
    raw, at, found = read_range(f, dir_at, dir_size), 0, {}
    for _ in range(entries):
        x = ENTRY.unpack_from(raw, at)
        if x[0] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, full, n_name, n_extra, n_note, offset = x[4], x[8], x[9], x[10], x[11], x[12], x[16]
        name = raw[at + ENTRY.size : at + ENTRY.size + n_name].decode()
        extra = raw[at + ENTRY.size + n_name : at + ENTRY.size + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:
                # only the fields that are full in the entry stand here, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        if method == 0:
            local = LOCAL.unpack(read_range(f, offset, LOCAL.size))
            found[name] = (offset + LOCAL.size + local[9] + local[10], full)
        at += ENTRY.size + n_name + n_extra + n_note
    return found


# ---- Spark: writing

def _payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, raw, key): key is the page_id and the payload's digest."""
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("raw"))
    return raw.withColumn("key", F.concat_ws(" ", F.sha2("raw", 256), F.col("page_id").cast("string")))


def references(slim: DataFrame, min_payload: int = 0) -> DataFrame:
    """(key, refers_to) of the revisits, from (page_id, key, size) of all pages: only digests and ids meet, and a payload that a third of all pages have is one row a task before it travels."""
    big = slim.filter(F.col("size") >= min_payload).withColumn("digest", F.substring("key", 1, 64))
    # written first, so that adaptive execution can split a hot digest in the join
    top = spill(big.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top is not null").select("digest", "top"), "warc-top")
    again = big.join(top.hint("merge"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("top")))
    return again.select("key", F.col("top").alias("refers_to")).distinct()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        name, index, at, n = f"pages-{uuid.uuid4().hex}.wacz", [], 0, 0

        def rows():
            yield from first.to_pylist()
            for b in batches:
                yield from b.to_pylist()

        with system.open_output_stream(f"{path}/{name}") as out, zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED) as z:
            with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                for r in rows():
                    record = gzip.compress(build_record(r["page_id"], r["url"], r["raw"], base32_sha1(r["raw"]), r["refers_to"]), 6, mtime=0)
                    member.write(record)
                    index.append(f"{at}\t{len(record)}\n")
                    at, n = at + len(record), n + 1
            with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                member.write("".join(index).encode())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "n"])

    return run


class _Forward:
    """A stream that only goes forward, as object stores give it: zipfile then writes sizes after the data."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives and give their listing (file, n). Files of lost attempts are never listed."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    rows = _payloads(pages, id_col, url_col, html_col)
    slim = spill(rows.select("page_id", "key", F.octet_length("raw").alias("size")), "warc-slim")
    total = slim.agg(F.sum(F.col("size") + 400).alias("n")).first()["n"] or 0
    # no fewer parts than a join has, else adaptive execution deals the payloads once more
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    # the payloads travel once, to the files that they are written to; what they refer to comes to them, dealt the same way
    dealt = rows.repartition(n, "key").join(references(slim, min_payload).repartition(n, "key").hint("shuffle_hash"), "key", "left")
    return spill(dealt.select("page_id", "url", "raw", "refers_to").mapInArrow(_write(folder), "file string, n long"), "warc-listing")


# ---- Spark: reading

def _runs(run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = filesystem(uri)
                with system.open_input_file(path) as f:
                    found = members(f, f.size())
                    (data_at, _), (index_at, index_n) = found[DATA], found[INDEX]
                    at, n, lengths, out = data_at, 0, [], []
                    for line in read_range(f, index_at, index_n).splitlines():
                        length = int(line.split(b"\t")[1])
                        lengths.append(length)
                        n += length
                        if n >= run_bytes:
                            out.append((at, n, lengths))
                            at, n, lengths = at + n, 0, []
                    if lengths:
                        out.append((at, n, lengths))
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(out), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["file", "at", "n", "lengths"])

    return run


_KINDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _records(with_payload: bool):
    kinds = {k: v for k, v in _KINDS.items() if with_payload or k != "payload"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, path = filesystem(r["file"])
                with system.open_input_file(path) as f:
                    raw = read_range(f, r["at"], r["n"])
                rows, at = [], 0
                for n in r["lengths"]:
                    rows.append(parse_record(gzip.decompress(raw[at : at + n])))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in kinds.items()], names=list(kinds))

    return run


def read(spark: SparkSession, files: DataFrame, with_payload: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per record of the listed archives."""
    ship(spark)
    n = max(spark.sparkContext.defaultParallelism, 1)
    runs = files.select("file").repartition(n).mapInArrow(_runs(run_bytes), "file string, at long, n long, lengths array<long>")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return spill(runs, "warc-runs").repartition(4 * n, "file", "at").mapInArrow(_records(with_payload), schema)
