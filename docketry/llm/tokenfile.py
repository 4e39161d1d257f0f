"""Token ids in a binary file format: frequency-ranked ids, byte-aligned lengths, separate control bytes.

The ids of the whole corpus are counted; an id is stored as its rank by falling count (ties: smaller id), so
that frequent ids take one byte. Four ranks share a control byte with two bits each (length 1 to 4 bytes, low
bits first); control bytes and data bytes are two separate streams. Decoding looks up each control byte's four
lengths in a table and gathers the data with numpy.

A file holds documents in ascending doc_id: magic, version, number of documents, then per document its id,
its start among all ids of the corpus and its number of ids, then the table rank -> id, then control and data streams.
Documents are dealt by ranges of doc_id; a part's start is the sum of the parts before it, from one number a part,
and each run of consecutive rows of a part becomes a file.
A task writes its file under a name of its own and reports it; files of lost attempts are never listed.

Defined results: a null or empty text has only the end id. Rows that repeat a doc_id stay apart, in the order of their
texts; a null doc_id comes first. An empty table gives no files and no rows. With `added_tokens` the tokenizer file's added
tokens that occur in a text get their own ids, as the library has it by default; otherwise they are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import filesystem, free_shuffles, id_and_bytes, parts as slices, ragged_take, scratch_path, ship, spill
from docketry.llm.pieces import cut_column, heads_and_tails

MAGIC, VERSION = b"DKTI", 1
#: The head: magic, version, documents, size of the rank table, ids, bytes of data.
HEAD = struct.Struct("<4sIQQQQ")
#: Most text encoded at once, and most words and pieces whose ids a Python worker keeps (for speed only).
SHARD_BYTES, KEPT_PARTS, KEPT_LENGTH = 8 << 20, 600_000, 48
#: Text that goes to one file.
FILE_BYTES = 24 << 20
NULL_ID = -(1 << 63)

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    grid = ranks.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), grid[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that pack() made."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    grid = np.zeros((n, 4), dtype=np.uint8)
    grid[np.arange(4) < size[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return grid.view("<u4").reshape(-1)


_encoders: dict[tuple[int, bool], "Encoder"] = {}


class Encoder:
    """The tokenizer, and the ids of the words and other pieces met so far."""

    #: Words handed to the tokenizer as one pretokenized text.
    TOGETHER = 2000

    def __init__(self, text: str, added_tokens: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        #: Text around an added token is tokenized by itself, so a text that holds one is never cut.
        self.whole = re.compile("|".join(map(re.escape, added))) if added else None
        steps = json.loads(text)
        first = steps.get("pre_tokenizer") or {}
        #: Texts may be cut where the byte-level pattern always cuts, and only where nothing else looks at them.
        self.cuts = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not any(steps.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        #: The same model for words that are cut already.
        self.words = Tokenizer.from_str(text)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.words.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # byte level: a character for each byte
        self.kept: dict[str, bytes] = {"": b""}

    def _new(self, new: list[str], single: list[bool], width: int) -> Iterator[tuple[str, bytes]]:
        """Ids of parts; those that are single tokens of the pattern go to the model together, the others each by itself."""
        own = [p for p, s in zip(new, single, strict=True) if s]
        groups = [own[i : i + self.TOGETHER] for i in range(0, len(own), self.TOGETHER)]
        for group, e in zip(groups, self.words.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=f"<u{width}")
            # the bytes behind the ids tell the words apart again
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in group])) + 1
            raw, bounds = ids.tobytes(), [0, *(ends * width).tolist()]
            yield from ((p, raw[bounds[i] : bounds[i + 1]]) for i, p in enumerate(group))
        rest = [p for p, s in zip(new, single, strict=True) if not s]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            yield p, np.array(e.ids, dtype=f"<u{width}").tobytes()

    def texts(self, texts: pa.Array, width: int, end: bytes) -> tuple[np.ndarray, bytes]:
        """(number of ids of each text, little-endian ids of width bytes), each text's ids closed by end; equal parts are encoded once."""
        if self.cuts:
            distinct, at, lengths = cut_column(texts, self.whole)
            parts, single, heads, tails = heads_and_tails(distinct)
        else:
            coded = pc.fill_null(texts, "").dictionary_encode()
            parts, at, lengths = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.ones(len(texts), dtype=np.int64)
            single, heads, tails = np.zeros(len(parts), dtype=bool), np.arange(len(parts)), None
        kept = self.kept
        found = list(map(kept.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        own = dict(self._new([parts[i] for i in missing], single[missing].tolist(), width))
        for i in missing:
            found[i] = own[parts[i]]
        if len(kept) > KEPT_PARTS:
            # what occurs here stays: the frequent parts are among it
            self.kept = kept = {"": b""} | {p: x for p, x in zip(parts, found, strict=True) if p in kept}
        kept.update((p, x) for p, x in own.items() if len(p) <= KEPT_LENGTH)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // width
        # the end id is one more part, after each text's last
        sizes, stops = np.append(sizes, len(end) // width), np.cumsum(lengths)
        order = heads[at] if tails is None else np.stack([heads[at], tails[at]], axis=1).reshape(-1)
        order = np.insert(order, stops * (1 if tails is None else 2), len(parts))
        flat = np.frombuffer(b"".join([*found, end]), dtype=f"<u{width}")
        total = np.concatenate([[0], np.cumsum(sizes[order])])
        closed = total[stops * (1 if tails is None else 2) + np.arange(1, len(texts) + 1)]
        return np.diff(closed, prepend=0), ragged_take(flat, (np.cumsum(sizes) - sizes)[order], sizes[order]).tobytes()


def _encoder(shared, added_tokens: bool) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    key = zlib.crc32(shared.value.encode()), added_tokens
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, added_tokens)
    return _encoders[key]


def _strings(raw: pa.Array) -> pa.Array:
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([(x or b"").decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _encode(shared, end_id: int, width: int, added_tokens: bool):
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, added_tokens)
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for b in slices(batches, 1, SHARD_BYTES):
            n, flat = encoder.texts(_strings(b.column(1)), width, end)
            offsets = np.concatenate([[0], np.cumsum(n) * width]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            cols = [pa.array(np.full(len(n), part)), pa.array(np.arange(row, row + len(n))), pa.array(before + np.cumsum(n) - n), b.column(0), ids]
            row, before = row + len(n), before + int(n.sum())
            yield pa.RecordBatch.from_arrays(cols, names=["part", "row", "before", "doc_id", "ids"])

    return run


def _count(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=f"<u{width}"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def write_file(out, doc_ids: np.ndarray, n_tokens: np.ndarray, start: int, ids: np.ndarray, rank_of: np.ndarray, id_of: np.ndarray) -> None:
    control, data = pack(rank_of[ids])
    starts = start + np.cumsum(n_tokens) - n_tokens
    out.write(HEAD.pack(MAGIC, VERSION, len(doc_ids), len(id_of), len(ids), len(data)))
    for x in (doc_ids.astype("<i8"), starts.astype("<i8"), n_tokens.astype("<i8"), id_of.astype("<u4")):
        out.write(x.tobytes())
    out.write(control)
    out.write(data)


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, starts, n_tokens, ids) of a file."""
    magic, version, n_docs, n_ranks, n_ids, n_data = HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file")
    at, cols = HEAD.size, []
    for kind, n in (("<i8", n_docs), ("<i8", n_docs), ("<i8", n_docs), ("<u4", n_ranks)):
        cols.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += cols[-1].nbytes
    n_control = -(-n_ids // 4)
    ranks = unpack(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], n_ids)
    return cols[0], cols[1], cols[2], cols[3][ranks]


def _write(shared, folder: str, width: int):
    """Each run of consecutive rows of one part goes to one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, starts = shared.value
        rank_of = np.zeros(int(id_of.max(initial=0)) + 1, dtype=np.uint32)
        rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)

        def close(rows: list[tuple]) -> pa.RecordBatch:
            part, row, before = rows[0][:3]
            blobs = [x[4] for x in rows]
            ids = np.frombuffer(b"".join(blobs), dtype=f"<u{width}")
            n_tokens = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // width
            name = f"ids-{part:06d}-{row:09d}-{uuid.uuid4().hex}.dkti"
            with system.open_output_stream(f"{path}/{name}") as out:
                write_file(out, np.array([NULL_ID if x[3] is None else x[3] for x in rows]), n_tokens, int(starts[part]) + before, ids, rank_of, id_of)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([row], pa.int64()), pa.array([f"{folder}/{name}"])], names=["part", "row", "file"])

        rows: list[tuple] = []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and (x[0], x[1]) != (rows[-1][0], rows[-1][1] + 1):
                    yield close(rows)
                    rows = []
                rows.append(x)
        if rows:
            yield close(rows)

    return run


def write(docs: DataFrame, tokenizer_json: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, added_tokens: bool = False) -> DataFrame:
    """Encode docs and write the files; gives their listing (part, row, file), which in the order of part and row ascends by doc_id."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "token-files")
    with open(tokenizer_json, encoding="utf-8") as f:
        text = f.read()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(text).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    raw = id_and_bytes(docs, id_col, text_col)
    # one number from every row sizes the files; then the texts are dealt by ranges of doc_id, once
    total = raw.agg(F.sum(F.coalesce(F.octet_length("raw"), F.lit(0)) + 16).alias("n")).first()["n"] or 0
    ordered = raw.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", F.xxhash64("raw")).sortWithinPartitions("doc_id", "raw")
    encoded = spill(ordered.mapInArrow(_encode(spark.sparkContext.broadcast(text), end_id, width, added_tokens), "part long, row long, before long, doc_id long, ids binary"), "token-ids")
    del ordered
    free_shuffles(spark)
    # at most one row for each entry of the vocabulary, and one for each file
    counts = encoded.select("ids").mapInArrow(_count(width, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    id_of = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], dtype=np.int64)
    sizes = encoded.groupBy("part").agg(F.sum(F.octet_length("ids")).alias("n")).orderBy("part").toArrow()
    part, n = (sizes.column(c).to_numpy().astype(np.int64) for c in ("part", "n"))
    # a number each: 32 MB for the parts of 100 TB
    starts = np.zeros(int(part.max(initial=-1)) + 1, dtype=np.int64)
    starts[part] = (np.cumsum(n) - n) // width
    shared = spark.sparkContext.broadcast((id_of, starts))
    return spill(encoded.mapInArrow(_write(shared, folder, width), "part long, row long, file string"), "token-listing")


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = filesystem(uri)
                with system.open_input_stream(path) as f:
                    doc_ids, starts, n_tokens, ids = read_file(f.read())
                little = ids.astype("<u4").tobytes()
                ends = np.cumsum(n_tokens) * 4
                parts = [little[e - 4 * n : e] for e, n in zip(ends.tolist(), n_tokens.tolist(), strict=True)]
                cols = {"doc_id": pa.array(doc_ids, mask=doc_ids == NULL_ID), "start": pa.array(starts), "n_tokens": pa.array(n_tokens), "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def read(spark: SparkSession, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the listed files, decoded from their bytes."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.select("file").mapInArrow(_read(with_ids), schema)
