"""Benchmark decontamination with suffix arrays over the training text.

Training documents are cut into shards. In each shard the words become numbers (0 for a word that no
benchmark item has) and a suffix array is built over the positions from which a window's worth of benchmark words follows;
positions where that cannot be are left out, which loses no match. Every test suffix is then searched in
every shard by bisection, all suffixes at once, to the depth of a window: the interval of training suffixes that begin with it gives
the places where it occurs. Words inside any occurrence of a window are hit, and its items are the document's; a document is contaminated
by a share of hit words. Places in a document are never paired with all places in the items: a match (item, place in the item, place
in the document, words) is found where it begins, which is where the words before its two places differ, and is followed
to its end, so each is the longest verbatim one of its two places, and they cost what they take to write down. They are made only where they are asked for.

The benchmark is dealt to blocks of about `block_bytes` of text. Tasks of their own prepare a block and write it to the shared folder;
a task over documents takes its shard through one block after the other and holds one block at a time, however large the
benchmark grows. There is one plan for any number of blocks, and no shuffle of documents.

Defined results: a null or empty text has no words and no hits. Items without words are no items. Items
that repeat an item_id count once (matches name the texts' places in either); equal texts under two ids count as two items. Rows that repeat a
doc_id, or have none, are judged each for itself.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.bpe import slices
from docketry.llm.common import filesystem, id_and_bytes, parts, ragged_take, scratch_path, ship

WINDOW = 13
#: Contaminated: at least one hit word, and MIN_SHARE times as many as words.
MIN_SHARE = 20
#: Most benchmark text in one block, and most training text in one shard of the suffix array.
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 8 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, every other ASCII character but digits and letters is a separator."""
    return (raw or b"").translate(_FOLD).split()


@dataclass
class Windows:
    """The distinct windows of one length, in order, and where they stand in the items."""

    rows: np.ndarray
    #: of each window the items that hold it: `items[own[w] : own[w + 1]]`
    own: np.ndarray
    items: np.ndarray
    #: places in `flat`, sorted by their window and the window before them in the item (or -1): `places[begins[w] : begins[w + 1]]`
    begins: np.ndarray
    places: np.ndarray
    before: np.ndarray
    #: the windows of the items one after the other, with -2 after each item, and where each item begins
    flat: np.ndarray
    starts: np.ndarray
    of_item: np.ndarray


def _windows(rows: list[np.ndarray], ids: list[int], k: int) -> Windows:
    n = np.array([len(w) - k + 1 for w in rows])
    distinct, window = np.unique(np.concatenate([np.lib.stride_tricks.sliding_window_view(w, k) for w in rows]), axis=0, return_inverse=True)
    window = np.asarray(window).reshape(-1)
    starts = np.cumsum(n + 1) - n - 1
    place = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(window))
    flat = np.full(int((n + 1).sum()), -2)
    flat[place] = window
    before = np.where(place > 0, flat[np.maximum(place, 1) - 1], -2)
    before[before == -2] = -1
    order = np.lexsort((place, before, window))
    pairs = np.unique(np.stack([window, np.repeat(ids, n)], axis=1), axis=0)
    edges = np.arange(len(distinct) + 1)
    return Windows(distinct, np.searchsorted(pairs[:, 0], edges), pairs[:, 1], np.searchsorted(window[order], edges), place[order], before[order], flat, starts, np.array(ids))


class Tests:
    """The windows of a block of items, numbered words, grouped by window length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, raw in items:
            w = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(raw)], dtype=np.int64)
            if len(w):
                rows.setdefault(min(window, len(w)), []).append((w, len(self.items)))
                self.items.append(item_id)
        self.windows = {k: _windows([w for w, _ in own], [i for _, i in own], k) for k, own in rows.items()}

    def save(self, out) -> None:
        """As arrays; words hold no line ends."""
        arrays = {f"{k}-{f.name}": getattr(w, f.name) for k, w in self.windows.items() for f in fields(w)}
        text = {"vocab": b"\n".join(self.vocab), "items": json.dumps(self.items).encode()}
        np.savez(out, **arrays, **{name: np.frombuffer(x, dtype=np.uint8) for name, x in text.items()})

    @staticmethod
    def load(raw: bytes) -> Tests:
        got, out = np.load(io.BytesIO(raw)), Tests([], 1)
        out.vocab = {w: i for i, w in enumerate(got["vocab"].tobytes().split(b"\n"), 1) if w}
        out.items = json.loads(got["items"].tobytes())
        lengths = {int(name.split("-")[0]) for name in got.files if "-" in name}
        out.windows = {k: Windows(*(got[f"{k}-{f.name}"] for f in fields(Windows))) for k in sorted(lengths)}
        return out


def suffix_array(codes: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts in order of the depth codes from each (the caller pads codes)."""
    keys = [codes[starts + i] for i in range(depth)]
    return starts[np.lexsort(keys[::-1])]


def search(codes: np.ndarray, order: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window (a row) the interval of `order` whose suffixes begin with it: the interval is narrowed word by word, by bisection for all windows at once."""
    low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(order), dtype=np.int64)
    for i in range(windows.shape[1]):
        want = windows[:, i]
        low, high = _bisect(codes, order, i, want, low, high, False), _bisect(codes, order, i, want, low, high, True)
    return low, high


def _bisect(codes, order, at, want, low, high, right):
    lo, hi = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        got = codes[order[mid] + at]
        up = got <= want[open_] if right else got < want[open_]
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]


@dataclass
class Found:
    """What a shard has of a block: per text its number of words and its hit words (places in the text); (text, item) pairs; and, if they
    are asked for, matches as arrays (text, item, place in the text, place in the item, words)."""

    n_words: np.ndarray
    hits: list[np.ndarray]
    pairs: np.ndarray
    matches: np.ndarray


def match_shard(texts: list[bytes | None], tests: Tests, with_matches: bool = True) -> Found:
    get = tests.vocab.get
    rows = [[get(w, 0) for w in words_of(t)] for t in texts]
    n_words = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    longest = max(tests.windows, default=1)
    # a 0 after each text, so that no match runs on into the next one
    codes = np.zeros(int(n_words.sum()) + len(rows) + longest + 1, dtype=np.int64)
    bounds = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(n_words + 1, out=bounds[1:])
    for at, row in zip(bounds, rows, strict=False):
        codes[at : at + len(row)] = row
    gaps = np.flatnonzero(codes == 0)
    room = gaps[np.searchsorted(gaps, np.arange(len(codes) - longest))] - np.arange(len(codes) - longest)
    edge, n_items = np.zeros(len(codes) + 1, dtype=np.int64), max(1, len(tests.items))
    pairs, matches = np.zeros(0, dtype=np.int64), [np.zeros((5, 0), dtype=np.int64)]
    for k, w in tests.windows.items():
        starts = np.flatnonzero(room >= k)
        if not len(starts):
            continue
        order = suffix_array(codes, starts, k)
        low, high = search(codes, order, w.rows)
        # a place begins one window at most, so these are no more than the shard's words
        place, window = order[ragged_take(np.arange(len(order)), low, high - low)], np.repeat(np.arange(len(low)), high - low)
        if not len(place):
            continue
        np.add.at(edge, place, 1)
        np.add.at(edge, place + k, -1)
        text = np.searchsorted(bounds, place, side="right") - 1
        seen = np.unique(text * len(low) + window)
        t, v = seen // len(low), seen % len(low)
        for lo, hi in _bounded(np.diff(w.own)[v]):
            n = np.diff(w.own)[v[lo:hi]]
            pairs = np.union1d(pairs, np.repeat(t[lo:hi], n) * n_items + ragged_take(w.items, w.own[v[lo:hi]], n))
        if with_matches:
            matches += _diagonals(place, window, w, k, bounds, len(codes))
    hit = np.cumsum(edge)[: len(codes)] > 0
    some = set((pairs // n_items).tolist())
    hits = [np.flatnonzero(hit[bounds[i] : bounds[i + 1]]) if i in some else np.zeros(0, dtype=np.int64) for i in range(len(rows))]
    return Found(n_words, hits, np.stack([pairs // n_items, pairs % n_items]), np.concatenate(matches, axis=1))


def _bounded(sizes: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes add up to about limit."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield at, end
        at = end


def _diagonals(place: np.ndarray, window: np.ndarray, w: Windows, k: int, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The longest verbatim matches: each begins where the windows before its two places differ, and goes on as long as the windows are the same."""
    at = np.full(size + 1, -1)
    at[place] = window
    before = at[place - 1]  # of place 0 the last entry, which is -1
    # of a window's places in the items all but those with the same window before them
    key = w.before + 1 + np.repeat(np.arange(len(w.rows)), np.diff(w.begins)) * (len(w.rows) + 1)
    lo, hi = (np.searchsorted(key, window * (len(w.rows) + 1) + before + 1, side=side) for side in ("left", "right"))
    hi = np.where(before < 0, lo, hi)
    first, second = lo - w.begins[window], w.begins[window + 1] - hi
    for a, b in _bounded(first + second):
        p = np.concatenate([np.repeat(place[a:b], n[a:b]) for n in (first, second)])
        q = np.concatenate([ragged_take(w.places, start[a:b], n[a:b]) for start, n in ((w.begins[window], first), (hi, second))])
        words, on, step = np.full(len(p), k), np.arange(len(p)), 1
        while len(on):
            # -1 ends a run in the text, -2 in the item
            on = on[at[p[on] + step] == w.flat[q[on] + step]]
            words[on] += 1
            step += 1
        text, item = np.searchsorted(bounds, p, side="right") - 1, np.searchsorted(w.starts, q, side="right") - 1
        yield np.stack([text, w.of_item[item], p - bounds[text], q - w.starts[item], words])


_loaded: dict[str, Tests] = {}


def _load(uri: str) -> Tests:
    """A block; a worker process keeps the one that it used last."""
    if uri not in _loaded:
        _loaded.clear()
        system, path = filesystem(uri)
        with system.open_input_stream(path) as f:
            _loaded[uri] = Tests.load(f.read())
    return _loaded[uri]


_MATCH = [("item", pa.string()), ("at", pa.int64()), ("item_at", pa.int64()), ("words", pa.int64())]
_COUNTS = "doc_id long, n_words long, n_hit long, items array<string>"
_SCHEMA = _COUNTS + ", matches array<struct<item:string,at:long,item_at:long,words:long>>, longest long"


def _match(blocks: list[str], shard_bytes: int, with_matches: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1, shard_bytes):
            texts = b.column(1).to_pylist()
            hits: list[list[np.ndarray]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            names, matches = [], [np.zeros((5, 0), dtype=np.int64)]
            n_words = [len(words_of(t)) for t in texts] if not blocks else None
            for uri in blocks:
                tests = _load(uri)
                found = match_shard(texts, tests, with_matches)
                n_words = found.n_words
                for i, j in found.pairs.T.tolist():
                    items[i].add(tests.items[j])
                for i in np.unique(found.pairs[0]).tolist():
                    hits[i].append(found.hits[i])
                found.matches[1] += len(names)
                names += tests.items
                matches.append(found.matches)
            n_hit = [0 if not h else len(h[0]) if len(h) == 1 else len(np.unique(np.concatenate(h))) for h in hits]
            cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(own) for own in items], pa.list_(pa.string()))]
            if with_matches:
                cols += _match_columns(np.concatenate(matches, axis=1), names, len(texts))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "items", "matches", "longest"][: len(cols)])

    return run


def _match_columns(matches: np.ndarray, names: list[str], n: int) -> list[pa.Array]:
    """(matches of each text, the words of its longest) as Arrow has them, without a Python object a match."""
    text, item, at, item_at, words = matches[:, np.lexsort((matches[2], matches[1], matches[0]))]
    flat = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(item)), pa.array(at), pa.array(item_at), pa.array(words)], fields=[pa.field(*x) for x in _MATCH])
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, text, words)
    return [pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), flat), pa.array(longest)]


def _prepare(folder: str, window: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        for items, raws in slices(batches, block_bytes):
            name, packed = f"block-{uuid.uuid4().hex}.npz", io.BytesIO()
            Tests(list(zip(items, raws, strict=True)), window).save(packed)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(packed.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["block"])

    return run


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[str]:
    """The prepared blocks: a path for each block_bytes of benchmark text. Blocks of lost attempts are never listed."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("raw")).filter(F.col("item").isNotNull() & F.col("raw").isNotNull())
    total = items.agg(F.sum(F.octet_length("raw")).alias("n")).first()["n"] or 0
    dealt = items.dropDuplicates(["item", "raw"]).repartition(max(1, -(-total // block_bytes)), "item", "raw")
    return sorted(r["block"] for r in dealt.mapInArrow(_prepare(scratch_path(spark, "bench-blocks"), window, block_bytes), "block string").collect())


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, with_matches: bool = True) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items[, matches, longest], contaminated) for every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    blocks = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    found = id_and_bytes(docs, id_col, text_col).mapInArrow(_match(blocks, shard_bytes, with_matches), _SCHEMA if with_matches else _COUNTS)
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * MIN_SHARE >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", *(("matches", "longest") if with_matches else ()), contaminated.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; decided row by row, so nothing is shuffled and repeated ids need no join."""
    ship(docs.sparkSession)
    blocks = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)

    @F.pandas_udf("boolean")
    def clean(raw):
        import pandas as pd

        raws, n_hit, n_words = list(raw), [], []
        for b in parts([pa.RecordBatch.from_arrays([pa.nulls(len(raws), pa.int64()), pa.array(raws, pa.binary())], names=["doc_id", "raw"])], 1, SHARD_BYTES):
            for found in _match(blocks, SHARD_BYTES, False)([b]):
                n_words += found.column(1).to_pylist()
                n_hit += found.column(2).to_pylist()
        return pd.Series([not (h and h * MIN_SHARE >= n) for h, n in zip(n_hit, n_words, strict=True)], dtype=bool)

    return docs.filter(clean(F.col(text_col).cast("binary")))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
