"""Near-duplicate documents by SimHash and a hierarchical index over fingerprints in Gray order.

A fingerprint has a bit for each bit of the 64-bit hashes of a text's 3-word shingles (repeats count): 1 if it is set in over half of them.
Two fingerprints are linked if at most RADIUS of their bits differ.

Only distinct fingerprints are indexed. Links of RADIUS 3 leave one of the four quarters of 16 bits as it is, so every fingerprint is
filed four times, turned so that another quarter leads, and sorted by its Gray rank: neighbours in that order differ in few bits,
and the leading quarter is the masked pattern that the highest nodes share. Ranges of that order are dealt to tasks, which build
the index over their range: a node stands for up to FANOUT nodes below it and holds the bits in which all of its fingerprints agree, less those that
its own parent holds. A search goes down from the node of its leading quarter, adds up the differing bits node by node, and leaves a
group as soon as they exceed the radius. Links found are contracted inside the task; what leaves it is one link for each fingerprint at most.

A quarter's pattern can be shared by any number of fingerprints. Ranges cut such a group where they end, and the parts meet afterwards in
blocks of at most BLOCK fingerprints: two blocks are compared only if the bits that each has in common allow it. So no task holds a group.

Defined results: a text with fewer words than a shingle is one shingle; without words (null, empty, only white space) the fingerprint is zero and
linked like any other. Rows that repeat a doc_id have their own fingerprints and components. A row with null doc_id is no document: it links
nothing, and its component_id is null. Very long texts are hashed in runs. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import id_and_bytes, parts, ragged_take, ship, spill
from docketry.llm.minhash import merge

SHINGLE, SEED, RADIUS, QUARTER = 3, 42, 3, 16
#: Children of a node; fingerprints of a block; filed fingerprints of a range; shingles hashed, and pairs looked at, at once.
FANOUT, BLOCK, RANGE, AT_ONCE, FRONTIER = 16, 4096, 32_768, 1 << 16, 1 << 19

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIGN = np.uint64(1 << 63)


def fingerprint(raw: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    words = (raw or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts, ends = np.concatenate([[0], ends[:-1] + 1])[:n], ends[min(size, len(words)) - 1 :]
    digest, set_ = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, AT_ONCE):
        cut = zip(starts[lo : lo + AT_ONCE].tolist(), ends[lo : lo + AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(flat[a:b], seed) for a, b in cut], dtype="<u8")
        set_ += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        found = np.array([fingerprint(raw) for raw in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])


def filed(prints: DataFrame) -> DataFrame:
    """(quarter, rank): each fingerprint turned four times, as its Gray rank; the sign bit is flipped, so that ranks sort as unsigned numbers."""

    def rank(q: int) -> Column:
        x = F.shiftleft("print", QUARTER * q).bitwiseOR(F.shiftrightunsigned("print", 64 - QUARTER * q)) if q else F.col("print")
        for s in (1, 2, 4, 8, 16, 32):
            x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
        return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))

    return prints.select(F.explode(F.array(*[F.struct(F.lit(q).alias("quarter"), rank(q).alias("rank")) for q in range(64 // QUARTER)])).alias("x")).select("x.quarter", "x.rank")


def turned_back(codes: np.ndarray, quarter: np.ndarray) -> np.ndarray:
    """The fingerprints behind turned codes."""
    by = (quarter * QUARTER).astype(np.uint64)
    return np.where(by == 0, codes, (codes >> by) | (codes << (np.uint64(64) - np.maximum(by, np.uint64(1)))))


class GrayIndex:
    """Nodes over codes in Gray order, level by level from the codes up; the codes of one run have one root."""

    def __init__(self, codes: np.ndarray, run: np.ndarray):
        """run: which run each code belongs to, 0, 1, ... without gaps."""
        self.codes = codes
        #: from the top: (first child of each node and one more, pattern, bits that the node holds beyond its parent's, last code of the node)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        low = high = codes
        last, roots = np.arange(len(codes)), int(run[-1]) + 1 if len(run) else 0
        built = [(np.arange(len(codes) + 1), codes, np.full(len(codes), _ALL), last)]
        while len(run) > roots:
            first_of_run = np.searchsorted(run, np.arange(roots))
            place = (np.arange(len(run)) - first_of_run[run]) // FANOUT
            first = np.flatnonzero(np.concatenate([[True], (np.diff(run) != 0) | (np.diff(place) != 0)]))
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            last, run = last[np.append(first[1:], len(last)) - 1], run[first]
            built.append((np.append(first, len(place)), low, ~(low ^ high), last))
        for at, (first, pattern, mask, last) in enumerate(built):
            if at + 1 < len(built):
                above = built[at + 1]
                mask = mask & ~np.repeat(above[2], np.diff(above[0]))
            self.levels.insert(0, (first, pattern, mask, last))

    def search(self, queries: np.ndarray, roots: np.ndarray, after: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in queries, places of codes) within the radius; of each query only codes behind place `after`."""
        at = np.arange(len(queries))
        todo = [(0, at[i : i + FRONTIER // FANOUT], roots[i : i + FRONTIER // FANOUT], None) for i in range(0, len(at), FRONTIER // FANOUT)][::-1]
        while todo:
            level, query, node, far = todo.pop()
            first, pattern, mask, last = self.levels[level]
            far = np.bitwise_count((queries[query] ^ pattern[node]) & mask[node]) + (0 if far is None else far)
            keep = (far <= radius) & (last[node] > after[query])
            query, node, far = query[keep], node[keep], far[keep]
            if level + 1 == len(self.levels):
                if len(query):
                    yield query, node
                continue
            # nodes of this level give way to the ones below, a bounded number at a time
            n = first[node + 1] - first[node]
            cuts = [0, *np.flatnonzero(np.diff(np.cumsum(n) // FRONTIER) > 0).tolist(), len(n)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    own = n[lo:hi]
                    below = ragged_take(np.arange(first[-1]), first[node[lo:hi]], own)
                    todo.append((level + 1, np.repeat(query[lo:hi], own), below, np.repeat(far[lo:hi], own)))


def contract(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Add links between places to the labels, in place; the label of a component is its least place."""
    while True:
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label[label] != label).any():
            label[:] = label[label]


_OUT = "a long, b long, key int, part int, block int, mask long, pattern long, codes binary"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _table(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    kinds = {"a": pa.int64(), "b": pa.int64(), "key": pa.int32(), "part": pa.int32(), "block": pa.int32(), "mask": pa.int64(), "pattern": pa.int64(), "codes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(cols[c], kinds[c]) if c in cols else pa.nulls(n, kinds[c]) for c in _NAMES], names=_NAMES)


def _range(block: int):
    """The index of a range: links inside it, and the blocks of its first and last group, which may go on in other ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        quarter = np.concatenate([b.column(0).to_numpy() for b in got]).astype(np.int64)
        rank = np.concatenate([b.column(1).to_numpy() for b in got]).view(np.uint64) ^ _SIGN
        codes = rank ^ (rank >> np.uint64(1))
        key = quarter << QUARTER | (codes >> np.uint64(64 - QUARTER)).astype(np.int64)
        runs = np.concatenate([[0], np.cumsum(np.diff(key) != 0)])
        label = np.arange(len(codes))
        for a, b in GrayIndex(codes, runs).search(codes, runs, label.copy()):
            contract(label, a, b)
        at = np.flatnonzero(label != np.arange(len(label)))
        own = turned_back(codes, quarter).view(np.int64)
        yield _table(a=own[at], b=own[label[at]])
        part = TaskContext.get().partitionId()
        for r in {0, int(runs[-1])}:
            lo, hi = np.searchsorted(runs, [r, r + 1]).tolist()
            for k, i in enumerate(range(lo, hi, block)):
                some = codes[i : min(i + block, hi)]
                low, high = np.bitwise_and.reduce(some), np.bitwise_or.reduce(some)
                yield _table(key=[int(key[lo])], part=[part], block=[k], mask=[int((~(low ^ high)).view(np.int64))], pattern=[int(low.view(np.int64))], codes=[some.tobytes()])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of one group."""
    for b in batches:
        for key, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            label = np.arange(len(x) + len(y))
            for i, j in GrayIndex(y, np.zeros(len(y), dtype=np.int64)).search(x, np.zeros(len(x), dtype=np.int64), np.full(len(x), -1)):
                contract(label, i, j + len(x))
            at = np.flatnonzero(label != np.arange(len(label)))
            own = turned_back(np.concatenate([x, y]), np.full(len(label), key >> QUARTER)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[label[at]])], names=["a", "b"])


def links(prints: DataFrame, range_size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints which a chain of differences of RADIUS bits or fewer connects. prints: distinct."""
    ship(prints.sparkSession)
    n = 64 // QUARTER * prints.count()
    dealt = filed(prints).repartitionByRange(max(1, -(-n // range_size)), "quarter", "rank").sortWithinPartitions("quarter", "rank")
    out = spill(dealt.mapInArrow(_range(block), _OUT), "simhash-index", "lz4")
    blocks = out.filter("key is not null").select("key", "part", "block", "mask", "pattern")
    x = blocks.select("key", F.col("part").alias("part_x"), F.col("block").alias("block_x"), F.col("mask").alias("mx"), F.col("pattern").alias("px"))
    y = blocks.select("key", F.col("part").alias("part_y"), F.col("block").alias("block_y"), F.col("mask").alias("my"), F.col("pattern").alias("py"))
    far = F.bit_count(F.col("px").bitwiseXOR(F.col("py")).bitwiseAND(F.col("mx")).bitwiseAND(F.col("my")))
    pairs = x.join(y, "key").filter((F.col("part_x") < F.col("part_y")) & (far <= RADIUS)).select("key", "part_x", "block_x", "part_y", "block_y")
    for side in "xy":
        codes = out.filter("key is not null").select("key", F.col("part").alias(f"part_{side}"), F.col("block").alias(f"block_{side}"), F.col("codes").alias(f"codes_{side}"))
        pairs = pairs.join(codes.hint("merge"), ["key", f"part_{side}", f"block_{side}"])
    met = pairs.select("key", "codes_x", "codes_y").mapInArrow(_meet, "a long, b long")
    return out.filter("a is not null").select("a", "b").unionByName(met).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row; component_id is the smallest doc_id reachable."""
    ship(docs.sparkSession)
    prints = spill(id_and_bytes(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, print long"), "simhash-prints", "lz4")
    # copies count once, under the smallest of their ids
    distinct = spill(prints.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("head")), "simhash-distinct", "lz4")
    found = links(distinct.select("print"), range_size, block)
    for c in "ab":
        found = found.join(distinct.select(F.col("print").alias(c), F.col("head").alias(f"head_{c}")), c)
    roots = merge(None, found.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    if roots is None:
        known = distinct.select("print", F.col("head").alias("root"))
    else:
        known = distinct.join(roots.withColumnRenamed("id", "head"), "head", "left").select("print", F.coalesce("root", "head").alias("root"))
    # a fingerprint can have any share of the rows: a merging join is split by adaptive execution
    out = prints.join(known.hint("merge"), "print", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))
