"""Byte-level BPE encoding and decoding by merge replay over a corpus shard.

A task takes its documents in shards of bounded size. The distinct pre-tokens of a shard form one long chain
of byte tokens, with an inverted index from token pair to the positions where the pair stands. The merges
of the vocabulary are replayed in rank order over the whole shard: the lowest rank present is taken from a heap, all its positions are merged
from left to right, and only the pairs with the touched neighbours enter the index. A merge that creates a pair of lower
rank than its own yields to it at once, so the result is that of merging each pre-token by itself. Shards
never interact, as no merge crosses a pre-token, so there is no shuffle at all.

A pre-token that is a vocabulary entry is that id. Decoding concatenates the entries' bytes by table lookup.

Defined results: a null or empty text has no ids. Every text round-trips, whatever its characters and length.
Repeated rows and null ids are encoded each for itself; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import id_and_bytes, ragged_take, ship
from docketry.llm.pieces import pieces

#: Most text in one shard, and most pre-tokens whose ids a Python worker keeps from earlier shards (for speed only).
SHARD_BYTES, KEPT_WORDS = 8 << 20, 600_000
#: Ids take fewer bits than this in a pair's key.
SHIFT = 24


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 of the entry, a space, its rank, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Vocabulary:
    """Ranks, the bytes of each id, and the ids of token pairs met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.findall = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.words: dict[str, bytes] = {}
        self._pairs(size)

    def _pairs(self, size: int) -> None:
        """Every pair of entries that makes an entry: sorted keys, the ids they merge to, and the ids after whose making a lower rank may come up."""
        keys, made, get = [], [], self.ranks.get
        for raw, i in self.ranks.items():
            for k in range(1, len(raw)):
                a = get(raw[:k])
                if a is not None and (b := get(raw[k:])) is not None:
                    keys.append(a << SHIFT | b)
                    made.append(i)
        keys, made = np.array(keys, dtype=np.int64), np.array(made, dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = np.append(keys[order], np.iinfo(np.int64).max), np.append(made[order], -1)
        self.yields = np.zeros(size, dtype=bool)
        for part in (keys >> SHIFT, keys & ((1 << SHIFT) - 1)):
            self.yields[part[made < part]] = True

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids (ranks) that the pairs merge to, -1 where they don't; negative tokens join with nothing."""
        keys = np.where((a >= 0) & (b >= 0), a << SHIFT | b, -1)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_made[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.flat, self.starts[ids], self.lengths[ids]).tobytes()

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids (little-endian, 32 bits each) of the distinct pre-tokens, by replay over all those not known yet."""
        if len(self.words) > KEPT_WORDS:
            # what occurs here stays: the frequent pre-tokens are among it
            self.words = {w: x for w, x in self.words.items() if w in words}
        known, new, raws = self.words, [], []
        for w in sorted(w for w in words if w not in known):
            raw = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                known[w] = whole.to_bytes(4, "little")
            else:
                new.append(w)
                raws.append(raw)
        known.update(zip(new, (ids.astype("<u4").tobytes() for ids in replay(raws, self)), strict=True))
        return known


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Replay the merges in rank order over all words at once."""
    if not words:
        return []
    # one chain of tokens; -1 stands between words and joins with nothing
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    heads = np.cumsum(sizes + 1) - sizes
    n = int(sizes.sum()) + len(words) + 1
    token, word = np.full(n, -1, dtype=np.int64), np.repeat(np.arange(len(words) + 1), np.append(1, sizes + 1))
    inside = np.ones(n, dtype=bool)
    inside[0] = inside[heads + sizes] = False
    token[inside] = vocabulary.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    # the inverted index: by the rank of the merge that the pair asks for, the places of the pair's left token
    where: dict[int, list[int]] = {}

    def enter(ranks: np.ndarray, at: np.ndarray) -> None:
        for r, i in zip(ranks.tolist(), at.tolist(), strict=True):
            if r in where:
                where[r].append(i)
            else:
                where[r] = [i]
                heapq.heappush(queue, r)

    queue: list[int] = []
    first = vocabulary.merged(token[:-1], token[1:])
    found = np.flatnonzero(first >= 0)
    enter(first[found], found)
    while queue:
        r = heapq.heappop(queue)
        places = where.pop(r, None)
        if places is None:
            continue
        i = np.unique(np.array(places))
        i = i[token[i] >= 0]
        i = i[vocabulary.merged(token[i], token[after[i]]) == r]
        if not len(i):
            continue
        if len(i) > 1:
            close = np.append(False, after[i[:-1]] == i[1:])
            if close.any():
                # a run of overlapping places takes every other one, from its left end
                at = np.arange(len(i))
                i = i[(at - np.maximum.accumulate(np.where(close, 0, at))) % 2 == 0]
            if vocabulary.yields[r] and (wait := np.append(False, word[i[1:]] == word[i[:-1]])).any():
                # its merge may bring up a lower rank: of a word's places only the first is merged now, the rest come up again
                where[r] = i[wait].tolist()
                heapq.heappush(queue, r)
                i = i[~wait]
        j = after[i]
        token[i], token[j] = r, -2
        far = after[j]
        after[i], before[far] = far, i
        left = before[i]
        ranks, at = vocabulary.merged(np.append(token[left], token[i]), np.append(token[i], token[far])), np.append(left, i)
        good = ranks >= 0
        enter(ranks[good], at[good])
    live = token >= 0
    kept = np.cumsum(live)
    ends = kept[heads + sizes]
    return np.split(token[live].astype(np.uint32), ends[:-1])


def encode_shard(texts: list[str | None], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Ids of every text of a shard."""
    seen: dict[str, int] = defaultdict(count().__next__)
    rows = [list(map(seen.__getitem__, pieces(t or ""))) for t in texts]
    split = list(map(vocabulary.findall, seen))
    ids_of = vocabulary.encode_words(set().union(*split)).__getitem__
    parts = [ids_of(x[0]) if len(x) == 1 else b"".join(map(ids_of, x)) for x in split]
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) >> 2
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(parts), dtype="<u4")
    return [ragged_take(flat, starts[r], lengths[r]) for r in (np.array(x, dtype=np.int64) for x in rows)]


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary a worker process, kept between tasks."""
    ranks, pattern = shared.value
    key = hash((len(ranks), pattern, max(ranks.values(), default=0)))
    if key not in _vocabularies or _vocabularies[key].ranks is not ranks and _vocabularies[key].ranks != ranks:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(ranks, pattern)
    return _vocabularies[key]


def slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes | None]]]:
    """The (ids, raw texts) of all batches in runs of about limit bytes."""
    ids, raws, size = [], [], 0
    for b in batches:
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            raws.append(raw)
            size += len(raw or b"")
            if size >= limit:
                yield ids, raws
                ids, raws, size = [], [], 0
    if ids:
        yield ids, raws


def _encode(shared, shard_bytes: int, with_ids: bool, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for doc_ids, raws in slices(batches, shard_bytes):
            found = encode_shard([None if r is None else r.decode("utf-8", "replace") for r in raws], vocabulary)
            cols = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array([len(x) for x in found], pa.int64())}
            little = [x.astype("<u4").tobytes() for x in found]
            if with_ids:
                cols["ids"] = pa.array(little, pa.binary())
            if digest:
                cols["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in little])
                cols["decoded_sha256"] = pa.array([hashlib.sha256(vocabulary.decode(np.frombuffer(x, dtype="<u4").astype(np.int64))).hexdigest() for x in little])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, digest: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_tokens[, ids: little-endian unsigned 32-bit][, ids_sha256, decoded_sha256]), one row per input row.

    The vocabulary (a fixed 50 thousand entries) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((load_ranks(vocabulary_path), pattern))
    schema = "doc_id long, n_tokens long" + ", ids binary" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digest
    return id_and_bytes(docs, id_col, text_col).mapInArrow(_encode(shared, shard_bytes, with_ids, digest), schema)


def decode(encoded: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids as encode() gives them; bytes that are no UTF-8 become U+FFFD."""
    spark = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((load_ranks(vocabulary_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for b in batches:
            texts = [vocabulary.decode(np.frombuffer(x or b"", dtype="<u4").astype(np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
