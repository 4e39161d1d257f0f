"""Spelling variants by bidirectional FM-index search schemes over the vocabulary.

Words of the corpus are counted; those of MIN_CHARS code points and MIN_COUNT occurrences or more are the vocabulary. Two words are
near if one inserted, deleted or replaced code point makes one of the other. One error leaves either half of a word
as it is, so two searches find every near word: match the first half exactly and extend to the right across the second, or match
the second half and extend to the left across the first, allowing one error there. A word that both find counts by the first.

The vocabulary is dealt by halves: a word is filed under the beginnings and ends that a near word's half can have, two lengths of
each, and searched for where its own halves are filed. Each shard is a delimited text of its words with two FM-indexes, one of the text
and one of its reverse. A half is matched with one of them while the interval in the other is kept in step; the extension goes on
with the other. All searches of a shard advance together, as intervals of suffix ranks in arrays; the symbols that can follow
an interval come from a wavelet matrix. A half with more words than a shard holds is cut into blocks of words to search for and to search in.

A word's form is its near word of the largest count (ties: the smallest in code-point order), if that is FACTOR times its own or
more; forms grow by that factor, so they make chains, whose last words are found by pointer doubling.

Defined results: null and empty texts have no words. Rows that repeat a doc_id count each; a row without doc_id counts with an
empty one in the hash that deletes characters. A run that loses its only character is no word. Invalid UTF-8 separates words.
Empty tables have no words. Very long runs are words like any other. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import id_and_bytes, ragged_take, ship, spill

MIN_CHARS, MIN_COUNT, FACTOR = 6, 5, 5
#: One run in DELETED of a document loses a character.
DELETED = 199
#: Words filed in a shard, and the most under one half before it is cut into blocks; words searched for at once; words that a task counts before it sends them on.
SHARD, AT_ONCE, KEPT_WORDS = 20_000, 20_000, 300_000

#: Letters of a run in UTF-8: A-Z fall to a-z, U+00C0 to U+00FF are C3 and a continuation byte.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c == 0xC3 or 0x80 <= c <= 0xBF else 32 for c in range(256))
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")


def runs_of(raw: bytes | None) -> list[bytes]:
    """Maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased."""
    raw = raw or b""
    if not raw.isascii():
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        raw = _OTHER.sub(b" ", raw)
    return raw.translate(_FOLD).split()


def _count(every: int, min_chars: int):
    """Words and their counts, added up over as many documents as the table of a task holds."""

    def send(counts: Counter) -> pa.RecordBatch:
        own = [(w, n) for w, n in ((w.decode(), n) for w, n in counts.items()) if len(w) >= min_chars]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        crc32 = zlib.crc32
        for b in batches:
            for doc_id, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = Counter(runs_of(raw))
                seed = crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for w in [w for w in own if not crc32(w, seed) % every]:
                    n, word = own.pop(w), w.decode()
                    at = crc32(w, seed) % len(word)
                    total[(word[:at] + word[at + 1 :]).encode()] += n
                total.update(own)
                if len(total) > KEPT_WORDS:
                    yield send(total)
                    total.clear()
        yield send(total)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, deleted: int = DELETED) -> DataFrame:
    """(word, n) of the words in use."""
    ship(docs.sparkSession)
    counts = id_and_bytes(docs, id_col, text_col).mapInArrow(_count(deleted, min_chars), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class FmIndex:
    """Suffix ranks of a cyclic text: Burrows-Wheeler transform in a wavelet matrix. Symbols are numbers under 2^bits."""

    def __init__(self, text: np.ndarray, bits: int):
        self.bits, self.order = bits, rotations(text, bits)
        last = text[self.order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        #: by bit, from the highest: number of zeros in front of each place, and of all
        self.zeros: list[tuple[np.ndarray, int]] = []
        for k in range(bits - 1, -1, -1):
            one = (last >> k & 1).astype(bool)
            self.zeros.append((np.concatenate([[0], np.cumsum(~one)]), int((~one).sum())))
            last = np.concatenate([last[~one], last[one]])
        #: where each symbol stands in the last row of the matrix
        self.base = np.searchsorted(_mirrored(last, bits), _mirrored(np.arange(1 << bits), bits))

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after one more symbol, and how many symbols of each interval are less, which moves the interval of the other index."""
        less = np.zeros(len(low), dtype=np.int64)
        for k, (zeros, n) in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = zeros[low], zeros[high]
            less += np.where(one, b - a, 0)
            low, high = np.where(one, n + low - a, a), np.where(one, n + high - b, b)
        at = self.before[symbol] - self.base[symbol]
        return low + at, high + at, less

    def follow(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, its new low, its new high) for every symbol of each interval: down the matrix, empty sides left out."""
        own, symbol = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for zeros, n in self.zeros:
            a, b = zeros[low], zeros[high]
            left, right = np.flatnonzero(b > a), np.flatnonzero(high - b > low - a)
            own = np.concatenate([own[left], own[right]])
            symbol = np.concatenate([symbol[left] << 1, symbol[right] << 1 | 1])
            low, high = np.concatenate([a[left], n + low[right] - a[right]]), np.concatenate([b[left], n + high[right] - b[right]])
        at = self.before[symbol] - self.base[symbol]
        return own, symbol, low + at, high + at


def _mirrored(symbols: np.ndarray, bits: int) -> np.ndarray:
    """The order in which a wavelet matrix leaves its symbols: by their bits from the lowest."""
    return sum((symbols >> k & 1) << (bits - 1 - k) for k in range(bits))


def rotations(text: np.ndarray, bits: int) -> np.ndarray:
    """The starts of a primitive cyclic text's rotations in order, by prefix doubling from as many symbols as a number holds."""
    k = 62 // bits
    key = np.zeros(len(text), dtype=np.int64)
    for j in range(k):
        key = key << bits | np.roll(text, -j)
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == len(text) - 1 or k >= 2 * len(text):
            return order
        key = rank * len(text) + np.roll(rank, -k)
        k *= 2


class Words:
    """Distinct words in code-point order as one delimited text, indexed in both directions."""

    def __init__(self, words: list[str]):
        self.words = words
        flat = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), dtype="<u4")
        self.letters, text = np.unique(flat, return_inverse=True)  # the delimiter is 0
        bits = max(1, int(len(self.letters)).bit_length())
        self.right, self.left = FmIndex(text[::-1].copy(), bits), FmIndex(text, bits)
        self.ends = np.cumsum(text == 0) - 1  # which word a delimiter closes

    def coded(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, a row each, closed and filled with delimiters; lengths); len(letters), which the text doesn't have, for letters that it lacks."""
        lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.frombuffer("".join(rows).encode("utf-32-le"), dtype="<u4")
        at = np.searchsorted(self.letters, flat)
        at = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == flat, at, len(self.letters))
        out = np.zeros((len(rows), int(lengths.max(initial=0)) + 1), dtype=np.int64)
        out[np.arange(out.shape[1]) < lengths[:, None]] = at
        return out, lengths

    def near(self, queries: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): the words that differ by one error outside the first half (or else outside the second)."""
        halves = [(q[: len(q) // 2], q[len(q) // 2 :]) for q in queries]
        exact, across = ([a[::-1] for a, _ in halves], [b for _, b in halves]) if first else ([b for _, b in halves], [a[::-1] for a, _ in halves])
        match, extend = (self.left, self.right) if first else (self.right, self.left)
        whole = len(match.order)
        # the half and the delimiter beyond it, with the other index in step
        symbols, lengths = self.coded(exact)
        low, high, other = np.zeros(len(queries), np.int64), np.full(len(queries), whole), np.zeros(len(queries), np.int64)
        for j in range(symbols.shape[1]):
            at = np.flatnonzero((j <= lengths) & (low < high))
            low[at], high[at], less = match.step(low[at], high[at], symbols[at, j])
            other[at] += less
        symbols, lengths = self.coded(across)
        q = np.flatnonzero(low < high)
        low, high = other[q], other[q] + high[q] - low[q]
        none = np.zeros(0, dtype=np.int64)
        with_error, found = (none, none, none), [(none, none)]
        for j in range(symbols.shape[1]):
            # without an error so far: go on with each symbol that follows
            own, symbol, lo, hi = extend.follow(low, high)
            want, letter = symbols[q[own], j], symbol != 0
            replaced, inserted, kept = letter & (want != 0) & (symbol != want), letter, (symbol == want) & letter
            deleted = symbols[q, j] != 0
            q1, lo1, hi1 = (np.concatenate([x, y[inserted]]) for x, y in zip(with_error, (q[own], lo, hi), strict=True))
            want1 = symbols[q1, j]
            lo1, hi1, _ = extend.step(lo1, hi1, want1)
            end = (want1 == 0) & (lo1 < hi1)
            found.append((q1[end], lo1[end]))
            on = (want1 != 0) & (lo1 < hi1)
            with_error = tuple(np.concatenate([x[on], y[replaced], z[deleted]]) for x, y, z in ((q1, q[own], q), (lo1, lo, low), (hi1, hi, high)))
            q, low, high = q[own][kept], lo[kept], hi[kept]
        query, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        place = extend.order[rank]
        # the delimiter behind the word, read from the right, or the one in front of it
        word = self.ends[whole - 1 - place] if first else (self.ends[place] + 1) % len(self.words)
        pairs = np.unique(query * len(self.words) + word)
        return pairs // len(self.words), pairs % len(self.words)


def _together(words: list[str]) -> Iterator[list[str]]:
    """Words to search for at once: about AT_ONCE of usual length, and fewer of very long ones."""
    words, lo = sorted(words, key=len), 0
    while lo < len(words):
        hi = lo + 1
        while hi < len(words) and (hi - lo) * len(words[hi]) < 32 * AT_ONCE:
            hi += 1
        yield words[lo:hi]
        lo = hi


def _search(table: pa.Table) -> pa.Table:
    """One shard: for each word searched for, its near words here: how many, and the best."""
    sides = np.array(table.column("side").to_pylist())
    words, counts = np.array(table.column("word").to_pylist(), dtype=object), table.column("n").to_numpy()
    filed = dict(zip(words[sides == 0].tolist(), counts[sides == 0].tolist(), strict=True))
    out: list[tuple] = []
    if filed:
        index = Words(sorted(filed))
        n = np.fromiter(map(filed.__getitem__, index.words), dtype=np.int64, count=len(filed))
        for side in (1, 2):
            for some in _together(words[sides == side].tolist()):
                q, w = index.near(some, side == 1)
                if side == 2:  # those with the same first half are found there
                    new = np.array([not index.words[b].startswith(some[a][: len(some[a]) // 2]) for a, b in zip(q.tolist(), w.tolist(), strict=True)], dtype=bool)
                    q, w = q[new], w[new]
                order = np.lexsort((w, -n[w], q))
                q, w = q[order], w[order]
                at = np.flatnonzero(np.diff(q, prepend=-1))
                out += [(some[i], m, index.words[best], int(n[best])) for i, m, best in zip(q[at].tolist(), np.diff(np.append(at, len(q))).tolist(), w[at].tolist(), strict=True)]
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "form", "form_n"])


def _keys() -> Column:
    """Where a word is filed (side 0), and where it is searched for by its first half (1) and its second (2)."""
    w, n = F.col("word"), F.length("word")

    def begin(m: Column, side: int) -> Column:
        return F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit("begin"), F.substring(w, F.lit(1), m)).alias("key"))

    def end(m: Column, side: int) -> Column:
        return F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit("end"), F.right(w, m)).alias("key"))

    half = F.floor(n / 2).cast("int")
    # halves of words that are one shorter, as long, or one longer
    begins = (F.floor((n - 1) / 2).cast("int"), F.floor((n + 1) / 2).cast("int"))
    ends = (F.ceil((n - 1) / 2).cast("int"), F.ceil((n + 1) / 2).cast("int"))
    return F.array(*[begin(m, 0) for m in begins], *[end(m, 0) for m in ends], begin(half, 1), end(n - half, 2))


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, form, form_n) of the words with near ones: how many, the one of the largest count, and that count. words: distinct (word, n)."""
    ship(words.sparkSession)
    rows = words.select("word", "n", F.explode(_keys()).alias("x")).select("word", "n", "x.side", "x.key")
    filed = spill(rows.filter("side = 0").groupBy("key").agg(F.count(F.lit(1)).alias("size")), "spelling-halves")
    shards = max(1, -(-(filed.agg(F.sum("size").alias("n")).first()["n"] or 0) // shard))
    hot = filed.filter(F.col("size") > shard).select("key", F.ceil(F.col("size") / shard).cast("int").alias("parts"))
    dealt = rows.select("word", "n", "side", F.pmod("key", F.lit(shards)).alias("shard"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    if not hot.isEmpty():
        # blocks of words to search for meet blocks of words to search in
        both = rows.join(hot.hint("merge"), "key", "left")
        own, all_ = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
        cut = both.filter("parts is not null").withColumn("own", own).withColumn("other", F.explode(all_))
        cut = cut.select("word", "n", "side", F.col("key").alias("shard"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("j"))
        dealt = both.filter("parts is null").select("word", "n", "side", F.pmod("key", F.lit(shards)).alias("shard"), F.lit(-1).alias("i"), F.lit(-1).alias("j")).unionByName(cut)
    found = dealt.groupBy("shard", "i", "j").applyInArrow(_search, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("k"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.k")).alias("form_n"))


def last_of_chains(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by pointer doubling."""
    roots = spill(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        # many words can share a form: a merging join is split by adaptive execution
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = spill(moved, "spelling-roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR, deleted: int = DELETED, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of the vocabulary."""
    words = spill(vocabulary(docs, id_col, text_col, min_chars, min_count, deleted), "spelling-words")
    found = words.join(near_words(words, shard), "word", "left")
    big = F.col("form_n") >= factor * F.col("n")
    known = spill(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(big, F.col("form")).alias("form"), F.when(big, F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = last_of_chains(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
