"""Quality rules as a short-circuit cascade.

Two base tests are fixed by the contract: fewer than 20 words, or over 30 % of the words inside 8-word windows that
the text holds twice or more. They are rules of the cascade as the method's own are. Each rule's cost (seconds a
document, the counts that it alone needs included) and selectivity (share of documents it rejects) are estimated on a sample
by hash, and the rules run in falling order of rejections per second; a document leaves the cascade at its first rejection, and what
later rules would have counted is never counted. The order changes the time only: the verdict is the conjunction of
all rules, whatever the sample says. `judge` reports all counts and so makes them all; `keep_good` makes those it needs.

Defined results: a null or empty text has no words, so base_failed is true and kept false. Repeated rows
are judged each for itself; a null doc_id stays null. Other columns are not looked at. A long text is
judged whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import id_and_bytes, parts, ship

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Thresholds of the rules: symbols per word, share of duplicate lines, of capital letters, of words equal to the one before, of exclamation marks per word; mean word length.
MAX_SYMBOLS, MAX_DUP_LINES, MAX_CAPITALS, MAX_ECHO, MAX_SHOUTS, MEAN_WORD = 0.1, 0.5, 0.6, 0.3, 0.5, (2.0, 15.0)
#: Documents that the estimate of costs and selectivities may look at.
SAMPLE_ROWS = 400

_SYMBOLS = b"#*$%&|<>"
_NOT_LOWER = bytes(c for c in range(256) if not 97 <= c <= 122)
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.translate(None, _CONTINUATION))


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a WINDOW-word window that occurs twice or more. Exact: windows are ranked by doubling, not hashed."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    step = 1
    while step < WINDOW:
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        step *= 2
    counts = np.bincount(rank)
    if counts.max() < 2:
        return 0
    hit = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


class Text:
    """One text; each count is made when it is first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return code_points(b"".join(self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, (_SYMBOLS[i : i + 1] for i in range(len(_SYMBOLS)))))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    def base_failed(self) -> bool:
        return _few_words(self) or _repeats(self)


def _few_words(t: Text) -> bool:
    return t.n_words < MIN_WORDS


def _repeats(t: Text) -> bool:
    return 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words


def _symbols(t: Text) -> bool:
    return t.n_symbols > MAX_SYMBOLS * t.n_words


def _dup_lines(t: Text) -> bool:
    return t.n_dup_lines > MAX_DUP_LINES * len(t.lines)


def _mean_word(t: Text) -> bool:
    return not MEAN_WORD[0] * t.n_words <= t.word_chars <= MEAN_WORD[1] * t.n_words


def _capitals(t: Text) -> bool:
    """ASCII letters speak for all: text in other scripts has none and passes."""
    upper, lower = len(t.raw.translate(None, _NOT_UPPER)), len(t.raw.translate(None, _NOT_LOWER))
    return upper > MAX_CAPITALS * (upper + lower)


def _echo(t: Text) -> bool:
    return sum(map(bytes.__eq__, t.words, t.words[1:])) > MAX_ECHO * t.n_words


def _shouts(t: Text) -> bool:
    return t.raw.count(b"!") > MAX_SHOUTS * t.n_words


RULES: dict[str, Callable[[Text], bool]] = {"few_words": _few_words, "repeats": _repeats, "symbols": _symbols, "dup_lines": _dup_lines, "mean_word": _mean_word, "capitals": _capitals, "echo": _echo, "shouts": _shouts}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seconds spent and documents rejected by each rule over the sample. The words are split beforehand, as every rule
    but two needs them; whatever else a rule counts is counted anew, and so is part of its cost."""
    spent, hits, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
    for b in batches:
        for raw in b.column(1).to_pylist():
            n += 1
            words = Text(raw).words
            for name, rule in RULES.items():
                t = Text(raw)
                t.words = words
                at = time.perf_counter()
                hits[name] += rule(t)
                spent[name] += time.perf_counter() - at
    yield pa.RecordBatch.from_arrays([pa.array(list(RULES)), pa.array([spent[k] for k in RULES]), pa.array([hits[k] for k in RULES], pa.int64()), pa.array([n] * len(RULES), pa.int64())], names=["rule", "spent", "hits", "n"])


def cascade_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules in falling order of rejections per second, from about sample_rows documents all over the table, chosen by hash (twice as many at most)."""
    ship(docs.sparkSession)
    raw = id_and_bytes(docs, id_col, text_col)
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = raw.filter(F.pmod(F.xxhash64("doc_id", "raw"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample_rows)
    seen = sample.mapInArrow(_measure, "rule string, spent double, hits long, n long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    worth = {r["rule"]: (r["hits"] + 0.01) / (r["spent"] + 1e-9) for r in seen}
    return sorted(RULES, key=lambda k: (-worth.get(k, 0.0), k))


def _judge(order: list[str]):
    rules = [(name, RULES[name]) for name in order]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]

    def verdict(t: Text) -> str | None:
        return next((name for name, rule in rules if rule(t)), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for raw in b.column(1).to_pylist():
                t = Text(raw)
                by = verdict(t)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed(), by is None, by))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The base columns, base_failed, kept and the rule that rejected, one row per input row."""
    ship(docs.sparkSession)
    order = order if order is not None else cascade_order(docs, id_col, text_col)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return id_and_bytes(docs, id_col, text_col).mapInArrow(_judge(order), schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns; decided row by row, so repeated ids need no join."""
    ship(docs.sparkSession)
    order = cascade_order(docs, id_col, text_col)
    rules = [RULES[k] for k in order]

    @F.pandas_udf("boolean")
    def passes(raw):
        import pandas as pd

        return pd.Series([not any(rule(t) for rule in rules) for t in map(Text, raw)], dtype=bool)

    return docs.filter(passes(F.col(text_col).cast("binary")))
