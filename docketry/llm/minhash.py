"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct 5-word shingles (64-bit hashes of the words). Its sketch is filled in rounds:
round i < t throws every shingle into a hashed bin, rounds t to 2t-1 throw all of them into bin i - t, and a bin
keeps its least value, where an earlier round is less than any later one. So every coordinate fills, after about
t log t throws, and the share of equal coordinates concentrates around the Jaccard similarity as for independent
hash functions. Bands of coordinates propose pairs; the full sets of a proposed pair decide.

Large groups cost no quadratic work where it can be helped:
1. Documents with equal words are one class, found by a partial aggregation; only its smallest id goes on.
2. In each bucket of a band every member is compared with the bucket's smallest id only (a star). Components of the
   confirmed links are contracted.
3. Only buckets that still hold two or more components go on. In a small one the members of different components
   are compared; the members of large ones are banded anew with more rows a band, for which low similarities
   hardly ever collide, and steps 2 and 3 are repeated for them.
4. What is left in large buckets after the last level is compared block by block, so no pair that shares a bucket of
   that level is given up.
A pair of similarity 0.75 is missed by all bands of the first level with probability (1 - 0.75^4)^32 = 5.2e-6. A pair all of
whose first-level buckets were large is compared only if it shares a bucket of the second level, which misses it with
probability (1 - 0.75^5)^45 = 5.1e-6. So 1.1e-5 is the most that a pair can have; more similar pairs have less.

Defined results: a document without words (null, empty, only white space) has an empty set and is linked with nothing. With
fewer than five words the whole sequence is the one shingle. Rows that repeat a doc_id are one document, whose text is the
smallest of theirs. A row with null doc_id is no document; its component_id is null and it is kept. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import id_and_bytes, mix64, ship, spill

SHINGLE, PERCENT = 5, 75
#: (rows a band, bands) of each level.
LEVELS = ((4, 32), (5, 45))
#: A bucket of more members than this is large.
LARGE = 24
#: Members of a block in the last, exhaustive comparison.
BLOCK = 256

_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(raw: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (raw or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    seen = dict.fromkeys(words)
    for w in seen:
        seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix64(out * _K + h[i : n - size + 1 + i])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The t coordinates of each (non-empty) set: all sets are thrown at once, round by round, until their bins are full."""
    n = len(sets)
    top = np.iinfo(np.uint64).max
    out = np.full((n, t), top, dtype=np.uint64)
    flat = out.reshape(-1)
    open_ = np.arange(n)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(open_):
                break
            h = mix64(items + np.uint64(i + 1) * _K)
            bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t, dtype=np.int64)
            # the round in the high bits: any value of this round is larger than any of the rounds before
            np.minimum.at(flat, owner * t + bins, (np.uint64(i) << np.uint64(48)) | mix64(h) >> np.uint64(16))
            done = (out[open_] != top).all(axis=1)
            if done.any():
                still = np.zeros(n, dtype=bool)
                still[open_[~done]] = True
                open_ = open_[~done]
                keep = still[owner]
                items, owner = items[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key a band, different bands never sharing one but by chance."""
    grid = sketch[:, : rows * bands].reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _K, (len(sketch), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix64(key * _K + grid[:, :, r])
    return key.view(np.int64)


def _profile(size: int, rows: int, bands: int, at_once: int = 256):
    """Per document: the size of its set, the digest of its words, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, at_once):
                part = b.slice(lo, at_once)
                raws = part.column(1).to_pylist()
                sets = [shingle_hashes(raw, size) for raw in raws]
                pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join((raw or b"").lower().split())) for raw in raws), dtype="<i8").reshape(-1, 2)
                n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(pair[:, 0]), pa.array(pair[:, 1]), _key_lists(sets, n, rows, bands)], names=["doc_id", "n_shingles", "h1", "h2", "buckets"])

    return run


def _key_lists(sets: list[np.ndarray], n: np.ndarray, rows: int, bands: int) -> pa.ListArray:
    keys = band_keys(sketches([s for s in sets if len(s)], rows * bands), rows, bands)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]), pa.int32()), pa.array(keys.reshape(-1)))


def _bands(rows: int, bands: int, at_once: int = 256):
    """Band keys of a further level, from the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, at_once):
                part = b.slice(lo, at_once)
                sets = [np.array(x, dtype=np.int64).view(np.uint64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _key_lists(sets, np.fromiter(map(len, sets), dtype=np.int64, count=len(sets)), rows, bands)], names=["id", "buckets"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(raw, size).view(np.int64) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))], names=["id", "items"])

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    # the sizes first: a pair whose sizes differ too much can't pass, and its sets need not travel
    x, y = sets.select(F.col("id").alias("a"), F.size("items").alias("n")), sets.select(F.col("id").alias("b"), F.size("items").alias("m"))
    # in a large family every pair has the same a
    sized = pairs.join(x.hint("merge"), "a").join(y, "b").filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b")
    both = sized.join(left.hint("merge"), "a").join(right, "b")
    return both.filter((100 + percent) * F.size(F.array_intersect("x", "y")) >= percent * (F.size("x") + F.size("y"))).select("a", "b")


def merge(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(id, root) after the links are added to roots; root is the smallest id reachable. Ids that are their own root need no row.

    Each round carries the links over to the roots of their ends and drops those that are closed, then every root hooks to the
    least root it is linked with. Hooks always go to a smaller id, so they form trees, which are flattened by pointer jumping.
    """
    while True:
        a, b = (None, None) if roots is None else (roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        ends = links if roots is None else links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        links = spill(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-links")
        if links.isEmpty():
            return roots
        hooks = links.groupBy("a").agg(F.min("b").alias("b"))
        while True:
            hooks = spill(hooks, "near-hooks")
            over = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            if hooks.join(over, "b", "left_semi").isEmpty():
                break
            hooks = hooks.join(over, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        hooked = hooks.select(F.col("a").alias("id"), F.col("b").alias("root"))
        if roots is not None:
            moved = roots.join(hooks.select(F.col("a").alias("root"), F.col("b").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
            hooked = moved.unionByName(hooked)
        roots = spill(hooked, "near-roots")


def _contract(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members (bucket, id, root) of the buckets that hold two or more components."""
    own = members.withColumn("root", F.col("id")) if roots is None else members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    open_ = spill(own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket", "n"), "near-open")
    return own.join(open_.hint("merge"), "bucket")


def _cross(small: DataFrame) -> DataFrame:
    """Pairs of different components within (small) buckets, once each."""
    x = small.select("bucket", F.col("id").alias("a"), F.col("root").alias("ra"))
    y = small.select("bucket", F.col("id").alias("b"), F.col("root").alias("rb"))
    return x.join(y, "bucket").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))).select("a", "b").distinct()


def _blockwise(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within large buckets: the members' sets are dealt into blocks, and a task gets
    two blocks at a time, so that nobody holds a bucket and no pair becomes a row unless it is a link."""
    own = left.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("id", "bucket"), F.col("parts")).cast("int"))
    # a block meets every block from itself on; each meeting is one group
    first = own.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1))).select("bucket", F.col("part").alias("i"), F.col("other").alias("j"), "id", "root", F.lit(0).alias("side"))
    second = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("part")))).select("bucket", F.col("other").alias("i"), F.col("part").alias("j"), "id", "root", F.lit(1).alias("side")).filter("i <> j")
    dealt = first.union(second).join(sets, "id")

    def meet(pdf):
        import pandas as pd

        rows = []
        pdf = pdf.assign(items=[frozenset(i.tolist()) for i in pdf["items"]])
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
        y = x if not len(y) and len(pdf) and pdf.i.iat[0] == pdf.j.iat[0] else y
        for a, ra, s in zip(x.id, x.root, x["items"], strict=True):
            for b, rb, u in zip(y.id, y.root, y["items"], strict=True):
                if ra != rb and 100 * min(len(s), len(u)) >= percent * max(len(s), len(u)) and (100 + percent) * len(s & u) >= percent * (len(s) + len(u)):
                    rows.append((min(a, b), max(a, b)))
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("bucket", "i", "j").applyInPandas(meet, "a long, b long").distinct()


def find_components(members: DataFrame, sets_of, percent: int = PERCENT, levels=LEVELS, large: int = LARGE) -> DataFrame | None:
    """(id, root) of the components of all links, without ids that are their own root; None if there are no links.

    members (id, bucket): the first level's band keys of distinct documents. sets_of(ids) gives (id, items) of the ids.
    """
    roots, sets = None, None
    for level in range(len(levels)):
        # a bucket can hold a third of all rows: stars are tables of their own and joins with them merge, so that adaptive execution splits it
        star = spill(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).filter("n > 1").select("bucket", "a"), "near-stars")
        shared = spill(members.join(star.hint("merge"), "bucket").select("bucket", "id", "a"), "near-shared")
        if sets is None:
            sets = spill(sets_of(shared.select("id").distinct()), "near-sets", "lz4")
        pairs = shared.filter("id <> a").select("a", F.col("id").alias("b")).distinct()
        pairs = spill(pairs if roots is None else _apart(pairs, roots), "near-pairs")
        roots = merge(roots, linked(pairs, sets, percent))
        left = spill(_contract(shared.select("bucket", "id"), roots), "near-left")
        # pairs with the bucket's smallest id have been compared already
        small = _cross(left.filter(F.col("n") <= large)).join(pairs, ["a", "b"], "left_anti")
        roots = merge(roots, linked(small, sets, percent))
        left = spill(_contract(left.filter(F.col("n") > large).select("bucket", "id"), roots), "near-left")
        if left.isEmpty():
            break
        if level + 1 < len(levels):
            again = sets.join(left.select("id").distinct(), "id", "left_semi")
            members = spill(again.mapInArrow(_bands(*levels[level + 1]), "id long, buckets array<long>").select("id", F.explode("buckets").alias("bucket")), "near-bands", "lz4")
        else:
            roots = merge(roots, _blockwise(left, sets, percent))
    return roots


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs that no link connects yet."""
    a, b = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, levels=LEVELS, large: int = LARGE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    ship(docs.sparkSession)
    rows = id_and_bytes(docs, id_col, text_col)
    raw = rows.filter(F.col("doc_id").isNotNull())
    twice = spill(raw.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "near-twice")
    plain = twice.isEmpty()
    if not plain:
        raw = raw.join(twice, "doc_id", "left_anti").unionByName(raw.join(twice, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("raw", F.lit(b""))).alias("raw")))
    # text is read and split once for all documents; it is read again, and shuffled, only for those that share a bucket
    profile = spill(raw.mapInArrow(_profile(size, *levels[0]), "doc_id long, n_shingles long, h1 long, h2 long, buckets array<long>"), "near-profile", "lz4")
    nodes = profile.filter(F.col("n_shingles") > 0)
    classes = spill(nodes.groupBy("h1", "h2").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")), "near-classes")
    heads = nodes.join(classes.select(F.col("head").alias("doc_id")), "doc_id", "left_semi")
    members = heads.select(F.col("doc_id").alias("id"), F.explode("buckets").alias("bucket"))

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = raw.select(F.col("doc_id").alias("id"), "raw").join(ids, "id", "left_semi")
        return texts.mapInArrow(_sets(size), "id long, items array<long>")

    near = find_components(members, sets_of, percent, levels, large)
    # the smallest id of each class, then of each component of classes
    copies = nodes.select("doc_id", "h1", "h2").join(classes.filter("n > 1"), ["h1", "h2"]).select("doc_id", "head")
    if near is None:
        known = copies.select("doc_id", F.col("head").alias("root"))
    else:
        known = copies.join(near.withColumnRenamed("id", "head"), "head", "left").select("doc_id", F.coalesce("root", "head").alias("root"))
        # heads of classes with copies are among the copies already
        known = known.unionByName(near.select(F.col("id").alias("doc_id"), "root").join(classes.filter("n = 1").select(F.col("head").alias("doc_id")), "doc_id", "left_semi"))
    root = F.coalesce("root", "doc_id")
    out = profile.select("doc_id", "n_shingles").join(known, "doc_id", "left").select("doc_id", "n_shingles", root.alias("component_id"), (F.col("doc_id") == root).alias("kept"))
    if not plain:
        out = rows.select("doc_id").filter("doc_id is not null").join(out, "doc_id")
    nameless = rows.filter(F.col("doc_id").isNull()).mapInArrow(_nameless(size), "doc_id long, n_shingles long").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def _nameless(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(shingle_hashes(x, size)) for x in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_shingles"])

    return run
