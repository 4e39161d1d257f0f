"""Operators against brute force on small tables with awkward rows."""

import hashlib
import io
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docketry.llm import bpe, decontam, line_dedup, minhash, quality, tokenfile, warc
from docketry.llm.pieces import pieces

LINE = "This very line is shared by many of the documents here."
PASSAGE = " ".join(f"word{i}" for i in range(40))
ODD = ["", None, " \t\n", "a", "\n\n", "Ünïcode wörds here", "a\x0bb\x1cc", "x" * 5000, "---- ==== ....", "tail  ", "日本語のテキスト", "<|endoftext|> is text here"]


def documents():
    rng = np.random.RandomState(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab, rng.randint(30, 120))) for _ in range(30)]
    docs = {}
    for t in texts:
        docs[len(docs)] = t
    for t in texts[:10]:  # exact copies but for case, and near copies of many degrees
        docs[len(docs)] = t.upper()
        for k in (1, 3, 6, 10):
            w = t.split()
            for j in rng.choice(len(w), k, replace=False):
                w[j] = "changed"
            docs[len(docs)] = " ".join(w)
    for k in range(8):
        docs[len(docs)] = f"start {k}\n  {LINE.upper()} \nmiddle\n{LINE}\nend " + texts[k]
    docs[len(docs)] = "lead " + PASSAGE + " tail " * 30
    docs[len(docs)] = "again and again " * 40
    for t in ODD:
        docs[len(docs)] = t
    return docs


def frame(spark, docs, extra=True):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    # columns that clash with names the operators use
    return df.withColumns({"kept": F.lit(1), "n_words": F.lit("x"), "raw": F.lit(None).cast("string"), "lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}) if extra else df


@pytest.fixture(scope="module")
def docs():
    return documents()


@pytest.fixture(scope="module")
def df(spark, docs):
    return frame(spark, docs).cache()


def table(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


def test_line_dedup(df, docs):
    want = brute.lines(docs)
    assert table(line_dedup.dedup_lines(df), "doc_id", "n_lines", "n_dropped", "text") == want
    assert sum(x[1] for x in want.values()) > 0
    kept = line_dedup.dedup_documents(df)
    assert kept.columns == df.columns
    assert {k: v or "" for k, (v,) in table(kept, "doc_id", "text").items()} == {k: v[2] for k, v in want.items()}


def test_quality(df, docs):
    got = table(quality.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {k: brute.base_counts(t) for k, t in docs.items()}
    kept = table(quality.judge(df), "doc_id", "kept")
    orders = (list(quality.RULES), list(quality.RULES)[::-1])
    assert all(table(quality.judge(df, order=o), "doc_id", "kept") == kept for o in orders)
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {k for k, (v,) in kept.items() if v}


@pytest.mark.parametrize("large", [24, 2])
def test_near_duplicates(df, docs, large):
    got = table(minhash.near_duplicates(df, large=large), "doc_id", "n_shingles", "component_id")
    assert got == brute.near(docs)


def test_near_duplicates_of_one_large_family(spark):
    rng = np.random.RandomState(1)
    base = [f"b{i}" for i in range(120)]
    docs = {}
    for k in range(60):
        w = list(base)
        for j in rng.choice(len(w), 2 + k % 3, replace=False):
            w[j] = f"x{k}"
        docs[k] = " ".join(w)
    got = table(minhash.near_duplicates(frame(spark, docs, False), large=4), "doc_id", "n_shingles", "component_id")
    assert got == brute.near(docs)


def test_no_level_of_bands_misses_more_links_than_the_first():
    sets = [minhash.mix64(np.arange(32 * i, 32 * i + 32, dtype=np.uint64)) for i in range(20_000)]
    for rows, bands in minhash.LEVELS:
        assert (1 - 0.75**rows) ** bands < 5.3e-6
        # two sets of 28 that have 24 of 32 in common
        a, b = (minhash.band_keys(minhash.sketches([np.delete(s, gone) for s in sets], rows * bands), rows, bands) for gone in (slice(0, 4), slice(4, 8)))
        assert (~(a == b).any(axis=1)).sum() <= 1


def test_contamination(spark, df, docs):
    items = {1: PASSAGE, 2: "word3 word4", 10: " ".join(PASSAGE.split()[5:30]), 3: "", 4: None, 5: "no such thing", 6: docs[3]}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute.contaminated(docs, items)
    for block, shard in ((1 << 20, 1 << 20), (100, 300)):
        out = decontam.match(df, bench, block_bytes=block, shard_bytes=shard)
        out = out.withColumn("h", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
        assert table(out, "doc_id", "n_words", "n_hit", "n_items", "h", "contaminated") == want
    assert any(x[4] for x in want.values())
    clean = decontam.drop_contaminated(df, bench, block_bytes=100)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {k for k, x in want.items() if not x[4]}
    assert decontam.match(df, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def test_matches_are_the_longest_verbatim_ones(spark):
    w = PASSAGE.split()
    texts = ["x y " + " ".join(w[5:25]) + " z " + " ".join(w[3:18] + w[20:34]), " ".join(w), None, "", PASSAGE + " " + PASSAGE, " ".join(w[:12])]
    items = {"a": PASSAGE, "b": " ".join(w[2:20]), "c": "z word3"}
    rows = [(7, t) for t in texts[:3]] + [(None, t) for t in texts[3:]]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id string, text string")

    def brute_matches(text):
        own, out = brute.bench_words(text), set()
        for item, t in items.items():
            other = brute.bench_words(t)
            least = min(13, len(other))
            for i in range(len(own)):
                for j in range(len(other)):
                    if not (i and j and own[i - 1] == other[j - 1]):
                        n = 0
                        while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                            n += 1
                        if n >= least:
                            out.add((item, i, j, n))
        return out

    want = sorted(sorted(brute_matches(t)) for t in texts)
    for block in (1 << 20, 50):
        got = decontam.match(docs, bench, block_bytes=block).collect()
        assert sorted(sorted((m["item"], m["at"], m["item_at"], m["words"]) for m in r.matches) for r in got) == want
        assert all(r.longest == max((m["words"] for m in r.matches), default=0) for r in got)


def test_repetitive_texts_cost_no_pairs_of_places(spark):
    import tracemalloc

    tests = decontam.Tests([("one", b"a " * 1200), ("two", b"b c d " * 9), ("short", b"a a")], 13)
    packed = io.BytesIO()
    tests.save(packed)
    tests = decontam.Tests.load(packed.getvalue())
    tracemalloc.start()
    found = decontam.match_shard([b"a " * 500_000, b"b c d " * 9, None], tests, with_matches=False)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert [len(h) for h in found.hits] == [500_000, 27, 0] and sorted(found.pairs.T.tolist()) == [[0, 0], [0, 2], [1, 1]]
    # a match for each diagonal, not for each pair of places
    some = decontam.match_shard([b"a " * 3000], tests)
    own = some.matches[:, some.matches[1] == 0]
    assert own.shape[1] == 3000 + 1200 - 2 * 12 - 1 and own[4].max() == 1200
    docs = spark.createDataFrame([(1, "a " * 500_000)], "doc_id long, text string")
    got = decontam.match(docs, spark.createDataFrame([("one", "a " * 1200)], "item_id string, text string"), with_matches=False).first()
    assert (got.n_words, got.n_hit, got.items, got.contaminated) == (500_000, 500_000, ["one"], True)


def encoder():
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(df, docs):
    enc = encoder()
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode(df, path, pattern, digest=True, shard_bytes=2000).cache()
    for r in out.collect():
        want = np.array(enc.encode_ordinary(docs[r.doc_id] or ""), dtype="<u4")
        assert np.array_equal(np.frombuffer(r.ids, dtype="<u4"), want) and r.n_tokens == len(want)
        assert r.decoded_sha256 == brute.sha(docs[r.doc_id] or "") and r.ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
    assert table(bpe.decode(out, path, pattern), "doc_id", "text") == {k: (t or "",) for k, t in docs.items()}


def test_replay_equals_the_library_on_runs_and_space():
    import random

    enc = encoder()
    vocabulary = bpe.Vocabulary(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    random.seed(2)
    parts = [" ", "  ", "\n", "\t", "\x1c", " ", "a", "aa", "b", "'s", "!", "é", "1", "日本", " \n", "the", "--", "\U0001f600"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(1500)] + ["a" * 3000, "-" * 3001, "=" * 777, "ab" * 999, " " * 500, "\n" * 501]
    assert all("".join(pieces(t)) == t for t in texts)
    assert [x.tolist() for x in bpe.encode_shard(texts, vocabulary)] == [enc.encode_ordinary(t) for t in texts]


def test_token_files(spark, df, docs):
    enc = encoder()
    files = tokenfile.write(df, public_tokenizers.path("byte_bpe_50k.json"), 2, file_bytes=4000)
    assert files.count() > 1
    want, at = {}, 0
    for k in sorted(docs):
        ids = np.array([*enc.encode_ordinary(docs[k] or ""), 2], dtype="<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert table(tokenfile.read(spark, files), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_token_files_with_the_library_s_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from docketry.llm.queries import END_ID, op10_token_ids

    texts = ["foo <|endoftext|> bar", "no such token", " <|endoftext|>", "a  <|endoftext|>  b", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", None, "last one"]
    frame(spark, dict(enumerate(texts)), False).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = {}, 0
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, END_ID], dtype="<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert table(op10_token_ids(spark, str(tmp_path)), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_packed_numbers():
    x = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], dtype=np.uint32)
    for n in range(len(x) + 1):
        assert np.array_equal(tokenfile.unpack(*tokenfile.pack(x[:n]), n), x[:n])


def test_warc(spark):
    pages = {i: h for i, h in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 3000, "<p>a</p>", "\r\n\r\nWARC/1.1\r\n"])}
    rows = [(i, f"http://x/{i} \n", h, "clash") for i, h in pages.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    files = warc.write(df, file_bytes=4000)
    out = warc.read(spark, files, with_payload=True, run_bytes=200)
    assert table(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute.warc(pages)
    assert {r.page_id: bytes(r.payload) for r in out.filter("payload is not null").collect()} == {i: (h or "").encode() for i, h in pages.items() if brute.warc(pages)[i][2] == "response"}


def test_warc_of_repeated_and_missing_values(spark):
    rows = [(1, None, "p"), (1, "u", "p"), (2, "v", "p"), (2, "v", "p"), (None, None, "p"), (None, "w", "q"), (None, None, "q"), (3, "x", None), (4, "y", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit("clash"), "size": F.lit(1)})
    out = warc.read(spark, warc.write(df, file_bytes=600))
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in out.collect()), key=str)
    want = [(1, None, "revisit", 2), (1, "u", "revisit", 2), (2, "v", "response", None), (2, "v", "response", None), (None, None, "revisit", 2), (None, "w", "response", None), (None, None, "response", None), (3, "x", "revisit", 4), (4, "y", "response", None)]
    assert got == sorted(want, key=str)


def test_archives_beyond_4_gb_and_damaged_ones(tmp_path):
    import zipfile

    path = tmp_path / "far.zip"
    with open(path, "wb") as f:
        f.seek(5 << 30)  # a hole
        with zipfile.ZipFile(f, "w") as z:
            z.writestr(zipfile.ZipInfo("a"), b"payload")
    with open(path, "rb") as f:
        at, n = warc.members(f, path.stat().st_size)["a"]
        assert at > 1 << 32 and warc.read_range(f, at, n) == b"payload"
    broken = tmp_path / "broken.zip"
    broken.write_bytes(b"PK no directory here")
    with open(broken, "rb") as f, pytest.raises(ValueError):
        warc.members(f, broken.stat().st_size)
    record = warc.build_record(1, "u", b"body", warc.base32_sha1(b"body"), None)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"body", b"bodi"))


def test_a_repeated_document_votes_once(spark):
    line = "a line of more than forty code points, which documents share"
    for ids, lost in (([1, 1, 1, 1, 2, 3], 0), ([1, 1, 2, 3, 4, 5], 5), ([1, 2, 3, 4, None], 3)):
        df = spark.createDataFrame([(i, line) for i in ids], "doc_id long, text string")
        assert line_dedup.dedup_lines(df).agg(F.sum("n_dropped")).first()[0] == lost


def test_zip64_directory_is_read(tmp_path):
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(70_000):  # more entries than 16 bits hold: the end record is a ZIP64 one
            z.writestr(zipfile.ZipInfo(f"{i}"), b"x" if i != 69_999 else b"last")
    with open(path, "rb") as f:
        found = warc.members(f, path.stat().st_size)
        assert len(found) == 70_000
        assert warc.read_range(f, *found["69999"]) == b"last"


def test_empty_tables(spark, df):
    none = df.limit(0)
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert line_dedup.dedup_lines(none).count() == quality.judge(none).count() == minhash.near_duplicates(none).count() == 0
    assert decontam.match(none, bench).count() == 0
    files = tokenfile.write(none, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert tokenfile.read(spark, files).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(pages)).count() == 0


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (line_dedup.dedup_lines(df), quality.judge(df), minhash.near_duplicates(df), tokenfile.read(spark, tokenfile.write(df, public_tokenizers.path("byte_bpe_50k.json"), 2))):
        assert out.count() == len(rows)
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).filter("doc_id is not null").collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]


def test_very_long_texts(spark):
    """Texts of 1.5 MB, most of them of one line, next to short ones."""
    rng = np.random.RandomState(9)
    words = rng.choice([f"w{i}" for i in range(5000)], 250_000)
    long, other = " ".join(words), " ".join(np.where(np.arange(len(words)) % 1000 == 7, "changed", words))
    lines = "\n".join([LINE, " ".join(words[:2000])] * 200)
    docs = {1: long, 2: other, 3: lines, 4: "a" * 1_500_000, 5: " " * 1_500_000, 6: "\n" * 300_000, 7: "short text", 8: LINE, 9: LINE, 10: LINE, 11: LINE + "\n" + long[:4000]}
    df = frame(spark, docs).cache()
    assert table(line_dedup.dedup_lines(df), "doc_id", "n_lines", "n_dropped", "text") == brute.lines(docs)
    assert table(quality.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == {k: brute.base_counts(t) for k, t in docs.items()}
    assert table(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id") == brute.near(docs)
    out = tokenfile.read(spark, tokenfile.write(df, public_tokenizers.path("byte_bpe_50k.json"), 2))
    enc, start = encoder(), 0
    for r in sorted(out.collect(), key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens
        if r.doc_id not in (4, 5, 6):  # the library that is compared with ends on these
            ids = np.array([*enc.encode_ordinary(docs[r.doc_id]), 2], dtype="<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    pages = spark.createDataFrame([(k, "u", t) for k, t in docs.items()], "page_id long, url string, html string")
    assert table(warc.read(spark, warc.write(pages)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute.warc(docs)
