"""Spelling variants, SimHash and whitening against plain re-statements."""

import random
import string

import brute
import numpy as np
import pytest

from docketry.llm import simhash, spelling, whitening

CLASHING = "doc_id long, text string, word string, n long, print long, head long, root long, key int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], CLASHING)


# spelling


def _spelled(rng, words=60):
    """Words with near ones around them, some of one half in common."""
    letters = "abcdefgéßÿ"
    out = []
    for k in range(words):
        w = ("common" if k % 3 else "") + "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
        out += [w] * (5 * 6 ** rng.randint(0, 2))
        for _ in range(3):
            at, c = rng.randrange(len(w)), rng.choice(letters)
            out += [rng.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :]])] * rng.choice([4, 5, 6, 31])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shard", [spelling.SHARD, 7])
def test_variants_are_those_of_brute_force(spark, shard):
    rng = random.Random(shard)
    words = _spelled(rng)
    rows = [(i, rng.choice([" ", ", ", "7", "ł", "中", "-"]).join(words[i::40]).title()) for i in range(40)] + [(None, "Common commen " * 9), (7, ""), (8, None), (3, "repeated repeatad " * 6), (3, "repeated"), (50, "chained " * 5 + "chaimed " * 40 + "chaimes " * 300)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(documents(spark, rows), shard=shard).collect()}
    want = brute.variants(brute.vocabulary(rows))
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] and v[0] != v[1] for v in want.values())
    assert got == want


def test_chains_ties_and_long_words(spark):
    long = "".join(random.Random(5).choice(string.ascii_lowercase) for _ in range(20_000))
    text = ["abcdef "] * 5 + ["abcdeg "] * 30 + ["abcdgg "] * 200 + ["abbdef "] * 30 + [long + " "] * 5 + [long[:-1] + "é "] * 30
    got = {r.word: r for r in spelling.variants(documents(spark, [(1, "".join(text))]), deleted=1 << 33).collect()}
    # of two near words with as many occurrences the smaller one; its own form is none, as nothing is five times as frequent there
    assert (got["abcdef"].form, got["abcdef"].root, got["abcdef"].n_near, got["abcdef"].form_n) == ("abbdef", "abbdef", 2, 30)
    assert (got["abcdeg"].form, got["abcdeg"].n_near) == ("abcdgg", 2)
    assert got[long].form == got[long].root == long[:-1] + "é" and got[long[:-1] + "é"].form is None


def test_roots_follow_the_whole_chain(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)], "word string, form string")
    assert {r.root for r in spelling.last_of_chains(forms).collect()} == {"w20"}


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "one two 123456")]):
        assert spelling.variants(documents(spark, rows)).collect() == []


def test_intervals_of_the_index_are_those_of_sorted_rotations():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = spelling.FmIndex(text, 3)
    turned = sorted(range(len(text)), key=lambda i: [*text[i:].tolist(), *text[:i].tolist()])
    assert index.order.tolist() == turned
    low, high, less = index.step(np.array([0, 17]), np.array([len(text), 90]), np.array([2, 3]))
    rows = [[*text[i:].tolist(), *text[:i].tolist()] for i in turned]
    assert (low[0], high[0]) == (sum(r[0] < 2 for r in rows), sum(r[0] <= 2 for r in rows))
    assert less[1] == sum(r[-1] < 3 for r in rows[17:90]) and high[1] - low[1] == sum(r[-1] == 3 for r in rows[17:90])
    own, symbol, lo, hi = index.follow(np.array([17]), np.array([90]))
    assert {s: h - a for s, a, h in zip(symbol.tolist(), lo.tolist(), hi.tolist(), strict=True)} == {s: n for s in range(5) if (n := sum(r[-1] == s for r in rows[17:90]))}


# SimHash


def _texts(rng):
    base = [f"word{rng.randint(0, 400)}" for _ in range(300)]
    rows = [(9, None), (4, ""), (30, " \n"), (11, "one two"), (12, "ONE two"), (13, "one"), (None, "one two"), (14, "x y z w v"), (21, "a b c d"), (21, "e f g h")]
    for i in range(100, 160):  # a family with few differences
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(f"t{rng.randint(0, 50)}" for _ in range(rng.randint(1, 60)))) for i in range(200, 260)]
    rows += [(900 + i, " ".join(base)) for i in range(20)]
    return rows


@pytest.mark.parametrize(("range_size", "block"), [(simhash.RANGE, simhash.BLOCK), (12, 3)])
def test_components_are_those_of_all_pairs(spark, range_size, block):
    rows = _texts(random.Random(8))
    got = simhash.near_duplicates(documents(spark, rows), range_size=range_size, block=block).collect()
    prints = {t: brute.fingerprint(t) for _, t in rows}
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint) for r in got if r.doc_id is not None) == sorted((False, i, f"{prints[t]:016x}") for i, t in rows if i is not None)
    own = [(i, prints[t]) for i, t in rows if i is not None]
    first = {}
    for i, p in own:
        first[p] = min(i, first.get(p, i))
    by_first = {i: p for p, i in first.items()}
    root = brute.components(by_first, lambda a, b: (by_first[a] ^ by_first[b]).bit_count() <= 3)
    assert len(set(root.values())) < len(root) - 10
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {(i, f"{p:016x}", root[first[p]]) for i, p in own}
    assert [(r.fingerprint, r.component_id) for r in got if r.doc_id is None] == [(f"{prints['one two']:016x}", None)]


def test_links_of_dense_and_hot_groups(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    some = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(500)}
    some |= {(centre & 0xFFFF) | rng.getrandbits(48) << 16 for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 2**63, 7}
    codes = sorted(some)
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    want = brute.components(codes, lambda a, b: (a ^ b).bit_count() <= 3)
    for size, block in ((100_000, 4096), (150, 20)):
        links = simhash.links(spark.createDataFrame(signed, "print long"), size, block).collect()
        assert len(links) < 60 * len(codes)
        linked = {frozenset((r.a % 2**64, r.b % 2**64)) for r in links}
        assert brute.components(codes, lambda a, b: frozenset((a, b)) in linked) == want


def test_fingerprints_of_very_long_texts_are_hashed_in_runs(monkeypatch):
    text = " ".join(f"W{i % 977}" for i in range(70_000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "AT_ONCE", 1000)
    assert simhash.fingerprint(text.encode()) == whole == brute.fingerprint(text)
    # exactly half of the hashes is not over half
    assert simhash.fingerprint(b"a b c a b") == brute.fingerprint("a b c a b")


def test_no_documents(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, n long, v double, component int, dims int")


def _plain(rows):
    """(n*x-S of each vector as Python integers, centred rows, eigenvalues and vectors, falling)."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in rows]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    exact = [[n * c - s for c, s in zip(v, total, strict=True)] for v in x]
    a = np.array(exact, dtype=float) / n
    e, u = np.linalg.eigh(a.T @ a / n)
    return exact, a, e[::-1], u[:, ::-1]


def test_whitening_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(4)
    good = (rng.normal(size=(300, 40)) * np.linspace(0.1, 9, 40) @ rng.normal(size=(40, 40))).tolist()
    bad = [None, [None, *good[0][1:]], [float("nan"), *good[0][1:]], [float("inf"), *good[0][1:]], [], [1.0, 2.0], [1e30, *good[0][1:]]]
    rows = [*enumerate(good[:-2]), (None, good[-2]), (5, good[-1]), *((1000 + i, v) for i, v in enumerate(bad))]
    got = whitening.whiten(vectors(spark, rows).repartition(5)).toPandas()
    assert len(got) == 300 * 32 and set(got.n) == {300} and got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1
    exact, a, e, u = _plain(good)
    want = a @ u[:, :32] / np.sqrt(e[:32])
    own = got[got.vec_id.notna() & (got.vec_id != 5)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    mine = np.delete(want[:298], 5, axis=0)
    assert np.abs(own * np.sign((own * mine).sum(axis=0)) - mine).max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first(), e[:32] / e.sum(), rtol=1e-9)
    assert sorted(got[got.component == 1].deviation) == sorted(sum(c * c for c in v) for v in exact)


def test_bad_condition_and_missing_rank(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 5))
    # one direction 10^5 times as long as the others, a repeated dimension, a constant one
    rows = np.column_stack([base[:, :1] * 1e5, base[:, 1:], base[:, 1], np.full(200, 0.5)]).tolist()
    got = whitening.whiten(vectors(spark, list(enumerate(rows))), components=7).toPandas()
    e = _plain(rows)[2]
    assert got.identity_error.max() < 1e-6 and len(got) == 200 * 7
    assert got[got.component <= 5].whitened.notna().all() and got[got.component > 5].whitened.isna().all()
    assert np.allclose(got.groupby("component").explained.first()[:5], e[:5] / e.sum(), rtol=1e-6) and set(got[got.component > 5].explained) == {0.0}


def test_few_vectors_and_none(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == [] == whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect()
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0, 0), (2, 0, None, 0, 0)] * 2
    two = whitening.whiten(vectors(spark, [(1, [0.5, 0.0]), (2, [-0.5, 0.0])])).collect()
    assert [(r.component, r.deviation, r.explained) for r in two] == [(1, 4096, 1), (2, 4096, 0)] * 2 and all(abs(abs(r.whitened) - 1) < 1e-12 for r in two if r.component == 1)


def test_deviations_are_exact_or_null():
    values = np.array([[2**40, 1], [-(2**40), 5], [3, 3]])
    sums = [int(x) for x in values.sum(axis=0)]
    want = [sum((3 * int(x) - s) ** 2 for x, s in zip(v, sums, strict=True)) for v in values]
    assert whitening.deviations(values, 3, sums).tolist() == [x if x < 2**63 else None for x in want]
    assert whitening.centred(values, 3, sums)[2].tolist() == [(3 * 3 - s) / 3 for s in sums]
