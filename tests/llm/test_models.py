"""Learnt operators: what they must return whatever they learn, and held-out accuracy."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import langid, secret_scan, toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def docs(spark):
    rng = np.random.RandomState(3)
    words = {"aa": ["mola", "tirano", "solare", "pinto"], "bb": ["schtr", "krumpf", "wirz", "zech"]}
    rows = [(i, " ".join(rng.choice(words[k], 30)), k) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", None), (903, "Mola!", None), (904, "x" * 20000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))


def test_langid(spark):
    got = {r.doc_id: r for r in langid.learn_and_predict(docs(spark)).collect()}
    assert len(got) == 205 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(200))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "aa"
    none = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.learn_and_predict(none).collect()} == {"und"}
    assert langid.learn_and_predict(none.limit(0)).count() == 0


def test_langid_keeps_every_gram_at_any_size(spark):
    def by_id(out):
        return {r.doc_id: r for r in out.collect()}

    want, got = (by_id(langid.learn_and_predict(docs(spark), max_grams=n)) for n in (langid.MAX_GRAMS, 10))
    assert want.keys() == got.keys()
    for i, r in want.items():
        assert got[i].lang_pred == r.lang_pred and got[i].rejected == r.rejected and got[i].held_out == r.held_out
        assert math.isclose(got[i].cross_entropy, r.cross_entropy, abs_tol=1e-9) and math.isclose(got[i].score, r.score, abs_tol=1e-9)


def test_langid_rejects_by_all_training_documents(spark):
    rows = [(i, "mola tirano solare pinto", "aa") for i in range(6000)] + [(7000 + i, "schtr krumpf wirz zech", "bb") for i in range(60)]
    # no sample by the ids' hash has the rare language
    rare = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter("lang = 'aa' or " + " and ".join(f"pmod(xxhash64(doc_id), {k}) <> 0" for k in (2, 3, 4)))
    odd = spark.createDataFrame([(9000, "zech" + "qxjv" * 50, None)], rare.schema)
    got = {r.doc_id: r for r in langid.learn_and_predict(rare.union(odd)).filter("doc_id >= 7000").collect()}
    assert len(got) > 5 and all(r.lang_pred == "bb" and r.rejected == (k == 9000) for k, r in got.items())


def test_distinct_grams():
    grams, sizes = langid.grams_of(["abab abba cab", "bac"])
    assert len(grams) == sizes.sum() == 16
    unique, at = langid.distinct(grams)
    want, back = np.unique(grams, return_inverse=True)
    assert np.array_equal(np.sort(unique), want) and np.array_equal(unique[at], grams) and np.array_equal(want[back], grams)


def brute_kneser_ney(texts, gram, alphabet):
    """Probability of gram's last character after the three before it, straight from the definition."""
    from collections import Counter

    counts = {4: Counter()}
    for t in texts:
        padded = "   " + t
        counts[4].update(padded[i : i + 4] for i in range(len(t)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = 1 / (alphabet + 1)
    for k in range(1, 5):
        own, c = gram[4 - k :], counts[k]
        ones, twos = (sum(1 for n in c.values() if n == m) for m in (1, 2))
        d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
        total = sum(n for g, n in c.items() if g[:-1] == own[:-1])
        if total:
            left = 1 - sum(max(n - d, 0) / total for g, n in c.items() if g[:-1] == own[:-1])
            p = max(c[own] - d, 0) / total + min(1.0, max(1e-9, left)) * p
    return p


def test_kneser_ney_equals_the_definition(spark):
    texts = {"x": ["abab abba cab abc ", "bac cab "], "y": ["dad add bad ", "éd da "]}
    df = spark.createDataFrame([(t, k) for k, own in texts.items() for t in own], "text string, lang string")
    model = langid.build(langid.count_grams(df))
    alphabet = len(set("".join(sum(texts.values(), []))))
    grams = [a + b for a in ("   ", "  a", " ab", "abb", "zzz", "b c") for b in " abcdézq"]
    codes = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in grams], dtype=np.uint64)
    for lang, own in texts.items():
        want = [math.log(brute_kneser_ney(own, g, alphabet)) for g in grams]
        assert np.allclose(model[lang].log_p(codes), want, atol=1e-9, rtol=0)
        seen = [g for g in grams if g[:3] == " ab" and g[3] not in "zq"]
        assert sum(math.exp(x) for x, g in zip(want, grams, strict=True) if g in seen) < 1


def test_marks_stay_with_their_letters():
    codes, sizes = langid.codes_of(["नमस्ते x", "\u0301\u0301"])
    assert sizes.tolist() == [8, 0] and 0x94D in codes.tolist()


@needs_data
def test_langid_held_out(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.learn_and_predict(table).filter("held_out").join(table.select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_toxicity(spark):
    rng = np.random.RandomState(5)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        if i % 4 == 0:
            w[rng.randint(40)] = ("vile", "rotten")[i % 8 // 4]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "vile"), (902, "vile")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(1))
    lab = spark.createDataFrame([*labels, (1, None), (0, 1)], "doc_id long, toxic int")
    got = toxicity.learn_and_score(d, lab).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    assert {r.score for r in toxicity.learn_and_score(d, lab.limit(0)).collect()}.pop() < 1e-6
    assert toxicity.learn_and_score(d.limit(0), lab).count() == 0


def test_ftrl_equals_the_plain_form():
    """The update rule coordinate by coordinate, in plain Python."""
    rng = np.random.RandomState(8)
    rows = [toxicity.features((" ".join(rng.choice(list("abcdefgh"), 6))).encode()) for _ in range(60)]
    labels = [int(rng.rand() < 0.4) for _ in rows]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.RandomState(7)
    for _ in range(4):
        for k in order.permutation(len(rows)):
            own = {int(i): weight(int(i)) for i in rows[k]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(own.values()))))) - labels[k]
            for i, w in own.items():
                was, n[i] = n.get(i, 0.0), n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(was)) / toxicity.ALPHA * w
    got = toxicity.ftrl(rows, labels, epochs=4)
    want = np.zeros(len(got))
    for i in z:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-9) and (want != 0).any() and (want == 0).sum() > len(want) - len(z)


@needs_data
def test_toxicity_held_out(spark):
    """Held-out labels of the given tables, by the registered query."""
    from docketry.llm.queries import op3_toxicity

    sf = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = op3_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[(1, 1)] > 0.75 * (n[(1, 1)] + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.02 * n[(0, 0)]


def test_toxicity_of_very_long_text(spark):
    rows = [(i, "vile " + "w " * 50 if i % 2 else "fine " + "w " * 50) for i in range(100)] + [(900, "w x y z " * 200_000 + "vile"), (901, "w x y z " * 200_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.learn_and_score(d, spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")).collect()}
    assert got[900] > got[901]


def test_toxicity_of_a_bounded_sample(spark):
    d = spark.createDataFrame([(i, "vile" if i % 2 else "fine") for i in range(400)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.learn_and_score(d, lab, max_rows=100).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def secrets(spark):
    import hashlib

    rows = []
    for i in range(120):
        hexes = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f"The the and and. token = \"{hexes}\" and the card 4{i:015d} paid", "src/app.env"))
        rows.append((1000 + i, f"see https://x.example.com/page{i}abcdefgh12 and the part-no-{i}-abcdefg or 12345678{i:06d}", None))
    rows += [(5000, None, "a"), (5001, "", None), (None, "token = \"0123456789abcdef\"", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("value", F.lit(1))


def test_secret_scan(spark):
    df = secrets(spark)
    found = secret_scan.scan(df, min_uses=5)
    got = found.collect()
    real = [r for r in got if r.length == 40]
    assert len(real) == 120 and all(r.is_secret for r in real)
    assert not any(r.is_secret for r in got if r.doc_id is not None and r.doc_id >= 1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert secret_scan.scan(df.limit(0)).count() == 0
    assert {r.probability for r in secret_scan.scan(df, labelled=spark.createDataFrame([(0, 0, 1.0)], "doc_id long, nth long, label double")).collect()} == {1.0}


def test_secret_scan_finds_every_form(spark):
    import base64
    import hashlib

    forms = {
        "API_KEY={}": lambda h: h[:32],
        "GITHUB_ACCESS_TOKEN={}": lambda h: h[:32],
        "password: {}": lambda h: "".join(chr(97 + int(c, 16)) for c in h[:20]),  # no digit
        "Authorization: Bearer {}": lambda h: base64.b64encode(bytes.fromhex(h)).decode(),
        "postgres://admin:{}@db.example.com/main": lambda h: h[:24],
        "use {} here": lambda h: "AKIA" + h[:16].upper(),
        "key\n{}\nend": lambda h: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join([base64.b64encode(bytes.fromhex(h + h)).decode()[:64]] * 3) + "\n-----END RSA PRIVATE KEY-----",
    }
    rows, want = [], {}
    for k, (form, make) in enumerate(forms.items()):
        for i in range(40):
            value = make(hashlib.sha256(f"{k} {i}".encode()).hexdigest())
            rows.append((100 * k + i, "some plain words " + form.format(value), "notes"))
            want.setdefault(form, set()).add((100 * k + i, hashlib.sha256(value.encode()).hexdigest()))
    rows += [(5000 + i, f"internationalization of https://x.example.com/page{i}abcdefgh12 in part-no-{i}-abcdefg, 12345678{i:06d}", None) for i in range(200)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_uses=5).filter("is_secret").collect()
    found = {(r.doc_id, r.value_sha256) for r in got}
    assert {form: len(x & found) for form, x in want.items()} == dict.fromkeys(forms, 40)
    assert all(r.doc_id < 5000 for r in got)


def test_secret_scan_overrules_forms(spark):
    """Passwords of plain words are in a form of secrets, and keys under names that no rule knows are in none."""
    import hashlib

    rng = np.random.RandomState(2)
    words = "orange garden window summer planet kitchen yellow pencil basket winter".split()
    rows = []
    for i in range(150):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        rows.append((i, f"config token = \"{h[:40]}\" set", "a.env"))
        rows.append((1000 + i, "the " + " ".join(rng.choice(words, 30)) + f" see https://x.example.com/{'-'.join(rng.choice(words, 3))} and " + "-".join(rng.choice(words, 3)), "notes"))
    rows += [(5000 + i, "password: " + "-".join(rng.choice(words, 3)), "a.env") for i in range(40)]
    rows += [(6000 + i, "vault seal " + hashlib.sha256(b"%d" % -i).hexdigest()[:40] + " kept", "a.env") for i in range(40)]
    out = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), with_context=True)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id // 1000, []).append(r.is_secret)
    assert all(got[0]) and not any(got[1]) and np.mean(got[5]) < 0.1 and np.mean(got[6]) > 0.9
    told = {(r.form, r.is_secret): r.n for r in secret_scan.disagreements(out).collect()}
    assert told[(1.0, True)] == 150 and told.get((None, True), 0) >= 36 and told.get((None, False), 0) >= 36


def test_secret_features_equal_brute_force(spark):
    import re
    import string

    rng = np.random.RandomState(6)
    values = ["".join(rng.choice(list(string.ascii_letters + string.digits + "_+/-"), rng.randint(12, 60))) for _ in range(44)] + ["orangeGarden12345", "windowwindow-orange", "0123456789ab", "A" * 300, "OrangeJuiceORANGE", "a1" * 20]
    rows = [(i, v, "x token ", " then") for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, "row long, value string, before string, after string").withColumn("path", F.lit("a/test.env"))
    words = {"orange", "garden", "window"}
    got = {r.row: r for r in secret_scan.features(found, spark.createDataFrame([(w,) for w in words], "word string")).collect()}

    def kind(c):
        return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3

    for i, v in enumerate(values):
        n, r = len(v), got[i]
        want = [n, sum(c.isdigit() for c in v) / n, sum(c.isupper() for c in v) / n, sum(c.islower() for c in v) / n, sum(kind(c) == 3 for c in v) / n, len(set(map(kind, v))), float(all(c in string.hexdigits for c in v)), sum(kind(a) != kind(b) for a, b in zip(v, v[1:])) / n]
        runs = [x.lower() for x in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}", v)]
        want.append(sum(len(x) for x in runs if x in words) / max(1, sum(c.isalpha() for c in v)))
        assert np.allclose([r[k] for k in secret_scan.FEATURES[:9]], want)
        assert (r.path_test, r.path_config, r.path_depth, r.punct_after) == (1.0, 1.0, 1.0, 0.0)
        assert sum(r[f"before_{k}"] for k in range(secret_scan.WORD_BUCKETS)) == 1.0 == sum(r[f"after_{k}"] for k in range(secret_scan.WORD_BUCKETS))


def test_secret_scan_of_awkward_rows(spark):
    long = "x y " * 50_000 + "token = \"" + "0a" * 20 + "\""
    rows = [(1, long, "a"), (1, long, "a"), (None, "b" * 300_000, None), (2, "", "a"), (3, None, "a")]
    labelled = spark.createDataFrame([(1, 0, 1.0), (1, 0, 0.0), (9, 9, 1.0), (1, None, 1.0)], "doc_id long, nth long, label double")
    out = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), labelled=labelled).collect()
    assert sorted((r.doc_id or 0, r.length, r.probability) for r in out) == [(0, 300_000, 1.0), (1, 40, 1.0), (1, 40, 1.0)]


@needs_data
def test_secret_scan_finds_the_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.select(F.sum(F.regexp_count("text", F.lit(r'(?i)token = "[0-9a-f]{40}"')))).first()[0]
    assert secret_scan.scan(docs).filter("is_secret and length = 40").count() == n


def test_letters_only():
    codes, sizes = langid.codes_of(["A1b  c!", None, ""])
    assert bytes(c for c in codes.tolist()).decode() == "   a b c    " + "   " and sizes.tolist() == [6, 0, 0]


def test_long_secrets_are_judged_whole(spark):
    import hashlib

    key = hashlib.sha256(b"key").hexdigest()
    dashed, pem = "word-" * 60 + key, "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n" + "Ab1+" * 30_000 + "\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f"see {dashed} there"), (2, f"x {pem} y {pem}"), (3, "-----BEGIN RSA PRIVATE KEY-----\n" + "Ab1+" * 9), (4, "a " + "word-" * 100_000 + "word " + "/ab" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secret_scan.candidates(docs).withColumns({"row": F.monotonically_increasing_id(), "coverage": F.lit(1.0)}).cache()
    got = {(r.doc_id, r.nth): r.value for r in found.collect()}
    assert got[1, 0] == dashed and got[2, 0] == got[2, 1] == pem and "BEGIN" not in got[3, 0] and len(got[4, 0]) == 500_004 and len(got[4, 1]) == 600_000
    labels = {(r.doc_id, r.nth): r.label for r in found.join(secret_scan.rule_labels(found), "row", "left").collect()}
    assert labels[1, 0] is None and labels[2, 0] == labels[2, 1] == 1.0 and labels[4, 0] == labels[4, 1] == 0.0
