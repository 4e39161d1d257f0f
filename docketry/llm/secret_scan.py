"""Secret scanning: candidate strings, then a random forest that removes false positives. DataFrame operations only.

A candidate is a run of at least MIN_LENGTH characters of `A-Za-z0-9_+/-` with its padding of `=`, or a whole PEM block of a
private key. Its features are its length, its mix of characters and the transitions between their classes, the share of its letters that dictionary
words cover (words that make up MIN_SHARE of the corpus or more, of any length; a run of letters is cut where small letters meet
capitals), its path, the signs around it, and the two words before and the word after it, hashed to WORD_BUCKETS places each.
A random forest trained from labelled findings gives the probability that it is a secret.

Training takes at most about `max_rows` labelled findings, chosen by a hash; counts for the dictionary cover all documents. Where
no labelled findings are given, `rule_labels` makes them from the corpus: candidates in one of several precise forms of
secrets are findings, those in a known benign form are not; those in both (a password that is made of plain words) and all others stay unlabelled, and
the forest decides. None of the patterns of those rules is a feature, so the forest judges by shape and neighbours, and `disagreements` counts
where it overrules a form.

Defined results: one row per candidate; null and empty texts have none. Rows that repeat a doc_id are scanned each for itself; a null doc_id
stays null. If the labelled findings have one class only, every probability is that class; without any, 0. A long text
is scanned whole. Of the other columns only the path is looked at; a null path is an empty one.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import scratch_root, spill

MIN_LENGTH = 12
#: A word of the dictionary makes up this share of all words, and MIN_USES words at least.
MIN_SHARE, MIN_USES, WORD_BUCKETS = 1e-6, 3, 16
#: The body has no five dashes in a row; possessive groups, so that a body of any length is matched without recursion.
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]++|-(?!----))++-----END [A-Z ]{0,40}PRIVATE KEY-----"
CANDIDATE = PEM + r"|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
#: What names a secret, before a value.
NAME = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
#: Keys that providers mark by a prefix.
PROVIDER = r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|(sk|rk|pk)_(live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36})$"
#: Before a value: a secret's name and an assignment, quoted or not; the scheme of a header; a user's name in a URL (with AT after it).
ASSIGNED, HEADER, USER, AT = NAME + r"[A-Za-z0-9_-]{0,16}[\"']?\s*(:=|=>|[:=])\s*[\"'`]?$", r"(?i)(\bbearer|authorization[\"']?\s*[:=]\s*[\"']?(basic|token))\s+$", r"://[^\s/@:]*:$", r"^[^\s/@]*@"
#: Benign values: digits only, signs only, words and short numbers joined by single signs (also paths), UUIDs.
BENIGN = r"^(?:[0-9+/_=-]++|[_+/=-]++|/*+(?:[A-Za-z]{1,24}|[0-9]{1,6})(?:[-_/+]{1,2}(?:[A-Za-z]{1,24}|[0-9]{1,6}))*+[-_/]*+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
#: Characters of context on either side.
BEFORE, AFTER = 48, 24
#: From this share of letters in dictionary words on, a benign form is plain words.
PLAIN = 0.5
MAX_ROWS, TREES, DEPTH = 20_000, 24, 6
FEATURES = ["length", "digits", "uppers", "lowers", "others", "kinds", "hex", "changes", "coverage", "path_test", "path_config", "path_depth", "quote_before", "quote_after", "number_before", "punct_after"]
FEATURES += [f"{place}_{k}" for place in ("before", "after") for k in range(WORD_BUCKETS)]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, path, nth, value, before, after): every candidate with its surroundings."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike(CANDIDATE))
    gaps, values = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    cut = own.select("doc_id", "path", gaps.alias("gaps"), values.alias("found"))
    around = F.transform("found", lambda v, i: F.struct(v.alias("value"), F.right(F.concat(F.coalesce(F.get("found", i - 1), F.lit("")), F.element_at("gaps", i + 1)), F.lit(BEFORE)).alias("before"), F.left(F.element_at("gaps", i + 2), F.lit(AFTER)).alias("after")))
    return cut.select("doc_id", "path", F.posexplode(around).alias("nth", "x")).select("doc_id", "path", F.col("nth").cast("long").alias("nth"), "x.value", "x.before", "x.after")


def dictionary(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, min_uses: int = MIN_USES) -> DataFrame:
    """(word): words a-z of three letters or more in use throughout the corpus, counted over all of it."""
    words = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<![\p{L}\p{N}])[a-z]{3,}(?![\p{L}\p{N}])"), F.lit(0))
    counts = spill(docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_uses), "secret-words")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return counts.filter(F.col("n") >= min_share * total).select("word")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the columns of FEATURES; found needs a unique `row`."""
    v, n = F.col("value"), F.length("value").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    def has(col: str, pattern: str) -> Column:
        return F.col(col).rlike(pattern).cast("double")

    # letter runs looked up in the dictionary by equality; only candidates' runs travel
    runs = found.select("row", F.explode(F.regexp_extract_all(v, F.lit(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))).alias("word")).withColumn("word", F.lower("word"))
    covered = runs.join(words, "word").groupBy("row").agg(F.sum(F.length("word")).alias("covered"))
    letters = F.greatest(F.regexp_count(v, F.lit("[A-Za-z]")), F.lit(1))
    out = found.join(covered, "row", "left")
    known = F.regexp_extract_all(F.lower("before"), F.lit("[a-z]{2,}"), F.lit(0))
    near = {"before": F.slice(F.reverse(known), 1, 2), "after": F.slice(F.regexp_extract_all(F.lower("after"), F.lit("[a-z]{2,}"), F.lit(0)), 1, 1)}
    out = out.withColumns({f"_{k}": F.transform(x, lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS))) for k, x in near.items()})
    out = out.withColumns({f"{place}_{k}": F.array_contains(f"_{place}", F.lit(k).cast("long")).cast("double") for place in near for k in range(WORD_BUCKETS)}).drop("_before", "_after")
    return out.withColumns({
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "others": share("[^A-Za-z0-9]"),
        "kinds": sum((has("value", p) for p in ("[0-9]", "[A-Z]", "[a-z]", "[^A-Za-z0-9]")), F.lit(0.0)),
        "hex": has("value", "^[0-9A-Fa-f]+$"),
        "changes": F.regexp_count(v, F.lit("(?<=[0-9])[^0-9]|(?<=[A-Z])[^A-Z]|(?<=[a-z])[^a-z]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")) / n,
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / letters,
        "path_test": has("path", r"(?i)test|example|sample|fixture|mock|doc"),
        "path_config": has("path", r"(?i)\.(env|ini|cfg|conf|ya?ml|json|toml|properties|pem|key)$|config|secret"),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "quote_before": has("before", r"[\"'`]$"),
        "quote_after": has("after", r"^[\"'`]"),
        "number_before": has("before", r"[0-9)+.,]\s?$"),
        "punct_after": has("after", r"^[.,;:!?@]"),
    }).drop("covered")


def rule_labels(found: DataFrame) -> DataFrame:
    """(row, label) of the candidates (with their coverage) in a precise form of secrets, or else in a benign one; the others are not labelled."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    hit = value.rlike(PROVIDER) | before.rlike(ASSIGNED) | before.rlike(HEADER) | (before.rlike(USER) & after.rlike(AT)) | value.startswith("-----BEGIN ")
    benign = value.rlike(BENIGN) | before.rlike(r"://\S*$") | before.rlike(r"@\S*$") | after.rlike("^@") | before.rlike(r"(?i)\b(commit|sha[0-9]*|md5|checksum|digest)\s*[:=]?\s*$")
    plain = benign & ((F.col("coverage") >= PLAIN) | ~value.rlike("[A-Za-z]"))
    return found.select("row", F.when(hit & ~plain, 1.0).when(benign & ~hit, 0.0).alias("label")).filter("label is not null")


def disagreements(scored: DataFrame) -> DataFrame:
    """(form, is_secret, n): how the forest judged the candidates that rule_labels calls findings (1), benign (0) or neither (null). scored: scan(..., with_context=True)."""
    own = scored.withColumn("row", F.monotonically_increasing_id())
    return own.join(rule_labels(own), "row", "left").groupBy(F.col("label").alias("form"), "is_secret").agg(F.count(F.lit(1)).alias("n"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", max_rows: int = MAX_ROWS, min_uses: int = MIN_USES, with_context: bool = False) -> DataFrame:
    """(doc_id, nth, value_sha256, length, probability, is_secret[, value, before, after, coverage]), one row per candidate.

    labelled: (doc_id, nth, label) findings to learn from; null: rule_labels over the candidates.
    """
    spark = docs.sparkSession
    scratch_root(spark)
    found = spill(candidates(docs, id_col, text_col, path_col).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    words = dictionary(docs, text_col, min_uses=min_uses)
    scored = spill(features(found, words), "secret-features")
    if labelled is None:
        truth = rule_labels(scored)
    else:
        own = labelled.select(F.col("doc_id").cast("long").alias("d"), F.col("nth").cast("long").alias("k"), F.col("label").cast("double").alias("label")).filter("label is not null").groupBy("d", "k").agg(F.max("label").alias("label"))
        truth = found.join(own, (F.col("doc_id") == F.col("d")) & (F.col("nth") == F.col("k"))).select("row", "label")
    truth = spill(truth, "secret-labels")
    counts = {r["label"]: r["n"] for r in truth.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    probability = F.lit(float(next(iter(counts), 0.0)))
    if len(counts) > 1:
        # the rarer class weighs as much as the other; a bounded share of each is learnt from
        keep = sum((F.when(F.col("label") == k, F.pmod(F.xxhash64("value", "before"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.5 * max_rows / n))).otherwise(False).cast("int") for k, n in counts.items()), F.lit(0)) > 0
        train = scored.join(truth, "row").filter(keep)
        weight = F.lit(1.0)
        for k, n in counts.items():
            weight = F.when(F.col("label") == k, F.lit(1.0 / min(n, 0.5 * max_rows))).otherwise(weight)
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="x")
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=TREES, maxDepth=DEPTH, seed=11)
        model = forest.fit(assemble.transform(train.withColumn("w", weight * min(counts.values()))).select("x", "label", "w").repartition(8))
        scored = model.transform(assemble.transform(scored))
        probability = vector_to_array("probability")[1]
    out = scored.withColumn("p", probability)
    return out.select("doc_id", "nth", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").cast("long").alias("length"), F.round("p", 6).alias("probability"), (F.col("p") >= 0.5).alias("is_secret"), *(("value", "before", "after", "coverage") if with_context else ()))
