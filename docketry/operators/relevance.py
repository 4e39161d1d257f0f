"""Whether a document matters, and what it is about: counts of whole-word terms, all in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.terms import among, found, lists_of, strings
from docketry.functions.text import contains_any, has_any, let, sample, single_spaced, words_of_name

STATEMENT_SCORE, LONGEST_BLOCK = 6, 800


#: V.HAS_DATE with a look ahead, as a character costs less to look at than an edge of words.
HAS_DATE = "(?i)(?=[0-9adfjmnos])" + V.HAS_DATE
#: All terms that documents are looked through for.
TERMS = tuple(dict.fromkeys((*(t for own in V.DOMAIN_TERMS.values() for t in own), *V.STATEMENT_NAMES, *V.BALANCE_NAMES, *V.BANK_HEADERS, *V.REFERENCE_MARKERS)))


def terms_of(low: Column) -> Column:
    """Which of all terms are whole words of a (lower-case) text."""
    return found(low, TERMS)


def statement_score(low: Column, terms: Column) -> Column:
    """How much a (lower-case) sample, with its terms, looks like a bank statement."""
    names, balances, headers = (F.size(among(terms, own)) for own in (V.STATEMENT_NAMES, V.BALANCE_NAMES, V.BANK_HEADERS))
    return names * 3 + F.least(F.lit(2), balances) * 2 + F.least(F.lit(4), headers) + F.least(F.lit(3), F.regexp_count(low, F.lit(V.DATED_ROW)))


def is_reference(low: Column, terms: Column, name_terms: Column) -> Column:
    """Course books and code listings: two markers, or one and a piece of code."""
    hits = F.size(F.array_union(among(terms, V.REFERENCE_MARKERS), among(name_terms, V.REFERENCE_MARKERS)))
    return (hits >= 2) | ((hits >= 1) & contains_any(F.concat(F.lit(" "), low, F.lit(" ")), V.CODE_TOKENS))


def best_domain(terms: Column, name_terms: Column) -> Column:
    """struct<score, ord, domain, by_text, by_name> of the domain that most terms of a text and, up to 3, of its name speak for; the first
    of several. A term of several words counts twice."""
    speaks_for = {t: [domain for domain, own in V.DOMAIN_TERMS.items() if t in own for _ in range(1 + (" " in t))] for own in V.DOMAIN_TERMS.values() for t in own}

    def votes(found_terms):
        return F.flatten(F.transform(among(found_terms, tuple(speaks_for)), lambda t: lists_of(t, speaks_for)))

    def best(own):
        def scored(domain):
            by_text, by_name = F.size(F.filter(own["text"], lambda d: d == domain)), F.least(F.lit(3), F.size(F.filter(own["name"], lambda d: d == domain)))
            return let(F.struct(by_text.alias("text"), by_name.alias("name")), lambda n: F.struct((n["text"] + n["name"]).alias("score"), (1 - F.array_position(strings(list(V.DOMAIN_TERMS)), domain)).cast("int").alias("ord"), domain.alias("domain"), n["text"].alias("by_text"), n["name"].alias("by_name")))

        return F.array_max(F.transform(F.array_union(own["text"], own["name"]), scored))

    none = F.struct(F.lit(0).alias("score"), F.lit(0).alias("ord"), F.lit(next(iter(V.DOMAIN_TERMS))).alias("domain"), F.lit(0).alias("by_text"), F.lit(0).alias("by_name"))
    return F.coalesce(let(F.struct(votes(terms).alias("text"), votes(name_terms).alias("name")), best), none)


def cohesive(content: Column, domain: Column) -> Column:
    """Whether one sentence has a term of the domain, one of action, and a date."""
    # a date has a digit: most blocks have none
    dated = F.filter(F.split(content, r"[\n.!?]+"), lambda b: b.rlike("[0-9]"))
    blocks = F.transform(dated, lambda b: F.lower(single_spaced(b)))

    def of_domain(b):
        # a pattern that is no literal would be compiled for each row
        return reduce(lambda other, own: F.when(domain == own[0], has_any(b, own[1])).otherwise(other), V.DOMAIN_TERMS.items(), F.lit(None).cast("boolean"))

    return F.exists(blocks, lambda b: (F.length(b) <= LONGEST_BLOCK) & b.rlike(HAS_DATE) & has_any(b, V.ACTION_TERMS) & of_domain(b))


def classify(docs: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """docs with relevant, domain, confidence, reason (as relevance_*) and bank_score.

    A null content has no evidence. Scores of all domains are one array; the first of the largest wins.
    """
    content = F.coalesce(F.col(content_col), F.lit(""))
    base = docs.withColumn("_low", F.lower(sample(content)))
    base = base.withColumns({"_terms": terms_of(F.col("_low")), "_name_terms": terms_of(F.lower(words_of_name(F.col(path_col))))})
    base = base.withColumns({"bank_score": statement_score(F.col("_low"), F.col("_terms")), "_top": best_domain(F.col("_terms"), F.col("_name_terms")), "_reference": is_reference(F.col("_low"), F.col("_terms"), F.col("_name_terms"))})
    top = F.col("_top")
    acts = has_any(F.col("_low"), V.ACTION_TERMS) & F.col("_low").rlike(HAS_DATE)
    enough = ((top["score"] >= 2) & cohesive(content, top["domain"])) | ((top["by_text"] >= 4) & acts) | ((top["by_name"] >= 2) & (top["by_text"] >= 2) & acts)
    bank = F.col("bank_score") >= STATEMENT_SCORE
    out = base.withColumn("_enough", F.when(F.col("_reference"), False).when(bank, True).otherwise(enough))
    by_bank = ~F.col("_reference") & bank
    return out.withColumns({
        "relevant": F.col("_enough"),
        "relevance_domain": F.when(by_bank, "banking").when(F.col("_enough"), top["domain"]),
        "relevance_confidence": F.when(by_bank, F.least(F.lit(99), 72 + F.col("bank_score") * 3)).when(F.col("_enough"), F.least(F.lit(96), 54 + top["score"] * 7)).otherwise(0),
        "relevance_reason": F.when(F.col("_reference"), "reference or educational material").when(bank, "bank statement structure").when(F.col("_enough"), "cohesive document evidence").otherwise("insufficient corroborating evidence"),
    }).drop("_low", "_terms", "_name_terms", "_top", "_reference", "_enough")
