"""Column functions over text. All native: no Python runs on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.terms import strings, whole_words
from docketry.functions.terms import found as terms_found

#: Line ends as str.splitlines() sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Word characters and white space of all scripts, as Python's \w and \s.
NOT_AFTER, NOT_BEFORE, SPACES = r"(?<!(?U:\w))", r"(?!(?U:\w))", r"(?U)\s+"
PAGE_LINE = r"^\[\[PAGE:([0-9]+)\]\]$"


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once a row, whatever is filtered by them later: filters are moved in front of a projection
    with all that its expressions hold, and not in front of a generator."""
    own = df.withColumns(columns)
    return own.select(*(c for c in own.columns if c not in columns), F.inline(F.array(F.struct(*columns))))


def has_any(text: Column, terms) -> Column:
    """Whether any of the terms is in text as whole words."""
    return text.rlike(whole_words(terms))


def contains_any(text: Column, parts) -> Column:
    """Whether any of the parts is a substring of text."""
    # one look for each part: a pattern of alternatives tries all of them at each place, which takes five times as long
    return reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in parts))


def single_spaced(text: Column) -> Column:
    """White space of any kind and length becomes one space."""
    # most texts have single spaces alone, and looking for others costs less than replacing each
    return F.when(text.rlike(r"(?U)  |[\s&&[^ ]]"), F.regexp_replace(text, SPACES, " ")).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space of any kind and length becomes one space; none at the ends."""
    return F.trim(single_spaced(text))


def clean(text: Column) -> Column:
    """Line ends become LF, spaces and tabs one space, three or more LF two; no white space at the ends."""
    lf = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(lf, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def sample(text: Column, tokens: int = V.SAMPLE_TOKENS) -> Column:
    """The text up to the end of its tokens-th token; the whole text if it has no more."""
    head = F.regexp_extract(text, r"^((?s:(?U:\s*(?:\S+\s+){0,%d}\S+)))" % (tokens - 1), 1)
    # one token more takes 2 * tokens + 1 characters at least
    return F.when((F.length(text) <= 2 * tokens) | (F.regexp_count(text, F.lit(r"(?U)\S+")) <= tokens), text).otherwise(head)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def words_of_name(path: Column) -> Column:
    return F.regexp_replace(stem(path), "[_-]+", " ")


def suffix(path: Column) -> Column:
    """The last suffix in lower case, with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1))


def title_case(text: Column) -> Column:
    """Capitals after everything but letters, small letters elsewhere."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def spans(text: Column, pattern: str, likely: bool = False) -> Column:
    """array<struct<start int, raw string>> of all matches, from left to right; text must hold no U+0001 or U+0002.

    likely: most texts match, so that it isn't tested beforehand."""
    marked = F.split(F.regexp_replace(text, "(" + pattern + ")", "\u0001$1\u0002"), "\u0001", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,raw:string>>").alias("found"))

    def step(acc, x):
        hit = x.contains("\u0002")
        raw = F.substring_index(x, "\u0002", 1)
        found = F.when(hit, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), raw.alias("raw"))))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(x) - hit.cast("int")).alias("at"), found.alias("found"))

    def placed(m):
        one = F.struct(F.length(F.get(m, 0)).alias("start"), F.substring_index(F.get(m, 1), "\u0002", 1).alias("raw"))
        return F.when(F.size(m) == 2, F.array(one)).otherwise(F.aggregate(m, start, step, lambda acc: acc["found"]))

    matches = let(marked, placed)
    return matches if likely else F.when(text.rlike(pattern), matches).otherwise(F.array().cast("array<struct<start:int,raw:string>>"))


def nearest(text: Column, at: Column, words) -> Column:
    """struct<distance int, ord int, word string> of the whole word nearest to position at; ties go to the first
    in the list; null if there is none."""

    def found(own):
        low, place = own["text"], own["at"]

        def closest(w):
            gaps = F.split(low, F.concat(F.lit(NOT_AFTER + r"\Q"), w, F.lit(r"\E" + NOT_BEFORE)), -1)
            n = F.length(w)

            def distance(begin):
                return F.least(F.abs(place - begin), F.abs(place - begin - n))

            def step(acc, gap):
                begin = acc["at"] + F.length(gap)
                return F.struct((begin + n).alias("at"), F.least(acc["best"], distance(begin)).alias("best"))

            start = F.struct(F.lit(0).alias("at"), F.lit(1 << 30).alias("best"))
            all_ = let(gaps, lambda g: F.aggregate(F.slice(g, F.lit(1), F.size(g) - 1), start, step, lambda acc: acc["best"]))
            # a word that text holds but once stands there as a whole word: no pattern has to be made of it
            best = let(F.instr(low, w), lambda first: F.when(F.call_function("locate", w, low, first + 1) == 0, distance(first - 1)).otherwise(all_))
            return F.struct(best.alias("distance"), (F.array_position(strings(words), w).cast("int") - 1).alias("ord"), w.alias("word"))

        return F.array_min(F.transform(terms_found(low, words), closest))

    return let(F.struct(text.alias("text"), at.alias("at")), found)


def first_of(text: Column, groups: dict, default: Column) -> Column:
    """The key of the group whose term comes first in text (substring); ties go to the first group."""
    def place(own, i):
        # a group's own terms are looked for only if it has one in text
        held = F.filter(strings(own), lambda t: F.contains(text, t))
        return F.when(contains_any(text, own), F.struct(F.array_min(F.transform(held, lambda t: F.instr(text, t))).alias("at"), F.lit(i).alias("i")))

    first = F.array_min(F.array(*(place(own, i) for i, own in enumerate(groups.values()))))
    return F.coalesce(F.get(strings(list(groups)), first["i"]), default)


def first_rule(text: Column, rules, test) -> Column:
    """The label of the first rule (terms, label) for which test(text, terms) holds, else null."""
    out = F.lit(None).cast("string")
    for terms, label in reversed(list(rules)):
        out = F.when(test(text, terms), F.lit(label)).otherwise(out)
    return out
