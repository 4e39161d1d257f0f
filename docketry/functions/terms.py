"""Lists of terms against texts by patterns that are trees, and lists as literals that cost a plan one node.

A pattern of many terms tries what they begin with once, not each term at each place. Where a term begins and ends with a word
character, as all in fixed_values do, an edge of words at both of its ends makes it a whole word. A text is gone through once: the
longest term at each place is taken, and those that it begins with are known beforehand.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The edge of a word in any script.
EDGE = r"(?U:\b)"
_SEP, _LIST_SEP = "\u0001", "\u0002"


def strings(values: Sequence[str], sep: str = _SEP) -> Column:
    """A list as an array; one string that the optimizer cuts, not an expression for each entry."""
    return F.split(F.lit(sep.join(values)), sep, -1)


def integers(values: Sequence[int]) -> Column:
    return strings([str(v) for v in values]).cast("array<int>")


def mapping(pairs: dict[str, str]) -> Column:
    return F.map_from_arrays(strings(list(pairs)), strings(list(pairs.values())))


def lists_of(key: Column, lists: dict[str, Sequence[str]]) -> Column:
    """The list of a key, which has one."""
    pairs = F.map_from_arrays(strings(list(lists), _LIST_SEP), strings([_SEP.join(own) for own in lists.values()], _LIST_SEP))
    return F.split(F.try_element_at(pairs, key), _SEP, -1)


def alternatives(terms: Sequence[str]) -> str:
    """A pattern of any of the terms, the longest at a place first, as a tree by what they begin with."""
    groups: dict[str, list[str]] = {}
    for t in sorted(set(terms)):
        groups.setdefault(t[0], []).append(t)
    branches = []
    for group in groups.values():
        start = os.path.commonprefix(group)
        longer = [t[len(start) :] for t in group if t != start]
        branches.append(r"\Q" + start + r"\E" + (f"(?:{alternatives(longer)})" + ("?" if start in group else "") if longer else ""))
    return "|".join(branches)


def _starts(terms: Sequence[str]) -> str:
    """A look ahead for a character that any of the terms begins with, which costs less than to try them."""
    return "(?=[" + "".join(sorted({re.escape(t[0]) for t in terms})) + "])"


def whole_words(terms: Sequence[str]) -> str:
    """A pattern that matches any of the terms as whole words."""
    return rf"(?<!(?U:\w)){_starts(terms)}(?:{alternatives(terms)})(?!(?U:\w))"


def _begun_with(term: str, terms: Sequence[str]) -> list[str]:
    """The terms that are there wherever `term` is, as it begins with them; itself first."""
    return [term, *(t for t in dict.fromkeys(terms) if t != term and re.match(re.escape(t) + r"(?!\w)", term))]


def found(text: Column, terms: Sequence[str]) -> Column:
    """The terms that are whole words of a text; each once."""
    for t in terms:
        if not re.fullmatch(r"\w.*\w|\w", t, re.S):
            raise ValueError(f"no whole words: {t!r}")
    longest = F.regexp_extract_all(text, F.lit(f"{EDGE}{_starts(terms)}(?=({alternatives(terms)}){EDGE})"), F.lit(1))
    several = {t: own for t in terms if len(own := _begun_with(t, terms)) > 1}

    def each(hits):
        every = F.concat(hits, F.flatten(F.transform(among(hits, tuple(several)), lambda t: lists_of(t, several)))) if several else hits
        return F.when(F.size(hits) == 0, hits).otherwise(F.array_distinct(every))

    return F.element_at(F.transform(F.array(longest), each), 1)


def among(found_terms: Column, terms: Sequence[str]) -> Column:
    """Those of the terms found that are in a list."""
    # a set that is made once a task; array_intersect would make it anew for each row
    return F.filter(found_terms, lambda t: t.isin(*terms))


def score(found_terms: Column, terms: Sequence[str]) -> Column:
    """How many of a list's terms are found, those of several words twice."""
    several = [t for t in terms if " " in t]
    once = F.size(among(found_terms, terms))
    return once + F.size(among(found_terms, several)) if several else once
