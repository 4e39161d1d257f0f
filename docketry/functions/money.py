"""Column functions over amounts of money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.text import let


def parse_number(cell: Column) -> Column:
    """A cell's number: negative in parentheses or with a leading minus, whatever stands around the digits; null for blanks, `na`, dashes and two decimal points."""

    def parse(text):
        number = let(F.regexp_replace(text, "[^0-9.]", ""), lambda d: F.when(F.regexp_count(d, F.lit(r"\.")) <= 1, d.try_cast("double")))
        minus = (text.startswith("(") & text.endswith(")")) | text.startswith("-")
        return F.when(~F.lower(text).isin("", "na", "n/a", "-", "--"), F.when(minus, -number).otherwise(number))

    return let(F.regexp_replace(cell, r"(?U)^\s+|\s+$", ""), parse)


def named_amount(text: Column, label: str) -> Column:
    """The first amount that follows the label, perhaps with a sign, `is` or a currency between."""
    pattern = rf"(?i)(?U:\b)\Q{label}\E(?U:\b)(?U:\s*)(?:[:=-]|is)?(?U:\s*)(?:{V.CURRENCY_MARKS})?(?U:\s*)(\(?-?[0-9][0-9,]*(?:\.[0-9]{{1,2}})?\)?)"
    return parse_number(F.regexp_extract(text, pattern, 1))


def currency_of(text: Column, default: str = "$") -> Column:
    low = F.lower(text)
    out = F.lit(default)
    for pattern, sign in reversed(V.CURRENCIES):
        out = F.when(low.rlike(pattern), sign).otherwise(out)
    return out
