"""Column functions over dates and the dates that a text mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.fixed_values import DAY_MONTH, ISO, MONTH_DAY, MONTH_NAMES, MOST_UNITS, NUMERIC, RELATIVE, TODAY, TOMORROW
from docketry.functions.terms import mapping
from docketry.functions.text import contains_any, let, spans

#: Every mention of a date has a digit or one of two words in it.
MAY_HAVE_DATE = "(?i)[0-9]|today|tomorrow"
#: ISO with a look ahead, as a character costs less to look at than an edge of words.
_ISO = "(?=2)" + ISO
_MONTH_STARTS = tuple(dict.fromkeys(m[:3] for m in MONTH_NAMES))
HIT = "array<struct<value:date,raw:string,start:int,end:int,quality:double,ambiguous:boolean,prio:int>>"


def date_of(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is no such day."""

    def checked(d):
        day = F.date_add(F.make_date(d["year"], d["month"], F.lit(1)), d["day"] - 1)
        return F.when(d["year"].between(1, 9999) & d["month"].between(1, 12) & d["day"].between(1, 31), F.when(F.month(day) == d["month"], day))

    return let(F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day")), checked)


def month_number(name: Column) -> Column:
    return F.try_element_at(mapping({k: str(v) for k, v in MONTH_NAMES.items()}), F.lower(name)).cast("int")


def add_business_days(start: Column, n: Column) -> Column:
    """n weekdays after start (Monday to Friday, no holidays), in closed form; 0 leaves start as it is."""
    day = F.weekday(start)  # Monday is 0
    base = F.date_sub(start, F.greatest(day - 4, F.lit(0)))
    left = n % 5
    days = F.floor(n / 5).cast("int") * 7 + left + F.when(F.weekday(base) + left > 4, 2).otherwise(0)
    return F.when(n == 0, start).otherwise(F.date_add(base, days.cast("int")))


def next_occurrence(month: Column, day: Column, anchor: Column) -> Column:
    """The day in the anchor's year; the year after if that is more than 14 days before the anchor."""
    this = date_of(F.year(anchor), month, day)
    return F.when(this < F.date_sub(anchor, 14), date_of(F.year(anchor) + 1, month, day)).otherwise(this)


def anchor_of(modified: Column, today: Column) -> Column:
    """The date part of an ISO time as it is written, else today."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
    # there is no year 0
    return F.coalesce(F.when(modified.rlike(shape) & ~modified.startswith("0000"), F.substring(modified, 1, 10).try_cast("date")), today)


def _hits(text: Column, pattern: str, prio: int, parse, groups: int, low: Column, parts: tuple[str, ...]) -> Column:
    """parse(groups of the match) -> (value, quality, ambiguous). The pattern is tried only where the (lower-case) text has one of the parts."""

    def hit(x):
        def built(g):
            value, quality, ambiguous = parse(*(g[f"g{k}"] for k in range(1, groups + 1)))
            return F.struct(value.alias("value"), x["raw"].alias("raw"), x["start"].alias("start"), (x["start"] + F.length(x["raw"])).alias("end"), quality.cast("double").alias("quality"), ambiguous.alias("ambiguous"), F.lit(prio).alias("prio"))

        # each group is cut out once, however often it is looked at
        return let(F.struct(F.lit(0).alias("g0"), *(F.regexp_extract(x["raw"], pattern, k).alias(f"g{k}") for k in range(1, groups + 1))), built)

    return F.when(contains_any(low, parts), F.transform(spans(text, pattern, likely=pattern == _ISO), hit).cast(HIT)).otherwise(F.array().cast(HIT))


def _int(group: Column) -> Column:
    return F.nullif(group, F.lit("")).cast("int")


def possible_dates(text: Column, anchor: Column, month_first: bool = False) -> Column:
    """All that looks like a date, as structs, by kind; those without a value are no dates. text must hold no U+0001 or U+0002."""
    no, yes = F.lit(False), F.lit(True)

    def iso(year, month, day):
        return date_of(_int(year), _int(month), _int(day)), F.lit(0.95), no

    def named(month, day, year):
        month, day, year = month_number(month), _int(day), F.nullif(year, F.lit(""))
        return F.when(year.isNotNull(), date_of(year.cast("int"), month, day)).otherwise(next_occurrence(month, day, anchor)), F.when(year.isNotNull(), 0.92).otherwise(0.72), no

    def numeric(first, second, year):
        first, second, year = _int(first), _int(second), _int(year)
        day, month = (second, first) if month_first else (first, second)
        unclear = (first <= 12) & (second <= 12)
        return date_of(year, month, day), F.when(unclear, 0.78).otherwise(0.86), F.when(unclear, yes).otherwise(no)

    def relative(n, business, unit):
        n, unit = F.least(_int(n), F.lit(MOST_UNITS)), F.lower(unit)
        value = F.when(business != "", add_business_days(anchor, n)).when(unit == "day", F.date_add(anchor, n)).when(unit == "week", F.date_add(anchor, n * 7)).otherwise(F.add_months(anchor, n))
        return value, F.lit(0.66), no

    low = F.lower(text)
    # the last of each is what stands in every match, which costs a fraction of its pattern to look for
    kinds = [
        (_ISO, iso, 3, ("20",)), (MONTH_DAY, named, 3, _MONTH_STARTS), (DAY_MONTH, lambda day, month, year: named(month, day, year), 3, _MONTH_STARTS), (NUMERIC, numeric, 3, ("/20", ".20", "-20")), (RELATIVE, relative, 3, ("day", "week", "month")),
        (TODAY, lambda: (anchor, F.lit(0.58), no), 0, ("today",)), (TOMORROW, lambda: (F.date_add(anchor, 1), F.lit(0.58), no), 0, ("tomorrow",)),
    ]
    return F.concat(*(_hits(text, p, i, parse, groups, low, parts) for i, (p, parse, groups, parts) in enumerate(kinds)))


def dates_in_order(possible: Column) -> Column:
    """Dates of possible_dates() from left to right. Kinds are tried in order (year first, named months, numeric, relative, day words);
    a mention that overlaps one found earlier is dropped, and an impossible date takes no room."""

    def keep(acc, x):
        return F.when(F.exists(acc, lambda o: (x["start"] < o["end"]) & (x["end"] > o["start"])), acc).otherwise(F.concat(acc, F.array(x)))

    def in_order(found):
        kept = F.aggregate(found, F.array().cast(HIT), keep)
        placed = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["prio"].alias("prio"), x.alias("hit"))))
        return F.when(F.size(found) < 2, found).otherwise(F.transform(placed, lambda x: x["hit"]))

    return let(F.filter(possible, lambda x: x["value"].isNotNull()), in_order)


def find_dates(text: Column, anchor: Column, month_first: bool = False) -> Column:
    """All date mentions as structs, from left to right. text must hold no U+0001 or U+0002."""
    return dates_in_order(possible_dates(text, anchor, month_first))


#: Dates of statement rows, day first whatever the order elsewhere: numeric with one kind of separator, year first, or with a month's name.
_DAY_FIRST = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4})$"
_SHORT = r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{2})$"
_YEAR_FIRST = r"^([0-9]{4})([/-])([0-9]{1,2})\2([0-9]{1,2})$"
_NAMED = r"(?i)^([0-9]{1,2}) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) ([0-9]{4}|[0-9]{2})$"


def statement_date(cell: Column) -> Column:
    """A cell as a date: a spreadsheet's day number (20000 to 80000), or one of the shapes above; two-digit years are 1969 to 2068."""

    def parse(t):
        pick = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
        year = F.coalesce(pick(_DAY_FIRST, 4), pick(_YEAR_FIRST, 1), pick(_SHORT, 4), pick(_NAMED, 3))
        month = F.coalesce(pick(_DAY_FIRST, 3), pick(_YEAR_FIRST, 3), pick(_SHORT, 3), month_number(F.regexp_extract(t, _NAMED, 2)).cast("string"))
        day = F.coalesce(pick(_DAY_FIRST, 1), pick(_YEAR_FIRST, 4), pick(_SHORT, 1), pick(_NAMED, 1))
        serial = pick(r"^([0-9]{5})(?:\.0+)?$", 1).cast("int")
        century = F.when(F.length(year) == 4, 0).when(year.cast("int") >= 69, 1900).otherwise(2000)
        return F.coalesce(F.when(serial.between(20_000, 80_000), F.date_add(F.lit("1899-12-30").cast("date"), serial)), date_of(year.cast("int") + century, month.cast("int"), day.cast("int")))

    return let(F.trim(F.regexp_replace(cell, r"(?U)\s+", " ")), parse)
