"""From documents to commitments: dated obligations with a category, a title and a confidence.

One narrow projection a document: its lines become an array, lines that can't hold a date are dropped before anything
is exploded, then segments and date mentions are exploded in turn. No shuffle is needed before deduplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.dates import HIT, MAY_HAVE_DATE, anchor_of, dates_in_order, possible_dates
from docketry.functions.terms import mapping
from docketry.functions.text import LINE_END, PAGE_LINE, bound, contains_any, first_of, first_rule, has_any, nearest, squeeze, stem, title_case

LONG_LINE, FAR, NEAR_HISTORY, WINDOW, STALE_DAYS = 2500, 160, 60, 55, 45
ACTION_WORDS = tuple(w for terms in V.ACTION_GROUPS.values() for w in terms) + V.DEADLINE_WORDS


def document_id(content: Column) -> Column:
    return F.substring(F.sha2(squeeze(content).cast("binary"), 256), 1, 20)


def category_of(low: Column, domain: Column) -> Column:
    free = {k: v for k, v in V.ACTION_GROUPS.items() if k in V.DOMAIN_FREE_CATEGORIES}
    return F.when(domain.isNull(), first_of(low, V.ACTION_GROUPS, F.lit("action"))).otherwise(first_of(low, free, domain))


def title_of(low: Column, category: Column, domain: Column) -> Column:
    labels, titles = mapping(V.DOMAIN_LABELS), mapping(V.CATEGORY_TITLES)
    entity = F.coalesce(first_rule(low, V.ENTITY_HINTS, contains_any), F.try_element_at(labels, F.coalesce(domain, F.lit(""))), F.lit(V.DEFAULT_LABEL))
    action = F.coalesce(F.try_element_at(titles, category), F.lit(V.CATEGORY_TITLES["action"]))
    return F.when(F.lower(entity).endswith(F.lower(action)), entity).otherwise(F.concat(entity, F.lit(" "), action))


def periodicity_of(text: Column) -> Column:
    token = F.lower(F.regexp_extract(text, V.PERIODICITY, 1))
    return (
        F.when(token == "", None)
        .when(token.rlike(r"month|/mo|p\.m\."), "monthly")
        .when(token.rlike(r"annu|year|/yr|p\.a\."), "annual")
        .when(token.contains("quarter"), "quarterly")
        .when(token.contains("one"), "one-time")
        .otherwise(token)
    )


def notice_days_of(text: Column) -> Column:
    unit = F.lower(F.regexp_extract(text, V.NOTICE, 2))
    days = F.nullif(F.regexp_extract(text, V.NOTICE, 1), F.lit("")).cast("int") * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)
    # one of these words is in every match, and in few texts
    return F.when(contains_any(F.lower(text), ("prior", "before", "advance", "notice")) & days.between(1, 180), days)


def document_entity(content: Column, path: Column) -> Column:
    """The subject line among the first 15 lines, else the file's name as a title; null if there is neither."""
    heads = F.transform(F.slice(F.split(content, LINE_END), 1, 15), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    subjects = F.transform(F.filter(heads, lambda x: F.lower(x).startswith("subject:")), lambda x: F.regexp_replace(F.substring(x, 9, 1 << 20), r"(?U)^\s+|\s+$", ""))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", ""), "[_-]+", " "))
    return F.coalesce(F.substring(F.try_element_at(F.filter(subjects, lambda x: x != ""), F.lit(1)), 1, 70), F.nullif(title_case(name), F.lit("")))


def summary_of(title: Column, entity: Column, notice_days: Column, action_date: Column) -> Column:
    parts = [title, F.when(~F.contains(title, entity), F.concat(F.lit("("), entity, F.lit(")"))), F.when(notice_days.isNotNull(), F.concat(F.lit("• Notice: "), notice_days, F.lit("d prior (Action by "), F.date_format(action_date, "MMM dd"), F.lit(")")))]
    return F.concat_ws(" ", *parts)


def is_statement_row(segment: Column) -> Column:
    shape = segment.contains("|") | segment.contains("\t") | segment.rlike(r"(?i)(?U:\b)(?:CR|DR|debit|credit)(?U:\b)")
    return segment.rlike(V.STATEMENT_ROW) & segment.rlike(r"[0-9][0-9,]*\.[0-9]{2}") & shape


def is_page_line(line: Column) -> Column:
    return line.startswith("[[PAGE:") & line.rlike(PAGE_LINE)


def segments(docs: DataFrame) -> DataFrame:
    """One row per segment that may hold a date: docs' columns and line, page, context, segment.

    docs: path, content, modified, document_id, domain. Lines are cut at sentence ends if they are long.
    """
    # the two marks that spans() uses become spaces, which keeps all positions
    text = F.coalesce("content", F.lit(""))
    text = F.when(contains_any(text, ("\u0001", "\u0002")), F.translate(text, "\u0001\u0002", "  ")).otherwise(text)
    lines = docs.withColumn("_lines", F.transform(F.split(text, LINE_END), squeeze))
    # the page marks alone, so that a dated line looks through pages and not through all lines before it
    marks = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), x.alias("mark"))), lambda m: is_page_line(m["mark"]))
    lines = lines.withColumn("_marks", F.when(F.col("content").contains("[[PAGE:"), marks))
    n = F.size("_lines")

    def around(i):
        near = F.slice("_lines", F.greatest(i, F.lit(1)), F.least(n, i + 2) - F.greatest(i, F.lit(1)) + 1)
        return F.array_join(F.filter(near, lambda x: (x != "") & ~is_page_line(x)), " · ")

    def page(i):
        last = F.try_element_at(F.filter("_marks", lambda m: m["i"] <= i), F.lit(-1))
        return F.regexp_extract(last["mark"], PAGE_LINE, 1).try_cast("int")

    found = F.filter(F.transform("_lines", lambda x, i: F.struct(x.alias("text"), i.alias("i"))), lambda s: s["text"].rlike(MAY_HAVE_DATE) & ~is_page_line(s["text"]))
    rows = F.transform(found, lambda s: F.struct((s["i"] + 1).alias("line"), page(s["i"]).alias("page"), around(s["i"]).alias("context"), F.when(F.length(s["text"]) > LONG_LINE, F.split(s["text"], r"(?<=[.!?])(?U:\s+)")).otherwise(F.array(s["text"])).alias("segments")))
    out = lines.withColumn("_row", F.explode(rows)).drop("_lines", "_marks", "content")
    return out.select("*", F.posexplode("_row.segments").alias("segment_no", "segment")).select("*", "_row.line", "_row.page", "_row.context").filter((F.size("_row.segments") == 1) | F.col("segment").rlike(MAY_HAVE_DATE)).drop("_row")


def mentions(docs: DataFrame, today, month_first: bool = False) -> DataFrame:
    """One row per date mention: segments' columns, hit, hit_no, hit_count."""
    day = F.lit(today).cast("date")
    found = segments(docs).withColumn("_anchor", anchor_of(F.col("modified"), day))
    # a column of its own, which is read twice and so stays one: inside a function over arrays it would not be compiled
    found = found.withColumn("_possible", possible_dates(F.col("segment"), F.col("_anchor"), month_first)).drop("_anchor")
    found = found.withColumn("_hits", F.when(F.size("_possible") > 0, dates_in_order(F.col("_possible"))).otherwise(F.array().cast(HIT))).drop("_possible")
    # no filter on the number of hits, nor a generator over the column itself, for which Spark adds one: in front of the
    # projection it would look for the dates once more
    numbered = F.transform("_hits", lambda h, i: F.struct(i.alias("hit_no"), h.alias("hit")))
    return found.select("*", F.size("_hits").alias("hit_count"), F.explode(numbered).alias("_hit")).select("*", "_hit.hit_no", "_hit.hit").drop("_hits", "_hit")


def _marked_as(low: Column, today: Column) -> Column:
    """What a mention is rejected as by the marks of its (lower-case) segment and by its date, whatever words are near; null if they leave it open."""
    banking = F.coalesce(F.col("domain") == "banking", F.lit(False))
    return (
        F.when((F.col("hit_count") >= 2) & (F.col("hit_no") == 0) & contains_any(low, V.RANGE_MARKERS) & contains_any(low, V.RANGE_SEPARATORS), V.HISTORICAL)
        .when(has_any(low, V.EXAMPLE_MARKERS), V.REFERENCE)
        .when(banking & is_statement_row(F.col("segment")), V.HISTORICAL)
        .when(banking & low.contains("statement") & low.contains("period"), V.HISTORICAL)
        .when((F.col("hit.value") < F.date_sub(today, STALE_DAYS)) & ~contains_any(low, V.OVERDUE_MARKERS), V.HISTORICAL)
    )


def _weighed(found: DataFrame, today, if_open: bool) -> tuple[DataFrame, Column, Column]:
    """(found with the words near to each mention, what it is rejected as, its score). if_open: words are looked for only where marks and
    date leave a mention open, for readers of the first alone."""
    day = F.lit(today).cast("date")
    start, raw, value = F.col("hit.start"), F.col("hit.raw"), F.col("hit.value")
    x = found.withColumns({"_low": F.lower("segment"), "_near": F.lower("context")})
    low, near = F.col("_low"), F.col("_near")
    x = x.withColumn("_marked", _marked_as(low, day))
    asked = (lambda c: F.when(F.col("_marked").isNull(), c)) if if_open else (lambda c: c)
    x = x.withColumns({
        "_own": asked(nearest(low, start, ACTION_WORDS)),
        "_history": asked(nearest(low, start, V.HISTORICAL_WORDS + V.INFORMATION_WORDS)),
        "_field": asked(contains_any(near, V.MILESTONE_FIELDS)),
    })
    x = x.withColumn("_context_word", asked(F.when(F.col("_own").isNull(), nearest(near, F.lit(0), ACTION_WORDS + V.MILESTONE_FIELDS)["word"])))
    word = F.coalesce("_own.word", "_context_word")
    distance = F.when(F.col("_own").isNotNull(), F.col("_own.distance")).when(F.col("_context_word").isNotNull(), 120).otherwise(10_000)
    x = x.withColumns({"_word": word, "_distance": distance})
    has_action = (F.col("_word").isNotNull() & (F.col("_distance") <= FAR)) | F.col("_field")
    has_history = F.coalesce(F.col("_history.distance") <= NEAR_HISTORY, F.lit(False))
    past = has_history & (F.col("_history.distance") <= F.col("_distance"))
    around = F.substring(low, F.greatest(start - WINDOW, F.lit(0)) + 1, F.least(start, F.lit(WINDOW)) + F.length(raw) + WINDOW)
    score = F.col("hit.quality") * 0.46 + 0.38 + F.when(value >= day, 0.08).otherwise(-0.02) - F.when(past, 0.38).otherwise(0.0) - F.when(F.col("hit.ambiguous"), 0.12).otherwise(0.0)
    weak = F.when(past & ~contains_any(around, V.OVERRIDE_MARKERS), V.HISTORICAL).when(~has_action, V.NO_ACTION).when(score < 0.42, V.NO_ACTION)
    return x, F.when(F.col("_marked").isNotNull(), F.col("_marked")).otherwise(weak), score


def verdicts(docs: DataFrame, today, month_first: bool = False) -> DataFrame:
    """(path, rejected_as) of all mentions of docs (path, content, modified, domain), as extract() gives them."""
    x, rejected, _ = _weighed(mentions(docs, today, month_first), today, if_open=True)
    return x.select("path", rejected.alias("rejected_as"))


def judge(found: DataFrame, today) -> DataFrame:
    """Every mention with rejected_as (null for commitments) and the commitment's columns."""
    x, rejected, score = _weighed(found, today, if_open=False)
    low, raw, value = F.col("_low"), F.col("hit.raw"), F.col("hit.value")
    x = bound(x, {"rejected_as": rejected})
    x = x.withColumns({"confidence": F.greatest(F.lit(45), F.least(F.lit(98), F.rint(score * 100).cast("int"))), "category": category_of(low, F.col("domain")), "notice_days": notice_days_of(F.col("segment")), "periodicity": periodicity_of(F.col("segment"))})
    x = x.withColumns({"title": title_of(low, F.col("category"), F.col("domain")), "action_date": F.date_sub(value, F.col("notice_days")), "entity": F.coalesce("document_entity", first_rule(low, V.ENTITY_HINTS, has_any))})
    key = F.concat(F.coalesce(F.nullif("document_id", F.lit("")), "path"), F.lit(":"), "line", F.lit(":"), value.cast("string"), F.lit(":"), raw)
    reason = F.when(F.col("_word").isNotNull(), F.concat(F.lit("“"), "_word", F.lit("” appears near this date"))).otherwise("Milestone date found in document context")
    return x.select(
        "path", "segment_no", "hit_no", "rejected_as",
        F.substring(F.sha2(key.cast("binary"), 256), 1, 12).alias("id"), value.alias("date"), "title", "category", F.col("path").alias("source"), "line",
        F.substring("segment", 1, 280).alias("snippet"), "confidence", reason.alias("reason"), raw.alias("original"), F.col("hit.ambiguous").alias("ambiguous"), "page", "document_id", "domain", "entity", "periodicity",
        summary_of(F.col("title"), F.col("entity"), F.col("notice_days"), F.col("action_date")).alias("summary"), "notice_days", "action_date",
    )


def extract(docs: DataFrame, today, month_first: bool = False) -> DataFrame:
    """All mentions of docs (path, content, modified, document_id, domain), judged."""
    return judge(mentions(docs.withColumn("document_entity", document_entity(F.coalesce("content", F.lit("")), F.col("path"))), today, month_first), today)
