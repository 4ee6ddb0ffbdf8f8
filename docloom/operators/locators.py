"""Lookups of locators and note labels in tables of document units, as joins on normalised keys.

Requests and units meet on keys of their document; no request reads a whole document. A
request that is found has at most MOST_UNITS units and MOST_TEXT UTF-16 units of text, so
its arrays are bounded; the matches of an ambiguous one are as many as the document has.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values of the request format: kinds, bounds and patterns.
LOCATOR_KINDS = ("page", "paragraph", "footnote", "section", "subsection", "provision_paragraph", "subparagraph", "clause", "subclause", "schedule", "article")
MOST_UNITS, MOST_CONTEXT, MOST_TEXT, MOST_LOCATOR = 20, 2, 60_000, 200
PAGE = r"(?i)^#?\s*\[?\s*(?:(?:pages?|pp?\.?)[\s:_=-]*)?0*(\d{1,6})\s*\]?$"
PARAGRAPH = r"(?i)^#?\s*(?:(?:paragraphs?|paras?|pars?|¶)\.?\s*)?(?:(?:paragraph|para|par)[\s:_=-]*)?0*(\d{1,6})$"
PAGE_PREFIX = r"(?i)^(?:pages?|pp?\.?)[\s:_=-]*"
PARAGRAPH_PREFIX = r"(?i)^(?:paragraphs?|paras?|pars?)\.?[\s:_=-]*"
RANGE = r"(?i)^(\d{1,6})\s*(?:-|–|—|\.\.|to)\s*(\d{1,6})$"
NOTE_PREFIX = r"(?i)^(?:footnotes?|notes?|fn)\s*[#.:_-]?\s*"
SECTION_PREFIX = r"(?i)^(?:ss?\.?|sections?)\s*"
NUMERIC = r"^\d{1,8}[A-Za-z]{0,3}(?:[.-]\d{1,8}[A-Za-z]{0,3}){0,3}(?:\([^)]+\))*$"
ALPHA = r"^[A-Za-z]{1,3}(?:[.-][0-9A-Za-z]{1,8}){1,3}(?:\([^)]+\))*$"
CONTEXT_CHARS = 2_000
MODES = ("sentence", "passage_since_prior_note")


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility forms as plain ones (NFKC), which SQL lacks."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def utf16(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def number_of(kind: Column, text: Column) -> Column:
    """The number of a folded page or paragraph locator, else null."""
    text = trimmed(text)
    digits = F.when(kind == "page", F.regexp_extract(text, PAGE, 1)).otherwise(F.regexp_extract(text, PARAGRAPH, 1))
    return digits.try_cast("bigint")


def range_of(kind: Column, text: Column) -> tuple[Column, Column]:
    """First and last number of a folded locator such as 'pp. 3-5', else nulls."""
    text = trimmed(text)
    for mark in (r"^#+", r"^\[+|\]+$"):
        text = trimmed(F.regexp_replace(text, mark, ""))
    text = F.when(kind == "page", F.regexp_replace(text, PAGE_PREFIX, "")).otherwise(F.regexp_replace(text, PARAGRAPH_PREFIX, ""))
    return tuple(F.regexp_extract(text, RANGE, k).try_cast("bigint") for k in (1, 2))


def note_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(text), NOTE_PREFIX, ""))


def section_key(text: Column) -> Column:
    """'sec' and the compact number of a folded section label, or the label in lower case."""
    compact = F.regexp_replace(F.regexp_replace(trimmed(text), SECTION_PREFIX, ""), r"\s+", "")
    plain = F.lower(trimmed(F.regexp_replace(text, r"\s+", " ")))
    return F.when(compact.rlike(NUMERIC) | compact.rlike(ALPHA), F.concat(F.lit("sec"), compact)).otherwise(plain)


def read_requests(requests: DataFrame) -> DataFrame:
    """Requests with folded locators, ``unit_kind``, first and last number, and whether they are valid."""
    rows = requests.select(
        "doc_id", "request_id", "locator_kind", "page", "occurrence",
        F.coalesce("locator", F.lit("")).alias("locator"),
        F.nullif("end_locator", F.lit("")).alias("end_locator"),
        F.coalesce("context", F.lit(0)).cast("bigint").alias("context"),
    )
    rows = rows.withColumn("first", folded("locator")).withColumn("last", folded("end_locator"))
    valid = (
        F.col("locator_kind").isin(*LOCATOR_KINDS)
        & (trimmed(F.col("locator")) != "")
        & (utf16(F.col("locator")) <= MOST_LOCATOR)
        & F.coalesce(utf16(F.col("end_locator")) <= MOST_LOCATOR, F.lit(True))
        & F.col("context").between(0, MOST_CONTEXT)
        & F.coalesce(F.col("page") > 0, F.lit(True))
        & F.coalesce(F.col("occurrence") > 0, F.lit(True))
    )
    kind = F.col("locator_kind")
    low, high = range_of(kind, F.col("first"))
    start = F.coalesce(low, number_of(kind, F.col("first")))
    stop = F.when(F.col("end_locator").isNotNull(), number_of(kind, F.col("last"))).otherwise(F.coalesce(high, start))
    return rows.select(
        "*",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(kind.isin("page", "paragraph", "footnote"), kind).otherwise("section").alias("unit_kind"),
        start.alias("start"),
        stop.alias("stop"),
    )


def structure_lookup(units: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with its status, error, found units, neighbours, matches and pages.

    units(doc_id, kind, place, number, id, label, aliases, locator_kind, pages, occurrence,
    text): kind is page, paragraph, footnote or section; place counts from 0 within a
    document and kind; number is that of a page or paragraph. requests(doc_id, request_id,
    locator_kind, locator, end_locator, context, page, occurrence), request_id unique. A null
    text counts as empty, which makes a unit unavailable; null context is 0.
    """
    asked = read_requests(requests)
    sizes = units.select("*", F.coalesce(utf16(F.col("text")), F.lit(0).cast("bigint")).alias("n_utf16")).drop("text")
    name = ["doc_id", "request_id"]

    # Pages and paragraphs: the first unit of the number at either end.
    by_number = asked.where("valid and unit_kind in ('page', 'paragraph')")
    numbered = sizes.where("number is not null").groupBy("doc_id", F.col("kind").alias("unit_kind"), F.col("number").alias("wanted")).agg(F.min("place").alias("place"))
    ends = by_number.where("start <= stop").select(*name, "unit_kind", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("wanted")), F.struct(F.lit(1).alias("side"), F.col("stop").alias("wanted")))).alias("end"))
    ends = ends.select(*name, "unit_kind", "end.*").join(numbered, ["doc_id", "unit_kind", "wanted"])
    ends = ends.groupBy(*name).agg(F.max(F.expr("if(side = 0, place, null)")).alias("low"), F.max(F.expr("if(side = 1, place, null)")).alias("high"))
    bad = F.when(F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") > F.col("stop")), "Invalid exact range")
    numbers = by_number.join(ends, name, "left").select(*name, "low", "high", bad.alias("error"), F.when(bad.isNotNull(), "invalid").alias("status"), F.array().cast("array<string>").alias("matches"))

    # Notes: by pair or label, hints of page and occurrence; either end may be ambiguous.
    by_note = asked.where("valid and unit_kind = 'footnote'")
    notes = sizes.where("kind = 'footnote'").select("doc_id", "place", "id", "occurrence", "pages", F.explode(F.array_distinct(F.array(note_key(folded("id")), note_key(folded("label"))))).alias("key")).withColumnRenamed("occurrence", "has_occurrence")
    sides = by_note.select(*name, "page", "occurrence", F.explode(F.array(F.struct(F.lit(0).alias("side"), note_key(F.col("first")).alias("key")), F.struct(F.lit(1).alias("side"), note_key(F.coalesce("last", "first")).alias("key")))).alias("end"))
    hits = sides.select(*name, "page", "occurrence", "end.*").join(notes, ["doc_id", "key"])
    hits = hits.where("(occurrence is null or has_occurrence = occurrence) and (page is null or array_contains(pages, page))")
    per = hits.groupBy(*name).agg(
        *[F.count(F.expr(f"if(side = {s}, 1, null)")).alias(f"n{s}") for s in (0, 1)],
        F.min(F.expr("if(side = 0, place, null)")).alias("low"),
        F.min(F.expr("if(side = 1, place, null)")).alias("high"),
        F.sort_array(F.collect_set(F.struct("side", "place", "id"))).alias("all"),
    )
    many = (F.col("n0") > 1) | (F.col("n1") > 1)
    per = per.select(*name, "low", "high", F.lit(None).cast("string").alias("error"), F.when(many, "ambiguous").alias("status"), F.when(many, F.array_distinct(F.transform("all", lambda x: x["id"]))).otherwise(F.array().cast("array<string>")).alias("matches"))
    found_notes = by_note.select(*name).join(per, name, "left")

    # Sections: by label, alias or, for the plain kind, id; the other kinds only where the document has any.
    by_section = asked.where("valid and unit_kind = 'section'")
    sections = sizes.where("kind = 'section'").withColumnRenamed("locator_kind", "own_kind")
    labels = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    texts = sections.select("doc_id", "place", "id", "own_kind", F.explode(labels).alias("text"), F.lit(False).alias("from_id")).unionByName(
        sections.where("id <> ''").select("doc_id", "place", "id", "own_kind", F.concat(F.lit("section:"), "id").alias("text"), F.lit(True).alias("from_id"))
    )
    keys = texts.where("text is not null").select("doc_id", "place", "id", "own_kind", "from_id", section_key(folded("text")).alias("key"))
    kinds = sections.where("own_kind is not null").select("doc_id", F.col("own_kind").alias("locator_kind"), F.lit(True).alias("has_kind")).distinct()
    one = by_section.select(*name, "locator_kind", "end_locator", section_key(F.col("first")).alias("key"))
    hits = one.join(keys, ["doc_id", "key"]).where("locator_kind = 'section' or (own_kind = locator_kind and not from_id)")
    per = hits.groupBy(*name).agg(F.sort_array(F.collect_set(F.struct("place", "id"))).alias("all"))
    one = one.join(kinds, ["doc_id", "locator_kind"], "left").join(per, name, "left")
    status = (
        F.when(F.col("end_locator").isNotNull(), "invalid")
        .when((F.col("locator_kind") != "section") & F.col("has_kind").isNull(), "unavailable")
        .when(F.size("all") > 1, "ambiguous")
    )
    error = F.when(status == "invalid", F.lit("Section ranges are not supported by this document contract")).when(
        status == "unavailable", F.concat(F.lit("No exact "), "locator_kind", F.lit(" identifiers exist in this source PDF"))
    )
    found_sections = one.select(*name, F.expr("all[0].place").alias("low"), F.expr("all[0].place").alias("high"), error.alias("error"), status.alias("status"), F.when(status == "ambiguous", F.transform("all", lambda x: x["id"])).otherwise(F.array().cast("array<string>")).alias("matches"))

    spots = reduce(DataFrame.unionByName, (numbers, found_notes, found_sections))
    spots = asked.join(spots, name, "left").select(
        *name, "unit_kind", "context", "low", "high", F.coalesce("matches", F.array().cast("array<string>")).alias("matches"),
        F.when(~F.col("valid"), "invalid").when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("low").isNull() | F.col("high").isNull() | (F.col("high") < F.col("low")), "not_found")
        .when(F.col("high") - F.col("low") >= MOST_UNITS, "invalid").alias("status"),
        F.when(~F.col("valid"), "Invalid or unbounded PDF locator").when(F.col("status").isNotNull(), F.col("error"))
        .when(F.col("high") - F.col("low") >= MOST_UNITS, f"Exact ranges are limited to {MOST_UNITS} units").alias("error"),
    )

    # What is left has at most MOST_UNITS places and its neighbours: each place is one row of an equi-join.
    places = spots.where("status is null").select(*name, F.col("unit_kind").alias("kind"), "low", "high", F.explode(F.sequence(F.greatest(F.col("low") - F.col("context"), F.lit(0).cast("bigint")), F.col("high") + F.col("context"))).alias("place"))
    rows = places.join(sizes.select("doc_id", "kind", "place", "id", "pages", "n_utf16"), ["doc_id", "kind", "place"])
    part = lambda test: F.transform(F.filter("all", test), lambda x: x["id"])
    taken = rows.groupBy(*name, "low", "high").agg(F.sort_array(F.collect_list(F.struct("place", "id", "n_utf16", "pages"))).alias("all"))
    taken = taken.select(
        *name,
        part(lambda x: x["place"].between(F.col("low"), F.col("high"))).alias("units"),
        part(lambda x: x["place"] < F.col("low")).alias("before"),
        part(lambda x: x["place"] > F.col("high")).alias("after"),
        F.exists("all", lambda x: x["place"].between(F.col("low"), F.col("high")) & (x["n_utf16"] == 0)).alias("hollow"),
        F.aggregate("all", F.lit(0).cast("bigint"), lambda n, x: n + x["n_utf16"]).alias("n_utf16"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["pages"], F.array().cast("array<bigint>")))))).alias("pages"),
    )
    out = spots.join(taken, name, "left")
    status = F.coalesce("status", F.when(F.col("hollow"), "unavailable").when(F.col("n_utf16") > MOST_TEXT, "invalid").otherwise("found"))
    out = out.select(
        *name, status.alias("status"), "units", "before", "after", "pages", "matches", "n_utf16",
        F.when(F.col("status").isNotNull(), F.col("error")).when(F.col("hollow"), "The requested structural unit has no exact text")
        .when(F.col("n_utf16") > MOST_TEXT, f"Exact result exceeds {MOST_TEXT} characters; request a narrower range").alias("error"),
    )
    held = lambda c, kind: F.when(F.col("status") == "found", F.col(c)).otherwise(F.array().cast(kind)).alias(c)
    return out.select(
        *name, "status", "error", *[held(c, "array<string>") for c in ("units", "before", "after")], held("pages", "array<bigint>"),
        F.when(F.col("status") == "found", F.col("units")).otherwise(F.col("matches")).alias("matches"),
        F.when(F.col("status") == "found", F.col("n_utf16")).alias("n_utf16"),
    )


def normal_label(text: Column) -> Column:
    """A note's label: raised digits as plain ones, without leading zeros."""
    plain = F.translate(trimmed(text), "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    return F.when(plain.rlike("^[0-9]{1,38}$"), F.regexp_replace(plain, "^0+(?=[0-9])", "")).otherwise(plain)


def lookup_footnote(notes: DataFrame, paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with status, matching pairs, proposition, and up to CONTEXT_CHARS of its paragraph.

    notes(doc_id, place, pair_id, label, occurrence, reference_page, body_pages,
    reference_line_id, sentence_proposition, passage_since_prior_note); paragraphs(doc_id,
    place, line_ids, text); requests(doc_id, request_id, query, page, occurrence, mode). An
    unknown mode is invalid; a note whose line is in no paragraph has an empty context.
    """
    name = ["doc_id", "request_id"]
    query = trimmed(F.coalesce("query", F.lit("")))
    asked = requests.select(*name, "page", "occurrence", "mode", query.alias("query"))
    keyed = lambda pair, label: F.explode(F.array(F.struct(F.lit("pair").alias("by"), pair.alias("key")), F.struct(F.lit("label").alias("by"), label.alias("key")))).alias("k")
    left = asked.where(F.col("mode").isin(*MODES)).select(*name, "page", F.col("occurrence").alias("wanted"), "mode", keyed(F.col("query"), normal_label(F.col("query")))).select("*", "k.*").drop("k")
    right = notes.select("doc_id", "place", keyed(F.col("pair_id"), F.col("label"))).select("doc_id", "place", "k.*")
    facts = notes.select("doc_id", "place", "pair_id", "occurrence", "reference_page", "body_pages")
    hits = left.join(right, ["doc_id", "by", "key"]).select(*name, "page", "wanted", "place").distinct().join(facts, ["doc_id", "place"])
    hits = hits.where("(page is null or coalesce(reference_page = page, false) or coalesce(array_contains(body_pages, page), false)) and (wanted is null or occurrence = wanted)")
    per = hits.groupBy(*name).agg(F.sort_array(F.collect_list(F.struct("place", "pair_id"))).alias("all"))
    per = asked.join(per, name, "left").select(*name, "query", "mode", "all", F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), "invalid").when(F.col("all").isNull(), "not_found").when(F.size("all") > 1, "ambiguous").otherwise("found").alias("status"))
    single = per.where("status = 'found'").select(*name, "mode", F.expr("all[0].place").alias("place"))
    single = single.join(notes.select("doc_id", "place", "reference_line_id", "sentence_proposition", "passage_since_prior_note"), ["doc_id", "place"])
    lines = paragraphs.select("doc_id", "place", F.explode("line_ids").alias("reference_line_id")).groupBy("doc_id", "reference_line_id").agg(F.min("place").alias("paragraph"))
    texts = paragraphs.select("doc_id", F.col("place").alias("paragraph"), F.left("text", F.lit(CONTEXT_CHARS)).alias("context"))
    single = single.join(lines, ["doc_id", "reference_line_id"], "left").join(texts, ["doc_id", "paragraph"], "left")
    single = single.select(*name, F.when(F.col("mode") == "sentence", F.col("sentence_proposition")).otherwise(F.col("passage_since_prior_note")).alias("proposition"), "context")
    blank = F.lit("")
    return per.join(single, name, "left").select(
        *name, "query", "status",
        F.coalesce(F.transform("all", lambda x: x["pair_id"]), F.array().cast("array<string>")).alias("matches"),
        F.coalesce("proposition", blank).alias("proposition"), F.coalesce("context", blank).alias("context"),
    )
