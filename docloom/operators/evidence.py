"""Evidence of notes and numbers: raised digits, detached references, page modes, raw runs, token counters."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from docloom.operators.chains import by_document, monotone_scopes

# Fixed values of the formats and thresholds.
COUNTERS = ("input_tokens", "output_tokens", "cached_input_tokens", "total_tokens")
DEEPEST = 127
STYLES = ("bracket", "dot", "bare")
MOST_GAP = 8
#: Height of the bands in which references meet lines; any height gives the same targets.
BAND = 8.0


def counters_in(line: str) -> list[tuple[str, int]]:
    """The token counters of a line of JSON; nothing if it isn't JSON or nested too deep."""

    def refuse(name):
        raise ValueError(name)

    try:
        open_values = [(json.loads(line, parse_constant=refuse), 1)]
    except (ValueError, RecursionError):
        return []
    found = []
    while open_values:
        value, depth = open_values.pop()
        if not isinstance(value, (dict, list)):
            continue
        if depth > DEEPEST:
            return []
        if isinstance(value, list):
            open_values += [(v, depth + 1) for v in value]
            continue
        for key, v in value.items():
            if key not in COUNTERS:
                open_values.append((v, depth + 1))
            elif type(v) is int and -(1 << 63) <= v < 1 << 63:
                found.append((key, v))
    return found


def token_usage(lines: DataFrame) -> DataFrame:
    """(doc_id, counter, tokens): the greatest value of each counter in the JSON lines(doc_id, line) of a run."""

    def work(batches):
        for batch in batches:
            rows = [(d, k, v) for d, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "line"))) if t for k, v in counters_in(t)]
            if rows:
                ids, keys, values = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(values, pa.int64())], names=["doc_id", "counter", "tokens"])

    found = lines.select("doc_id", "line").mapInArrow(work, "doc_id bigint, counter string, tokens bigint")
    return found.groupBy("doc_id", "counter").agg(F.max("tokens").alias("tokens"))


def isolated_references(lines: DataFrame) -> DataFrame:
    """Raised digits that end a line, a quarter of an em and more after the span that they follow.

    lines(doc_id, line_id, text, spans); a span is (text, start, end, x0, x1, size,
    superscript) with offsets in characters. Of several spans that end where the digits
    start, the last is the host; digits without a host are left out.
    """

    def host(mark):
        return F.element_at(F.filter("spans", lambda s: ~s["superscript"] & (s["end"] == mark["start"])), -1)

    def isolated(mark):
        plain = F.trim(mark["text"])
        ends = mark["superscript"] & (mark["end"] == F.length("text")) & (mark["start"] < mark["end"])
        return ends & plain.rlike("^[0-9]{1,4}$") & F.coalesce(mark["x0"] - host(mark)["x1"] >= F.greatest(host(mark)["size"], F.lit(1.0)) * 0.25, F.lit(False))

    # try_element_at semantics: a line without spans has no marks to look a host up for.
    with_host = lines.withColumn("spans", F.filter("spans", lambda s: ~s["superscript"] | F.exists("spans", lambda h: ~h["superscript"] & (h["end"] == s["start"]))))
    rows = with_host.select("doc_id", "line_id", F.explode(F.filter("spans", isolated)).alias("mark"))
    return rows.select("doc_id", "line_id", F.trim("mark.text").alias("note_id"), F.col("mark.start").alias("start_offset"), F.col("mark.end").alias("end_offset"))


def detached_targets(lines: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, page, reference, target, offset): the line and offset that each detached mark belongs to.

    lines(doc_id, page, place, source_index, x0, y0, x1, y1, size, region_type, excluded,
    spans(start, end, x0, x1)), references(doc_id, page, place, body_size) name some of them.
    A host stands at the mark's height, within a fifth of its own height, and has a span
    edge within a body size; the nearest edge wins, then height, then source order. Marks
    without a host are left out.
    """
    marks = references.join(lines.select("doc_id", "page", "place", "source_index", "x0", "x1", "y0"), ["doc_id", "page", "place"])
    marks = marks.select(
        "doc_id", "page", F.col("place").alias("reference"), "body_size", F.col("source_index").alias("at"),
        ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("y"), F.floor(F.col("y0") / BAND).alias("band"),
    )
    reach = F.greatest((F.col("y1") - F.col("y0")) * 0.20, F.lit(2.0))
    hosts = lines.where("not excluded and region_type not in ('header', 'footer')").select(
        "doc_id", "page", F.col("place").alias("target"), "source_index", "size", "spans", "y0", reach.alias("reach"),
        F.explode(F.sequence(F.floor((F.col("y0") - reach) / BAND), F.floor((F.col("y0") + reach) / BAND))).alias("band"),
    )
    near = marks.join(hosts, ["doc_id", "page", "band"]).where("target <> reference and size >= body_size * 0.80 and abs(y0 - y) <= reach")
    edge = F.array_min(
        F.flatten(
            F.transform(
                "spans",
                lambda s: F.array(
                    F.struct(F.abs(F.col("x") - s["x0"]).alias("distance"), (-s["start"]).alias("back")),
                    F.struct(F.abs(F.col("x") - s["x1"]).alias("distance"), (-s["end"]).alias("back")),
                ),
            )
        )
    )
    near = near.withColumn("edge", edge).where("edge.distance <= greatest(body_size, 6.0)")
    rank = F.struct("edge.distance", F.abs(F.col("y0") - F.col("y")).alias("height"), F.abs(F.col("source_index") - F.col("at")).alias("apart"), "target", (-F.col("edge.back")).alias("offset"))
    best = near.groupBy("doc_id", "page", "reference").agg(F.min(rank).alias("best"))
    return best.select("doc_id", "page", "reference", "best.target", "best.offset")


def note_region_modes(lines: DataFrame) -> DataFrame:
    """lines with ``mode``: endnote, footnote, footnote_continuation, or what it was before.

    lines(doc_id, page, place, text, region_type, number, mode): number is that of a note
    line's label. Pages are reduced to one row of facts each, and only those are carried
    from page to page; a page without note lines ends what went before.
    """
    note = F.col("region_type") == "footnote"
    numbers = F.struct("place", "number")
    numbered = note & F.col("number").isNotNull()
    facts = lines.groupBy("doc_id", "page").agg(
        F.max(note.cast("int")).alias("notes"),
        F.max(F.trim("text").rlike("(?i)^(?:end)?notes?$").cast("int")).alias("heading"),
        F.max((note & (F.col("mode") == "endnote")).cast("int")).alias("endnote"),
        F.max((note & (F.col("mode") == "footnote")).cast("int")).alias("footnote"),
        F.coalesce(F.min(F.when(numbered, numbers))["number"], F.lit(-1).cast("bigint")).alias("first"),
        F.coalesce(F.max(F.when(numbered, numbers))["number"], F.lit(-1).cast("bigint")).alias("last"),
    )

    def run(held: dict) -> dict:
        modes, open_end, expected, before = [], False, None, False
        for notes, heading, endnote, footnote, first, last in zip(*(held[c].tolist() for c in ("notes", "heading", "endnote", "footnote", "first", "last"))):
            mode = ""
            if notes and (heading or endnote or (open_end and (first < 0 or first == expected))):
                mode, open_end = "endnote", True
                expected = last + 1 if last >= 0 else expected
            else:
                open_end, expected = False, None
                if notes:
                    mode = "footnote" if footnote else "footnote_continuation" if before else ""
            modes.append(mode)
            before = bool(notes)
        return {"page": held["page"].tolist(), "page_mode": modes}

    facts = facts.select("doc_id", "page", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("notes", "heading", "endnote", "footnote", "first", "last")])
    modes = by_document(facts, ("page",), run, "doc_id bigint, page bigint, page_mode string")
    was = F.coalesce("mode", F.lit(""))
    now = F.when(note & ((F.col("page_mode") == "endnote") | (was == "")), F.col("page_mode")).otherwise(was)
    return lines.join(modes, ["doc_id", "page"], "left").withColumn("mode", F.coalesce(now, was)).drop("page_mode")


def numeric_runs(markers: DataFrame) -> DataFrame:
    """Candidate runs of two and more numbers of one style, each at most MOST_GAP above the one before.

    markers(doc_id, position, number, style, n_chars), positions distinct within a style;
    n_chars is the document's length. A member ends where the next marker of any style
    starts. Runs are numbered by where they begin, then by where they end, whatever their
    style; (doc_id, run_id, ordinal, position, end_at, number, rooted, consecutive).
    """

    def run(held: dict) -> dict:
        out: dict[str, list] = {"position": [], "number": [], "style": [], "scope": []}
        for at, style in enumerate(STYLES):
            rows = np.flatnonzero(held["style"] == style)
            numbers = held["number"][rows].tolist()
            out["position"] += held["position"][rows].tolist()
            out["number"] += numbers
            out["style"] += [at] * len(rows)
            out["scope"] += monotone_scopes(numbers, MOST_GAP)
        return out

    scopes = by_document(markers.select("doc_id", "position", "number", "style"), ("position", "number"), run, "doc_id bigint, position bigint, number bigint, style bigint, scope bigint")
    after = Window.partitionBy("doc_id").orderBy("position").rangeBetween(1, Window.unboundedFollowing)
    lengths = markers.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    one = Window.partitionBy("doc_id", "style", "scope")
    along = one.orderBy("position", "number")
    rows = scopes.withColumn("next_at", F.min("position").over(after)).withColumn("size", F.count("*").over(one)).where("size > 1")
    rows = rows.withColumn("ordinal", F.row_number().over(along)).withColumn("before", F.lag("number").over(along))
    rows = rows.withColumn("rooted", F.min(F.when(F.col("ordinal") == 1, F.col("number"))).over(one) == 1)
    rows = rows.withColumn("consecutive", F.min(F.coalesce(F.col("number") == F.col("before") + 1, F.lit(True))).over(one))
    rows = rows.join(lengths, "doc_id").withColumn("end_at", F.coalesce("next_at", "n_chars"))
    spans = rows.groupBy("doc_id", "style", "scope").agg(F.min("position").alias("starts"), F.max("end_at").alias("ends"))
    by_place = Window.partitionBy("doc_id").orderBy("starts", "ends", "style", "scope")
    rows = rows.join(spans.select("doc_id", "style", "scope", F.row_number().over(by_place).alias("run")), ["doc_id", "style", "scope"])
    return rows.select(
        "doc_id", F.format_string("numeric-%06d", "run").alias("run_id"), F.col("ordinal").cast("bigint").alias("ordinal"), "position", "end_at", "number", "rooted", "consecutive",
    )
