"""Heading ladders: enumerators of headings read as an outline of up to four levels.

``readings`` says what an enumerator may count: numbers, dotted numbers, Roman numerals, letters, each
by its punctuation. ``ladder`` goes through the enumerators of a document in order with a stack of
open counters; families, actions and the document's status are aggregates of its rows.

Headings: (doc_id, position, kind, mark, punct). Rows of a kind other than "enumerator" are passed
over ("caps_observed"); a null mark has no reading; repeated rows are counted anew; documents without
enumerators have the status "no_enumerators".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.operators.chains import by_document

#: Fixed values of the rules.
COUNTER_MOST, DEPTH_MOST, SUSPECT_FROM, VIOLATION_SHARE = 200, 4, 15, 5
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ACTIONS = ("violation", "increment", "open_level", "illegal_restart", "jump_forward", "open_midcounter")
READING = "array<struct<family: string, value: bigint>>"


def roman_value(numeral: Column) -> Column:
    """What a numeral of Roman letters counts, from the right: a letter below the greatest so far is taken off."""
    weight = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    letters = F.reverse(F.filter(F.split(numeral, ""), lambda c: c != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    step = lambda s, n: F.struct(F.when(n < s["most"], s["total"] - n).otherwise(s["total"] + n).alias("total"), F.greatest(s["most"], n).alias("most"))
    return F.aggregate(F.transform(letters, lambda c: F.coalesce(weight[c], F.lit(0))), start, step, lambda s: s["total"])


def readings(mark: Column, punct: Column) -> Column:
    """READING of an enumerator's mark, the likelier one first; empty for none."""
    like = lambda pattern: F.regexp_like(mark, F.lit(pattern))
    one = lambda family, value: F.struct(F.concat(F.lit(f"{family}_"), punct).alias("family"), value.cast("bigint").alias("value"))
    fits = lambda value: F.coalesce((value >= 1) & (value <= COUNTER_MOST), F.lit(False))
    only = lambda family, value: F.when(fits(value), F.array(one(family, value))).otherwise(none)
    none = F.array().cast(READING)
    letter = F.ascii(F.upper(mark)) - (ord("A") - 1)
    case = F.when(like("^[A-Z]$"), one("upper_alpha", letter)).otherwise(one("lower_alpha", letter))
    roman = roman_value(mark)
    return (
        F.when(mark.isNull(), none)
        .when(like(r"^\d{1,2}(?:\.\d{1,2}){1,3}$"), only("legal_numeric", F.substring_index(mark, ".", -1).cast("bigint")))
        .when(like(r"^[0-9]+$"), only("numeric", F.when(F.length(mark) <= 9, mark.cast("bigint"))))
        .when(like("^[IVXLCDM]{2,7}$"), only("roman", roman))
        .when(like("^[IVXLCDM]$"), F.array_append(only("roman", roman), case))
        .when(like("^[A-Za-z]$"), F.array(case))
        .otherwise(none)
    )


def climb(stack: list[list], options: list[tuple[str, int]]) -> tuple[str, int, int, int] | None:
    """(family, value, level, action) of an enumerator, by the first rule that one of its readings meets; the stack is changed.

    The next value of an open counter; a new counter from 1; an open counter again from 1, or further on; a new counter from
    elsewhere. What is open below a counter that goes on is closed.
    """
    open_at = {family: k for k, (family, _) in enumerate(stack)}
    before = {family: stack[k][1] for family, k in open_at.items()}
    room = len(stack) < DEPTH_MOST
    rules = (
        (1, lambda f, v: f in before and v == before[f] + 1),
        (2, lambda f, v: room and f not in before and v == 1),
        (3, lambda f, v: f in before and (v == 1 or v > before[f] + 1)),
        (5, lambda f, v: room and f not in before),
    )
    for action, meets in rules:
        for family, value in options:
            if meets(family, value):
                level = open_at.get(family, len(stack))
                stack[level:] = [[family, value]]
                return family, value, level + 1, action + (action == 3 and value != 1)
    return None


def ladder(headings: DataFrame) -> DataFrame:
    """(doc_id, position, family, value, level, action) of every heading."""
    marks = headings.where("position is not null").select("doc_id", "position", F.coalesce(F.col("kind") == "enumerator", F.lit(False)).alias("counts"), readings(F.col("mark"), F.coalesce("punct", F.lit(""))).alias("r"))
    first, second = F.get("r", 0), F.get("r", 1)
    text = lambda c: F.coalesce(c["family"], F.lit(""))
    number = lambda c: F.coalesce(c["value"], F.lit(0).cast("bigint"))
    rows = marks.select("doc_id", "position", "counts", text(first).alias("family1"), number(first).alias("value1"), text(second).alias("family2"), number(second).alias("value2"))

    def run(held: dict) -> dict:
        stack: list[list] = []
        out = []
        for position, counts, *flat in zip(*(held[c].tolist() for c in ("position", "counts", "family1", "value1", "family2", "value2"))):
            options = [(f, v) for f, v in (flat[:2], flat[2:]) if f]
            if not counts:
                out.append((position, "", None, None, "caps_observed"))
            elif made := climb(stack, options):
                out.append((position, *made[:3], ACTIONS[made[3]]))
            else:
                out.append((position, *(options[0] if options else ("unknown", None)), None, ACTIONS[0]))
        return dict(zip(("position", "family", "value", "level", "action"), map(list, zip(*out))))

    return by_document(rows, ("position", "family1", "value1"), run, "doc_id bigint, position bigint, family string, value bigint, level bigint, action string")


def families(rungs: DataFrame) -> DataFrame:
    """(doc_id, family, n, max_value, violations, gaps, levels, footnote_suspect) of the families of each ladder.

    ``levels`` says how often a level was taken, as "level:times", comma-joined. Numbers that go high on one level only may be footnotes.
    """
    rows = rungs.where("action <> 'caps_observed'").withColumn("placed", F.col("action") != "violation")
    votes = rows.groupBy("doc_id", "family", "level").agg(
        F.count(F.when(F.col("placed"), 1)).alias("n"),
        F.max(F.when(F.col("placed"), F.col("value"))).alias("max_value"),
        F.count(F.when(F.col("action").isin("violation", "illegal_restart"), 1)).alias("violations"),
        F.count(F.when(F.col("action").isin("jump_forward", "open_midcounter"), 1)).alias("gaps"),
    )
    level = F.when(F.col("level").isNotNull(), F.struct("level", F.concat_ws(":", F.col("level").cast("string"), F.col("n").cast("string")).alias("t")))
    whole = votes.groupBy("doc_id", "family").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.max("max_value"), F.lit(0).cast("bigint")).alias("max_value"),
        F.sum("violations").alias("violations"),
        F.sum("gaps").alias("gaps"),
        F.array_join(F.sort_array(F.collect_list(level))["t"], ",").alias("levels"),  # four at most
        F.count("level").alias("n_levels"),
    )
    suspect = F.regexp_like("family", F.lit("^(legal_)?numeric_")) & (F.col("max_value") >= SUSPECT_FROM) & (F.col("n_levels") == 1)
    return whole.withColumn("footnote_suspect", suspect).drop("n_levels")


def statuses(rungs: DataFrame) -> DataFrame:
    """(doc_id, n_enumerators, violations, gaps, status) of each ladder; up to a fifth of the enumerators may violate it, and one may always."""
    rows = rungs.groupBy("doc_id").agg(
        F.count(F.when(F.col("action") != "caps_observed", 1)).alias("n_enumerators"),
        F.count(F.when(F.col("action").isin("violation", "illegal_restart"), 1)).alias("violations"),
        F.count(F.when(F.col("action").isin("jump_forward", "open_midcounter"), 1)).alias("gaps"),
    )
    allowed = F.greatest(F.floor(F.col("n_enumerators") / VIOLATION_SHARE), F.lit(1))
    status = (
        F.when(F.col("n_enumerators") == 0, "no_enumerators")
        .when(F.col("violations") == 0, "parsed_clean")
        .when(F.col("violations") <= allowed, "parsed_with_violations")
        .otherwise("unparseable")
    )
    return rows.withColumn("status", status)
