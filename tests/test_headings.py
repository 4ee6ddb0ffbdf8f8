"""Heading ladders: literal outlines, and a stack of plain rules on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import headings

SHAPE = "doc_id bigint, position bigint, kind string, mark string, punct string"


@pytest.mark.parametrize(
    "mark, want",
    [
        ("12", [("numeric_dot", 12)]), ("201", []), ("0", []), ("99999999999999999999", []), ("3.2", [("legal_numeric_dot", 2)]), ("1.2.3.4", [("legal_numeric_dot", 4)]), ("1.2.3.4.5", []), ("1.0", []), ("123.4", []),
        ("IV", [("roman_dot", 4)]), ("XLIX", [("roman_dot", 49)]), ("IIX", [("roman_dot", 8)]), ("MM", []), ("V", [("roman_dot", 5), ("upper_alpha_dot", 22)]), ("D", [("upper_alpha_dot", 4)]), ("v", [("lower_alpha_dot", 22)]),
        ("iv", []), ("ab", []), ("", []), (None, []), ("CCX", []),
    ],
)
def test_readings(spark, mark, want):
    frame = spark.createDataFrame([(1, 1, "enumerator", mark, "dot")], SHAPE)
    got = frame.select(headings.readings(F.col("mark"), F.col("punct"))).first()[0]
    assert [tuple(r) for r in got] == want


def rungs(spark, marks, doc=1):
    rows = [(doc, k, "caps" if m == "-" else "enumerator", m, "dot") for k, m in enumerate(marks)]
    return headings.ladder(spark.createDataFrame(rows, SHAPE))


def test_literal_outline(spark):
    marks = ["I", "A", "1", "2", "B", "1", "II", "A", "4", "A", "-", "C", "C", "", None, "a", "b", "1.1", "1.1"]
    got = [(r["level"], r["action"], r["value"]) for r in rungs(spark, marks).orderBy("position").collect()]
    assert got == [
        (1, "open_level", 1), (2, "open_level", 1), (3, "open_level", 1), (3, "increment", 2), (2, "increment", 2), (3, "open_level", 1), (1, "increment", 2), (2, "open_level", 1), (3, "open_midcounter", 4),
        (2, "illegal_restart", 1), (None, "caps_observed", None), (1, "jump_forward", 100), (2, "open_midcounter", 3), (None, "violation", None), (None, "violation", None), (3, "open_level", 1), (3, "increment", 2),
        (4, "open_level", 1), (4, "illegal_restart", 1),
    ]


def test_families_and_status(spark):
    marks = [str(k) for k in range(1, 17)] + ["1", "20"]
    made = rungs(spark, marks)
    row = headings.families(made).first()
    assert (row["family"], row["n"], row["max_value"], row["violations"], row["gaps"], row["levels"], row["footnote_suspect"]) == ("numeric_dot", 18, 20, 1, 1, "1:18", True)
    assert headings.statuses(made).first()["status"] == "parsed_with_violations"
    assert headings.statuses(rungs(spark, ["-", "-"])).first()["status"] == "no_enumerators"
    assert headings.statuses(rungs(spark, ["1", "2", "I", "II"])).first()["status"] == "parsed_clean"
    assert headings.statuses(rungs(spark, ["", "", "1"])).first()["status"] == "unparseable"
    assert headings.families(rungs(spark, ["-"])).count() == 0


def plain(options_of):
    """The rules one after another, each over all readings and frames."""
    stack, out = [], []
    for options in options_of:
        found = None
        for f, v in options:
            for k in range(len(stack) - 1, -1, -1):
                if not found and stack[k] == (f, v - 1):
                    found = (k, f, v, "increment")
        for f, v in options:
            if not found and v == 1 and len(stack) < 4 and f not in [s[0] for s in stack]:
                found = (len(stack), f, v, "open_level")
        for f, v in options:
            for k in range(len(stack) - 1, -1, -1):
                if not found and stack[k][0] == f and (v == 1 or v > stack[k][1] + 1):
                    found = (k, f, v, "illegal_restart" if v == 1 else "jump_forward")
        for f, v in options:
            if not found and len(stack) < 4 and f not in [s[0] for s in stack]:
                found = (len(stack), f, v, "open_midcounter")
        if found:
            stack = [*stack[: found[0]], (found[1], found[2])]
        out.append((found[1], found[2], found[0] + 1, found[3]) if found else None)
    return out


def test_climb_equals_plain_rules():
    draw = random.Random(2)
    for _ in range(300):
        rows = [[(draw.choice("abcdef"), draw.choice([1, 1, 2, 3, 4, 7])) for _ in range(draw.choice([0, 1, 1, 2]))] for _ in range(draw.randint(1, 14))]
        stack, got = [], []
        for options in rows:
            made = headings.climb(stack, options)
            got.append(made and (*made[:3], headings.ACTIONS[made[3]]))
        assert got == plain(rows)
