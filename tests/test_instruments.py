"""Instruments: literal texts, ends against a quadratic search, dialects and readings."""

import random

import pytest

from docloom.operators import instruments

TEXT = """PART I - General
1 This is the first section.
(a) one thing
(b) another thing
(i) a part of it
(ii) more of it
(c) the last
2 Second section of it.
(1) inline no
(3) a jump
(1) again
PART II
3 Third (x).
a) not used
(q) starts late
Schedule A Forms
Exhibit b small"""


def nodes_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {k: [] for k in range(len(texts))}
    for r in instruments.instrument_nodes(frame).orderBy("doc_id", "ordinal").collect():
        out[r["doc_id"]].append(r)
    return [out[k] for k in range(len(texts))]


def test_literal_instruments(spark):
    direct = "Section 1. First of them\nwords\na. alpha\nb. beta\nc. gamma\n1.2 Second (a) Inline not\n4) Words\n3 (2) Inline it is"
    first, second, none, null = nodes_of(spark, [TEXT, direct, "no marks here", None])
    short = lambda rows: [(r["label"], r["parent_label"], r["depth"], (r["code"] or "").removeprefix("instrument_ladder_")) for r in rows]
    assert short(first) == [
        ("part1", None, 0, ""), ("sec1", "part1", 1, ""), ("sec1(a)", "sec1", 2, "level_open"), ("sec1(b)", "sec1", 2, "increment"), ("sec1(b)(i)", "sec1(b)", 3, "level_open"), ("sec1(b)(ii)", "sec1(b)", 3, "increment"),
        ("sec1(c)", "sec1", 2, "increment"), ("sec2", "part1", 1, ""), ("sec2(1)", "sec2", 2, "level_open"), ("sec2(3)", "sec2", 2, "forward_jump"), ("sec2(1)@2", "sec2", 2, "restart"), ("part2", None, 0, ""),
        ("sec3", "part2", 1, ""), ("sec3(q)", "sec3", 2, "midcounter_open"), ("scheda", None, 0, ""),
    ]
    assert short(second) == [
        ("sec1", None, 0, ""), ("sec1(a)", "sec1", 1, "level_open"), ("sec1(b)", "sec1", 1, "increment"), ("sec1(c)", "sec1", 1, "increment"), ("sec1.2", None, 0, ""), ("sec4", None, 0, ""), ("sec3", None, 0, ""), ("sec3(2)", "sec3", 1, "midcounter_open"),
    ]
    assert none == null == []
    assert [TEXT[r["start"] : r["start"] + 5] for r in first[:3]] == ["PART ", "1 Thi", "(a) o"] and TEXT[first[2]["content_start"] :].startswith("one thing") and first[0]["end_at"] == TEXT.index("PART II")
    for text, rows in ((TEXT, first), (direct, second)):
        later = lambda k: next((r["start"] for r in rows[k + 1 :] if r["depth"] <= rows[k]["depth"]), len(text))  # noqa: B023, E731
        assert [r["end_at"] for r in rows] == [later(k) for k in range(len(rows))]


def test_ends_equal_a_quadratic_search():
    draw = random.Random(1)
    for _ in range(200):
        nodes = [(k * 3, "", None, 0, None, draw.randint(0, 5)) for k in range(draw.randint(0, 30))]
        want = [next((n[0] for n in nodes[k + 1 :] if n[5] <= nodes[k][5]), 999) for k in range(len(nodes))]
        assert instruments.closed(nodes, 999) == want


@pytest.mark.parametrize(
    "token, want",
    [("3", [(0, "3")]), ("1.2", [(0, "1.2")]), ("a", [(1, "1")]), ("i", [(1, "9"), (2, "1")]), ("B", [(3, "2")]), ("C", [(3, "3"), (4, "100")]), ("ii", [(2, "2")]), ("aa", [(1, "27")]), ("cc", [(1, "29")]), ("mm", [(1, "39")]), ("cm", [(2, "900")]), ("ab", []), ("IV", [(4, "4")])],
)
def test_readings(token, want):
    assert instruments.readings(token) == want


def test_dialects_and_points():
    assert instruments.uses(["a", "b", "c"]) and not instruments.uses(["b", "c", "d"]) and instruments.uses(["a", "c", "b", "f"]) and not instruments.uses(["a", "b"])
    assert instruments.order("1.10") > instruments.order("1.1") and instruments.order("1.2") > instruments.order("1.10") and instruments.order("10") > instruments.order("9")
    full = [[f, "1", ""] for f in range(10, 16)]
    assert instruments.point(full, [(0, "1")])[:2] == (4, -1) and instruments.point([], []) == (4, -1, 0, "")
