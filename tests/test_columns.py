"""Column models on literal pages, and on random pages against a plain loop."""

import random

import pytest

from docloom.operators import columns

SCHEMA = "doc_id bigint, page bigint, page_width double, x0 double, y0 double, x1 double, y1 double, region_type string, excluded boolean"


def page(number, boxes, width=600.0, region="body"):
    return [(1, number, width, float(x0), float(y), float(x1), float(y + 10), region, False) for x0, x1, y in boxes]


def test_page_columns(spark):
    ys = range(0, 100, 12)
    left, right = [(50, 280, y) for y in ys], [(320, 550, y) for y in ys]
    rows = page(1, left + right)
    rows += page(2, [(50, 550, y) for y in ys])
    rows += page(3, left + [(x0, x1, y + 500) for x0, x1, y in right])  # one below the other
    rows += page(4, [(50, 370, y) for y in ys] + [(430, 520, y) for y in ys])  # a margin
    rows += page(5, left[:2] + right)  # too few on the left
    rows += page(6, left + right, region="header")
    rows += page(7, left + right, width=0.0)
    rows += page(8, left + right + [(40, 560, 200 + 12 * k) for k in range(20)])  # mostly wide lines
    rows += page(9, left + right + [(290, 310, y) for y in ys])  # centred short lines
    df = spark.createDataFrame(rows, "doc_id bigint, page bigint, page_width double, x0 double, y0 double, x1 double, y1 double, region_type string, excluded boolean")
    got = {r.page: (r.kind, r.split_x, r.n_left, r.n_right) for r in columns.page_columns(df).collect()}
    single = ("single", 0.0, 0, 0)
    assert got[1] == ("two_column", 300.0, 9, 9)
    assert got[4] == ("margin_column", (210 + 475) / 2, 9, 9)
    assert [got[k] for k in (2, 3, 5, 6, 7, 8)] == [single] * 6
    # Both gaps beside the centred lines are as wide: the first is taken; of an even number of widths the upper middle one counts.
    assert got[9] == ("two_column", 232.5, 9, 18)
    got = {r.page: (r.kind, r.split_x, r.n_left, r.n_right) for r in columns.page_columns(df, skip_centred=True).collect()}
    assert got[9] == ("two_column", 300.0, 9, 9) == got[1]
    assert columns.page_columns(df.limit(0)).count() == 0


def plain_model(lines, across, skip_centred):
    """The model of one page, split by split."""
    lines = [(x0, y0, x1, y1, (x1 - x0) / across, (x0 + x1) / 2) for x0, y0, x1, y1 in lines if across > 0]
    if skip_centred:
        lines = [b for b in lines if b[4] > 0.30 or abs(b[5] / across - 0.5) > 0.12]
    narrow = sorted((b for b in lines if b[4] <= 0.55), key=lambda b: b[5])
    found = []
    for k in range(3, len(narrow) - 2) if len(narrow) >= 6 and 1 - len(narrow) / len(lines) <= 0.40 else ():
        left, right = narrow[:k], narrow[k:]
        gap, split, uneven = right[0][5] - left[-1][5], (left[-1][5] + right[0][5]) / 2, 0
        if gap / across < 0.12 or not 0.25 <= split / across <= 0.75:
            continue
        if skip_centred:
            inner, outer = max(b[2] for b in left), min(b[0] for b in right)
            gap, split, uneven = outer - inner, (inner + outer) / 2, abs(len(left) - len(right))
            if gap <= 0:
                continue
        tops, ends = ([min(b[1] for b in side) for side in (left, right)], [max(b[3] for b in side) for side in (left, right)])
        if (min(ends) - max(tops)) / (max(ends) - min(tops)) < 0.30:
            continue
        crossing = sum(b[0] < split < b[2] for b in narrow)
        usual = [sorted(b[4] for b in side)[len(side) // 2] for side in (left, right)]
        even = min(usual) / max(usual) >= 0.60
        middle = crossing == 0 and 0.40 <= round(split / across, 4) <= 0.60
        found.append((crossing, uneven, -gap, k, "two_column" if even or middle else "margin_column", split))
    if not found:
        return ("single", 0.0, 0, 0)
    *_, k, kind, split = min(found)
    return (kind, split, k, len(narrow) - k)


@pytest.mark.parametrize("skip_centred", [False, True])
def test_many_pages_at_once(spark, skip_centred, monkeypatch):
    monkeypatch.setattr(columns, "LINES_AT_ONCE", 100)
    random.seed(7)
    rows, want = [], {}
    for number in range(400):
        across, parts, far = random.choice([600.0, 612.0, 595.27, 0.0]), random.randint(1, 4), random.choice([0, 0, 0, 400])
        own = []
        for _ in range(random.choice([0, 3, 8, 30])):
            side = random.randrange(parts)
            x0, y0 = side * 600.0 / parts + random.choice([0, 0, 12, 40]), random.randrange(40) * 12.0 + side * far
            own.append((x0, y0, x0 + random.choice([5.0, 60.0] if side and number % 2 else [60.0, 111.1, 140.0, 270.0, 400.0]), y0 + 10))
        want[number] = plain_model(own, across, skip_centred)
        odd = [(None, 1.0, 9.0, 9.0), (float("nan"), 1.0, 9.0, 9.0), (1.0, 1.0, float("inf"), 9.0), (9.0, 1.0, 9.0, 9.0)]
        rows += [(1, number, across, *b, random.choice([None, "body"]), random.choice([False, None])) for b in own]
        rows += [(1, number, across, *b, "body", False) for b in odd] + [(1, number, across, 1.0, 1.0, 590.0, 9.0, "header", False), (1, number, across, 1.0, 1.0, 590.0, 9.0, "body", True)]
    random.shuffle(rows)
    df = columns.page_columns(spark.createDataFrame(rows, SCHEMA).repartition(3), skip_centred)
    got = {r.page: (r.kind, r.split_x, r.n_left, r.n_right) for r in df.collect()}
    assert got == want and len({w[0] for w in want.values()}) == 3
    # One call of Python for each page took 3,400 seconds a GB of documents.
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
