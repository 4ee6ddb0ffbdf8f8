"""Evidence operators against literal cases and plain Python."""

import json
import random

from docloom.operators import chains, evidence
from docloom.sources import adapters


def test_token_usage(spark):
    lines = [
        (1, '{"usage": {"input_tokens": 5, "output_tokens": 2}}'),
        (1, '[{"a": [{"input_tokens": 9}, {"total_tokens": 3.5}]}]'),
        (1, '{"input_tokens": {"output_tokens": 99}}'),
        (1, "not json"),
        (1, '{"x": NaN, "input_tokens": 70}'),
        (1, '{"input_tokens": true, "cached_input_tokens": -4}'),
        (1, "[" * 200 + '{"input_tokens": 80}' + "]" * 200),
        (1, None),
        (2, '{"total_tokens": 9223372036854775808}'),
    ]
    got = evidence.token_usage(spark.createDataFrame(lines, "doc_id bigint, line string")).collect()
    assert sorted(map(tuple, got)) == [(1, "cached_input_tokens", -4), (1, "input_tokens", 9), (1, "output_tokens", 2)]


LINE = "doc_id bigint, line_id string, text string, spans array<struct<text:string,start:bigint,`end`:bigint,x0:double,x1:double,size:double,superscript:boolean>>"


def test_isolated_references(spark):
    def line(name, mark, gap=3.0, end=12, text="host text.12", raised=True, host=True):
        spans = [("host text.", 0, 10, 10.0, 60.0, 10.0, False)] * host + [(mark, 10, end, 60.0 + gap, 70.0, 6.0, raised)]
        return (1, name, text, spans)

    rows = [line("far", "12"), line("edge", "12", 2.5), line("near", "12", 2.4), line("plain", "12", raised=False), line("alone", "12", host=False), line("word", "1a"), line("inside", "12", text="host text.12 more"), line("blank", " 7 ", end=13, text="host text. 7 "), (1, "none", "", []), (1, "null", None, None)]
    got = evidence.isolated_references(spark.createDataFrame(rows, LINE)).collect()
    assert sorted((r.line_id, r.note_id, r.start_offset, r.end_offset) for r in got) == [("blank", "7", 10, 13), ("edge", "12", 10, 12), ("far", "12", 10, 12)]


def test_detached_targets(spark):
    random.seed(3)
    lines, marks = [], []
    for page in range(6):
        for place in range(40):
            x0, y0, height = random.randrange(0, 300, 3), random.randrange(0, 120), random.choice([6, 10, 30])
            x1 = x0 + random.randrange(3, 120, 3)
            spans = [(0, 4, float(x0), (x0 + x1) / 2), (4, 9, (x0 + x1) / 2, float(x1))]
            lines.append((1, page, place, random.randrange(60), float(x0), float(y0), float(x1), float(y0 + height), random.choice([5.0, 10.0]), random.choice(["body", "body", "header"]), random.random() < 0.1, spans))
            if place % 4 == 0:
                marks.append((1, page, place, 10.0))
    spans_of = "spans array<struct<start:bigint,`end`:bigint,x0:double,x1:double>>"
    table = spark.createDataFrame(lines, "doc_id bigint, page bigint, place bigint, source_index bigint, x0 double, y0 double, x1 double, y1 double, size double, region_type string, excluded boolean, " + spans_of)
    got = evidence.detached_targets(table, spark.createDataFrame(marks, "doc_id bigint, page bigint, place bigint, body_size double")).collect()
    at = {(r[1], r[2]): r for r in lines}
    want = set()
    for _, page, place, body in marks:
        ref = at[page, place]
        best = None
        for (p, other), (_, _, _, index, _, y0, _, y1, size, region, excluded, spans) in at.items():
            height = abs(y0 - ref[5])
            if p != page or other == place or excluded or region == "header" or size < 8 or height > max(2, (y1 - y0) * 0.2):
                continue
            edges = [(abs((ref[4] + ref[6]) / 2 - x), -offset) for s, e, a, b in spans for x, offset in ((a, s), (b, e))]
            distance, back = min(edges)
            if distance <= body and (best is None or (distance, height, abs(index - ref[3]), other) < best[0]):
                best = ((distance, height, abs(index - ref[3]), other), -back)
        if best:
            want.add((page, place, best[0][3], best[1]))
    assert {(r.page, r.reference, r.target, r.offset) for r in got} == want and len(want) > 5 and len(got) == len(want)


def test_note_region_modes(spark):
    note = lambda number, mode="": ("footnote", f"{number} text", number, mode)
    pages = [
        [("body", "text", None, "")],
        [note(1)],
        [note(2), note(None)],
        [("body", " NOTES ", None, ""), note(1), note(2)],
        [note(3)],
        [note(None)],
        [note(4), note(5)],
        [note(9)],
        [("body", "text", None, "")],
        [note(10)],
        [note(11, "endnote"), note(12, "footnote")],
        [note(1, "footnote"), note(2)],
    ]
    rows = [(1, page, place, line[1], line[0], line[2], line[3]) for page, lines in enumerate(pages) for place, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id bigint, page bigint, place bigint, text string, region_type string, number bigint, mode string")
    got: dict = {}
    for r in evidence.note_region_modes(df).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append(r["mode"])
    again, end = "footnote_continuation", "endnote"
    assert list(got.values()) == [[""], [""], [again, again], ["", end, end], [end], [end], [end, end], [again], [""], [""], [end, end], ["footnote", "footnote"]]


def test_numeric_runs(spark):
    rows = [(0, 1, "dot"), (10, 2, "dot"), (20, 40, "dot"), (30, 3, "dot"), (40, 41, "dot"), (15, 5, "bracket"), (25, 6, "bracket"), (50, 90, "bare")]
    df = spark.createDataFrame([(7, *r, 60) for r in rows], "doc_id bigint, position bigint, number bigint, style string, n_chars bigint")
    runs: dict = {}
    for r in evidence.numeric_runs(df).orderBy("run_id", "ordinal").collect():
        runs.setdefault((r.run_id, r.rooted, r.consecutive), []).append((r.position, r.end_at, r.number))
    assert runs == {
        ("numeric-000001", True, True): [(0, 10, 1), (10, 15, 2), (30, 40, 3)],
        ("numeric-000002", False, True): [(15, 20, 5), (25, 30, 6)],
        ("numeric-000003", False, True): [(20, 25, 40), (40, 50, 41)],
    }
    assert chains.monotone_scopes([1, 2, 40, 3, 41], 8) == [0, 0, 1, 0, 1]


def test_block_json(spark):
    rows = [("page", "page1", 0, 5, "o", a, anchor, parent, order) for order in [*adapters.FIELD_ORDERS, "other"] for a, anchor, parent in ((["x"], "#a", "p"), ([], None, None), (None, None, None))]
    df = spark.createDataFrame(rows, "kind string, label string, start bigint, `end` bigint, origin string, aliases array<string>, anchor string, parent_label string, field_order string")
    got = [r.json for r in adapters.block_json(df).coalesce(1).collect()]
    full = [list(json.loads(t)) for t in got[:-3:3]]
    assert full == [[*names.split(), "parentLabel"] for names in adapters.FIELD_ORDERS.values()]
    short = [json.loads(t) for t in got[1:-3:3]]
    assert [("aliases" in d, "anchor" in d, "parentLabel" in d) for d in short] == [(order == "native_with_aliases", False, False) for order in adapters.FIELD_ORDERS]
    assert got[-3:] == [None] * 3


def test_json_gz(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "a bigint, b array<string>, c string"
    rows = [(1, ["x", "é"], None), (2, [], "y")]
    for _ in range(2):
        adapters.write_json_gz(spark.createDataFrame(rows, schema).coalesce(1), path)
        assert sorted(map(tuple, adapters.read_json_gz(spark, path, schema).collect())) == rows
