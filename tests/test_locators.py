"""Lookups on literal cases: each status, range, neighbour and hint."""

import pytest

from docloom.operators import locators

UNITS = "doc_id bigint, kind string, place bigint, number bigint, id string, label string, aliases array<string>, locator_kind string, pages array<bigint>, occurrence bigint, text string"
REQUESTS = "doc_id bigint, request_id bigint, locator_kind string, locator string, end_locator string, context bigint, page bigint, occurrence bigint"


@pytest.fixture(scope="module")
def units(spark):
    rows = [(1, "page", k, k + 1, f"page-{k + 1}", None, None, None, [k + 1], None, f"Page {k + 1}.") for k in range(30)]
    rows += [(1, "paragraph", k, k + 1, f"par-{k}", None, None, None, [1 + k // 2], None, "" if k == 4 else "x" * (31_000 if k > 5 else 10)) for k in range(8)]
    rows += [(1, "footnote", k, None, f"pair-{k}", label, None, None, [k + 1, k + 2], occurrence, f"Note {k}.") for k, (label, occurrence) in enumerate([("1", 1), ("2", 1), ("1", 2)])]
    rows += [(1, "section", k, None, f"s{k}", label, aliases, kind, [1], None, "text") for k, (label, aliases, kind) in enumerate([("Section 1.1", ["Scope"], None), ("s. 2", None, "article"), ("s. 3", ["scope of it"], None), ("S 3", None, None)])]
    return spark.createDataFrame(rows, UNITS)


CASES = [
    (("page", "p. 2", None, 1, None, None), ("found", ["page-2"], ["page-1"], ["page-3"])),
    (("page", "[pp. 2–4]", None, 2, None, None), ("found", ["page-2", "page-3", "page-4"], ["page-1"], ["page-5", "page-6"])),
    (("page", "２", "Page 3", None, None, None), ("found", ["page-2", "page-3"], [], [])),
    (("page", "1-20", None, 0, None, None), ("found", [f"page-{k}" for k in range(1, 21)], [], [])),
    (("page", "1-21", None, 0, None, None), ("invalid", [], [], [])),
    (("page", "4-2", None, 0, None, None), ("invalid", [], [], [])),
    (("page", "31", None, 0, None, None), ("not_found", [], [], [])),
    (("page", "two", None, 0, None, None), ("invalid", [], [], [])),
    (("page", "2", None, 3, None, None), ("invalid", [], [], [])),
    (("page", "2", None, 0, 0, None), ("invalid", [], [], [])),
    (("page", " ", None, 0, None, None), ("invalid", [], [], [])),
    (("page", "2" * 201, None, 0, None, None), ("invalid", [], [], [])),
    (("chapter", "2", None, 0, None, None), ("invalid", [], [], [])),
    (("paragraph", "paras. 1 to 2", None, 1, None, None), ("found", ["par-0", "par-1"], [], ["par-2"])),
    (("paragraph", "¶ 5", None, 0, None, None), ("unavailable", [], [], [])),
    (("paragraph", "7", "8", 0, None, None), ("invalid", [], [], [])),
    (("paragraph", "para 7", None, 0, None, None), ("found", ["par-6"], [], [])),
    (("footnote", "fn. 2", None, 1, None, None), ("found", ["pair-1"], ["pair-0"], ["pair-2"])),
    (("footnote", "1", None, 0, None, None), ("ambiguous", [], [], [])),
    (("footnote", "1", None, 0, None, 2), ("found", ["pair-2"], [], [])),
    (("footnote", "note 1", None, 0, 4, None), ("found", ["pair-2"], [], [])),
    (("footnote", "pair-0", "2", 0, None, None), ("found", ["pair-0", "pair-1"], [], [])),
    (("footnote", "2", "pair-0", 0, None, None), ("not_found", [], [], [])),
    (("section", "s 1.1", None, 0, None, None), ("not_found", [], [], [])),
    (("section", "SECTION  1.1", None, 0, None, None), ("found", ["s0"], [], [])),
    (("section", "scope", None, 1, None, None), ("found", ["s0"], [], ["s1"])),
    (("section", "3", None, 0, None, None), ("ambiguous", [], [], [])),
    (("section", "2", "3", 0, None, None), ("invalid", [], [], [])),
    (("article", "2", None, 0, None, None), ("found", ["s1"], [], [])),
    (("article", "3", None, 0, None, None), ("not_found", [], [], [])),
    (("schedule", "2", None, 0, None, None), ("unavailable", [], [], [])),
]


def test_structure_lookup(spark, units):
    rows = [(1, n, *asked) for n, (asked, _) in enumerate(CASES)] + [(2, 99, "page", "1", None, None, None, None)]
    got = {r.request_id: r for r in locators.structure_lookup(units, spark.createDataFrame(rows, REQUESTS)).collect()}
    assert len(got) == len(rows) and got[99].status == "not_found"
    assert {n: (r.status, r.units, r.before, r.after) for n, r in got.items() if n < 99} == {n: want for n, (_, want) in enumerate(CASES)}
    assert got[18].matches == ["pair-0", "pair-2"] and got[26].matches == ["s2", "s3"] and got[1].pages == [1, 2, 3, 4, 5, 6]
    assert got[4].error == "Exact ranges are limited to 20 units" and got[0].error is None


def test_structure_lookup_of_nothing(spark, units):
    none = spark.createDataFrame([], REQUESTS)
    assert locators.structure_lookup(units, none).count() == 0
    one = spark.createDataFrame([(1, 1, "page", None, None, None, None, None), (None, 2, "section", "x", None, None, None, None)], REQUESTS)
    assert {(r.request_id, r.status) for r in locators.structure_lookup(units.limit(0), one).collect()} == {(1, "invalid"), (2, "not_found")}


def test_lookup_footnote(spark):
    notes = [(1, k, f"pair-{k + 1}", "1", k + 1, 1, [2], f"line-{k + 1}", f"Sentence {k + 1}.", f"Passage {k + 1}.") for k in range(2)]
    notes = spark.createDataFrame(notes, "doc_id bigint, place bigint, pair_id string, label string, occurrence bigint, reference_page bigint, body_pages array<bigint>, reference_line_id string, sentence_proposition string, passage_since_prior_note string")
    text = "Context for the second reference. " + "y" * 3000
    paragraphs = spark.createDataFrame([(1, 0, ["line-2"], text), (1, 1, ["line-2"], "later")], "doc_id bigint, place bigint, line_ids array<string>, text string")
    asked = [(1, 0, "¹", None, None, "sentence"), (1, 1, " 01 ", 2, 2, "passage_since_prior_note"), (1, 2, "pair-1", 1, None, "sentence"), (1, 3, "pair-1", 3, None, "sentence"), (1, 4, "1", None, None, "other"), (1, 5, None, None, None, "sentence")]
    asked = spark.createDataFrame(asked, "doc_id bigint, request_id bigint, query string, page bigint, occurrence bigint, mode string")
    got = {r.request_id: (r.status, r.matches, r.proposition, r.context) for r in locators.lookup_footnote(notes, paragraphs, asked).collect()}
    assert got == {
        0: ("ambiguous", ["pair-1", "pair-2"], "", ""),
        1: ("found", ["pair-2"], "Passage 2.", text[:2000]),
        2: ("found", ["pair-1"], "Sentence 1.", ""),
        3: ("not_found", [], "", ""),
        4: ("invalid", [], "", ""),
        5: ("not_found", [], "", ""),
    }
