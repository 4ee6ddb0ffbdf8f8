"""Fill-in-the-middle: cuts, forms and rebuilt texts against plain slices."""

import hashlib

import pytest
import regex

from docloom.llm import infill

TEXTS = [None, "", "a", "ab😀é\n\r\nç" * 400, "holds <P> a mark", "tail <S", "> head", "<M", "x" * 300_000, "same", "same", "\x00nul"]


def plain(doc_id, text):
    """The contract, by indices of code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m


def test_rows_equal_plain_slices(spark):
    rows = [(k, t, "own") for k, t in enumerate(TEXTS * 12)] + [(None, "no id", "own"), (5, "again", "own"), (5, "again", "own"), (-3, "negative", "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string").repartition(3)
    got = sorted(map(repr, infill.fill_in_middle(docs).collect()))
    want = []
    for doc_id, text, _ in rows:
        n, form, prefix, middle, output = plain(doc_id, text)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        row = dict(doc_id=doc_id, n=n, form=form, prefix_chars=prefix, middle_chars=middle, output_sha256=sha(output), restored_sha256=sha(text or ""), output=output)
        want.append("Row(" + ", ".join(f"{k}={v!r}" for k, v in row.items()) + ")")
    assert got == sorted(want)
    assert {r.split("form=")[1][:5] for r in want} == {"'plai", "'psm'", "'spm'"}


def test_no_rows_and_kept_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, n string, other int")
    out = infill.fill_in_middle(docs, keep=("doc_id", "n", "other"))
    assert out.columns[:3] == ["doc_id", "other", "n"] and out.count() == 0


@pytest.mark.parametrize("unit", [infill.CODE_POINT, infill.WORD, infill.LINE, r"\X", r"[a-c]", r"(?<one>\w)(?P=one)?"])
def test_units_are_those_of_finditer(unit):
    for text in ["", " lead word  word\n\nline", "abcabd abc", "éé 😀" * 700, "aabbbc" * 500]:
        assert list(infill.unit_ends(infill.side_by_side(unit), text)) == [m.end() for m in regex.finditer(unit, text)]


@pytest.mark.parametrize("unit", [infill.WORD, infill.LINE, r"[a-c]"])
def test_any_cut_can_be_undone(unit):
    text = " x one two\nthree <S four\n\n> abc <P"
    ends = infill.unit_ends(infill.side_by_side(unit), text)
    for a in range(len(ends) + 1):
        for b in range(len(ends) + 1):
            for spm in (0, 99):
                form, prefix, middle, output = infill.arranged(text, ends, (a, b, 0, spm))
                assert infill.restore(output, form) == text and form == ("psm", "spm")[spm == 0]
                assert text[prefix : prefix + middle] == output.partition(infill.MIDDLE)[2]
