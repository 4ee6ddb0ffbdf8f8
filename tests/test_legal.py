"""Protected spans and signs of references, pattern by pattern."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from docloom.functions import legal

PARTS = [
    "[1998] 2 SCR 123", "2012 SCC 45", "RSC 1985, c C-46", "(1999) 12:3 Osgoode Hall LJ 45", "at pp. 12", "at 12, 13-15 and 20A", "(1990) 3 D.L.R. 12", "12 O.R. (2d) 345", "class 7", "supra note 4", "paras 3 to 5.2",
    "2020 CanLII 12345", "é 😀", "s 7", "(1901) 2 A 3", "pages 12345", "words", "12", ",", "\u00a0", "-", "ss. 1–3",
]


def one_by_one(text, pattern):
    """All spans of a pattern, each searched for from the end of the one before."""
    out, at = [], 0
    compiled = regex.compile(pattern.replace("(?U)", "").replace("(?Ui)", "(?i)").replace(r"\z", r"\Z"))
    while found := compiled.search(text, at):
        out.append(found.span())
        at = found.end()
    return out


def test_spans_equal_patterns_one_by_one(spark):
    draw = random.Random(6)
    texts = [draw.choice([" ", "", ", "]).join(draw.choice(PARTS) for _ in range(draw.randint(1, 7))) for _ in range(400)] + ["", None]
    frame = spark.createDataFrame([(k % 7, k, t) for k, t in enumerate(texts)], "doc_id bigint, line bigint, text string").repartition(3)
    spans = legal.protected_spans(frame)
    got = {(r["line"], r["pattern"], r["start_at"], r["end_at"]) for r in spans.collect()}
    want = {(k, n, a, b) for k, t in enumerate(texts) if t for n, p in enumerate(legal.PROTECTED) for a, b in one_by_one(t, p)}
    assert got == want and {n for _, n, *_ in want} == set(range(5))
    merged: dict[int, set] = {}
    for r in legal.merged_spans(spans).collect():
        merged.setdefault(r["line"], set()).update(range(r["start_at"], r["end_at"]))
    covered: dict[int, set] = {}
    for k, _, a, b in want:
        covered.setdefault(k, set()).update(range(a, b))
    assert merged == covered


def test_a_statute_is_protected(spark):
    text = "Criminal Code, RSC 1985, c C-46, s 7"
    frame = spark.createDataFrame([(1, 1, text)], "doc_id bigint, line bigint, text string")
    assert "RSC 1985, c C-46" in [text[r["start_at"] : r["end_at"]] for r in legal.protected_spans(frame).collect()]


@pytest.mark.parametrize(
    "text, want",
    [("under s. 7", True), ("see paras 12-14", True), ("at p. 123", True), ("supra note 4", True), ("class 7", False), ("xss. 12", False), ("at p. 12345", False), ("Smith v. Jones", True), ("ｓｕｐｒａ note ４", True),
     ("1 Alta L Rev 2", True), ("1 Nat’l J Sexual Orientation L 2", True), ("1 XYZ Rev 2", False), ("", False), (None, None), ("1 A.B.C. Rev 2", True), ("[2001] 3 Res & Dev (2 d) 9", True)],
)
def test_signals(spark, text, want):
    frame = spark.createDataFrame([(text,)], "text string")
    reporters = ["Alta L Rev", "Nat'l J Sexual Orientation L", "ABC Rev", "Res & Dev (2 d)"]
    assert frame.select(legal.has_signal(F.col("text"), reporters)).first()[0] == want


def test_reporters_match_themselves():
    for name in ["Alta L Rev", "Nat'l J Sexual Orientation L", "Actualités-Justice", "Res Communes: Vermont's J Env't", "J Energy, Nat'l Res & Envtl L", "DLR (4th)"]:
        assert regex.fullmatch(legal.reporter_pattern(name), name)
