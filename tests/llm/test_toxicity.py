"""Toxicity by compression distance: held-out rows, the parts of the fit, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import queries, toxicity


def prose(draw, words=120):
    return " ".join("".join(draw.choice(["an", "the", "or", "ti", "ble", "ou", "re", "sh"]) for _ in range(draw.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled():
    """Texts of one prose; those of label 1 have some of six rare words here and there."""
    draw, bad = random.Random(11), ["grumpfwit", "snarvel", "mookzap", "zilchkov", "quaxter", "vlurm"]
    rows = []
    for k in range(600):
        text = prose(draw).split()
        if k % 5 == 0:
            for _ in range(6):
                text[draw.randrange(len(text))] = draw.choice(bad)
        rows.append((k, " ".join(text), int(k % 5 == 0)))
    return rows


def test_held_out_rows_are_told_apart(spark, labelled, tmp_path):
    frame = spark.createDataFrame([(k, t) for k, t, _ in labelled], "doc_id bigint, text string").repartition(4)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    # Labels of held-out rows are turned round: they must not be learned from.
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    marks = spark.createDataFrame([(k, 0, 1 - y if out(k) else y) for k, _, y in labelled], "doc_id bigint, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r["doc_id"]: r for r in queries.op13_toxicity(spark, str(tmp_path)).collect()}
    assert len(rows) == len(labelled) and all(rows[k]["held_out"] == out(k) for k in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    held = [(rows[k]["predicted"], y) for k, _, y in labelled if out(k)]
    caught = [p for p, y in held if y]
    clean = [p for p, y in held if not y]
    assert len(caught) > 20 and np.mean(caught) >= 0.9 and np.mean(clean) <= 0.05


def test_scores_depend_on_the_text_alone(spark, labelled):
    model = toxicity.learn(*[[toxicity.folded(t) for _, t, y in labelled if y == kind] for kind in (0, 1)])
    text = labelled[0][1]
    again = spark.createDataFrame([(k, text, k) for k in range(5)], "doc_id bigint, text string, score int").repartition(3)
    scores = {r["score"] for r in toxicity.score(again, model).collect()}
    assert len(scores) == 1 and scores.pop() > 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, prose(random.Random(3), 300_000)), (4, "😀" * 99)], "doc_id bigint, text string")
    scores = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(scores) == 5 and max(scores) < 0.3


def test_few_labels_give_their_share(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(8)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    few = spark.createDataFrame([(0, 0), (1, None), (None, 1), (99, 1), (3, 0)], "doc_id bigint, toxic int")
    ids = [k for k in (0, 3) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, few)).collect()} == {1 / (len(ids) + 2)}


def test_sample_is_bounded_and_holds_different_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    docs = spark.createDataFrame([(k, "copy" if k % 2 else f"text {k}") for k in range(200)] + [(500, "y" * 30_000)], "doc_id bigint, text string")
    marks = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    ordinary, toxic = toxicity.sampled(docs, marks)
    assert len(ordinary) == len(set(ordinary)) == 10 and len(toxic) == len(set(toxic)) == 10
    assert (ordinary, toxic) == toxicity.sampled(docs.repartition(7), marks)


def test_telling_strings_and_their_runs():
    plain, bad = [b"abcdefgh ijkl"] * 30, [b"abcdefgh badword ijkl"] * 5
    wanted = toxicity.telling(bad, plain)
    assert toxicity.runs_of(bad[0], wanted) == [b"fgh badword ijk"]
    assert toxicity.runs_of(plain[0], wanted) == [] and toxicity.runs_of(b"ab", wanted) == [] and len(toxicity.telling([], [])) == 0


def test_shares_rise():
    sums, shares = toxicity.rising(np.array([0.0, 0, 1, 2, 2, 3]), np.array([0, 1, 0, 1, 0, 1]), np.ones(6))
    assert list(sums) == sorted(sums) and list(shares) == sorted(shares)


def test_windows_cover_every_byte():
    for n in (1, 2, 95, 96, 97, 168, 169, 1000):
        body = bytes(range(256)) * 4
        parts = list(toxicity.windows(body[:n]))
        assert parts[-1].endswith(body[:n][-1:]) and sum(map(len, parts)) - (len(parts) - 1) * (toxicity.WINDOW - toxicity.STEP) == n
