"""The pipeline's stages against plain Python on a small table."""

import base64
import re

import numpy as np
import pytest

from docloom.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    import public_tokenizers
    import tiktoken

    prose = lambda k: " ".join(f"word{k}x{n}" for n in range(40)) + "."
    texts = {k: prose(k) for k in range(12)}
    texts |= {20: prose(1), 21: prose(2) + " tail", 22: "too short", 23: " | ".join(f"item{n}" for n in range(30)), 24: None, 25: prose(25) + ' token = "abcdef123456" end of it.'}
    rows = [(k, t, "en", f"s{k % 2}" if k % 7 else None, 0) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "secret_scan", "source_mix", "byte_bpe"]
    stages = dict(corpus_pipeline.STAGES)

    def apply(name, docs):
        out = stages[name](spark, docs, "")
        rows = out.collect()
        assert name == "byte_bpe" or out.columns == docs.columns
        return spark.createDataFrame(rows, out.schema), rows

    docs, rows = apply("quality_rules", docs)
    assert {r.doc_id: r.text for r in rows} == {k: j[-1] for k, t in texts.items() if (j := quality.judge(t))[6]}
    assert 0 in {r.doc_id for r in rows} and not {22, 23, 24} & {r.doc_id for r in rows}

    docs, rows = apply("near_copies", docs)
    assert {r.doc_id for r in rows} == {*range(12), 25}

    docs, rows = apply("secret_scan", docs)
    got = {r.doc_id: r.text for r in rows}
    assert "abcdef" not in got.pop(25) and got == {k: texts[k] for k in range(12)}
    assert all(r.n_chars == len(r.text) for r in rows)

    docs, rows = apply("source_mix", docs)
    times = {k: sum(r.doc_id == k for r in rows) for k in {r.doc_id for r in rows}}
    assert rows and max(times.values()) <= 3

    _, out = apply("byte_bpe", docs)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in rows)
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in out) == want
    assert not re.search("too short", " ".join(r.text for r in rows))


CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_no_rows(spark, name):
    docs = spark.createDataFrame([], CLASH)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_nulls_repeats_and_other_columns(spark, name):
    """Nulls in each column, an empty text, a repeated row, one very long text, and columns named as the stages' own."""
    prose = lambda k: " ".join(f"word{k}x{n}" for n in range(60)) + "."
    long = " ".join(f"long{n}" for n in range(300_000)) + "."
    rows = [(1, prose(1), "en", "a", 5), (1, prose(1), "en", "a", 5), (None, prose(2), None, None, None), (3, None, "en", "a", None), (4, "", "en", "b", 0), (5, long, "en", "b", 0)]
    own = ("spans", "_spans", "_gone", "component_id", "size", "kept", "ids", "blob_id", "path", "component", "_end", "_hit_blob", "n", "key", "s", "target", "_mix_goal", "_mix_copy", "goal", "whole", "copy", "c0")
    docs = spark.createDataFrame([(*r, *[f"own{k}"] * len(own)) for k, r in enumerate(rows)], CLASH + "".join(f", {c} string" for c in own))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    got = out.collect()
    if name == "byte_bpe":
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and len(got) == len(rows)
        assert sorted(r.n_tokens for r in got)[:2] == [0, 0]
        return
    assert out.columns == docs.columns
    assert all(r[c].startswith("own") and len({r[c] for c in own}) == 1 for r in got for c in own)
    counts = {k: sum(r.doc_id == k for r in got) for k in (1, None, 3, 4, 5)}
    if name == "quality_rules":
        assert counts == {1: 2, None: 1, 3: 0, 4: 0, 5: 1}
    elif name == "near_copies":
        assert counts == {1: 2, None: 1, 3: 1, 4: 1, 5: 1}
    elif name == "secret_scan":
        assert counts == {1: 2, None: 1, 3: 1, 4: 1, 5: 1} and {r.doc_id: r.text for r in got} == {r[0]: r[1] for r in rows}
    else:
        assert set(r.text for r in got) <= {r[1] for r in rows} and max(counts.values()) <= 6
