"""What stays in memory between steps: things kept in workers, texts that travel, joins in one plan."""

import numpy as np

from docloom.llm import arrow, bpe, jaccard, secrets


def test_a_task_of_another_operator_lets_go_of_the_codec(spark):
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "plain words of a plain text")], "doc_id bigint, text string").coalesce(1)
    assert bpe.encode(docs, *how).count() == 1

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(arrow._kept)], pa.int64())})

    # Whichever workers get them, one of many tasks meets the codec.
    assert max(r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n bigint").collect()) == 1
    assert {r.n for r in spark.range(0, 40, 1, 16).mapInArrow(arrow.tidy(held), "n bigint").collect()} == {0}


def test_equal_pieces_of_a_batch_are_learned_once(monkeypatch):
    import public_tokenizers

    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    asked = []
    learn = codec.learn
    monkeypatch.setattr(codec, "learn", lambda pieces: (asked.extend(pieces), learn(pieces)))
    a, none, b = codec.encode(["zqx vwk zqx", None, "zqx vwk zqx"])
    assert a == b and none == b"" and len(asked) == len(set(asked))


def test_redaction_moves_no_text_without_findings(spark):
    rows = [(1, "no finding here"), (2, "token = abcdef123456 end"), (3, None), (2, "token = abcdef123456 end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = spark.createDataFrame([(docs.where("doc_id = 2").select(secrets.blob_id(docs["text"])).first()[0], "assign", 0, 0, 20)], "blob_id string, kind string, rule int, start bigint, end bigint")
    clean = secrets.redact(docs, found)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted([(1, "no finding here"), (2, "[SECRET] end"), (2, "[SECRET] end"), (3, None)], key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = secrets.redact(docs, found)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_no_plan_of_the_similarity_join_has_many_joins(spark, monkeypatch):
    """The driver holds a plan's broadcasts, threads and metrics at once."""
    rng = np.random.default_rng(7)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(60):
        own = list(base)
        for _ in range(k % 6):
            own[int(rng.integers(0, 60))] = f"e{rng.integers(0, 10**6)}"
        texts.append((k, " ".join(own)))
    joins = {}
    write = jaccard.staged

    def seen(df, label, *a, **b):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins[label] = max(joins.get(label, 0), plan.count("Join "))
        return write(df, label, *a, **b)

    monkeypatch.setattr(jaccard, "staged", seen)
    assert jaccard.classes(spark.createDataFrame(texts, "doc_id bigint, text string")).count() == 60
    assert "open-classes" in joins and max(joins.values()) <= 4, joins
