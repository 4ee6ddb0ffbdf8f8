from docloom.streaming import imports

SCHEMA = "provider string, source_id bigint, text_en string, text_fr string"


def test_import_resumes_and_the_last_version_wins(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("source", "target", "state"))
    spark.createDataFrame([("p", 1, "one", None), ("p", 2, None, "deux"), ("q", 3, None, None)], SCHEMA).coalesce(1).write.parquet(source)
    imports.import_files(spark, source, target, state, SCHEMA)
    assert imports.latest(spark, target).count() == 4
    spark.createDataFrame([("p", 1, "one again", "un")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    imports.import_files(spark, source, target, state, SCHEMA)
    imports.import_files(spark, source, target, state, SCHEMA)  # nothing new
    got = {(r.source_id, r.language): r.text for r in imports.latest(spark, target).collect()}
    assert got == {(1, "en"): "one again", (1, "fr"): "un", (2, "en"): "deux", (2, "fr"): "deux"}
