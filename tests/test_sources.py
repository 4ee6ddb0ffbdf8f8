import pytest

from docloom.sources import adapters


def test_requests(spark):
    rows = ['{"operation": "inspect", "path": "a"}', '{"operation": "inspect", "path": "a", "x": 1}', '{"operation": "erase"}', '{"operation": "prepare", "pages": [0]}', "no json"]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, request string")
    errors = [r.error for r in adapters.requests(df).orderBy("n").collect()]
    assert errors == [None, "unknown field x", "unknown operation", "bad page", "unknown operation"]


def test_selected_pages():
    assert adapters.selected_pages([5, 1, 5]) == [0, 4]
    for bad in ([], [0]):
        with pytest.raises(ValueError):
            adapters.selected_pages(bad)


def test_journal_pages(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"article_id": 1, "pdf_page": 2, "text": "t", "regions": [{"order": 1, "type": "body", "text": "t"}]}\n')
    row = adapters.journal_pages(spark, str(tmp_path)).first()
    assert (row.article_id, row.regions[0].type) == (1, "body")
