"""States of documents, and pages that number their lines, on literal cases."""

from docloom.operators import pages


def test_statuses(spark):
    counted = spark.createDataFrame([(d, p) for d in range(1, 8) for p in (0, 1)], "doc_id bigint, page bigint")
    rows = [
        (1, 0, "OCR_REQUIRED", "info"), (1, 1, "OCR_REQUIRED", "info"),  # all pages
        (2, 0, "OCR_REQUIRED", "info"), (2, 0, "OCR_REQUIRED", "info"),  # one page twice, no warning
        (3, 0, "OCR_REQUIRED", "warning"), (4, 1, "TEXT_QUALITY_LOW", "error"), (5, 1, "OTHER", "error"),
        (6, None, "OCR_REQUIRED", "info"), (6, 1, "OCR_REQUIRED", None),  # a null page is one more
        (99, 0, "OCR_REQUIRED", "error"),  # no such document
    ]
    found = pages.statuses(counted, spark.createDataFrame(rows, "doc_id bigint, page bigint, code string, severity string"))
    assert {r["doc_id"]: r["status"] for r in found.collect()} == {1: "ocr_required", 2: "ready", 3: "degraded", 4: "degraded", 5: "ready", 6: "ocr_required", 7: "ready"}
    assert pages.statuses(counted.limit(0), found.select("doc_id").withColumns({}).selectExpr("doc_id", "doc_id as page", "'x' as code", "'y' as severity")).count() == 0


def test_transcript_pages(spark):
    rows = []
    put = lambda page, x, width, *texts: rows.extend((1, page, float(x), float(width), t) for t in texts)
    numbers = [str(k) for k in range(1, 16)]
    put(1, 10, 1000, *numbers, "16", "words", None)
    put(2, 10, 1000, *numbers[:-1])  # 15 is not there
    put(3, 10, 0, *numbers)  # no width
    put(4, 10, 1000, *numbers[:8])
    put(4, 45, 1000, *numbers[8:])  # more than 3 % apart
    put(5, 10, 1000, *[f" - {k} - " for k in numbers])
    put(6, 10, 1000, *numbers[:8])
    put(6, 40, 1000, *numbers[8:])  # just 3 % apart
    put(7, 10, 1000, *numbers)
    put(7, 500, 1000, *["7"] * 20)  # a larger band of one number hides the column
    put(8, 10, 1000, *numbers[1:], "41", "0001")
    found = pages.transcript_pages(spark.createDataFrame(rows, "doc_id bigint, page bigint, x0 double, width double, text string"))
    assert {r["page"]: r["n_numbers"] for r in found.collect()} == {1: 16, 5: 15, 6: 15, 8: 15}
