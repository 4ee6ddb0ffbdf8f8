"""States of documents by their diagnostics, and pages of transcripts by their line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Fixed values of the rules.
OCR = "OCR_REQUIRED"
HARD = ("COLUMN_ORDER_UNCERTAIN", "FOOTNOTE_UNMATCHED_LABEL", "FOOTNOTE_UNMATCHED_REFERENCE", "FOOTNOTE_REGION_UNCERTAIN", "TEXT_QUALITY_LOW")
NUMBER = r"^(?U)\s*-?\s*([0-9]{1,4})\s*-?\s*$"
NUMBERS, HIGHEST, BAND = 15, 40, 0.03


def statuses(pages: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(doc_id, status, n_pages) of every document of pages(doc_id, page).

    "ocr_required" if as many different pages need OCR as the document has; "degraded" if there is a warning or an error
    of OCR or of a HARD code; else "ready". diagnostics(doc_id, page, code, severity); a null page is one page of its own.
    """
    needs = F.col("code") == OCR
    bad = F.col("severity").isin("warning", "error") & (needs | F.col("code").isin(*HARD))
    found = diagnostics.groupBy("doc_id").agg(
        (F.count_distinct(F.when(needs, F.col("page"))) + F.max(F.when(needs & F.col("page").isNull(), 1).otherwise(0))).alias("n_ocr"),
        F.max(F.coalesce(bad, F.lit(False))).alias("bad"),
    )
    rows = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).join(found, "doc_id", "left")
    status = F.when(F.col("n_ocr") == F.col("n_pages"), "ocr_required").when(F.col("bad"), "degraded").otherwise("ready")
    return rows.select("doc_id", status.alias("status"), "n_pages")


def transcript_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page, n_numbers) of the pages that number their lines.

    Of the lines that are a number up to HIGHEST, the most that begin within BAND of the page's width of each other (the
    leftmost such band) must hold NUMBERS different ones, among them all from 1 to NUMBERS. lines(doc_id, page, x0, width,
    text); pages without a width are none.
    """
    number = F.regexp_extract("text", NUMBER, 1)
    rows = lines.where("width > 0").select("doc_id", "page", "width", F.col("x0").alias("x"), F.when(number != "", number.cast("int")).alias("number"))
    found = rows.where((F.col("number") <= HIGHEST) & F.col("x").isNotNull()).groupBy("doc_id", "page").agg(F.collect_list(F.struct("x", "number")).alias("all"), (F.max("width") * BAND).alias("band"))
    # Arrays hold one page's numbers.
    inside = lambda to: F.filter("all", lambda v: (v["x"] <= to) & (to - v["x"] <= F.col("band")))
    best = F.array_max(F.transform("all", lambda v: F.struct(F.size(inside(v["x"])).alias("n"), (-v["x"]).alias("left"))))
    rows = found.withColumn("to_x", -best["left"]).withColumn("held", F.array_distinct(inside(F.col("to_x"))["number"]))
    low = F.size(F.array_intersect("held", F.array(*map(F.lit, range(1, NUMBERS + 1)))))
    return rows.where(low == NUMBERS).select("doc_id", "page", F.size("held").cast("bigint").alias("n_numbers"))
