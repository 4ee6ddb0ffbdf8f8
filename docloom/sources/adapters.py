"""Readers of stored documents as explicit-schema DataFrames, and their envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fields that a request may have, by operation (fixed values of the request format).
FIELDS = {
    "inspect": ("operation", "path"),
    "prepare": ("operation", "path", "pages"),
    "source_doc": ("operation", "path", "id", "url"),
    "structure_lookup": ("operation", "path", "locator_kind", "locator", "context", "page", "occurrence"),
}
REQUEST = "operation string, path string, pages array<int>, id string, url string, locator_kind string, locator string, context int, page int, occurrence int"
MOST_BYTES, MOST_PAGES = 65536, 1000


def journal_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page exports, a JSON object per line; a line that doesn't fit the schema fails the read."""
    schema = "article_id bigint, pdf_page bigint, text string, regions array<struct<`order`:bigint,type:string,text:string>>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def requests(rows: DataFrame, column: str = "request") -> DataFrame:
    """rows with the parsed ``request`` and an ``error``, null for requests that may run."""
    known = F.create_map(*[x for k, v in FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    parsed = F.from_json(column, REQUEST)
    operation = parsed["operation"]
    unknown = F.array_except(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")), F.coalesce(F.element_at(known, operation), F.array().cast("array<string>")))
    error = (
        F.when(F.octet_length(column) > MOST_BYTES, "request too large")
        .when(operation.isNull() | ~F.coalesce(F.array_contains(F.map_keys(known), operation), F.lit(False)), "unknown operation")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.element_at(unknown, 1)))
        .when(F.size(parsed["pages"]) > MOST_PAGES, "too many pages")
        .when(F.exists(parsed["pages"], lambda p: p < 1), "bad page")
    )
    return rows.withColumn("parsed", parsed).withColumn("error", error)


def selected_pages(pages: list[int]) -> list[int]:
    """Zero-based pages of a selection, each once and in order."""
    if not pages or len(pages) > MOST_PAGES or min(pages) < 1:
        raise ValueError("pages must be 1 to 1000 positive numbers")
    return sorted({p - 1 for p in pages})


#: Names of a block's fields in the orders that providers write them (fixed values of the format).
FIELD_ORDERS = {
    "projected": "kind label start end origin aliases anchor",
    "native": "kind label start end anchor aliases origin",
    "native_with_aliases": "kind label start end anchor aliases origin",
    "aliases_before_origin": "kind label start end aliases origin anchor",
    "aliases_anchor_before_origin": "kind label start end aliases anchor origin",
    "end_last": "kind label start anchor aliases origin end",
}


def block_json(blocks: DataFrame) -> DataFrame:
    """blocks(kind, label, start, end, origin, aliases, anchor, parent_label, field_order) with ``json``.

    Null anchors and parents are left out, and so are empty aliases but in the order
    'native_with_aliases'. An unknown order gives null.
    """
    some = F.when(F.size("aliases") > 0, F.col("aliases"))
    every = F.coalesce("aliases", F.array().cast("array<string>"))

    def written(order: str) -> Column:
        fields = [((every if order == "native_with_aliases" else some) if c == "aliases" else F.col(c)).alias(c) for c in FIELD_ORDERS[order].split()]
        return F.to_json(F.struct(*fields, F.col("parent_label").alias("parentLabel")), {"ignoreNullFields": "true"})

    return blocks.withColumn("json", F.coalesce(*[F.when(F.col("field_order") == order, written(order)) for order in FIELD_ORDERS]))


def write_json_gz(rows: DataFrame, path: str) -> None:
    """One gzip JSON line per row, columns in their order; the committer replaces a path as a whole or not at all."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression="gzip")


def read_json_gz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_json_gz`` wrote; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
