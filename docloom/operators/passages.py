"""The sentence around an offset of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

# Fixed values of the rule: a sentence ends with one of .?! and closing marks, before white space, a note marker or the end.
MARKER = "⟦FN:[^⟧]+⟧"
CLOSE = "[.?!][\"'”’)\\]]*+"
PIECE = f"(?s).*?{CLOSE}(?=\\p{{IsWhite_Space}}|\\z|⟦FN:)|.+\\z"


def sentences_at(texts: DataFrame, offsets: DataFrame) -> DataFrame:
    """(text_id, offset, sentence) of each offset, in characters, into texts(text_id, text).

    An offset behind a sentence, with only white space between, belongs to that sentence;
    note markers are left out of what is returned. Offsets past the end count as the end;
    equal offsets of a text give one row; offsets of no text, or of a null one, are left out.
    A text meets its offsets once, however many they are.
    """
    offsets = offsets.where("offset >= 0").select("text_id", F.col("offset").cast("bigint").alias("offset")).distinct()
    along = Window.partitionBy("text_id").orderBy("place")
    pieces = texts.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("place", "piece"))
    pieces = pieces.select("text_id", "place", F.length("piece").alias("size"), F.length(F.regexp_extract("piece", CLOSE + "\\z", 0)).alias("mark"))
    ends = pieces.withColumn("stop", F.sum("size").over(along)).where("mark > 0")
    ends = ends.select("text_id", "stop", (F.col("stop") - F.col("mark")).alias("begin"), F.lag("stop", 1, 0).over(along).alias("stop_before"))

    none = F.lit(None).cast("bigint")
    here = offsets.select("text_id", F.col("offset").alias("at"), F.lit(1).alias("turn"), "offset", none.alias("stop"), none.alias("stop_before"))
    back = ends.select("text_id", F.col("stop").alias("at"), F.lit(0).alias("turn"), none.alias("offset"), "stop", "stop_before").unionByName(here)
    seen = Window.partitionBy("text_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    back = back.select("text_id", "offset", *[F.last(c, ignorenulls=True).over(seen).alias(c) for c in ("stop", "stop_before")]).where("offset is not null")
    ahead = ends.select("text_id", F.col("begin").alias("at"), F.lit(1).alias("turn"), none.alias("offset"), F.col("stop").alias("next")).unionByName(
        offsets.select("text_id", F.col("offset").alias("at"), F.lit(0).alias("turn"), "offset", none.alias("next"))
    )
    later = Window.partitionBy("text_id").orderBy("at", "turn").rowsBetween(0, Window.unboundedFollowing)
    ahead = ahead.withColumn("next", F.first("next", ignorenulls=True).over(later)).where("offset is not null").select("text_id", "offset", "next")

    asked = back.join(ahead, ["text_id", "offset"]).groupBy("text_id").agg(F.collect_list(F.struct("offset", "stop", "stop_before", "next")).alias("asked"))

    def part(low, high):
        return F.substring("text", low.cast("int") + 1, (high - low).cast("int"))

    def sentence(a):
        size = F.length("text").cast("bigint")
        zero = F.lit(0).cast("bigint")
        behind = a["stop"].isNotNull() & ~part(a["stop"], F.least(a["offset"], size)).rlike("\\P{IsWhite_Space}")
        low = F.when(behind, a["stop_before"]).otherwise(F.coalesce(a["stop"], zero))
        high = F.when(behind, a["stop"]).otherwise(F.coalesce(a["next"], size))
        plain = F.regexp_replace(part(low, high), MARKER, "")
        return F.struct(a["offset"].alias("offset"), F.regexp_replace(plain, "^\\p{IsWhite_Space}+|\\p{IsWhite_Space}+\\z", "").alias("sentence"))

    rows = texts.where("text is not null").join(asked, "text_id").select("text_id", F.explode(F.transform("asked", sentence)).alias("one"))
    return rows.select("text_id", "one.*")
