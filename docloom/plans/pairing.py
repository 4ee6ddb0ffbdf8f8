"""Queries over note pairing: sequences of labels, filled gaps, references of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.functions import dialect, legal
from docloom.operators import pairing
from docloom.plans.registry import query
from docloom.session import cut


def lines_of(spark, sf_dir) -> DataFrame:
    return dialect.run(spark, sf_dir, "select doc_id, line, page, zone, false as column_fit, false as demoted, text from printed")


def refs_of(spark, sf_dir) -> DataFrame:
    return dialect.run(spark, sf_dir, "select doc_id, line, cast(at as bigint) as at, page, value, score, form, 'body' as region, form = 'plain' and line % 10 = 0 as visual, line_order from printed_refs")


def labels_of(spark, sf_dir) -> DataFrame:
    """Candidates of labels: note lines that begin with a token, scored by what follows it; supported by a reference on this page or the next to it."""
    rows = pairing.label_tokens(lines_of(spark, sf_dir).where("zone = 'note'")).where("value is not null")
    body = F.substr("text", F.col("end_at") + F.length("post") + 1)
    follow = F.when((F.col("post") != "") | F.regexp_like(body, F.lit(r"^\s")), 0.8).otherwise(0.0)
    said = F.when(legal.has_cue(body), 0.7).when(F.length(F.trim(body)) >= 8, 0.4).otherwise(0.0) - F.when(legal.continues(F.trim(body)), 1.2).otherwise(0.0)
    near = refs_of(spark, sf_dir).select("doc_id", "value", F.explode(F.array(*(F.col("page") + k for k in (-1, 0, 1)))).alias("page")).distinct().withColumn("supported", F.lit(True))
    rows = rows.join(near, ["doc_id", "value", "page"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))
    score = F.lit(3.0) + F.when(F.col("form") == "sup", 1.0).when(F.col("form") == "paren", -1.8).otherwise(follow) + said + F.when(F.col("supported"), 0.9).otherwise(0.0)
    return rows.select("doc_id", "line", "at", "page", "value", score.alias("score"), "supported", (F.col("value") == 1).alias("restart"))


def completed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Members of segments, and labels: members with what fills their gaps, with page and body."""
    members, lines = cut(pairing.segments(labels_of(spark, sf_dir))), lines_of(spark, sf_dir)
    filled = pairing.fill_gaps(members, lines).where("line is not null").select("doc_id", "segment", "value", "line", "at")
    labels = members.select(*filled.columns).unionByName(filled).join(lines.select("doc_id", "line", "page", F.col("text").alias("body")), ["doc_id", "line"])
    return members, cut(labels)


@query("seq_segments")
def segments(spark, sf_dir):
    """SEQ-19: sequences of labels, one after the other taken out of the candidates."""
    return pairing.segments(labels_of(spark, sf_dir)).select("doc_id", "segment", "ordinal", "line", "at", "value", "chain_score")


@query("seq_gap_fills")
def gap_fills(spark, sf_dir):
    """SEQ-20: each value that a sequence passes over, and the line that holds it."""
    return pairing.fill_gaps(cut(pairing.segments(labels_of(spark, sf_dir))), lines_of(spark, sf_dir))


@query("join_label_references")
def label_references(spark, sf_dir):
    """JOIN-02: references assigned to labels in their order, and why others are not."""
    members, labels = completed(spark, sf_dir)
    lines = lines_of(spark, sf_dir)
    pool = pairing.pools(members, lines, refs_of(spark, sf_dir))
    return pairing.assign_references(labels, pool, pairing.endnotes(members, lines)).select("doc_id", "segment", "value", "line", "at", "page", "label_page", "outcome")
