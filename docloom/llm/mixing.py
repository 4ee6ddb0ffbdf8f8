"""Mixing sources to target weights: capped water-filling and seeded repetition.

Only DataFrame operations. Rows of ``docs`` are sized in one scan; all later steps
read that narrow table (doc_id, source, size, draw).

Null and edge cases: a null text has size 0; a null source is a source of its own
and comes last; a null doc_id draws as the text 'null'; repeated rows draw alike,
and are taken or left together; an empty table gives an empty mix; columns other
than the three named ones are carried by ``mix_documents`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docloom.llm.store import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: A draw has 60 bits; the cut is first found among 2**12 ranges of draws, then inside one.
DRAW_BITS, RANGE_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def draw(doc_id: Column, seed: str) -> Column:
    """A uniform 60-bit number of the document's id and the seed."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, draw) of every row."""
    return docs.select(
        "doc_id",
        "source",
        F.when(F.col("text").isNull(), F.lit(0).cast("bigint")).otherwise(word_count(F.col("text"))).alias("size"),
        draw(F.col("doc_id"), seed).alias("draw"),
    )


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, the 0-based place by code points, null last.

    Sources are range-partitioned and counted per range, so that millions of
    sources (urls, authors) don't meet in one task.
    """
    placed = staged(
        sources.repartitionByRange(8, F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "mix-sources",
    )
    before = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = before.select(
        "part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )  # as many rows as ranges
    return placed.join(F.broadcast(before), "part").select(
        *sources.columns, (F.col("before") + F.col("place") - F.col("first")).alias("rank")
    )


def targets(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0
) -> DataFrame:
    """(source, source_size, weight, cap, target) of each source.

    The budget is ``share`` of all sizes. Each round gives what is left to the
    sources that are not yet capped, by weight, and caps those above their limit;
    it ends when none is above. A round is one aggregate of the small source table,
    of which two sums come back.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = staged(
        ranked(by).select(
            "source",
            "source_size",
            weight.cast("bigint").alias("weight"),
            (F.col("source_size") * max_epochs).alias("cap"),
        ),
        "mix-weights",
    )
    big = lambda c: c.cast("decimal(38,0)")  # noqa: E731  products may pass 64 bits
    total, all_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = left = int((total or 0) * share)
    left_weight = all_weight or 0
    while True:
        over = big(F.lit(left)) * F.col("weight") > big(F.col("cap")) * F.lit(left_weight)
        capped, capped_weight = table.where(over).agg(F.sum("cap"), F.sum("weight")).first()
        now = (budget - (capped or 0), (all_weight or 0) - (capped_weight or 0))
        if now == (left, left_weight) or not now[1]:
            break
        left, left_weight = now
    even = big(F.lit(left)) * F.col("weight")
    target = F.when(even > big(F.col("cap")) * F.lit(left_weight), F.col("cap").cast("double")).otherwise(
        (F.lit(left) * F.col("weight")).cast("double") / F.lit(max(left_weight, 1)).cast("double")
    )
    return table.withColumn("target", target)


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds ``whole`` (copies of every document), ``cut`` (a further copy of draws up to it) and ``extra``.

    In order of draws, documents are taken while they fit into the words that whole
    copies leave open. What then is missing goes to one document more, the ``extra``
    draw: that with the size nearest to the gap, if it makes the gap smaller.
    """
    goals = goals.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn("open", F.col("target") - F.col("whole") * F.col("source_size"))
    some = goals.where("open > 0").select(F.col("source").alias("s"), "open")
    shift = DRAW_BITS - RANGE_BITS
    at = F.shiftright("draw", shift)
    sums = rows.groupBy("source", at.alias("range")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("range"))  # at most 2**RANGE_BITS rows each
    crossing = (
        sums.withColumn("upto", upto)
        .join(some, F.col("source").eqNullSafe(F.col("s")))
        .where("upto - words <= open and open < upto")
        .select("s", "open", "range", (F.col("upto") - F.col("words")).alias("before"))
    )
    inside = (
        rows.withColumn("at", at)
        .join(crossing, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("range")))
        .groupBy("s", "open", "range", "before", "draw")
        .agg(F.sum("size").alias("words"))
    )
    run = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("draw"))
    fits = F.col("upto") <= F.col("open")
    fine = staged(
        inside.withColumn("upto", run)
        .groupBy("s", "open", "range", "before")
        .agg(F.max(F.when(fits, F.col("draw"))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("took"))
        .select(
            "s",
            F.coalesce("last", F.shiftleft(F.col("range").cast("bigint"), shift) - 1).alias("cut"),
            (F.col("open") - F.coalesce("took", "before")).alias("gap"),
        ),
        "mix-cuts",
    )
    off = F.abs(F.col("gap") - F.col("size"))
    extra = (
        rows.join(fine, F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("draw") > F.col("cut")) & (off < F.col("gap")))
        .groupBy("s")
        .agg(F.min(F.struct(off.alias("off"), "draw")).alias("best"))
        .select(F.col("s").alias("x"), F.col("best.draw").alias("extra"))
    )
    fine = fine.join(extra, F.col("s").eqNullSafe(F.col("x")), "left")
    return goals.join(fine, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("goal_source"),
        "source_size",
        "target",
        F.col("whole").cast("bigint").alias("whole"),
        F.coalesce("cut", F.lit(-1).cast("bigint")).alias("cut"),
        F.coalesce("extra", F.lit(-1).cast("bigint")).alias("extra"),
    )


def copies_of(number: Column, whole: Column, cut: Column, extra: Column) -> Column:
    return whole + ((number <= cut) | (number == extra)).cast("bigint")


def mix_counts(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs."""
    rows = staged(sized(docs, seed), "mix-sized")
    plan = staged(cuts(rows, targets(rows, **how)), "mix-plan")
    copies = copies_of(F.col("draw"), F.col("whole"), F.col("cut"), F.col("extra"))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("goal_source"))).select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mix_documents(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mix itself: each row of docs as often as its source's target asks, 0 to max_epochs times.

    A row of no words is kept as often as others of its draw; of a source without any words, never.
    """
    rows = staged(sized(docs, seed), "mix-sized")
    plan = staged(cuts(rows, targets(rows, **how)), "mix-plan").select("goal_source", "whole", "cut", "extra")
    plan = plan.toDF("goal", "whole", "cut", "extra")
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no column has a name of the plan's
    doc_id, source = (inner[f"c{docs.columns.index(c)}"] for c in ("doc_id", "source"))
    copies = copies_of(draw(doc_id, seed), F.col("whole"), F.col("cut"), F.col("extra"))
    return (
        inner.join(plan, source.eqNullSafe(F.col("goal")))
        .where(copies >= 1)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
        .select(*inner.columns)
        .toDF(*docs.columns)
    )
