"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from docloom.llm.store import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links; a component is named by its smallest node.

    Each round rewires edges to the smallest neighbour, so that paths of any length
    shrink in about the logarithm of their length; edges never grow in number. A round
    is written to the shared folder. Links with a null end and loops are left out; an
    empty table gives an empty result.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        near = Window.partitionBy("u")
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = (
            both.withColumn("m", F.least("u", F.min("v").over(near)))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.withColumn("m", F.min("v").over(near))
        # For v = m the second row is a loop, which goes.
        small = least.select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        edges = staged(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """named(node, component) after further links(a, b): only the graph of components is worked on."""
    at = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = staged(ends.select(F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")).distinct(), "ends")
    over = staged(components(ends, "of_a", "of_b"), "components").toDF("component", "top")
    every = named.unionByName(ends.select(F.explode(F.array("of_a", "of_b")).alias("node")).select("node", F.col("node").alias("component"))).distinct()
    return staged(every.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
