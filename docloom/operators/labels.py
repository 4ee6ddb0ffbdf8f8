"""Order of provision labels such as 4, 4.1, 12A, 7-3 or A.2, as sort keys.

A label is cut at dots and hyphens. Its parts become structs whose order is that of the labels, so that
Spark sorts and compares them without a function of its own. After a dot, digits count as a number
("component", 1.9 before 1.10) or as decimals ("fraction", 1.10 before 1.9).

A null label has a null key. Empty parts are passed over, the separator after them counts. Equal keys
are equal labels but for the case of letters.
"""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.operators.chains import by_document

#: What a provision's label looks like, and what the part before the first is called.
PROVISION = r"^(?:\d{1,8}[A-Za-z]{0,3}(?:[.-]\d{1,8}[A-Za-z]{0,3}){0,3}|[A-Za-z]{1,3}(?:[.-][0-9A-Za-z]{1,8}){1,3})$"
PREAMBLE = ("preamble", "préambule")


def label_key(label: Column, fraction: bool) -> Column:
    """The sort key of a label: one struct a part.

    Of a part: its separator, whether it is no number, the number (its length and digits, or its decimals), the length
    of the digits as written, the letters after them (fewer first), or the text if it is no number.
    """
    pieces = F.regexp_extract_all(label, F.lit(r"([^.-]*)([.-]|$)"), F.lit(0))

    def part(piece: Column, at: Column) -> Column:
        body = F.regexp_replace(piece, "[.-]$", "")
        before = F.when(at > 0, F.regexp_extract(F.get(pieces, at - 1), "([.-])$", 1)).otherwise("")
        digits = F.when(F.regexp_like(body, F.lit("^[0-9]+[A-Za-z]*$")), F.regexp_extract(body, "^([0-9]+)", 1))
        number = F.regexp_replace(digits, "^0+", "")
        decimals = F.lit(fraction) & (before == ".")
        suffix = F.upper(F.regexp_extract(body, "^[0-9]+([A-Za-z]*)$", 1))
        none = F.lit("")
        return F.struct(
            body.alias("body"),
            F.struct(
                F.when(before == ".", 2).when(before == "-", 1).otherwise(0).alias("separator"),
                digits.isNull().alias("is_text"),
                F.when(digits.isNull() | decimals, 0).otherwise(F.length(number)).alias("length"),
                F.coalesce(F.when(decimals, F.regexp_replace(digits, "0+$", "")).otherwise(number), none).alias("number"),
                F.coalesce(F.length(digits), F.lit(0)).alias("written"),
                F.when(digits.isNull(), 0).otherwise(F.length(suffix)).alias("letters"),
                F.when(digits.isNull(), none).otherwise(suffix).alias("suffix"),
                F.when(digits.isNull(), F.upper(body)).otherwise(none).alias("text"),
            ).alias("key"),
        )

    return F.transform(F.filter(F.transform(pieces, part), lambda p: p["body"] != ""), lambda p: p["key"])


def map_order(entries: DataFrame) -> DataFrame:
    """entries(doc_id, index, label) with ``place``, the order of a JSON object's keys: whole numbers first, by value, then as given."""
    number = F.when(F.regexp_like("label", F.lit("^(0|[1-9][0-9]{0,9})$")), F.col("label").cast("bigint"))
    number = F.when(number < 2**32 - 1, number)
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(number.isNull(), number, "index")).cast("bigint"))


def dotted_order(entries: DataFrame) -> DataFrame:
    """(doc_id, component_turns, fraction_turns, fraction): how the dotted labels of each document count after a dot.

    By the reading under which fewer neighbours are out of order; of equal ones as numbers if every two neighbours
    stand alike under both, else null. entries(doc_id, place, label), whole documents; those without dotted labels count as numbers.
    """
    dotted = F.col("label").contains(".") & ~F.col("label").contains("-")
    rows = entries.select("doc_id", "place", F.when(dotted, F.struct(label_key(F.col("label"), False).alias("c"), label_key(F.col("label"), True).alias("f"))).alias("key"))
    before = F.lag("key").over(Window.partitionBy("doc_id").orderBy("place"))
    rows = rows.where("key is not null").withColumn("before", before)
    sign = lambda k: F.when(F.col(f"before.{k}") > F.col(f"key.{k}"), 1).when(F.col(f"before.{k}") < F.col(f"key.{k}"), -1).otherwise(0)
    pairs = rows.where("before is not null").select("doc_id", sign("c").alias("c"), sign("f").alias("f"))
    turns = pairs.groupBy("doc_id").agg(F.count(F.when(F.col("c") > 0, 1)).alias("component_turns"), F.count(F.when(F.col("f") > 0, 1)).alias("fraction_turns"), F.max(F.col("c") != F.col("f")).alias("differ"))
    every = entries.select("doc_id").distinct().join(turns, "doc_id", "left").na.fill(0, ["component_turns", "fraction_turns"])
    decided = F.col("component_turns") != F.col("fraction_turns")
    fraction = F.when(decided, F.col("fraction_turns") < F.col("component_turns")).when(~F.coalesce("differ", F.lit(False)), F.lit(False))
    return every.select("doc_id", "component_turns", "fraction_turns", fraction.alias("fraction"))


def ordered_sections(entries: DataFrame) -> DataFrame:
    """(doc_id, label, place): the entries of each document's section map in the order of the law.

    The preamble comes first, then provisions by their labels, then what has no provision's label, in map order. Where
    the order of dotted labels is undecided, two provisions stand by label if both readings agree, else in map order.
    entries(doc_id, index, label): labels trimmed for the order; null labels come last; repeated labels keep map order.
    """
    mapped = map_order(entries)
    mode = dotted_order(mapped.select("doc_id", "place", "label"))
    trimmed = F.trim("label")
    rows = mapped.join(mode, "doc_id").withColumn("open", F.col("fraction").isNull())
    rows = rows.withColumn("rest", ~F.coalesce(F.regexp_like(trimmed, F.lit(PROVISION)), F.lit(False)))
    rows = rows.withColumn("group", F.when(F.lower(trimmed).isin(*PREAMBLE), 0).when(F.col("rest"), 2).otherwise(1))
    whole = Window.partitionBy("doc_id", "group")
    rank = lambda fraction: F.when(F.col("group") == 1, F.dense_rank().over(whole.orderBy(label_key(trimmed, fraction)))).otherwise(0).cast("bigint")
    rows = rows.select("doc_id", F.col("group").cast("bigint").alias("group"), "place", "index", "label", "open", F.coalesce("fraction", F.lit(False)).alias("fraction"), rank(False).alias("component"), rank(True).alias("decimal"))

    def run(held: dict) -> dict:
        place, group, component, decimal, index = (held[c].tolist() for c in ("place", "group", "component", "decimal", "index"))

        def compare(a: int, b: int) -> int:
            by_component, by_decimal = ((r[a] > r[b]) - (r[a] < r[b]) for r in (component, decimal))
            return group[a] - group[b] or (by_component if by_component == by_decimal else index[a] - index[b])

        order = range(len(place))
        if held["open"].any():
            order = sorted(order, key=cmp_to_key(compare))
        else:
            by = decimal if held["fraction"].any() else component
            order = sorted(order, key=lambda k: (group[k], by[k], place[k]))
        return {"map_place": [place[k] for k in order], "place": list(range(1, len(place) + 1))}

    done = by_document(rows.drop("label"), ("place",), run, "doc_id bigint, map_place bigint, place bigint")
    return done.join(mapped.select("doc_id", F.col("place").alias("map_place"), "index", "label"), ["doc_id", "map_place"]).select("doc_id", "index", "label", "place")
