"""Orders of labels against a plain comparison, and orders of section maps."""

import random
import re
from functools import cmp_to_key

from pyspark.sql import functions as F

from docloom.operators import labels


def parts(label):
    out, separator = [], ""
    for body, after in re.findall(r"([^.-]*)([.-]|$)", label):
        if body:
            digits = re.match(r"([0-9]+)([A-Za-z]*)$", body)
            out.append((separator, digits and digits[1], sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(digits[2].upper()))) if digits else 0, body.upper()))
        separator = after
    return out


def compare(a, b, fraction):
    sign = lambda x, y: (x > y) - (x < y)
    left, right = parts(a), parts(b)
    for k in range(max(len(left), len(right))):
        if k >= min(len(left), len(right)):
            return sign(len(left), len(right))
        (s, d, x, t), (s2, d2, x2, t2) = left[k], right[k]
        if s != s2:
            return sign({"": 0, "-": 45, ".": 46}[s], {"": 0, "-": 45, ".": 46}[s2])
        if d and d2:
            width = max(len(d), len(d2))
            one = sign(d.ljust(width, "0"), d2.ljust(width, "0")) if fraction and s == "." else sign(int(d), int(d2))
            one = one or sign(len(d), len(d2)) or sign(x, x2)
        else:
            one = -1 if d else 1 if d2 else sign(t, t2)
        if one:
            return one
    return 0


LABELS = ["1", "2", "10", "1.1", "1.10", "1.9", "1.2", "01", "1.05", "1.5", "1.50", "1A", "1AA", "1Z", "1a", "1-1", "1-2", "1.1-2", "A.1", "A.10", "a.1", "B-2", "1..2", ".1", "1.", "A", "1.A", "1.A1", "1b.2", "99999999.1", "-"]


def test_keys_order_as_the_comparison(spark):
    frame = spark.createDataFrame([(x,) for x in LABELS], "label string")
    for fraction in (False, True):
        keyed = frame.withColumn("key", labels.label_key(F.col("label"), fraction))
        pairs = keyed.alias("a").join(keyed.alias("b")).select("a.label", F.col("b.label").alias("other"), (F.when(F.col("a.key") > F.col("b.key"), 1).when(F.col("a.key") < F.col("b.key"), -1).otherwise(0)).alias("sign"))
        wrong = [(r.label, r.other, r.sign) for r in pairs.collect() if r.sign != compare(r.label, r.other, fraction)]
        assert not wrong


def mode_of(some):
    some = [x for x in some if "." in x and "-" not in x]
    pairs = list(zip(some, some[1:]))
    c, f = (sum(compare(a, b, way) > 0 for a, b in pairs) for way in (False, True))
    if c != f:
        return c, f, f < c
    return c, f, None if any(compare(a, b, False) != compare(a, b, True) for a, b in pairs) else False


def plain_order(entries):
    """entries: labels in map order."""
    whole = lambda x: re.fullmatch("0|[1-9][0-9]*", x) and int(x) < 2**32 - 1
    mapped = sorted(range(len(entries)), key=lambda k: (not whole(entries[k]), int(entries[k]) if whole(entries[k]) else 0, k))
    fraction = mode_of([entries[k] for k in mapped])[2]
    group = lambda x: 0 if x.strip().lower() in labels.PREAMBLE else 1 if re.match(labels.PROVISION, x.strip()) else 2

    def by(a, b):
        x, y = entries[a].strip(), entries[b].strip()
        if group(x) != group(y) or group(x) != 1:
            return group(x) - group(y)
        if fraction is not None:
            return compare(x, y, fraction)
        c, f = compare(x, y, False), compare(x, y, True)
        return c if c == f else a - b

    return [entries[k] for k in sorted(mapped, key=cmp_to_key(by))]


def test_section_maps(spark):
    draw, cases = random.Random(8), []
    pool = ["Preamble", " préambule ", "Schedule 1", "Form 2", "1", "2", "3", "10", "1.1", "1.2", "1.9", "1.10", "1.11", "1.15", "2.5", "2.50", "4A", "4B", "7-1", "x", "", "4294967295", "007"]
    for _ in range(60):
        cases.append(draw.sample(pool, draw.randint(1, 9)))
    cases.append(["4.2", "1", "2", "5", "4", "4.1", "Schedule 2", "Schedule 1"])
    frame = spark.createDataFrame([(d, k, x) for d, one in enumerate(cases) for k, x in enumerate(one)], "doc_id bigint, index bigint, label string")
    turns = {r["doc_id"]: (r["component_turns"], r["fraction_turns"], r["fraction"]) for r in labels.dotted_order(frame.withColumn("place", F.col("index"))).collect()}
    assert turns == {d: mode_of(one) for d, one in enumerate(cases)}
    assert {t[2] for t in turns.values()} == {True, False, None}
    got: dict[int, list] = {}
    for r in labels.ordered_sections(frame.repartition(3)).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append(r["label"])
    decided = [d for d in turns if turns[d][2] is not None]
    assert {d: got[d] for d in decided} == {d: plain_order(cases[d]) for d in decided}
    undecided = [d for d in turns if turns[d][2] is None]
    assert all(sorted(got[d]) == sorted(cases[d]) for d in undecided)
    agree = sum(got[d] == plain_order(cases[d]) for d in undecided)
    assert agree == len(undecided)
    assert got[len(cases) - 1] == ["1", "2", "4", "4.1", "4.2", "5", "Schedule 2", "Schedule 1"]


def test_nulls_and_no_rows(spark):
    shape = "doc_id bigint, index bigint, label string"
    assert labels.ordered_sections(spark.createDataFrame([], shape)).count() == 0
    rows = labels.ordered_sections(spark.createDataFrame([(1, 0, None), (1, 1, "2"), (1, 2, "2"), (1, 3, "1")], shape)).orderBy("place").collect()
    assert [(r["label"], r["index"]) for r in rows] == [("1", 3), ("2", 1), ("2", 2), (None, 0)]
