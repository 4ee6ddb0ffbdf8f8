"""The spine of a statute: which numbered lines are its sections.

Lines are read as marks of three families (bare numbers, numbers with a dot or bracket, Markdown
headings). In each family, marks form scopes of rising labels, under each reading of their dots; the longest
scope of a reading wins, then readings and families are held against each other by where they begin and how
many sections they have. Where nothing wins, a lone 1, or 1 and 2, may be the spine.

Marks, the widening of scopes by dotted labels below their members, and the tournament are expressions,
joins and aggregates by document; only the forming of scopes is a fold, over ranks of labels. Each of these
steps is checkpointed (``session.cut``), so that the next one plans from rows.

Documents: (doc_id, text). A null text has no lines; labels count ASCII digits; repeated documents
are one document whose lines come twice, so doc_id should be unique.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.operators.chains import by_document
from docloom.operators.labels import label_key
from docloom.session import cut

#: Fixed values of the rules: families in their order, live scopes, least length of a scope, latest begin of a spine.
FAMILIES = ("bare", "dotterm", "markdown")
LIVE, LEAST, LATEST = 8, 3, 0.7
NUMBER = r"(?>[0-9]{1,8}(?:[.-][0-9]{1,8}){0,3}[A-Z]{0,2})"
MARKS = {
    "bare": rf"^(?s)([ \t]*+)(\*\*)?+({NUMBER})(\*\*)?+()([ \t]*+)(.*)$",
    "dotterm": rf"^(?s)([ \t]*+)(\*\*)?+({NUMBER})(\*\*)?+([.)])([ \t]*+)(.+)$",
    "markdown": rf"^(?s)([ \t]*+)#{{1,6}}+[ \t]++(\*\*)?+({NUMBER})(\*\*)?+([.]?+)([ \t]*+)(.*)$",
}
RANGE_HEADING = r"(?iu)^[ \t]*#{1,6}[ \t]+.*(?:[ \t](?:to|à)|[-–—])[ \t]*$"
STATUS = r"(?iu)^(?:\[\s*)?(?:repealed|revoked|abrog(?:ated|é|ée|és|ées)|renumbered|spent|not (?:yet )?in force|omitted)\b"
HEADING = r"^(?:(?:[\"'“«]\s*)?\p{Lu}|\([0-9]+\))"
FILLED = r"(?U)\S"
#: Readings: the styles that take part, whether dots are decimals, whether a scope starts with ones only.
READINGS = {"component": (("integer", "dot", "dotterm"), False, False), "hyphen": (("hyphen",), False, True), "mixed": (("mixed",), False, True), "fraction": (("dot",), True, False)}


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, share, text, cr, n_chars): lines with their offset, and the part of the text (in UTF-16 units) before it."""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("doc_id")
    units = F.octet_length(F.encode("raw", "UTF-16BE")) / 2 + 1
    rows = rows.select(
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("bigint").alias("start"),
        F.coalesce(F.sum(units).over(before), F.lit(0.0)).alias("units"),
        (F.sum(units).over(every) - 1).alias("all_units"),
        (F.sum(F.length("raw") + 1).over(every) - 1).cast("bigint").alias("n_chars"),
        "raw",
    )
    return rows.select("doc_id", "line", "start", "units", "all_units", "n_chars", F.regexp_replace("raw", r"\r$", "").alias("text"), F.col("raw").endswith("\r").alias("cr"))


def numbers(label: Column) -> Column:
    """The leading numbers of a label's parts."""
    return F.transform(F.regexp_extract_all(label, F.lit(r"(?:^|[.-])([0-9]+)"), F.lit(1)), lambda n: n.cast("bigint"))


def section_marks(lines: DataFrame) -> DataFrame:
    """(doc_id, family, line, start, content_start, label, style, content, inline, early) of every line that may be a section's.

    ``inline``: something follows on the line; ``early``: it stands in the first LATEST of the text.
    """
    seen = F.last(F.when(F.regexp_like("text", F.lit(FILLED)), F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("seen", seen).where(F.regexp_like("text", F.lit(r"^[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*)?[0-9]")))
    found = []
    for family, pattern in MARKS.items():
        part = lambda k, p=pattern: F.regexp_extract("text", p, k)
        one = rows.select("*", *(part(k).alias(name) for k, name in ((1, "lead"), (2, "bold"), (3, "label"), (4, "unbold"), (5, "term"), (6, "space"), (7, "content"))))
        spaced, opens = F.length("space") > 0, F.col("content").startswith("(")
        accepted = {
            "bare": (F.col("content") == "") & ~F.coalesce(F.regexp_like("seen", F.lit(RANGE_HEADING)), F.lit(False))
            | spaced & F.regexp_like("content", F.lit(r"^[\p{IsAlphabetic}0-9(\[*“\"«]"))
            | ~spaced & opens,
            "dotterm": F.regexp_like("content", F.lit(r"^[\p{IsAlphabetic}\p{N}\"'“«(]")) & (spaced | opens),
            "markdown": F.col("label").rlike("[.-]") & ((F.col("content") == "") | spaced),
        }[family]
        one = one.where((F.col("label") != "") & (F.col("bold") == F.col("unbold")) & accepted)
        style = (
            F.when(F.col("term") != "", "dotterm")
            .when(F.col("label").contains(".") & F.col("label").contains("-"), "mixed")
            .when(F.col("label").contains("-"), "hyphen")
            .when(F.col("label").contains("."), "dot")
            .otherwise("integer")
        )
        found.append(
            one.select(
                "doc_id",
                F.lit(FAMILIES.index(family)).alias("family"),
                "line",
                (F.col("start") + F.length("lead")).alias("start"),
                (F.col("start") + F.length("text") - F.length("content")).alias("content_start"),
                "label",
                style.alias("style"),
                "content",
                F.regexp_like("content", F.lit(FILLED)).alias("inline"),
                ((F.col("units") + F.length("lead")) / F.col("all_units") <= LATEST).alias("early"),
            )
        )
    return found[0].unionByName(found[1]).unionByName(found[2])


def rising_scopes(ranks: list[int], sizes: list[int]) -> list[int]:
    """The scope of each label, or -1: of the scopes whose last label has as many parts and is less, that with the greatest last one.

    Over LIVE scopes, the shortest is forgotten; scopes of fewer than LEAST labels don't count.
    """
    live: list[list[int]] = []
    for i, (rank, size) in enumerate(zip(ranks, sizes)):
        fit = [s for s in live if sizes[s[-1]] == size and ranks[s[-1]] < rank]
        if fit:
            max(fit, key=lambda s: ranks[s[-1]]).append(i)
        else:
            live.append([i])
            if len(live) > LIVE:
                live.remove(min(live, key=len))
    out = [-1] * len(ranks)
    for number, scope in enumerate(live):
        for i in scope if len(scope) >= LEAST else ():
            out[i] = number
    return out


SCOPE = ("doc_id", "variant", "family", "reading", "scope")


def scopes(marks: DataFrame, allow_hyphen: bool) -> DataFrame:
    """marks in scopes, by variant, family and reading: (doc_id, variant, family, reading, scope, and the mark's columns)."""
    whole = Window.partitionBy("doc_id", "variant", "family")
    enough = marks.withColumn("n", F.count("*").over(whole)).where(F.col("n") >= LEAST).drop("n")
    parts = []
    for number, (styles, fraction, _) in enumerate(READINGS.values()):
        if allow_hyphen or styles[0] not in ("hyphen", "mixed"):
            key = label_key(F.col("label"), fraction)
            one = enough.where(F.col("style").isin(*styles)).withColumn("key", key).withColumn("size", F.size("key").cast("bigint"))
            rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("key")).cast("bigint")
            parts.append(one.select("doc_id", "variant", "family", F.lit(number).alias("reading"), "start", "size", rank.alias("rank")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    names = ("variant", "family", "reading", "start", "size", "rank")

    def run(held: dict) -> dict:
        out: list[tuple] = []
        for group, same in groupby(zip(*(held[c].tolist() for c in names)), key=lambda r: r[:3]):
            same = list(same)
            found = rising_scopes([r[5] for r in same], [r[4] for r in same])
            out += [(*group, r[3], s) for r, s in zip(same, found) if s >= 0]
        return dict(zip((*names[:4], "scope"), map(list, zip(*out)) if out else ([] for _ in range(5))))

    made = by_document(rows, ("variant", "family", "reading", "start"), run, "doc_id bigint, variant int, family int, reading int, start bigint, scope bigint")
    rows = made.join(marks, ["doc_id", "variant", "family", "start"])
    rows = rows.withColumn("first", F.min_by("label", "start").over(Window.partitionBy(*SCOPE)))
    free = ~F.col("reading").isin(*[k for k, r in enumerate(READINGS.values()) if r[2]])
    return rows.where(free | F.forall(numbers(F.col("first")), lambda n: n == 1)).drop("first")


def widened(members: DataFrame, marks: DataFrame, wide: Column, families: tuple[str, ...] = ("family",)) -> DataFrame:
    """Scopes with the dotted labels below their members, where the scope's first label is one number and ``wide`` holds.

    Between a member and the next, those that begin with its number and stand there once. marks meet the scopes of
    their ``families``, eight of a reading at most.
    """
    whole = Window.partitionBy(*SCOPE)
    rows = members.withColumn("first", F.min_by(F.struct("label", "style", "start"), "start").over(whole))
    rows = rows.withColumn("opens", wide & (F.size(numbers(F.col("first.label"))) == 1))
    heads = rows.where("opens").groupBy(*SCOPE).agg(F.first("first.start").alias("from_start"))
    dotted = marks.where(F.col("style").isin("dot", "dotterm") & F.col("label").contains("."))
    below = dotted.join(heads if "family" in families else heads.withColumnRenamed("family", "own"), ["doc_id", "variant", *families]).where("start > from_start")
    if "family" not in families:
        below = below.withColumn("family", F.col("own"))
    columns = [*SCOPE, "start", "content_start", "label", "style", "inline", "early"]
    both = rows.where("opens").select(*columns, F.lit(True).alias("member")).unionByName(below.select(*columns, F.lit(False).alias("member")))
    along = Window.partitionBy(*SCOPE).orderBy("start", F.desc("member"))
    parent = F.last(F.when(F.col("member"), F.struct("start", "label")), ignorenulls=True).over(along)
    below = both.withColumn("parent", parent).where("not member and start > parent.start").where(F.get(numbers(F.col("label")), 0) == F.get(numbers(F.col("parent.label")), 0))
    once = F.count("*").over(Window.partitionBy(*SCOPE, "parent.start", "label")) == 1
    return members.select(*columns).unionByName(below.withColumn("once", once).where("once").select(*columns))


def winners(found: DataFrame) -> DataFrame:
    """The scopes that win the tournament: (doc_id, variant, family, reading, scope); variants without a row of any scope are absent, those in conflict have a null family."""
    order = F.array_sort(F.collect_list(F.struct("start", "label")))
    one = found.groupBy(*SCOPE).agg(F.min_by("early", "start").alias("early"), F.min("start").alias("begin"), F.count("*").alias("n"), F.md5(F.to_json(order["label"])).alias("labels")).where("early")
    fraction = list(READINGS).index("fraction")
    side = (F.col("reading") == fraction).cast("int")
    best = Window.partitionBy("doc_id", "variant", "family", "side").orderBy(F.desc("n"), "begin", "reading", "scope")
    alike = Window.partitionBy("doc_id", "variant", "family", "side", "n", "begin")
    one = one.withColumn("side", side).withColumn("place", F.row_number().over(best)).withColumn("clear", F.min("labels").over(alike) == F.max("labels").over(alike))
    one = one.where("place = 1 and clear")
    entry = F.struct("begin", "side", "n", "labels", "family", "reading", "scope")

    def choose(left: Column, right: Column) -> Column:
        """Of two scopes that with equal labels the left one, else the earlier, else the longer; null if neither."""
        return (
            F.when(left["labels"] == right["labels"], left)
            .when(left["begin"] != right["begin"], F.when(left["begin"] < right["begin"], left).otherwise(right))
            .when(left["n"] != right["n"], F.when(left["n"] > right["n"], left).otherwise(right))
        )

    pair = one.groupBy("doc_id", "variant", "family").agg(F.array_sort(F.collect_list(F.struct("side", entry.alias("e"))))["e"].alias("es"))
    kept = pair.withColumn("e", F.when(F.size("es") == 1, F.get("es", 0)).otherwise(choose(F.get("es", 0), F.get("es", 1)))).where("e is not null")
    first = kept.withColumn("least", F.min("e.begin").over(Window.partitionBy("doc_id", "variant"))).where("e.begin = least")
    row = first.groupBy("doc_id", "variant").agg(F.array_sort(F.collect_list(F.struct("family", "e")))["e"].alias("es"))
    step = lambda k, so_far: F.when(F.size("es") <= k, so_far).otherwise(choose(so_far, F.get("es", k)))
    two = row.withColumn("e", F.get("es", 0)).withColumn("e", step(1, F.col("e")))
    final = two.withColumn("e", F.when(F.col("e").isNotNull(), step(2, F.col("e"))))
    return final.select("doc_id", "variant", "e.family", "e.reading", "e.scope")


def short_roots(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, start, content_start, label, style, family, inline) of documents whose only sections are 1, or 1 and 2.

    A mark with nothing on its line needs a heading, a bracketed number or a note of repeal on the next line; one mark without ends it.
    """
    plain = lines.withColumn("value", F.regexp_extract("text", r"^[ \t]*([12])[ \t]*$", 1)).where("value <> ''")
    lead = F.length(F.regexp_extract("text", r"^([ \t]*)", 1))
    bare = plain.select(
        "doc_id",
        F.lit(0).alias("family"),
        "line",
        (F.col("start") + lead).alias("start"),
        (F.col("start") + F.length("text")).alias("content_start"),
        F.col("value").alias("label"),
        F.lit("integer").alias("style"),
        F.lit("").alias("content"),
        F.lit(False).alias("inline"),
        ((F.col("units") + lead) / F.col("all_units") <= LATEST).alias("early"),
        F.lit(len(FAMILIES)).alias("turn"),
    )
    some = marks.where(F.col("label").isin("1", "2")).withColumn("turn", F.col("family")).unionByName(bare)
    ahead = Window.partitionBy("doc_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    after = F.first(F.when(F.regexp_like("text", F.lit(FILLED)), F.struct("start", "text")), ignorenulls=True).over(ahead)
    next_line = lines.select("doc_id", "line", "cr", after.alias("after"))
    some = some.join(next_line, ["doc_id", "line"])
    body = F.regexp_replace(F.col("after.text"), r"^(?U)\s+", "")
    fits = F.regexp_like(body, F.lit(HEADING)) | F.regexp_like(body, F.lit(r"^\(\p{N}")) | F.regexp_like(body, F.lit(STATUS))
    bottom = (F.col("content") == "") & ~F.col("cr")
    some = some.withColumn("invalid", bottom & ~F.coalesce(fits, F.lit(False)))
    moved = F.col("after.start") + F.length(F.regexp_extract(F.col("after.text"), r"^([ \t]*)", 1))
    some = some.withColumn("content_start", F.when(bottom, moved).otherwise(F.col("content_start")))
    whole = Window.partitionBy("doc_id")
    some = some.withColumn("void", F.max("invalid").over(whole)).where("not void")
    some = some.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "start", "label").orderBy("turn"))).where("copy = 1")
    count = lambda label: F.count(F.when(F.col("label") == label, 1)).over(whole)
    begin = lambda label: F.min(F.when(F.col("label") == label, F.col("start"))).over(whole)
    some = some.withColumn("ones", count("1")).withColumn("twos", count("2")).withColumn("one_at", begin("1")).withColumn("two_at", begin("2"))
    some = some.withColumn("in_time", F.max((F.col("label") == "1") & F.col("early")).over(whole))
    return some.where("ones = 1 and twos <= 1 and (two_at is null or two_at > one_at) and in_time").select("doc_id", "start", "content_start", "label", "style", "family", "inline")


def statute_spine(docs: DataFrame, allow_hyphen: bool = False) -> DataFrame:
    """(doc_id, start, content_start, label, style) of the sections of each document.

    If no section has anything on its own line, the spine of the marks that have is taken in its place.
    """
    lines = text_lines(docs)
    plain = cut(section_marks(lines))
    marks = plain.withColumn("variant", F.lit(0)).unionByName(plain.where("inline").withColumn("variant", F.lit(1)))
    members = cut(scopes(marks, allow_hyphen))
    first_style = F.min_by("style", "start").over(Window.partitionBy(*SCOPE))
    wide = cut(widened(members.withColumn("first_style", first_style), marks, F.col("first_style") != "dotterm"))
    won = cut(winners(wide))
    chosen = wide.join(won, list(SCOPE))
    dotted = FAMILIES.index("dotterm")
    narrow = chosen.where(F.col("family") != dotted)
    broad = widened(chosen.where(F.col("family") == dotted), marks.where(F.col("family") <= dotted), F.lit(True), families=())
    columns = ["doc_id", "variant", "start", "content_start", "label", "style", "family", "inline"]
    short = short_roots(plain, lines)
    spines = narrow.select(*columns).unionByName(broad.select(*columns))
    for variant in (0, 1):
        spines = spines.unionByName(short.join(won.where(F.col("variant") == variant).select("doc_id"), "doc_id", "left_anti").withColumn("variant", F.lit(variant)).select(*columns))
    any_inline = F.max(F.when(F.col("variant") == 0, F.col("inline"))).over(Window.partitionBy("doc_id"))
    return spines.withColumn("any_inline", any_inline).where((F.col("variant") == 0) & F.col("any_inline") | (F.col("variant") == 1) & ~F.col("any_inline")).select(*[c for c in columns if c not in ("variant", "inline", "family")])
