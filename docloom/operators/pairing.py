"""Note pairing: label candidates in sequences, gaps filled from their lines, references assigned to labels.

Texts are read by expressions (tokens, cues, scores), candidates meet by joins, and what
depends on order is a fold over the numbers of one document (``chains.by_document``).

Tables. Lines: (doc_id, line, page, zone, column_fit, demoted, text); ``line`` is the place in
reading order. Candidates of labels: (doc_id, line, at, page, value, score, supported, restart);
of references: (doc_id, line, at, page, value, score, form, region, visual, line_order). A null
in a flag is false; rows without a value, line or place are left out; repeated candidates
follow each other nowhere and one of them is taken; documents without candidates give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import legal
from docloom.operators.chains import by_document, numeric_chain

#: Fixed values of the rules.
LARGEST, ROUNDS = 999, 6
LEAST_LENGTH, LEAST_SCORE, STRONG_SCORE, LATEST_START = 4, 2.0, 3.2, 3
TAIL_GAP = 20
ENDNOTE_LABELS, ENDNOTE_FROM, ENDNOTE_SHARE = 8, 0.75, 0.7
BEFORE_FIRST, FILL_SCORE, FILL_CHARS, REKEY_MOST = 9, 1.2, 4, 8
OPTIONS, OPTION_SCORE, TAKEN_GAIN = 6, -1.0, 0.5
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"
LABEL = rf"^(?U)([\s\"'‘’“”.,:;–—-]{{0,3}})(?:([(]\s*([0-9]{{1,3}})\s*[)])|([{RAISED}]{{1,3}})|([0-9]{{1,3}})(?![0-9]))([.)\],]{{0,2}})"
#: Letters and signs that are read for digits, and those digits.
LOOKS, DIGITS = "lIi|!ítoO°ºðDQsSBGbZzgqAT?nJ", "1111111000000055866229947773"
CONFUSED = r"^(?U)(\s*+)([0-9lIi|!íoO°ºDQsSBGbZzgqATnJt?]{1,3}+)(?=\s|[.]|\z)"
ENDS_AT = " .)]"


def value_of(digits: Column) -> Column:
    """Digits, raised ones too, as a label's value from 1 to LARGEST; else null."""
    number = F.translate(digits, RAISED, "0123456789")
    number = F.when(F.regexp_like(number, F.lit("^[0-9]{1,3}$")), number.cast("int"))
    return F.when((number >= 1) & (number <= LARGEST), number).cast("bigint")


def label_tokens(lines: DataFrame) -> DataFrame:
    """lines with the label token that a text begins with: form, at, end_at, value, post; null where there is none."""
    part = lambda k: F.regexp_extract("text", LABEL, k)
    form = F.when(part(2) != "", "paren").when(part(4) != "", "sup").when(part(5) != "", "plain")
    token = F.concat(part(2), part(4), part(5))
    return lines.select("*", form.alias("form"), F.length(part(1)).cast("bigint").alias("at"), token.alias("token"), F.concat(part(3), part(4), part(5)).alias("digits"), part(6).alias("post")).select(
        *lines.columns,
        "form",
        F.when(F.col("form").isNotNull(), F.col("at")).alias("at"),
        F.when(F.col("form").isNotNull(), F.col("at") + F.length("token")).cast("bigint").alias("end_at"),
        value_of(F.col("digits")).alias("value"),
        F.when(F.col("form").isNotNull(), F.col("post")).alias("post"),
    )


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def segments(candidates: DataFrame) -> DataFrame:
    """(doc_id, segment, ordinal, line, at, value, score, chain_score) of up to ROUNDS sequences of each document.

    A backbone is taken out with all candidates of its lines, and the next one looked for in the rest. After the
    first, it must start at LATEST_START or below, overlap no other in lines, have an average score of LEAST_SCORE
    and LEAST_LENGTH members; fewer do from 1 with STRONG_SCORE, one alone only as a supported restart. Segments are
    numbered by where they begin. A last member far above the one before it, weak and unsupported, is then dropped,
    and so on from the end.
    """
    columns = ["line", "at", "page", "value", "score", "supported", "restart"]

    def accepted(held: dict, chain: np.ndarray, spans: list[tuple[int, int]]) -> bool:
        lines, scores = held["line"][chain], held["score"][chain]
        if not spans:
            return True
        if any(lines[0] <= b and a <= lines[-1] for a, b in spans) or scores.mean() < LEAST_SCORE or held["value"][chain[0]] > LATEST_START:
            return False
        strong = held["value"][chain[0]] == 1 and scores.mean() >= STRONG_SCORE
        alone = held["restart"][chain[0]] and held["supported"][chain[0]]
        return len(chain) >= LEAST_LENGTH or bool(strong and (len(chain) > 1 or alone))

    def run(held: dict) -> dict:
        place = (held["line"].astype(np.int64) << 32) + held["at"]
        left, spans, found = np.arange(len(place)), [], []
        for _ in range(ROUNDS):
            rows = zip(place[left].tolist(), held["value"][left].tolist(), held["score"][left].tolist(), held["page"][left].tolist(), held["supported"][left].tolist())
            members, score = numeric_chain(list(rows), rooted=False)
            chain = left[members]
            if not members or not accepted(held, chain, spans):
                break
            spans.append((held["line"][chain[0]], held["line"][chain[-1]]))
            found.append((chain, score))
            left = left[~np.isin(held["line"][left], held["line"][chain])]
        found.sort(key=lambda c: held["line"][c[0][0]])
        every = np.concatenate([c for c, _ in found]) if found else left[:0]
        out = {c: held[c][every].tolist() for c in ("line", "at", "value", "score", "supported")}
        out["segment"] = [k + 1 for k, (c, _) in enumerate(found) for _ in c]
        out["ordinal"] = [k + 1 for c, _ in found for k in range(len(c))]
        out["chain_score"] = [round(s, 3) for c, s in found for _ in c]
        return out

    some = candidates.where("value is not null and line is not null and at is not null")
    some = some.select("doc_id", "line", "at", "page", "value", "score", flag("supported").alias("supported"), flag("restart").alias("restart"))
    schema = "doc_id bigint, segment bigint, ordinal bigint, line bigint, at bigint, value bigint, score double, supported boolean, chain_score double"
    chosen = by_document(some.select("doc_id", *columns), ("line", "at", "value"), run, schema)
    along = Window.partitionBy("doc_id", "segment").orderBy("ordinal")
    weak = (F.col("value") - F.lag("value").over(along) > TAIL_GAP) & (F.col("score") < STRONG_SCORE) & ~F.col("supported")
    to_end = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    kept = chosen.withColumn("weak", F.coalesce(weak, F.lit(False))).withColumn("dropped", F.min("weak").over(to_end))
    return kept.where("not dropped").drop("weak", "dropped", "supported")


def endnotes(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, endnote): whether the labels of the first segment crowd in the last quarter of their pages."""
    first = members.where("segment = 1").join(lines.select("doc_id", "line", "page"), ["doc_id", "line"])
    last = F.max("page").over(Window.partitionBy("doc_id"))
    late = F.avg((F.col("page") > ENDNOTE_FROM * F.col("last")).cast("double")) >= ENDNOTE_SHARE
    return first.withColumn("last", last).groupBy("doc_id").agg(((F.count("*") >= ENDNOTE_LABELS) & (F.max("last") > 1) & late).alias("endnote"))


def gaps(members: DataFrame) -> DataFrame:
    """(doc_id, segment, gap, from_line, to_line, low, high): values that a segment passes over, and the lines they may be in.

    Gap 0 is before a first value of 2 to BEFORE_FIRST; its lines begin with the document.
    """
    along = Window.partitionBy("doc_id", "segment").orderBy("ordinal")
    before = members.withColumn("left", F.lag("value").over(along)).withColumn("left_line", F.lag("line").over(along))
    first = F.col("left").isNull()
    inner = before.where(F.when(first, (F.col("value") >= 2) & (F.col("value") <= BEFORE_FIRST)).otherwise(F.col("value") > F.col("left") + 1))
    return inner.select(
        "doc_id",
        "segment",
        (F.col("ordinal") - 1).alias("gap"),
        F.when(first, 0).otherwise(F.col("left_line") + 1).cast("bigint").alias("from_line"),
        F.col("line").alias("to_line"),
        F.when(first, 1).otherwise(F.col("left") + 1).cast("bigint").alias("low"),
        (F.col("value") - 1).alias("high"),
    )


def windows(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Each gap with the lines inside of it: (…, line or null).

    Gaps between members lie apart, so a line looks back for the one that has begun last; those before a first member
    (one for a segment) meet the lines of their document.
    """
    inner = found.where("gap > 0")
    marks = inner.select("doc_id", F.col("from_line").alias("line"), F.lit(0).alias("is_line"), F.struct("segment", "gap", "from_line", "to_line", "low", "high").alias("one"))
    rows = marks.unionByName(lines.select("doc_id", "line", F.lit(1).alias("is_line")), allowMissingColumns=True)
    last = F.last("one", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line", "is_line"))
    inside = rows.withColumn("one", last).where("is_line = 1 and line < one.to_line").select("doc_id", "line", "one.*")
    outer = found.where("gap = 0").join(lines.select("doc_id", "line"), "doc_id").where("line < to_line").select(*inside.columns)
    held = inside.unionByName(outer)
    return found.join(held.select("doc_id", "segment", "gap", "line"), ["doc_id", "segment", "gap"], "left")


def fill_tokens(lines: DataFrame) -> DataFrame:
    """Lines that may hold a missing label, with what their first token and a confused one read as.

    (doc_id, line, score1, value1, at1, end1, ok1, value2, exact2, at2, end2, score2, ok2, rekey). ``ok`` is that enough text
    follows and the line scores FILL_SCORE; ``rekey`` that besides it doesn't go on with a reference.
    """
    noted = (F.col("zone") == "note") & ~flag("demoted")
    open_zone = flag("column_fit") | F.col("zone").isin("body", "other")
    rows = label_tokens(lines.where(noted | (open_zone & legal.has_cue(F.col("text")))))
    plain = F.col("form").isin("plain", "sup")
    rows = rows.withColumn("lead", F.regexp_extract("text", CONFUSED, 1)).withColumn("odd", F.regexp_extract("text", CONFUSED, 2))
    rows = rows.withColumn("at2", F.length("lead").cast("bigint")).withColumn("end2", (F.col("at2") + F.length("odd")).cast("bigint"))
    other = ~(F.coalesce(plain & F.col("value").isNotNull() & (F.col("at") == F.col("at2")) & (F.col("end_at") == F.col("end2")), F.lit(False)))
    odd = (F.col("odd") != "") & F.regexp_like("odd", F.lit("[0-9]")) & other
    body = lambda end: F.ltrim(F.substr("text", F.col(end) + 1), F.lit(ENDS_AT))
    base = F.when(noted, 3.0).otherwise(0.6) + F.when(flag("column_fit"), 0.7).otherwise(0.0)
    score = lambda b: base + F.when(legal.has_cue(F.col(b)), 0.7).otherwise(0.0)
    rows = rows.withColumn("body1", body("end_at")).withColumn("body2", body("end2")).withColumn("score1", score("body1")).withColumn("score2", score("body2"))
    ok = lambda k: (F.length(f"body{k}") >= FILL_CHARS) & (F.col(f"score{k}") >= FILL_SCORE)
    return rows.select(
        "doc_id",
        "line",
        F.when(plain, F.col("value")).alias("value1"),
        F.col("at").alias("at1"),
        F.col("end_at").alias("end1"),
        "score1",
        F.coalesce(ok(1), F.lit(False)).alias("ok1"),
        F.when(odd, value_of(F.translate("odd", LOOKS, DIGITS))).alias("value2"),
        F.coalesce(odd & value_of(F.col("odd")).isNotNull(), F.lit(False)).alias("exact2"),
        F.when(odd, F.lit(True)).otherwise(False).alias("odd"),
        "at2",
        "end2",
        "score2",
        F.coalesce(ok(2), F.lit(False)).alias("ok2"),
        F.coalesce(ok(1) & ~legal.continues(F.col("body1")), F.lit(False)).alias("rekey"),
        F.coalesce(noted, F.lit(False)).alias("noted"),
    )


#: What becomes of a value, in the numbers that the fold gives.
KINDS = ("no_confusable_glyph_in_window", "weak_form_promoted", "confusable_value_repair", "sequence_position_rekey")


def claim(row: tuple, last: int, high: int) -> tuple[int, int, int] | None:
    """(value, token, kind) that a line's tokens claim of the values after ``last`` up to ``high``."""
    for token, (present, value, exact, ok) in enumerate(row, 1):
        if not present:
            continue
        if not last < value <= high:
            return None
        if ok:
            return value, token, 1 if exact else 2
    return None


def fill_gaps(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, segment, value, line, at, end_at, score, kind): each value that a segment passes over, and the line that fills it.

    In each gap, lines claim values in rising order by their own token, or by one whose letters look like digits. What is
    left between two claims goes to the lines there, if they hold as many labels as values are missing, all of them too small
    to be any of these (labels read wrong). Other values keep a null line and a kind that says why; lines of members, and
    those that have filled a gap, fill none after. A segment that starts above BEFORE_FIRST has one row for all values
    before it, with the last of them.
    """
    free = lines.join(members.select("doc_id", "line").distinct(), ["doc_id", "line"], "left_anti")
    tokens = fill_tokens(free)
    spans = windows(gaps(members), tokens.select("doc_id", "line"))
    rows = spans.join(tokens.select("doc_id", "line", "value1", "ok1", "value2", "exact2", "odd", "ok2", "rekey"), ["doc_id", "line"], "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(-1).cast("bigint")).alias(c)
    rows = rows.select("doc_id", "segment", "gap", "low", "high", number("line"), number("value1"), number("value2"), *(flag(c).alias(c) for c in ("ok1", "exact2", "odd", "ok2", "rekey")))

    def run(held: dict) -> dict:
        names = ("segment", "gap", "low", "high", "line", "value1", "ok1", "odd", "value2", "exact2", "ok2", "rekey")
        used: set[int] = set()
        out: list[tuple] = []
        for (segment, _, low, high), one in groupby(zip(*(held[c].tolist() for c in names)), key=lambda r: r[:4]):
            row = [r[4:] for r in one if r[4] >= 0 and r[4] not in used]
            between: list[list[tuple]] = [[]]  # lines before, between and after claims
            claims = [(low - 1, None)]
            for line, value1, ok1, odd, value2, exact2, ok2, rekey in row:
                made = claim(((value1 > 0, value1, True, ok1), (odd, value2, exact2, ok2)), claims[-1][0], high)
                if made:
                    used.add(line)
                    out.append((segment, made[0], line, made[1], made[2]))
                    claims.append((made[0], line))
                    between.append([])
                else:
                    between[-1].append((line, value1, rekey))
            for held_lines, (before, _), (after, _) in zip(between, claims, [*claims[1:], (high + 1, None)]):
                missing = range(before + 1, after)
                labels = [r for r in held_lines if r[1] > 0]
                fit = [line for line, _, rekey in labels if rekey]
                if missing and len(missing) <= REKEY_MOST and len(fit) == len(missing) and all(v < missing[0] for _, v, _ in labels):
                    used.update(fit)
                    out += [(segment, value, line, 1, 3) for value, line in zip(missing, fit)]
                else:
                    out += [(segment, value, -1, 0, 0) for value in missing]
        return dict(zip(("segment", "value", "line", "token", "kind"), map(list, zip(*out)) if out else ([] for _ in range(5))))

    made = by_document(rows, ("segment", "gap", "line"), run, "doc_id bigint, segment bigint, value bigint, line bigint, token bigint, kind bigint")
    made = made.join(tokens.select("doc_id", "line", "at1", "end1", "score1", "at2", "end2", "score2", "noted"), ["doc_id", "line"], "left")
    pick = lambda c: F.when(F.col("token") == 1, F.col(f"{c}1")).when(F.col("token") == 2, F.col(f"{c}2"))
    filled = made.select(
        "doc_id",
        "segment",
        "value",
        F.when(F.col("line") >= 0, F.col("line")).alias("line"),
        pick("at").alias("at"),
        pick("end").alias("end_at"),
        F.when(F.col("kind") == 3, F.when(F.col("noted"), 3.0).otherwise(0.6)).otherwise(pick("score")).alias("score"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("kind") + 1).cast("int")).alias("kind"),
    )
    above = members.where((F.col("ordinal") == 1) & (F.col("value") > BEFORE_FIRST))
    return filled.unionByName(above.select("doc_id", "segment", (F.col("value") - 1).alias("value"), F.lit("chain_starts_above_one").alias("kind")), allowMissingColumns=True)


def pools(members: DataFrame, lines: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with the ``segment`` whose pages they stand on: up to the last line of its last page, after the segment before; the last takes the rest."""
    ends = members.join(lines.select("doc_id", "line", "page"), ["doc_id", "line"]).groupBy("doc_id", "segment").agg(F.max_by("page", "ordinal").alias("page"))
    ends = ends.withColumn("final", F.col("segment") == F.max("segment").over(Window.partitionBy("doc_id")))
    reach = lines.groupBy("doc_id", "page").agg(F.max("line").alias("upto"))
    upto = reach.withColumn("upto", F.max("upto").over(Window.partitionBy("doc_id").orderBy("page")))
    ends = ends.join(upto, ["doc_id", "page"]).select("doc_id", "segment", F.when(F.col("final"), F.lit(2**62)).otherwise(F.col("upto")).alias("line"), F.lit(1).alias("is_end"))
    rows = refs.withColumn("is_end", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    ahead = Window.partitionBy("doc_id").orderBy("line", "is_end").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("segment", F.first("segment", ignorenulls=True).over(ahead)).where("is_end = 0").drop("is_end")


def ordered_choice(options: list[tuple[int, tuple[int, int], float]]) -> list[int]:
    """The options, one for a value at most, of greatest summed score whose places rise with their values.

    options: (value, place, score) sorted by value, then best first. A choice adds TAKEN_GAIN. Of equal sums that with
    the earliest last place is taken. Sums are kept for the last place so far, each greater than those of earlier
    places; an option goes on from the last sum before its place, so all options take n log n steps and more only to insert.
    """
    places, sums, tails = [(-1, -1)], [0.0], [-1]
    back = [-1] * len(options)
    for _, same in groupby(range(len(options)), key=lambda i: options[i][0]):
        fresh = []
        for i in same:
            k = bisect_left(places, options[i][1]) - 1
            back[i] = tails[k]
            fresh.append((options[i][1], sums[k] + options[i][2] + TAKEN_GAIN, i))
        for place, total, i in sorted(fresh, key=lambda f: (f[0], -f[1])):
            k = bisect_left(places, place)
            if total <= sums[k - 1] + 1e-9 or k < len(places) and places[k] == place and total <= sums[k] + 1e-9:
                continue
            over = k
            while over < len(places) and sums[over] <= total + 1e-9:
                over += 1
            places[k:over], sums[k:over], tails[k:over] = [place], [total], [i]
    best, out = tails[-1], []
    while best >= 0:
        out.append(best)
        best = back[best]
    return out[::-1]


def reference_candidates(labels: DataFrame, refs: DataFrame, endnote: DataFrame) -> DataFrame:
    """refs of segments with the label of their value and ``dropped``, the reason why a candidate doesn't come in question (or null).

    labels(doc_id, segment, value, line, at, page, body); refs(doc_id, segment, value, line, at, page, score, form, region,
    visual, line_order). The gain of nearness to the label's page is in ``option``; null where pages are too far apart.
    """
    spans = labels.select("doc_id", "line", "at", F.lit(True).alias("is_label")).distinct()
    mine = labels.select("doc_id", "segment", "value", F.col("page").alias("label_page"), F.col("body").alias("label_body"))
    mine = mine.withColumn("n_labels", F.count("*").over(Window.partitionBy("doc_id", "segment")))
    rows = refs.join(spans, ["doc_id", "line", "at"], "left").join(mine, ["doc_id", "segment", "value"], "left").join(endnote, "doc_id", "left")
    table = (F.col("form") == "sup") & F.lower("region").contains("table")
    unseen = flag("visual") & ~F.coalesce(table, F.lit(False)) & ~F.regexp_like("label_body", F.lit(legal.VISUAL))
    reason = (
        F.when(F.col("is_label"), "is_selected_label_span").when(F.col("label_page").isNull(), "no_selected_label").when(F.coalesce(unseen, F.lit(False)), "visual_zone_without_visual_label_cue")
    )
    rows = rows.withColumn("dropped", reason)
    pool = Window.partitionBy("doc_id", "segment")
    most = F.max(F.when(F.col("dropped").isNull(), F.col("line"))).over(pool) + 1
    delta = F.col("label_page") - F.col("page")
    near = (
        F.when(flag("endnote"), 0.08 * F.col("line") / most)
        .when(delta == 0, 1.0)
        .when(delta == 1, 0.35)
        .when((delta == -1) & (F.col("line_order") <= 10), -0.2)
        .when(delta < 0, -2.0 - 0.45 * (-delta - 1))
        .otherwise(-0.45 * (delta - 1))
    )
    far = ~flag("endnote") & (F.col("n_labels") >= ENDNOTE_LABELS) & (F.abs(delta) >= 2)
    return rows.withColumn("option", F.when(F.col("dropped").isNull() & ~far, F.col("score") + near))


def assign_references(labels: DataFrame, refs: DataFrame, endnote: DataFrame) -> DataFrame:
    """refs with ``label_page`` and ``outcome``: "chosen" for the reference of a label, else why it isn't.

    Of each label's OPTIONS best candidates one or none is chosen, so that references stand in the order of their labels.
    Candidates of labels that get none are in "window_conflict", the others of a label "not_chosen".
    """
    rows = reference_candidates(labels, refs, endnote)
    best = Window.partitionBy("doc_id", "segment", "value").orderBy(F.desc("option"), "line", "at")
    options = rows.where("option is not null").withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= OPTIONS) & (F.col("option") > OPTION_SCORE))

    def run(held: dict) -> dict:
        names = ("segment", "value", "line", "at", "option")
        chosen = []
        for _, one in groupby(zip(*(held[c].tolist() for c in names)), key=lambda r: r[0]):
            one = list(one)
            chosen += [one[i] for i in ordered_choice([(value, (line, at), option) for _, value, line, at, option in one])]
        return {c: [r[k] for r in chosen] for k, c in enumerate(names)}

    picked = by_document(options.select("doc_id", "segment", "value", "rank", "line", "at", "option"), ("segment", "value", "rank"), run, "doc_id bigint, segment bigint, value bigint, line bigint, at bigint, option double")
    rows = rows.join(picked.select("doc_id", "segment", "value", "line", "at", F.lit(True).alias("chosen")), ["doc_id", "segment", "value", "line", "at"], "left")
    served = F.max(flag("chosen")).over(Window.partitionBy("doc_id", "segment", "value"))
    outcome = F.when(F.col("chosen"), "chosen").when(F.col("dropped").isNotNull(), F.col("dropped")).when(served, "not_chosen").otherwise("window_conflict")
    return rows.select(*refs.columns, "label_page", outcome.alias("outcome"))
