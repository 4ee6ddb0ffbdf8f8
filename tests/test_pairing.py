"""Note pairing against plain loops over all possibilities on small cases."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import chains, pairing

LINES = "doc_id bigint, line bigint, page bigint, zone string, column_fit boolean, demoted boolean, text string"
LABELS = "doc_id bigint, line bigint, at bigint, page bigint, value bigint, score double, supported boolean, restart boolean"
MEMBERS = "doc_id bigint, segment bigint, ordinal bigint, line bigint, at bigint, value bigint, score double, chain_score double"


def test_label_tokens(spark):
    cases = {
        "12 Smith": ("plain", 0, 2, 12), "(7) Smith": ("paren", 0, 3, 7), "⁴ Smith": ("sup", 0, 1, 4), "2endnote 2This is the note": ("plain", 0, 1, 2), "( 12 ) x": ("paren", 0, 6, 12),
        "“1. x": ("plain", 1, 2, 1), "1234 x": (None, None, None, None), "    5 x": (None, None, None, None), "  ¹²x": ("sup", 2, 4, 12), "000 x": ("plain", 0, 3, None), "(1234) x": (None, None, None, None), "": (None, None, None, None),
    }
    frame = spark.createDataFrame([(k, 0, 1, "note", False, False, t) for k, t in enumerate([*cases, None])], LINES)
    got = {r["doc_id"]: (r["form"], r["at"], r["end_at"], r["value"]) for r in pairing.label_tokens(frame).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and got[len(cases)] == (None,) * 4


def every_backbone(rows):
    """The best chain of (place, value, score, page, supported) by trying all; scores make it the only one."""
    best = (float("-inf"), ())
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
    for n in range(1, len(rows) + 1):
        for chain in itertools.combinations(order, n):
            steps = list(zip(chain, chain[1:]))
            if any(not (rows[a][0] < rows[b][0] and 0 < rows[b][1] - rows[a][1] <= 201) for a, b in steps):
                continue
            first = rows[chain[0]]
            total = sum(rows[i][2] for i in chain) + (0 if first[4] else max(-4, -0.25 * (first[1] - 1)))
            for a, b in steps:
                gap = rows[b][1] - rows[a][1] - 1
                total += max(-4, (-0.4 if rows[a][3] == rows[b][3] else -0.12) * gap) + (0.3 if not gap else 0)
            if total > best[0]:
                best = (total, chain)
    return list(best[1]), best[0]


def plain_segments(rows):
    """rows: (line, at, page, value, score, supported, restart)."""
    left, out = list(range(len(rows))), []
    for _ in range(6):
        chain, _ = every_backbone([(rows[i][:2], rows[i][3], rows[i][4], rows[i][2], rows[i][5]) for i in left])
        chain = [left[k] for k in chain]
        if not chain:
            break
        if out:
            average = sum(rows[i][4] for i in chain) / len(chain)
            first, span = rows[chain[0]], (rows[chain[0]][0], rows[chain[-1]][0])
            overlap = any(not (span[1] < rows[c[0]][0] or rows[c[-1]][0] < span[0]) for c in out)
            strong = first[3] == 1 and average >= 3.2 and (len(chain) >= 2 or first[6] and first[5])
            if len(chain) < 4 and not strong or average < 2.0 or first[3] > 3 or overlap:
                break
        out.append(chain)
        lines = {rows[i][0] for i in chain}
        left = [i for i in left if rows[i][0] not in lines]
    out.sort(key=lambda c: rows[c[0]][0])
    for c in out:
        while len(c) > 1 and rows[c[-1]][3] - rows[c[-2]][3] > 20 and rows[c[-1]][4] < 3.2 and not rows[c[-1]][5]:
            c.pop()
    return {(k + 1, n + 1, *rows[i][:2], rows[i][3]) for k, c in enumerate(out) for n, i in enumerate(c)}


def test_segments_equal_all_chains(spark):
    draw, cases = random.Random(3), []
    for case in range(60):
        rows, value = [], 0
        for line in range(draw.randint(1, 10)):
            value = 1 if draw.random() < 0.25 else value + draw.choice([1, 1, 1, 2, 25])
            for at in range(draw.choice([1, 1, 1, 2])):
                rows.append((line * 2, at, line // 4 + 1, value + at, draw.choice([1.0, 3.0, 4.0]) + draw.random() / 10, draw.random() < 0.3, draw.random() < 0.5))
        cases.append(rows)
    frame = spark.createDataFrame([(k, r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for k, rows in enumerate(cases) for r in rows] + [(0, 1, 0, 1, None, 9.0, True, True), (99, None, 0, 1, 1, 9.0, None, None)], LABELS)
    got: dict[int, set] = {}
    for r in pairing.segments(frame).collect():
        got.setdefault(r["doc_id"], set()).add((r["segment"], r["ordinal"], r["line"], r["at"], r["value"]))
    assert got == {k: plain_segments(rows) for k, rows in enumerate(cases)}
    assert max(s for g in got.values() for s, *_ in g) >= 2


def test_equal_backbones_end_early_and_high():
    assert chains.numeric_chain([(0, 1, 5.0, 1, False), (0, 2, 5.0, 1, True)], rooted=False)[0] == [1]
    assert chains.numeric_chain([(0, 1, 5.0, 1, True), (1, 205, 5.0, 1, True)], rooted=False)[0] == [0]
    assert chains.numeric_chain([(0, 9, 5.0, 1, True), (1, 2, 5.0, 1, True)], rooted=False)[0] == [0]


def test_endnotes(spark):
    lines = spark.createDataFrame([(d, k, 10 if d == 1 or k > 7 else 1, "note", False, False, "") for d in (1, 2) for k in range(9)] + [(3, 0, 4, "note", False, False, "")], LINES)
    members = spark.createDataFrame([(d, 1, k + 1, k, 0, k + 1, 3.0, 1.0) for d in (1, 2) for k in range(9)] + [(3, 1, 1, 0, 0, 1, 3.0, 1.0)], MEMBERS)
    assert {r["doc_id"]: r["endnote"] for r in pairing.endnotes(members, lines).collect()} == {1: True, 2: False, 3: False}


CUES = re.compile(r"\bsupra\b|\bat\b|\bA\.C\b")
LOOKS = dict(zip(pairing.LOOKS, pairing.DIGITS)) | {str(k): str(k) for k in range(10)}


def plain_fills(segments, lines):
    """segments: lists of (line, value); lines: (zone, demoted, text) by number."""
    used = {line for s in segments for line, _ in s}
    out = set()

    def label(text):
        m = re.match(r"([\s.,:;]{0,3})(\d{1,3})(?!\d)", text)
        return (int(m[2]), len(m[1]), m.end()) if m and int(m[2]) else None

    def score(k, body):
        return (3.0 if lines[k][0] == "note" and not lines[k][1] else 0.6) + (0.7 if CUES.search(body) else 0)

    for number, members in enumerate(segments, 1):
        spans = []
        if 2 <= members[0][1] <= 9:
            spans.append((0, members[0][0], 1, members[0][1] - 1))
        elif members[0][1] > 9:
            out.add((number, members[0][1] - 1, None, None, None, "chain_starts_above_one"))
        spans += [(a + 1, b, v + 1, w - 1) for (a, v), (b, w) in zip(members, members[1:]) if w > v + 1]
        for start, end, low, high in spans:
            window = [k for k in range(start, end) if k not in used and (lines[k][0] == "note" and not lines[k][1] or lines[k][0] in ("body", "other") and CUES.search(lines[k][2]))]
            claims, last = [], low - 1
            for k in window:
                tokens, text = [], lines[k][2]
                if found := label(text):
                    tokens.append((str(found[0]), found[1], found[2]))
                m = re.match(r"(\s*)([0-9lIi|!íoO°ºDQsSBGbZzgqATnJt?]{1,3})", text)
                if m and (m.end() == len(text) or text[m.end()] in " .") and any(c.isdigit() for c in m[2]) and (not found or m.span(2) != found[1:]):
                    tokens.append((m[2], m.start(2), m.end()))
                for observed, at, stop in tokens:
                    value = int("".join(LOOKS[c] for c in observed))
                    if not last < value <= high or not 1 <= value <= 999:
                        break
                    body = text[stop:].lstrip(" .)]")
                    if len(body) >= 4 and score(k, body) >= 1.2:
                        out.add((number, value, k, at, stop, "weak_form_promoted" if observed.isdigit() else "confusable_value_repair"))
                        claims.append((k, value))
                        used.add(k)
                        last = value
                        break
            edges = [(-1, low - 1), *claims, (10**9, high + 1)]
            for (a, v), (b, w) in zip(edges, edges[1:]):
                missing = list(range(v + 1, w))
                found = [(k, label(lines[k][2])) for k in window if a < k < b and k not in used and label(lines[k][2])]
                fit = [(k, f) for k, f in found if len(body := lines[k][2][f[2] :].lstrip(" .)]")) >= 4 and score(k, body) >= 1.2 and not body.startswith("A.C. ")]
                if missing and len(missing) <= 8 and len(fit) == len(missing) and all(f[0] < missing[0] for _, f in found):
                    for value, (k, f) in zip(missing, fit):
                        out.add((number, value, k, f[1], f[2], "sequence_position_rekey"))
                        used.add(k)
                else:
                    out |= {(number, value, None, None, None, "no_confusable_glyph_in_window") for value in missing}
    return out


def test_gap_fills_equal_plain_loops(spark):
    draw, docs = random.Random(9), []
    for _ in range(200):
        n = draw.randint(6, 26)
        lines = []
        for k in range(n):
            value = draw.randint(1, n + 2)
            token = draw.choice([str(value), str(value), str(value).replace("1", "l"), "", "l", " " + str(value), ".", f"{value}O", f"l{draw.randint(2, 9)}", f"I{draw.randint(2, 9)}"])
            lines.append((draw.choice(["note", "note", "note", "body", "header"]), draw.random() < 0.1, token + draw.choice([" words here", " x", " see supra there", ". tail of it", " A.C. 123", ""])))
        picked = sorted(draw.sample(range(n), draw.randint(2, min(5, n))))
        value, members = draw.choice([0, 0, 1, 3, 12, 12, 12]), []
        for line in picked:
            value += draw.choice([1, 1, 2, 3, 5])
            members.append((line, value))
        cut = draw.choice([len(members), len(members), len(members) // 2]) or len(members)
        rest = [(line, v - members[cut][1] + 2) for line, v in members[cut:]] if cut < len(members) else []
        docs.append(([s for s in (members[:cut], rest) if s], lines))
    lines = spark.createDataFrame([(d, k, k // 6 + 1, zone, False, None if k % 2 and not demoted else demoted, text) for d, (_, ls) in enumerate(docs) for k, (zone, demoted, text) in enumerate(ls)], LINES)
    members = spark.createDataFrame([(d, s, k + 1, line, 0, value, 3.0, 1.0) for d, (segs, _) in enumerate(docs) for s, one in enumerate(segs, 1) for k, (line, value) in enumerate(one)], MEMBERS)
    got: dict[int, set] = {}
    for r in pairing.fill_gaps(members, lines.repartition(3)).collect():
        got.setdefault(r["doc_id"], set()).add((r["segment"], r["value"], r["line"], r["at"], r["end_at"], r["kind"]))
    want = {d: w for d, (segs, ls) in enumerate(docs) if (w := plain_fills(segs, ls))}
    assert not [(d, got.get(d, set()) - want.get(d, set()), want.get(d, set()) - got.get(d, set()), docs[d][0], list(enumerate(docs[d][1]))) for d in {*got, *want} if got.get(d) != want.get(d)]
    kinds = {row[-1] for w in want.values() for row in w}
    assert kinds == {*pairing.KINDS, "chain_starts_above_one"}


def test_ordered_choice_equals_all_assignments():
    draw = random.Random(4)
    for _ in range(400):
        options = sorted({(draw.randint(1, 4), (draw.randint(0, 3), draw.randint(0, 1)), round(draw.uniform(-0.9, 2), 3)) for _ in range(draw.randint(0, 9))}, key=lambda o: (o[0], -o[2], o[1]))
        best = 0.0
        for n in range(len(options) + 1):
            for some in itertools.combinations(range(len(options)), n):
                if all(options[a][0] < options[b][0] and options[a][1] < options[b][1] for a, b in zip(some, some[1:])):
                    best = max(best, sum(options[i][2] + 0.5 for i in some))
        found = pairing.ordered_choice(options)
        assert all(options[a][0] < options[b][0] and options[a][1] < options[b][1] for a, b in zip(found, found[1:]))
        assert sum(options[i][2] + 0.5 for i in found) == pytest.approx(best)


def test_references_of_labels(spark):
    labels = spark.createDataFrame([(1, 1, 1, 9, 0, 1, "1 Figure of it"), (1, 1, 2, 10, 0, 1, "2 plain"), (1, 1, 3, 30, 0, 3, "3 late"), (2, 1, 1, 5, 0, 1, "1 x"), (4, 1, 1, 9, 0, 1, "1 x"), (4, 1, 2, 10, 0, 1, "2 x")], "doc_id bigint, segment bigint, value bigint, line bigint, at bigint, page bigint, body string")
    shape = "doc_id bigint, segment bigint, value bigint, line bigint, at bigint, page bigint, score double, form string, region string, visual boolean, line_order bigint"
    refs = spark.createDataFrame(
        [
            (1, 1, 1, 9, 0, 1, 5.0, "plain", "body", False, 1),  # the label itself
            (1, 1, 7, 1, 0, 1, 5.0, "plain", "body", False, 1),  # no such label
            (1, 1, 2, 2, 0, 1, 5.0, "plain", "body", True, 1),  # a visual zone, and no word of one in the label
            (1, 1, 1, 3, 0, 1, 1.0, "plain", "body", True, 1),  # there it is
            (1, 1, 2, 2, 5, 1, 1.0, "sup", "Table 1", True, 1),  # a raised mark in a table
            (1, 1, 3, 1, 4, 1, 9.0, "plain", "body", False, 1),  # so good that those after it give way
            (4, 1, 1, 3, 0, 1, 1.0, "plain", "body", True, 1),  # no word of a figure
            (4, 1, 1, 3, 7, 1, 1.0, "sup", "body", False, 1),
            (4, 1, 2, 3, 5, 1, 1.9, "sup", "body", False, 1),  # best of its value, but before the one above
            (4, 1, 2, 4, 0, 1, 0.8, None, None, None, 1),  # so this one
            (2, 1, 1, 40, 0, 5, 0.4, "plain", "body", False, 1),  # four pages behind: below the least score
            (3, 1, 1, 1, 0, 1, 1.0, "plain", "body", False, 1),  # a document without labels
        ],
        shape,
    )
    flags = spark.createDataFrame([(1, False)], "doc_id bigint, endnote boolean")
    rows = pairing.assign_references(labels, refs, flags).collect()
    got = {(r["doc_id"], r["value"], r["line"], r["at"]): r["outcome"] for r in rows}
    assert len(rows) == len(got) == 12 and got == {
        (1, 1, 9, 0): "is_selected_label_span", (1, 7, 1, 0): "no_selected_label", (1, 2, 2, 0): "visual_zone_without_visual_label_cue", (1, 1, 3, 0): "window_conflict", (1, 2, 2, 5): "window_conflict",
        (1, 3, 1, 4): "chosen", (4, 1, 3, 0): "visual_zone_without_visual_label_cue", (4, 1, 3, 7): "chosen", (4, 2, 3, 5): "not_chosen", (4, 2, 4, 0): "chosen",
        (2, 1, 40, 0): "window_conflict", (3, 1, 1, 0): "no_selected_label",
    }


def test_pools_end_with_the_pages_of_segments(spark):
    lines = spark.createDataFrame([(1, k, k // 4 + 1, "note", False, False, "") for k in range(16)], LINES)
    members = spark.createDataFrame([(1, 1, 1, 1, 0, 1, 3.0, 1.0), (1, 1, 2, 5, 0, 2, 3.0, 1.0), (1, 2, 1, 9, 0, 1, 3.0, 1.0)], MEMBERS)
    refs = spark.createDataFrame([(1, k, 0) for k in range(16)], "doc_id bigint, line bigint, at bigint")
    assert [r["segment"] for r in pairing.pools(members, lines, refs).orderBy("line").collect()] == [1] * 8 + [2] * 8


def test_no_rows(spark):
    none = spark.createDataFrame([], LABELS)
    members = pairing.segments(none)
    assert members.count() == 0 and pairing.fill_gaps(members, spark.createDataFrame([], LINES)).count() == 0
    assert none.where(F.lit(True)).count() == 0
