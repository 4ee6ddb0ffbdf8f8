"""Statute spines: literal texts, and a plain tournament that tries all families and readings."""

import random
import re
from collections import Counter
from functools import cmp_to_key

from docloom.operators import spine
from test_labels import compare, parts

BODY = "This section provides for the administration of the enactment in force across the territory."


def labels_of(spark, texts, allow_hyphen=False):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = {k: [] for k in range(len(texts))}
    for r in spine.statute_spine(frame, allow_hyphen).orderBy("doc_id", "start").collect():
        out[r["doc_id"]].append((r["label"], r["start"], r["content_start"]))
    return [out[k] for k in range(len(texts))]


def test_literal_spines(spark):
    texts = [
        "### Interpretation\n85F\nProvision text continues on the next line.\n85G Next provision.\n86 Final provision.",
        "1 This Act may be cited as the Example Act.\n2 The following definitions apply in this Act.\n3\nApplication\nThis Act applies to every person in the territory.\n4 The Minister may make regulations.",
        f"1. There is established a board. {BODY}\n2.(1) A term has the prescribed meaning. {BODY}\n2.1. This inserted provision governs administration. {BODY}\n3. The Minister may make regulations. {BODY}\n4. This Act comes into force. {BODY}",
        "1 A person is exempted if the person satisfies the following:\n1. The person is registered with a regulatory authority.\n2. A regulatory authority has not refused the person.\n3. A finding of misconduct has not been made.\n4. The person is not the subject of any proceeding.\n5. The person has submitted an application.\n2 A person who is exempted must notify the College.\n3 Omitted (provides for coming into force).",
        "1\r\n\r\n________________\r\n2\r\n\r\n________________\r\n",
        "1\n\nnot a heading\n2 Words",
        "1\n\nA heading\n",
        "",
        None,
        "no numbers\nat all",
    ]
    got = [[x for x, *_ in one] for one in labels_of(spark, texts)]
    assert got == [["85F", "85G", "86"], ["1", "2", "3", "4"], ["1", "2", "2.1", "3", "4"], ["1", "2", "3"], ["1", "2"], [], ["1"], [], [], []]


def plain_marks(text, family):
    out, at, lines = [], 0, text.split("\n")
    for k, raw in enumerate(lines):
        line, start = raw.removesuffix("\r"), at
        at += len(raw) + 1
        lead = len(line) - len(line.lstrip(" \t"))
        value = line[lead:]
        if family == "markdown":
            hashes = re.match(r"#+", value)
            if not hashes or len(hashes[0]) > 6 or value[hashes.end() : hashes.end() + 1] not in (" ", "\t"):
                continue
            value = value[hashes.end() :].lstrip(" \t")
        bold = value.startswith("**")
        value = value[2 * bold :]
        m = re.match(r"[0-9]{1,8}(?:[.-][0-9]{1,8}){0,3}[A-Z]{0,2}", value)
        if not m or family == "markdown" and not re.search("[.-]", m[0]):
            continue
        rest = value[m.end() :]
        if bold:
            if not rest.startswith("**"):
                continue
            rest = rest[2:]
        trailing = False
        if family == "dotterm" or family == "markdown" and rest.startswith("."):
            if rest[:1] not in (".", ")"):
                continue
            rest, trailing = rest[1:], True
        content = rest.lstrip(" \t")
        spaces, c = len(rest) - len(content), content[:1]
        ok = {
            "bare": not content or spaces and (c.isalpha() or c in "0123456789([*“\"«") or not spaces and c == "(",
            "dotterm": content and (c.isalnum() or c in "\"'“«(") and (spaces or c == "("),
            "markdown": not content or spaces,
        }[family]
        seen = next((x for x in reversed(lines[:k]) if x.strip()), "")
        if not ok or family == "bare" and not content and re.match(spine.RANGE_HEADING.replace("u", "", 1), seen.removesuffix("\r")):
            continue
        x = m[0]
        style = "dotterm" if trailing else "mixed" if "." in x and "-" in x else "hyphen" if "-" in x else "dot" if "." in x else "integer"
        out.append((start + lead, x, style, start + len(line) - len(content), bool(content.strip()), bool(content) or raw.endswith("\r")))
    return out


def keys(label):
    return [int(n) for n in re.findall(r"(?:^|[.-])([0-9]+)", label)]


def plain_scopes(marks, styles, root, fraction):
    live = []
    for mark in (m for m in marks if m[2] in styles):
        fit = [s for s in live if len(parts(s[-1][1])) == len(parts(mark[1])) and compare(mark[1], s[-1][1], fraction) > 0]
        if fit:
            best = fit[0]
            for s in fit[1:]:
                if compare(s[-1][1], best[-1][1], fraction) > 0:
                    best = s
            best.append(mark)
        else:
            live.append([mark])
        if len(live) > 8:
            live.pop(min(range(len(live)), key=lambda k: len(live[k])))
    return [s for s in live if len(s) >= 3 and (not root or all(n == 1 for n in keys(s[0][1])))]


def plain_widen(scope, marks, length):
    if len(keys(scope[0][1])) != 1:
        return scope
    out = []
    for k, parent in enumerate(scope):
        end = scope[k + 1][0] if k + 1 < len(scope) else length
        below = [m for m in marks if parent[0] < m[0] < end and m[2] in ("dot", "dotterm") and "." in m[1] and keys(m[1])[0] == keys(parent[1])[0]]
        times = Counter(m[1] for m in below)
        out += [parent, *(m for m in below if times[m[1]] == 1)]
    return out


def names(scope):
    return [m[1] for m in scope]


def plain_choose(a, b):
    if a is None or b is None:
        return a or b
    if names(a) == names(b):
        return a
    if a[0][0] != b[0][0]:
        return min(a, b, key=lambda s: s[0][0])
    return None if len(a) == len(b) else max(a, b, key=len)


def plain_spine(text, hyphens):
    def early(start):
        units = lambda t: len(t.encode("utf-16-le")) // 2
        return units(text) > 0 and units(text[:start]) / units(text) <= 0.7

    def winner(scopes, marks):
        some = [plain_widen(s, marks, len(text)) if s[0][2] != "dotterm" else s for s in scopes]
        some = [s for s in some if early(s[0][0])]
        some.sort(key=cmp_to_key(lambda a, b: len(b) - len(a) or a[0][0] - b[0][0]))
        if not some or any(len(s) == len(some[0]) and s[0][0] == some[0][0] and names(s) != names(some[0]) for s in some[1:]):
            return None
        return some[0]

    def over(inline):
        marks = {f: [m for m in plain_marks(text, f) if m[4] or not inline] for f in spine.FAMILIES}
        found = []
        for family, ms in marks.items():
            if len(ms) < 3:
                continue
            component = plain_scopes(ms, ("integer", "dot", "dotterm"), False, False)
            if hyphens:
                component += plain_scopes(ms, ("hyphen",), True, False) + plain_scopes(ms, ("mixed",), True, False)
            best = plain_choose(winner(component, ms), winner(plain_scopes(ms, ("dot",), False, True), ms))
            if best:
                found.append((family, best))
        if not found:
            return short()
        begin = min(s[0][0] for _, s in found)
        found = [(f, s) for f, s in found if s[0][0] == begin]
        best = found[0][1]
        for _, s in found[1:]:
            best = plain_choose(best, s)
            if best is None:
                return []
        family = next(f for f, s in found if s is best)
        return plain_widen(best, sorted(marks["bare"] + marks["dotterm"]), len(text)) if family == "dotterm" else best

    def short():
        some, at = [], 0
        for f in spine.FAMILIES:
            some += plain_marks(text, f)
        spans = []
        for raw in text.split("\n"):
            line = raw.removesuffix("\r")
            spans.append((at, line))
            if line.strip(" \t") in ("1", "2"):
                some.append((at + len(line) - len(line.lstrip(" \t")), line.strip(" \t"), "integer", at + len(line), False, raw.endswith("\r")))
            at += len(raw) + 1
        some = [m for m in some if m[1] in ("1", "2")]
        done = []
        for m in some:
            if not m[5]:
                after = next(((a, x) for a, x in spans if a > m[0] and x.strip()), None)
                if not after or not (re.match(r"(?:[\"'“«]\s*)?[A-Z]|\(\d", after[1].lstrip()) or re.match(r"(?i)(?:\[\s*)?(?:repealed|omitted)\b", after[1].lstrip())):
                    return []
                m = (*m[:3], after[0] + len(after[1]) - len(after[1].lstrip(" \t")), *m[4:])
            done.append(m)
        kept = {}
        for m in done:
            kept.setdefault((m[0], m[1]), m)
        ones, twos = ([m for m in sorted(kept.values()) if m[1] == x] for x in "12")
        if len(ones) != 1 or len(twos) > 1 or twos and twos[0][0] <= ones[0][0] or not early(ones[0][0]):
            return []
        return ones + twos

    found = over(False)
    return found if not found or any(m[4] for m in found) else over(True)


def some_text(draw):
    lines, n = [], 0
    for _ in range(draw.randint(1, 14)):
        n = draw.choice([n + 1, n + 1, n + 1, n, 1, n + 2])
        label = draw.choice([str(n), str(n), f"{n}.{draw.randint(1, 12)}", f"{n}A", f"{n}-{draw.randint(1, 3)}", f"1-{n}", f"1.1-{n}"])
        lead = draw.choice(["", "", "", " ", "\t", "## ", "####### ", "### "])
        if draw.random() < 0.15:
            label = f"**{label}**"
        tail = draw.choice([" Words", " words 😀😀", "", ". Words", ".", ") words", "(1) words", ". (a) x", " [x]", " ;", "\r", " Words\r"])
        lines.append(draw.choice(["", "words", "Words", "(1) x", "## Part 1 to", "[Repealed]", lead + label + tail, lead + label + tail, lead + label + tail, lead + label + tail]))
    return "\n".join(lines)


def test_spines_equal_a_plain_tournament(spark):
    draw = random.Random(12)
    texts = [some_text(draw) for _ in range(500)]
    for hyphens in (False, True):
        got = labels_of(spark, texts, hyphens)
        want = [[(m[1], m[0], m[3]) for m in plain_spine(t, hyphens)] for t in texts]
        wrong = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
        assert not wrong, (len(wrong), wrong[0])
    assert sum(map(bool, want)) > 40 and any(len(w) > 3 for w in want) and any(len(w) == 1 for w in want)
