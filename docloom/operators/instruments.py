"""The grammar of instruments: parts, sections and lettered points, as a tree of ranges.

Lines are read by expressions: as the begin of a part or schedule, as a section (by the spine of the
text, or by what a section looks like where there is no spine), or as a marker such as (a), a) or a.
The last two forms of markers only count in documents that use them for a list of three. A fold over
the lines of a document keeps the open part, section and points, and closes ranges with a stack.

Documents: (doc_id, text). A null text has no nodes; markers before the first section are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.operators import headings
from docloom.operators.chains import by_document
from docloom.operators.spine import statute_spine, text_lines

#: Fixed values of the rules.
DEPTH_MOST, DIALECT_LEAST, ROMAN_MOST = 6, 3, 50
BLANK = r"[\s\x{feff}]"
TOP = (
    r"(?U)^(?:(ARTICLE|Article|PART|Part|DIVISION|Division)\s+([IVXLCDM]+|\d{1,3})\b\s*[—–\-.:]?\s*(.*)"
    r"|(SCHEDULE|Schedule|EXHIBIT|Exhibit|ANNEX|Annex|APPENDIX|Appendix)\s+([A-Z0-9][\w.\-]*)\s*[—–\-.:]?\s*(.*))$"
)
SECTION = (
    r"(?U)^(?:(?:Section|SECTION)\s+(\d{1,3}(?:\.\d{1,3})*[A-Za-z]?)[.)]?\s*[—–\-:]?\s*([\"'“(A-Z].*|)|(\d{1,3}\.\d{1,3}(?:\.\d{1,3})*)\s+([\"'“(A-Z].*)"
    r"|((?:[0-4]?\d{1,2}|500))[.)]\s+([\"'“(A-Z].*)|(\d{1,3}(?:\.\d{1,3}){0,3})[ \t]+(\(\d.*))$"
)
MARKER = (
    r"^(?:\((\d{1,3}(?:\.\d{1,3})?|[a-z]{1,2}|[ivxlcdm]{1,6}|[A-Z]{1,2}|[IVXLCDM]{1,6})\)[ \t]*(.*)"
    r"|([a-z]{1,2}|[ivxlcdm]{1,6})\)[ \t]+(\S.*)|([a-z]{1,2}|[ivxlcdm]{1,6})\.[ \t]+(\S.*))$"
)
CODES = ("instrument_ladder_increment", "instrument_ladder_level_open", "instrument_ladder_restart", "instrument_ladder_midcounter_open", "instrument_ladder_violation", "instrument_ladder_forward_jump")
LETTERS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def instrument_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, kind, label, content_start, and a token with its content's place for inline, paren, tail and dot)."""
    lines = text_lines(docs)
    spine = statute_spine(docs).select("doc_id", "start", F.col("label").alias("mark"), F.col("content_start").alias("mark_content"))
    lead = F.length(F.regexp_extract("text", rf"^(?U)({BLANK}*)", 1))
    value = F.regexp_replace("text", rf"(?U)^{BLANK}+|{BLANK}+$", "")
    rows = lines.select("doc_id", "line", "n_chars", "text", F.col("start").alias("line_start"), (F.col("start") + lead).alias("start"), value.alias("value")).where("value <> ''")
    rows = rows.join(spine, ["doc_id", "start"], "left").join(spine.select("doc_id", F.lit(True).alias("spined")).distinct(), "doc_id", "left")
    part = lambda pattern, k: F.regexp_extract("value", pattern, k)
    rows = rows.select("*", *(part(TOP, k).alias(f"t{k}") for k in range(1, 7)), *(part(SECTION, k).alias(f"s{k}") for k in range(1, 9)), *(part(MARKER, k).alias(f"m{k}") for k in range(1, 7)))

    word = F.lower(F.concat("t1", "t4"))
    prefix = F.when(word.isin("part", "annex"), word).when(word == "schedule", "sched").otherwise(F.left(word, F.lit(3)))
    number = F.when(F.regexp_like("t2", F.lit("^[0-9]+$")), F.col("t2").cast("bigint")).otherwise(headings.roman_value(F.col("t2")))
    titled = (F.col("t6") == "") | F.regexp_like("t6", F.lit(r"^[\"'“(A-Z]"))
    suffix = F.when(F.col("t1") != "", F.when((number > 0) | F.regexp_like("t2", F.lit("^[0-9]+$")), number.cast("string"))).when(titled, F.lower("t5"))
    top = F.when((F.col("t1") != "") | (F.col("t4") != ""), F.concat(prefix, suffix))
    direct = F.col("spined").isNull() & (F.col("t1") == "") & (F.col("t4") == "")
    bare = F.concat("s1", "s3", "s5", "s7")
    rest = lambda of: F.col("start") + F.length("value") - F.length(of)

    on_spine = F.col("mark").isNotNull()
    kind = F.when(on_spine, "section").when(top.isNotNull(), "container").when(direct & (bare != ""), "section").otherwise("")
    rows = rows.withColumn("kind", kind).withColumn("top", top)
    label = F.when(on_spine, F.concat(F.lit("sec"), "mark")).when(F.col("kind") == "container", F.col("top")).when(F.col("kind") == "section", F.concat(F.lit("sec"), bare)).otherwise("")
    content = F.when(on_spine, F.col("mark_content")).when(F.col("kind") == "container", rest(F.concat("t3", "t6"))).when(F.col("kind") == "section", rest(F.concat("s2", "s4", "s6", "s8"))).otherwise(0)
    rows = rows.withColumn("label", label).withColumn("content_start", content)
    inside = F.when(F.col("kind") == "section", F.substr("text", F.greatest(F.col("content_start") - F.col("line_start"), F.lit(0)) + 1)).otherwise("")
    rows = rows.withColumn("inside", inside)
    inline = F.regexp_extract("inside", MARKER, 1)
    return rows.select(
        "doc_id", "line", "n_chars", "start", "kind", "label", "content_start",
        inline.alias("inline"), (F.col("content_start") + F.length("inside") - F.length(F.regexp_extract("inside", MARKER, 2))).alias("inline_at"),
        F.col("m1").alias("paren"), F.col("m3").alias("tail"), F.col("m5").alias("dot"), rest(F.concat("m2", "m4", "m6")).alias("at"),
    )


def roman(token: str) -> int | None:
    if any(c not in LETTERS for c in token):
        return None
    total = most = 0
    for c in reversed(token):
        total += LETTERS[c] if LETTERS[c] >= most else -LETTERS[c]
        most = max(most, LETTERS[c])
    return total if total > 0 else None


def readings(token: str) -> list[tuple[int, str]]:
    """(family, value) that a marker may count: 0 numbers, 1 and 3 letters, 2 and 4 Roman numerals (3 and 4 capitals)."""
    if token.replace(".", "").isdigit():
        return [(0, token)]
    low = token.lower()
    shift = 2 if token != low else 0
    doubled = len(low) == 2 and low[0] == low[1]
    letter = [(1 + shift, str(ord(low[0]) - 96 + 26 * doubled))] if len(low) == 1 or doubled else []
    number = roman(low)
    numeral = [(2 + shift, str(number))] if number else []
    if len(low) == 1:
        return letter + numeral
    return numeral if number and number <= ROMAN_MOST else (letter or numeral)


def order(value: str) -> tuple:
    """The sort key of a counter's value: a number, then decimals after each dot."""
    first, *more = value.split(".")
    return ((len(first.lstrip("0")), first.lstrip("0"), len(first)), *((d.rstrip("0"), len(d)) for d in more))


def uses(tokens: list[str]) -> bool:
    """Whether lists of a dialect's markers rise for DIALECT_LEAST."""
    live: dict[int, tuple[str, int]] = {}
    for token in tokens:
        for family, value in readings(token):
            last, n = live.get(family, ("", 0))
            if value == "1":
                live[family] = ("1", 1)
            elif n and order(value) > order(last):
                live[family] = (value, n + 1)
            if live.get(family, ("", 0))[1] >= DIALECT_LEAST:
                return True
    return False


def point(stack: list[list], options: list[tuple[int, str]]) -> tuple[int, int, int, str]:
    """(code, level, family, value) of a marker among the open points; level -1 if it fits nowhere."""
    open_at = {frame[0]: k for k, frame in enumerate(stack)}
    last = {frame[0]: frame[1] for frame in stack}
    further = lambda f, v: order(v) > order(last[f])
    follows = lambda f, v: int(v) == int(last[f]) + 1 if v.isdigit() and last[f].isdigit() else further(f, v)
    room = len(stack) < DEPTH_MOST
    rules = (
        lambda f, v: f in last and follows(f, v),
        lambda f, v: f not in last and v == "1" and room,
        lambda f, v: f in last and (v == "1" or further(f, v)),
        lambda f, v: f not in last and room,
    )
    for code, meets in enumerate(rules):
        for family, value in options:
            if meets(family, value):
                return 5 if code == 2 and value != "1" else code, open_at.get(family, len(stack)), family, value
    return 4, -1, 0, ""


def outline(rows: list[tuple]) -> list[tuple]:
    """(start, label, parent, content_start, code, depth) of the nodes of one document's lines."""
    tail = uses([r[7] for r in rows if r[7] and not r[6]])
    dot = uses([r[8] for r in rows if r[8] and not r[6]])
    container = section = None
    stack: list[list] = []  # family, value, label
    used: dict[str, int] = {}
    nodes: list[tuple] = []

    def child(token: str, start: int, content_start: int) -> None:
        code, level, family, value = point(stack, readings(token))
        parent = stack[level - 1][2] if level > 0 else section[0]
        name = f"{parent}({token})"
        used[name] = used.get(name, 0) + 1
        label = name if used[name] == 1 else f"{name}@{used[name]}"
        if level >= 0:
            stack[level:] = [[family, value, label]]
        nodes.append((start, label, parent, content_start, CODES[code], section[1] + max(level, 0) + 1))

    for start, kind, label, content_start, inline, inline_at, paren, tailed, dotted, at in rows:
        if kind:
            depth = int(kind == "section" and container is not None)
            nodes.append((start, label, container if kind == "section" else None, content_start, None, depth))
            stack.clear()
            if kind == "container":
                container, section = label, None
            else:
                section = (label, depth)
                if inline:
                    child(inline, content_start, inline_at)
        elif section and (token := paren or tail and tailed or dot and dotted):
            child(token, start, at)
    return nodes


def closed(nodes: list[tuple], length: int) -> list[int]:
    """Where each node ends: at the next one of no greater depth, or with the text. A stack of open nodes, deepest last."""
    ends = [length] * len(nodes)
    live: list[int] = []
    for k, node in enumerate(nodes):
        while live and nodes[live[-1]][5] >= node[5]:
            ends[live.pop()] = node[0]
        live.append(k)
    return ends


def instrument_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, start, end_at, label, parent_label, content_start, code, depth) of each document's nodes, in order."""
    rows = instrument_lines(docs)
    names = ("start", "kind", "label", "content_start", "inline", "inline_at", "paren", "tail", "dot", "at")

    def run(held: dict) -> dict:
        nodes = outline(list(zip(*(held[c].tolist() for c in names))))
        ends = closed(nodes, int(held["n_chars"][0]))
        columns = list(map(list, zip(*nodes))) if nodes else [[] for _ in range(6)]
        return {"ordinal": list(range(1, len(nodes) + 1)), "end_at": ends} | dict(zip(("start", "label", "parent_label", "content_start", "code", "depth"), columns))

    whole = lambda c: F.col(c).cast("bigint").alias(c)
    rows = rows.select("doc_id", "line", "n_chars", *(whole(c) if c in ("start", "content_start", "inline_at", "at") else F.col(c) for c in names))
    schema = "doc_id bigint, ordinal bigint, start bigint, end_at bigint, label string, parent_label string, content_start bigint, code string, depth bigint"
    return by_document(rows, ("line",), run, schema)
