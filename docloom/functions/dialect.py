"""One query text for Spark SQL and for DuckDB, with the few functions that differ as macros.

``@name(a, b)`` stands for a function that the two spell differently; derived tables
are common table expressions, put in front of a query that names them. The Spark text
is what the library runs; the DuckDB text is its oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (Spark, DuckDB); {0}, {1}, ... are the arguments.
MACROS = {
    "like": ("regexp_like({0}, {1})", "regexp_matches({0}, {1})"),
    "sub": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "hits": ("size(regexp_extract_all({0}, {1}, 0))", "len(regexp_extract_all({0}, {1}))"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "u16": ("cast(octet_length(encode({0}, 'UTF-16BE')) / 2 as bigint)", "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"),
    "even": ("bround({0}, {1})", "round_even({0}, {1})"),
    "join": ("listagg({0}, {1}) within group (order by {2})", "string_agg({0}, {1} order by {2})"),
    "pctl": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "int": ("try_cast({0} as bigint)", "try_cast({0} as bigint)"),
    "part": ("split_part({0}, {1}, {2})", "split_part({0}, {1}, {2})"),
    "seq": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "left": ("left({0}, {1})", "left({0}, {1})"),
    "json": ("get_json_object({0}, {1})", "json_extract_string({0}, {1})"),
    "tokens": ("explode(split({0}, ' '))", "unnest(string_split({0}, ' '))"),
    "edit": ("levenshtein({0}, {1})", "levenshtein({0}, {1})"),
}

#: Derived tables: (Spark, DuckDB) or one text for both.
VIEWS: dict[str, str | tuple[str, str]] = {
    "doc_lines": (
        "select doc_id, cast(line_no as bigint) as line_no, line from (select doc_id, posexplode(split(text, '\\n', -1)) as (line_no, line) from documents)",
        "select doc_id, cast(generate_subscripts(p, 1) - 1 as bigint) as line_no, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents)",
    ),
    "marked": """
select doc_id, line_no, line_no + 1 as n,
       case when doc_id % 3 = 0 then 'bracket' when doc_id % 3 = 1 then 'dot' else 'bare' end as style,
       case when (doc_id * 7 + line_no) % 11 = 0 then line
            when doc_id % 3 = 0 then concat('[', line_no + 1, '] ', line)
            when doc_id % 3 = 1 then concat(line_no + 1, '. ', line)
            else concat(line_no + 1, ' ', line) end as line
from doc_lines""",
    "paged": """
select doc_id, line_no, concat('[page ', cast(floor(line_no / 5) as bigint) + 1 + doc_id % 4, ']') as marker, line
from doc_lines where line_no % 5 = 0""",
    "sectioned": """
select doc_id, line_no,
       concat(case when line_no % 3 = 0 then concat(cast(floor(line_no / 3) as bigint) + 1, '. ')
                   when line_no % 3 = 1 then '(a) ' else '(b) ' end, line) as line
from doc_lines""",
    "layout": """
select doc_id, cast(floor(line_no / 12) as bigint) + 1 as page_number, line_no + 1 as source_index,
       72.0e0 + (line_no % 12) * 54.0e0 as y0, 84.0e0 + (line_no % 12) * 54.0e0 as y1, 72.0e0 as x0,
       72.0e0 + least(length(line), 80) * 5.5e0 as x1,
       case when line_no % 12 = 0 then 'header' when line_no % 12 = 11 then 'footer'
            when line_no % 12 >= 9 then 'footnote' else 'body' end as region_type,
       case when line_no % 12 >= 9 then 8.0e0 else 10.0e0 end as size,
       cast(floor(line_no / 4) as bigint) as block_index,
       case when line_no % 12 = 0 then concat('Running Title ', cast(floor(line_no / 12) as bigint) + 1) else line end as text
from doc_lines""",
    "notes": """
select doc_id, line_no, cast(row_number() over (partition by doc_id order by line_no) as bigint) as label,
       concat('note-', row_number() over (partition by doc_id order by line_no)) as pair_id,
       concat('See supra note ', (line_no % 6) + 1, ', ', line) as body
from doc_lines where length(line) % 3 = 0""",
    #: Lines as printed: three note lines end each page of twelve. Note numbers start again after every 12 notes in a fifth
    #: of the documents; some labels are lost, some hold letters that look like digits.
    "printed": """
select doc_id, line_no as line, page, zone, case when zone = 'note' then n end as number,
       case when zone = 'body' or (doc_id * 7 + line_no) % 11 = 0 then line
            when (doc_id + line_no) % 13 = 0 then concat(translate(cast(n as varchar(9)), '10', 'lO'), ' ', line)
            else concat(n, ' ', line) end as text
from (select doc_id, line_no, line, page, zone, case when doc_id % 5 = 0 then (k - 1) % 12 + 1 else k end as n
      from (select doc_id, line_no, line, cast(floor(line_no / 12) as bigint) + 1 as page, case when line_no % 12 >= 9 then 'note' else 'body' end as zone,
                   cast(floor(line_no / 12) * 3 + greatest(line_no % 12 - 8, 1) as bigint) as k from doc_lines) l) p""",
    #: Numbers beside the lines of transcripts, twenty a page: in a column, or in steps across the page; some are not numbers.
    "transcripts": """
select doc_id, cast(floor(line_no / 20) as bigint) as page, 30.0e0 + case when doc_id % 4 = 3 then (line_no % 20) * 9 else line_no % 3 * 4 end as x0,
       case when doc_id % 11 = 5 then 0.0e0 else 500.0e0 end as width, case when (doc_id + line_no) % 37 = 0 then line when line_no % 5 = 2 then concat(' - ', line_no % 20 + 1, ' -') else cast(line_no % 20 + 1 as varchar(9)) end as text
from doc_lines""",
    #: Diagnostics of pages of five lines: one for a short page, one for some others.
    "diagnosed": """
select doc_id, case when chars % 17 = 3 then null else page end as page, case when chars < 200 then 'OCR_REQUIRED' when chars % 3 = 0 then 'TEXT_QUALITY_LOW' else 'FONT_MISSING' end as code,
       case when chars % 2 = 0 then 'warning' when chars % 5 = 0 then 'error' else 'info' end as severity
from (select doc_id, cast(floor(line_no / 5) as bigint) as page, sum(length(line)) as chars from doc_lines group by doc_id, cast(floor(line_no / 5) as bigint)) p where chars < 200 or chars % 4 = 0""",
    #: Lines with a reference in them, of eleven forms; some only look like one.
    "cited": """
select doc_id, line_no as line, concat(left(line, cast(floor(length(line) / 2) as int)), ' ', case line_no % 11
         when 0 then concat('[1998] ', line_no % 5 + 1, ' SCR ', line_no) when 1 then concat('2012 SCC ', line_no + 1) when 2 then concat('RSC 1985, c C-', line_no) when 3 then concat('(1999) 12:3 Osgoode Hall LJ ', line_no)
         when 4 then concat('at pp. ', line_no, ', 13-15') when 5 then concat('(1990) 3 D.L.R. ', line_no) when 6 then concat('class ', line_no) when 7 then concat('supra note ', line_no) when 8 then 'Smith v. Jones'
         when 9 then concat(line_no, ' Alta L Rev ', line_no + 7) else '' end, ' ', line) as text
from doc_lines""",
    #: Statutes: sections in bare numbers, numbers with a dot, dotted numbers or Markdown headings by document, with points
    #: in other families and letters between them, parts over them, some sections left out and some said twice.
    "statutes": """
select doc_id, @join(line, chr(10), line_no) as text
from (select doc_id, line_no, case when (doc_id + line_no) % 13 = 0 then line
             when line_no % 3 = 0 and doc_id % 4 = 0 then concat(k, ' ', line) when line_no % 3 = 0 and doc_id % 4 = 1 then concat(k, '. ', line)
             when line_no % 3 = 0 and doc_id % 4 = 2 then concat('### ', k, '.', k % 4 + 1, ' ', line) when line_no % 3 = 0 then concat(k, '.', k % 11 + 1, ' ', line)
             when line_no % 3 = 1 and line_no % 2 = 0 then concat(k, '.', line_no % 5, '. ', line) when line_no % 3 = 1 then concat(line_no % 4 + 1, ') ', line)
             when line_no % 30 = 29 then concat('PART ', cast(floor(line_no / 30) as bigint) + 1) else concat('(', @part('a,b,c,i,ii', ',', cast(floor(line_no / 3) % 5 as int) + 1), ') ', line) end as line
      from (select doc_id, line_no, line, cast(floor(line_no / 3) as bigint) + 1 - case when (doc_id * 5 + line_no) % 23 = 0 then 1 else 0 end as k from doc_lines) l) n
group by doc_id""",
    #: Section maps: dotted labels that count as numbers in two of three documents and as decimals in the third, whole numbers,
    #: schedules, a preamble, some labels out of their order; named in the order of the lines.
    "section_maps": """
select doc_id, line_no as index,
       case when line_no = 5 then 'Preamble' when line_no % 7 = 6 then concat('Schedule ', line_no) when line_no % 9 = 4 then cast(100000 - line_no as varchar(9))
            when line_no % 11 = 3 then concat('9', line_no, '.1')
            when doc_id % 3 = 0 then concat(cast(floor(line_no / 12) as bigint) + 1, '.', @part('1,11,12,2,21,22,3,31,32,4,41,42', ',', cast(line_no % 12 + 1 as int)))
            else concat(cast(floor(line_no / 12) as bigint) + 1, '.', line_no % 12 + 1) end as label
from doc_lines""",
    #: Headings of an outline: parts in Roman numerals, sections in letters, points in numbers or dotted numbers; now and then
    #: a number is left out or said again, and some headings have no mark.
    "outlined": """
select doc_id, line_no as position, case when (doc_id + line_no) % 19 = 0 then 'caps' else 'enumerator' end as kind,
       case when line_no % 12 = 0 then @part('I,II,III,IV,V,VI,VII,VIII,IX,X,XI,XII,XIII,XIV,XV', ',', cast(floor(line_no / 12) % 15 + 1 as int))
            when line_no % 4 = 0 then @part('A,B,C,D,E,F,G,H,I', ',', cast(floor(line_no / 4) % (3 + doc_id % 7) + 1 as int))
            when doc_id % 3 = 0 then concat(cast(floor(line_no / 4) as bigint) % 3 + 1, '.', line_no % 4 + jump)
            when doc_id % 3 = 1 then cast(line_no % 4 + jump as varchar(9)) else cast(line_no + jump as varchar(9)) end as mark,
       case when line_no % 4 = 0 then 'dot' when doc_id % 2 = 0 then 'paren' else 'dot' end as punct
from (select doc_id, line_no, case when (doc_id * 5 + line_no) % 13 = 0 then 2 when (doc_id * 3 + line_no) % 17 = 0 then -1 else 0 end as jump from doc_lines) o""",
    #: References in the body of the printed lines: every third body line has that of a note of its page, some are lost, and
    #: some lines repeat one of the page before.
    "printed_refs": """
select doc_id, line, page, value, length(text) as at, 1.5e0 + (line % 2) * 0.5e0 as score, case when line % 4 = 0 then 'sup' else 'plain' end as form, line % 12 + 1 as line_order
from (select doc_id, line, page, text, case when doc_id % 5 = 0 then (k - 1) % 12 + 1 else k end as value
      from (select doc_id, line, page, text, cast(case when line % 12 in (2, 5, 8) then floor(line / 12) * 3 + (line % 12 + 1) / 3 else floor(line / 12) * 3 - 1 end as bigint) as k
            from printed where zone = 'body' and (line % 12 in (2, 5, 8) and (doc_id * 3 + line) % 17 <> 0 or line % 12 = 4 and (doc_id + line) % 5 = 0 and page > 1)) r) v""",
    "claims": """
select doc_id, case when line_no % 2 = 0 then 'section' else 'paragraph' end as kind,
       concat(case when line_no % 2 = 0 then 'sec' else 'par' end, line_no + 1) as label, line_no,
       s as range_start, s + length(line) as range_end,
       case when line_no % 4 = 0 then 'complete' when line_no % 4 = 1 then 'augment' else 'absent' end as state
from (select doc_id, line_no, line, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no
        rows between unbounded preceding and 1 preceding), 0) as bigint) as s from doc_lines) t""",
    #: Paragraph markers of the marked view: one row per marked line.
    "markers": """
select doc_id, line_no, style, number, line
from (select doc_id, line_no, style, line, @int(@sub(regexp_extract(line, '^(⟨[0-9]+⟩|[0-9]+[.]?) ', 1), '[^0-9]', '')) as number from marked) m
where number is not null and (doc_id * 7 + line_no) % 11 <> 0""",
    #: Maximal runs of markers that go up by one.
    "scopes": """
select doc_id, line_no, number, sum(case when number = before + 1 then 0 else 1 end) over (partition by doc_id order by line_no) as scope
from (select doc_id, line_no, number, lag(number) over (partition by doc_id order by line_no) as before from markers) m""",
}
NAME = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the bracket that opens at ``at``, and where it has closed."""
    out, depth, quoted, start = [], 0, False, at + 1
    for k in range(at, len(text)):
        c = text[k]
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[start:k].strip()], k + 1
        elif c == "," and depth == 1 and not quoted:
            out.append(text[start:k].strip())
            start = k + 1
    raise ValueError(f"unclosed macro: {text[at:]}")


def expand(text: str, duck: bool) -> str:
    """Macros replaced by one engine's functions."""
    while m := re.search(r"@(\w+)\(", text):
        own, end = _arguments(text, m.end() - 1)
        text = text[: m.start()] + MACROS[m[1]][duck].format(*own) + text[end:]
    # ⟨ and ⟩ are square brackets as plain characters of a pattern.
    # ⧵ is a backslash of a pattern.
    text = text.replace("⧵", "\\" if duck else "\\\\")
    return re.sub("[⟨⟩]", lambda m: ("\\" if duck else "\\\\") + ("[" if m[0] == "⟨" else "]"), text)


def _needed(text: str) -> list[str]:
    """Views that a text names, what they need first."""
    out: list[str] = []
    for name in dict.fromkeys(NAME.findall(text)):
        body = VIEWS[name]
        for k in [*_needed(body if isinstance(body, str) else " ".join(body)), name]:
            if k not in out and k != "":
                out.append(k)
    return out


def render(text: str, duck: bool) -> str:
    """The whole query for one engine."""
    views = [(n, VIEWS[n] if isinstance(VIEWS[n], str) else VIEWS[n][duck]) for n in _needed(text)]
    own = text.strip()
    parts = [f"{n} as ({body.strip()})" for n, body in views]
    if m := re.match(r"with\s+(recursive\s+)?", own):
        own = own[m.end() :]
        head = ",\n".join(parts)
        whole = f"with {m[1] or ''}{head},\n{own}" if parts else text
    else:
        whole = (f"with {',\n'.join(parts)}\n" if parts else "") + own
    return expand(whole, duck)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The query over the Parquet tables of a directory."""
    tables = "|".join(TABLES)
    return spark.sql(re.sub(rf"\b(from|join) ({tables})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", render(text, duck=False)))
