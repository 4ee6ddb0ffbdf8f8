"""Scalar text functions over derived lines."""

from pyspark.sql import functions as F

from docloom.functions import dialect, legal
from docloom.plans.registry import query, sql

# TXT-01: where each line starts, in scalars and in UTF-16 units.
sql(
    "txt_line_index",
    """
select doc_id, line_no, cast(length(line) as bigint) as n_scalars, @u16(line) as n_utf16,
       cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as scalar_start,
       cast(coalesce(sum(@u16(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as utf16_start
from doc_lines
""",
)

# TXT-02: line ends of all five kinds, put in place of some sentence ends.
sql(
    "txt_javascript_lines",
    """
with mixed as (select doc_id, replace(replace(replace(text, '. T', concat('.', chr(13), 'T')), '. A', concat('.', chr(13), chr(10), 'A')), '. E', '.\u2028E') as t from documents)
select doc_id, cast(@hits(t, '\r\n|\r|\n|\u2028|\u2029') as bigint) + 1 as n_lines, cast(length(@sub(t, '\r\n|\r|\n|\u2028|\u2029', '')) as bigint) as n_chars from mixed
""",
)

# TXT-03
sql(
    "txt_quality",
    """
select doc_id, greatest(0.0e0, @even(least(length(@sub(text, '^[ ⧵t-⧵r]+|[ ⧵t-⧵r]+$', '')) / 100.0e0, 1.0e0) * printable * (1.0e0 - least(20.0e0 * odd, 1.0e0)), 4)) as quality
from (select doc_id, text, length(@sub(text, '[^⧵p{L}⧵p{M}⧵p{N}⧵p{P}⧵p{S} ]', '')) / cast(greatest(length(text), 1) as double) as printable,
             length(@sub(text, '[^�]', '')) / cast(greatest(length(text), 1) as double) as odd from (select doc_id, coalesce(text, '') as text from documents) n) t
""",
)

# TXT-04: zero-width spaces: one goes, several become a blank; a byte order mark goes.
sql(
    "txt_normalize",
    """
select doc_id, line_no, @sub(@sub(@sub(t, '﻿', ''), '​​+', ' '), '​', '') as clean
from (select doc_id, line_no, replace(replace(line, ' th', '​th'), ' an', '​​an') as t from doc_lines) x
""",
)

# TXT-05 and its use: keys of running heads.
sql(
    "txt_furniture_key",
    """
select doc_id, furniture, count(*) as n from (
  select doc_id, @sub(@sub(lower(trim(text)), '[ \t]+', ' '), '[0-9]+', '#') as furniture from layout) k group by doc_id, furniture
""",
)

# TXT-06
sql(
    "txt_normalize_label",
    """
select doc_id, label, case when @like(t, '^[0-9]+$') then cast(cast(t as bigint) as varchar(40)) else t end as normal
from (select doc_id, label, translate(case when label % 4 = 0 then concat('00', label) when label % 4 = 1 then translate(cast(label as varchar(40)), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') when label % 4 = 2 then '∗∗' else concat(label, 'a') end, '⁰¹²³⁴⁵⁶⁷⁸⁹∗', '0123456789*') as t from notes) x
""",
)

# TXT-07, TXT-08: the note label of a line, and whether letters follow it.
sql(
    "txt_label_prefix",
    """
select doc_id, line_no, regexp_extract(line, '^(⟨[0-9]{1,4}⟩|[0-9]{1,4}|[*]{1,8})[.]? ', 1) as label,
       length(@sub(regexp_extract(line, '^⟨?[0-9]{1,4}⟩?[.]? (.*)$', 1), '[^A-Za-z]', '')) >= 4 as compact_note
from marked
""",
)

# TXT-09
sql(
    "txt_printed_label",
    "select doc_id, line_no, regexp_extract(@sub(@sub(marker, '^⟨', ''), '⟩$', ''), '^(page )?([0-9]{1,6}|[ivxlcdm]{1,12})$', 2) as label from paged",
)

# TXT-10: Roman numerals to numbers; a sign is negative before a larger one.
sql(
    "txt_roman_value",
    """
with numerals as (
  select distinct n, concat(case cast(floor(n / 10) as bigint) when 0 then '' when 1 then 'x' when 2 then 'xx' when 3 then 'xxx' else 'xl' end,
                   case n % 10 when 0 then '' when 1 then 'i' when 2 then 'ii' when 3 then 'iii' when 4 then 'iv' when 5 then 'v' when 6 then 'vi' when 7 then 'vii' when 8 then 'viii' else 'ix' end) as roman
  from (select line_no % 49 + 1 as n from doc_lines) l),
signs as (
  select n, roman, k, case substring(roman, cast(k as int), 1) when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 end as v
  from (select n, roman, @seq(1, length(roman)) as k from numerals) s)
select n, roman, cast(sum(case when v < after then -v else v end) as bigint) as value
from (select n, roman, v, lead(v) over (partition by n order by k) as after from signs) s group by n, roman
""",
)

# TXT-11, TXT-12: provision labels in order, by components and as fractions.
sql(
    "txt_compare_labels",
    """
select doc_id, label, cast(row_number() over (partition by doc_id order by a, b, label) as bigint) as by_component,
       cast(row_number() over (partition by doc_id order by a, rpad(cast(b as varchar(9)), 6, '0'), label) as bigint) as by_fraction
from (select doc_id, concat(line_no % 4 + 1, '.', line_no + 1) as label, line_no % 4 + 1 as a, line_no + 1 as b from doc_lines) l
""",
)

# TXT-13
sql("txt_numeric_label", "select doc_id, line_no, regexp_extract(line, '^([0-9]+([.][0-9]+){0,3}[A-Z]{0,2})[.] ', 1) as label from sectioned")

# TXT-14
sql("txt_word_count", "select doc_id, cast(@hits(text, '[^ \t\n\r]+') as bigint) as n_words, cast(@hits(text, '[A-Za-z]+') as bigint) as n_letter_words from documents")

# TXT-15, TXT-16: lines that may be headings.
sql(
    "txt_heading_plausible",
    """
select doc_id, line_no, @u16(line) <= 120 and not @like(line, '[;!{}|]') and n_words <= 12 and @like(line, '^[A-Z]') and not @like(line, '[0-9]$')
       and (n_capital >= 0.6e0 * n_words or n_words <= 6) as heading
from (select doc_id, line_no, line, @hits(line, '[^ ]+') as n_words, @hits(line, '(^| )[A-Z]') as n_capital from doc_lines) l
""",
)

# TXT-19
sql("txt_citation_cue", "select doc_id, label, @like(body, '(^| )(ibid|supra|infra|para|paras|at)( |[.,])') as has_cue from notes")

# TXT-20, TXT-21: what a marker may be read as.
sql(
    "txt_enumerators",
    """
select doc_id, line_no, regexp_extract(line, '^([(][a-z]+[)]|[0-9]+[.])', 1) as marker,
       case when @like(line, '^[(][ivxlcdm]+[)]') then 'roman or letter' when @like(line, '^[(][a-z][)]') then 'letter' when @like(line, '^[0-9]+[.]') then 'number' else 'none' end as family
from sectioned
""",
)

# TXT-23: blocks of lines joined, hyphens at line ends taken out before a small letter.
sql(
    "txt_join_lines",
    """
with hyphened as (
  select doc_id, line_no, cast(floor(line_no / 4) as bigint) as block, case when line_no % 3 = 0 then concat(line, '-') else line end as line,
         lead(line) over (partition by doc_id, cast(floor(line_no / 4) as bigint) order by line_no) as after from doc_lines)
select doc_id, block, @join(case when after is null then line when @like(line, '-$') and @like(after, '^[a-z]') then @sub(line, '-$', '') else concat(line, ' ') end, '', line_no) as joined
from hyphened group by doc_id, block
""",
)

# TXT-24
sql("txt_shortform", "select doc_id, label, regexp_extract(substring(body, greatest(1, length(body) - 69)), '([A-Z][a-z]+)[^A-Z]*$', 1) as short_form from notes")

# TXT-26
sql("txt_normalized", "select doc_id, @sub(@sub(replace(text, '. ', ' \n\n\n\n'), '[ \t]+\n', '\n'), '\n\n\n+', '\n\n') as normal from documents")

# TXT-27
sql(
    "txt_section_id",
    """
select id, case when @part(id, '_', 3) = '' then @part(id, '_', 2) else concat(@part(id, '_', 2), '(', @part(id, '_', 3), ')') end as label, count(*) as n
from (select case when line_no % 2 = 0 then concat('section_', line_no) else concat('section_', line_no, '_', case line_no % 3 when 0 then 'a' when 1 then 'b' else 'c' end) end as id from doc_lines) s
group by id
""",
)

# TXT-28
sql("txt_page_aliases", "select doc_id, line_no, concat_ws('|', p, concat('2024 X ', doc_id, ' at ', p), case when cast(p as bigint) % 2 = 0 then concat('X, at *', p) end) as aliases from (select doc_id, line_no, regexp_extract(marker, '([0-9]+)', 1) as p from paged) m")

# TXT-29
sql(
    "txt_parse_ordinal",
    """
select doc_id, line_no, @int(regexp_extract(lower(t), '^(page|para|paragraph|¶|section)? ?([0-9]{1,9})$', 2)) as ordinal
from (select doc_id, line_no, concat(case line_no % 4 when 0 then 'Page ' when 1 then 'para ' when 2 then '¶' else 'x ' end, line_no) as t from doc_lines) l
""",
)

# TXT-30
sql("txt_scalar_slice", "select c.doc_id, label, substring(d.text, cast(range_start as int) + 1, cast(range_end - range_start as int)) as slice from claims c join documents d on d.doc_id = c.doc_id")

# TXT-32: a cheap test for an anchor before the pattern.
sql("txt_anchored_matches", "select doc_id, cast(@hits(text, '[^ ]*tion[a-z]* [^ ]+') as bigint) as n from documents where position('tion' in text) > 0")

# TXT-33: repeats collapse, blanks (0) go.
sql(
    "txt_greedy_ctc",
    """
select doc_id, @join(cast(c as varchar(9)), '', line_no) as decoded
from (select doc_id, line_no, c, lag(c) over (partition by doc_id order by line_no) as before from (select doc_id, line_no, length(line) % 4 as c from doc_lines) l) m
where c <> 0 and (before is null or before <> c) group by doc_id
""",
)


# TXT-17 to TXT-19: signs of references in lines.
CITED = "select doc_id, line, text from cited"


# Letters beyond ASCII are letters for the bounds of words: the oracle, whose \\b knows ASCII only, sees a z for each.
ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g')"


@query("txt_legal_cue", f"select doc_id, line, regexp_matches({ASCII}, '{legal.CUE.replace('(?U', '(?')}') as has_cue, regexp_matches({ASCII}, '{legal.CONTINUATION.replace('(?U', '(?')}') as continues from ({CITED}) c")
def legal_cue(spark, sf_dir):
    """TXT-19, whole: cues of references, and lines that go on with one."""
    return dialect.run(spark, sf_dir, CITED).select("doc_id", "line", legal.has_cue(F.col("text")).alias("has_cue"), legal.continues(F.col("text")).alias("continues"))


@query("txt_protected_spans")
def protected_spans(spark, sf_dir):
    """TXT-18: spans of references by pattern, in code points."""
    return legal.protected_spans(dialect.run(spark, sf_dir, CITED))


@query("txt_protected_ranges")
def protected_ranges(spark, sf_dir):
    """TXT-18: what the spans of a line cover together."""
    return legal.merged_spans(legal.protected_spans(dialect.run(spark, sf_dir, CITED)))


@query("txt_citation_signal")
def citation_signal(spark, sf_dir):
    """TXT-17: lines with a sign of a reference; reporters beyond the patterns are a parameter."""
    return dialect.run(spark, sf_dir, CITED).select("doc_id", "line", legal.has_signal(F.col("text"), ("Alta L Rev", "Osgoode Hall LJ")).alias("has_signal"))
