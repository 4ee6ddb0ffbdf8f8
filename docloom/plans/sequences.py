"""Sequence queries: islands, neighbours and ordered joins."""

from docloom.plans.registry import sql

# SEQ-02, SEQ-03
sql("seq_paragraph_markers", "select doc_id, line_no, style, number from markers")
sql("seq_contiguous_scopes", "select doc_id, cast(scope as bigint) as scope, min(number) as first_n, max(number) as last_n, count(*) as n_markers from scopes group by doc_id, scope")

# SEQ-05: gaps of one number that one line of the document could fill.
sql(
    "seq_recover",
    """
with gaps as (select doc_id, number as before, line_no as from_line, after_line from (
  select doc_id, number, line_no, lead(number) over (partition by doc_id order by line_no) as after, lead(line_no) over (partition by doc_id order by line_no) as after_line from markers) m where after = number + 2)
select g.doc_id, g.before + 1 as number, min(l.line_no) as line_no from gaps g
join doc_lines l on l.doc_id = g.doc_id and l.line_no > g.from_line and l.line_no < g.after_line and length(l.line) > 0
group by g.doc_id, g.before having count(*) = 1
""",
)

# SEQ-06: scopes of five and more, the best of each document by markers, then place.
sql(
    "seq_detect_paragraphs",
    """
select doc_id, cast(scope as bigint) as scope, n_markers, cast(words as bigint) as words from (
  select doc_id, scope, n_markers, words, row_number() over (partition by doc_id order by n_markers desc, scope) as place from (
    select s.doc_id, s.scope, count(*) as n_markers, sum(@hits(m.line, '[^ ]+')) as words from scopes s join markers m on m.doc_id = s.doc_id and m.line_no = s.line_no group by s.doc_id, s.scope) a
  where n_markers >= 5) b where place = 1
""",
)

# SEQ-07: chains of page marks; the longest counts if it is the only one of its length and has three.
sql(
    "seq_detect_pages",
    """
with marks as (select doc_id, line_no, @int(regexp_extract(marker, '([0-9]+)', 1)) as page from paged),
chains as (select doc_id, line_no, page, sum(case when page = before + 1 then 0 else 1 end) over (partition by doc_id order by line_no) as chain
           from (select doc_id, line_no, page, lag(page) over (partition by doc_id order by line_no) as before from marks) b),
sizes as (select doc_id, chain, count(*) as n from chains group by doc_id, chain),
best as (select doc_id, max(chain) as chain from (select doc_id, chain, n, max(n) over (partition by doc_id) as top from sizes) s where n = top and n >= 3 group by doc_id having count(*) = 1)
select c.doc_id, c.page, c.line_no as first_line, lead(c.line_no) over (partition by c.doc_id order by c.line_no) as end_line
from chains c join best b on b.doc_id = c.doc_id and b.chain = c.chain
""",
)

# SEQ-08
sql(
    "seq_sections",
    """
select doc_id, line_no, case when @like(line, '^[0-9]+[.] ') then 'dotted' when @like(line, '^#+ ') then 'markdown' when @like(line, '^[*][*]') then 'bold' else 'none' end as family,
       regexp_extract(line, '^([0-9]+)[.] ', 1) as label from sectioned
""",
)

# SEQ-11: which order of dotted labels has fewer inversions.
sql(
    "seq_dotted_order",
    """
with marks_of as (select doc_id, line_no, line_no % 3 + 1 as a, (line_no * 7) % 13 + 1 as b from doc_lines),
turns as (select doc_id,
  case when a * 1000 + b < lag(a * 1000 + b) over (partition by doc_id order by line_no) then 1 else 0 end as by_component,
  case when concat(a, '.', b) < lag(concat(a, '.', b)) over (partition by doc_id order by line_no) then 1 else 0 end as by_fraction from marks_of)
select doc_id, cast(sum(by_component) as bigint) as component_turns, cast(sum(by_fraction) as bigint) as fraction_turns,
       case when sum(by_component) < sum(by_fraction) then 'component' when sum(by_component) > sum(by_fraction) then 'fraction' end as mode from turns group by doc_id
""",
)

# SEQ-12: two readings of sections merged by label.
sql(
    "seq_merge_sections",
    """
with x as (select doc_id, lower(label) as label, min(line_no) as line_no from claims where line_no % 3 <> 0 group by doc_id, lower(label)),
y as (select doc_id, lower(label) as label, min(line_no) as line_no from claims where line_no % 2 = 0 group by doc_id, lower(label))
select coalesce(x.doc_id, y.doc_id) as doc_id, coalesce(x.label, y.label) as label, coalesce(x.line_no, y.line_no) as line_no,
       case when x.label is null then 'second' when y.label is null then 'first' else 'both' end as found_by
from x full outer join y on x.doc_id = y.doc_id and x.label = y.label
""",
)

# SEQ-16: prose blocks between blank (here: short) lines.
sql(
    "seq_prose_blocks",
    """
select doc_id, cast(block as bigint) as block, min(line_no) as first_line, max(line_no) as last_line, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from (
  select doc_id, line_no, line, blank, sum(blank) over (partition by doc_id order by line_no) as block
  from (select doc_id, line_no, line, case when length(line) < 20 then 1 else 0 end as blank from doc_lines) b) c
where blank = 0 group by doc_id, block
""",
)

# SEQ-18: a decision table over observations of each line.
sql(
    "seq_resolve_candidates",
    """
select doc_id, line_no, case when excluded then 'excluded' when rooted then 'numeric prose' when hierarchy then 'section' when list_item then 'list item' else 'insufficient' end as verdict
from (select doc_id, line_no, length(line) < 12 as excluded, @like(line, '^1[.] ') as rooted, @like(line, '^[0-9]+[.] ') as hierarchy, @like(line, '^[(][a-z][)] ') as list_item from sectioned) o
""",
)

# SEQ-21: the longest run of numbers that go up by one.
sql("seq_longest_run", "select doc_id, max(n) as longest from (select doc_id, scope, count(*) as n from scopes group by doc_id, scope) s group by doc_id")

# SEQ-22: folios with a constant offset to the page number, four pages and more.
sql(
    "seq_folios",
    """
with folios as (select distinct doc_id, page_number, page_number + doc_id % 3 + case when page_number % 6 = 0 then 1 else 0 end as printed from layout)
select doc_id, printed - page_number as shift, island, count(*) as n_pages, min(page_number) as first_page from (
  select doc_id, page_number, printed, page_number - row_number() over (partition by doc_id, printed - page_number order by page_number) as island from folios) i
group by doc_id, printed - page_number, island having count(*) >= 4
""",
)

# SEQ-23, SEQ-24: flow from line to line.
sql(
    "seq_text_flow",
    """
select doc_id, source_index, coalesce(region_type <> after_region and @like(text, '-$'), false) as boundary_fault, after_text is null and @like(text, '-$') as dangling,
       coalesce(region_type = after_region and not @like(text, '[.!?]$') and @like(after_text, '^[a-z]'), false) as continues
from (select doc_id, source_index, region_type, case when source_index % 5 = 0 then concat(text, '-') else text end as text,
             lead(region_type) over (partition by doc_id order by source_index) as after_region, lead(text) over (partition by doc_id order by source_index) as after_text from layout) l
""",
)

# SEQ-26: the text since the note before, in the same paragraph.
sql(
    "seq_propositions",
    """
with anchors as (select n.doc_id, n.pair_id, n.label, cast(floor(n.line_no / 4) as bigint) as paragraph, c.range_end as until from notes n join claims c on c.doc_id = n.doc_id and c.line_no = n.line_no),
spans as (select doc_id, pair_id, until, coalesce(lag(until) over (partition by doc_id, paragraph order by label), greatest(0, until - 80)) as since from anchors)
select s.doc_id, pair_id, since, until, substring(text, cast(since as int) + 1, cast(until - since as int)) as proposition from spans s join documents d on d.doc_id = s.doc_id
""",
)

# SEQ-27: runs of lines of one region and block.
sql(
    "seq_build_regions",
    """
select doc_id, page_number, region_type, cast(island as bigint) as island, min(source_index) as first_line, max(source_index) as last_line, count(*) as n_lines, min(y0) as y0, max(y1) as y1 from (
  select doc_id, page_number, region_type, source_index, y0, y1, sum(fresh) over (partition by doc_id, page_number order by source_index) as island from (
    select doc_id, page_number, region_type, source_index, y0, y1, case when region_type = lag(region_type) over (partition by doc_id, page_number order by source_index)
      and block_index = lag(block_index) over (partition by doc_id, page_number order by source_index) then 0 else 1 end as fresh from layout) f) i
group by doc_id, page_number, region_type, island
""",
)

# SEQ-28: body paragraphs with note anchors put in.
sql(
    "seq_build_paragraphs",
    """
select l.doc_id, l.block_index, @join(case when n.pair_id is null then l.text else concat(l.text, '⟦FN:', n.pair_id, '⟧') end, ' ', l.source_index) as paragraph, count(n.pair_id) as n_anchors
from layout l left join notes n on n.doc_id = l.doc_id and n.line_no + 1 = l.source_index where l.region_type = 'body' group by l.doc_id, l.block_index
""",
)

# SEQ-30: ids by place.
sql(
    "seq_line_ids",
    """
select doc_id, source_index, concat('p', lpad(cast(page_number as varchar(9)), 4, '0'), '-l', lpad(cast(row_number() over (partition by doc_id, page_number order by y0, x0, source_index) as varchar(9)), 4, '0')) as line_id from layout
""",
)

# SEQ-31: neighbours on one base line.
sql(
    "seq_baseline_groups",
    """
select doc_id, cast(grp as bigint) as grp, min(source_index) as first_line, count(*) as n_items from (
  select doc_id, source_index, sum(fresh) over (partition by doc_id order by source_index) as grp from (
    select doc_id, source_index, case when abs(y - lag(y) over (partition by doc_id order by source_index)) <= 0.8e0 * size then 0 else 1 end as fresh
    from (select doc_id, source_index, size, y0 - 54.0e0 * (source_index % 2) as y from layout) l) f) g group by doc_id, grp
""",
)
