"""Queries over lookups and evidence operators; their oracles are written apart, as plain all-pairs DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import dialect
from docloom.operators import columns, evidence, locators, passages
from docloom.plans.registry import query
from docloom.sources import adapters

UNITS = """
select doc_id, 'page' as kind, page_number - 1 as place, page_number as number, concat('page-', page_number) as id, cast(null as string) as label,
       cast(null as string) as own_kind, page_number, cast(null as bigint) as occurrence, @join(text, ' ', source_index) as text from layout group by doc_id, page_number
union all select doc_id, 'paragraph', line_no, line_no + 1, concat('par-', line_no), null, null, cast(floor(line_no / 12) as bigint) + 1, null, line from doc_lines
union all select doc_id, 'footnote', label - 1, null, pair_id, cast(label % 9 as string), null, cast(floor(line_no / 12) as bigint) + 1, cast(floor(label / 9) as bigint) + 1, body from notes
union all select doc_id, 'section', cast(row_number() over (partition by doc_id order by line_no) as bigint) - 1, null, concat('n', line_no),
       regexp_extract(line, '^[^ ]+', 0), case when line_no % 2 = 0 then 'article' end, cast(floor(line_no / 12) as bigint) + 1, null, line from sectioned where @like(line, '^[0-9(]')
"""
#: Eight requests of each document; their numbers follow from doc_id.
ASKED = """
select doc_id, k as request_id,
       case k when 0 then 'page' when 1 then 'paragraph' when 2 then 'footnote' when 3 then 'footnote' when 4 then 'section' when 5 then 'article' when 6 then 'schedule' else 'paragraph' end as locator_kind,
       case k when 0 then concat('pp. ', doc_id % 3 + 1, '-', doc_id % 3 + 1 + doc_id % 2) when 1 then concat('para ', doc_id % 40 + 1) when 2 then concat('Note ', doc_id % 9)
              when 3 then concat('fn. ', doc_id % 9) when 4 then concat(' ', doc_id % 7 + 1, '. ') when 5 then '(A)' when 6 then '1' else concat(doc_id % 5 + 1, ' to ', doc_id % 30 + 1) end as locator,
       cast(k % 3 as bigint) as context, cast(case when k = 3 then doc_id % 2 + 1 end as bigint) as occurrence
from (select doc_id, @seq(0, 7) as k from documents) q
"""


@query(
    "lkp_locators",
    f"""
with units as ({UNITS}),
asked as ({ASKED}),
wanted as (select *, case when locator_kind in ('page', 'paragraph', 'footnote') then locator_kind else 'section' end as unit_kind,
  case when request_id = 0 then doc_id % 3 + 1 when request_id = 1 then doc_id % 40 + 1 when request_id = 7 then doc_id % 5 + 1 end as lo,
  case when request_id = 0 then doc_id % 3 + 1 + doc_id % 2 when request_id = 1 then doc_id % 40 + 1 when request_id = 7 then doc_id % 30 + 1 end as hi from asked),
hits as (select w.doc_id, w.request_id, u.place, case when u.number = w.hi then 1 else 0 end as is_hi, case when u.number = w.lo then 1 else 0 end as is_lo
  from wanted w join units u on u.doc_id = w.doc_id and u.kind = w.unit_kind and (u.number in (w.lo, w.hi)
    or (w.unit_kind = 'footnote' and (w.occurrence is null or u.occurrence = w.occurrence) and cast(w.doc_id % 9 as varchar) in (u.label, replace(u.id, 'note-', '')))
    or (w.request_id = 4 and (u.label = concat(w.doc_id % 7 + 1, '.'))) or (w.request_id = 5 and u.own_kind = 'article' and u.label = '(a)'))),
ends as (select doc_id, request_id, count(distinct place) as n, case when request_id in (0, 1, 7) then min(case when is_lo = 1 then place end) else min(place) end as a,
  case when request_id in (0, 1, 7) then min(case when is_hi = 1 then place end) else min(place) end as b from hits group by doc_id, request_id),
has as (select doc_id, count(case when own_kind = 'article' then 1 end) as n_articles from units group by doc_id),
state as (select w.doc_id, w.request_id, w.unit_kind, w.context, e.a, e.b,
  case when w.lo > w.hi then 'invalid' when w.request_id = 6 or (w.request_id = 5 and h.n_articles = 0) then 'unavailable'
       when w.lo is null and e.n > 1 then 'ambiguous' when e.a is null or e.b is null then 'not_found' when e.b - e.a >= 20 then 'invalid' end as early
  from wanted w left join ends e on e.doc_id = w.doc_id and e.request_id = w.request_id left join has h on h.doc_id = w.doc_id),
got as (select s.doc_id, s.request_id, s.early, count(case when u.place between s.a and s.b then 1 end) as n_units, count(case when u.place < s.a then 1 end) as n_before,
  count(case when u.place > s.b then 1 end) as n_after, min(case when u.place = s.a then u.id end) as first_id, sum(@u16(u.text)) as size,
  count(case when u.place between s.a and s.b and u.text = '' then 1 end) as hollow
  from state s left join units u on s.early is null and u.doc_id = s.doc_id and u.kind = s.unit_kind and u.place between s.a - s.context and s.b + s.context group by s.doc_id, s.request_id, s.early),
named as (select *, coalesce(early, case when hollow > 0 then 'unavailable' when size > 60000 then 'invalid' else 'found' end) as status from got)
select doc_id, request_id, status, case when status = 'found' then n_units else 0 end as n_units, case when status = 'found' then n_before else 0 end as n_before,
  case when status = 'found' then n_after else 0 end as n_after, case when status = 'found' then first_id end as first_id, cast(case when status = 'found' then size end as bigint) as n_utf16 from named
""",
)
def structure_lookup(spark, sf_dir):
    """LKP-01, JOIN-14: eight requests of each document against its pages, lines, notes and sections."""
    units = dialect.run(spark, sf_dir, f"select *, cast(null as array<string>) as aliases from ({UNITS}) u").withColumnRenamed("own_kind", "locator_kind").withColumn("pages", F.array("page_number"))
    asked = dialect.run(spark, sf_dir, f"select *, cast(null as string) as end_locator, cast(null as bigint) as page from ({ASKED}) a")
    found = locators.structure_lookup(units, asked)
    size = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return found.select("doc_id", "request_id", "status", size("units"), size("before"), size("after"), F.get("units", F.lit(0)).alias("first_id"), "n_utf16")


NOTES = """
select doc_id, label - 1 as place, pair_id, cast(label % 9 as string) as label, cast(floor(label / 9) as bigint) + 1 as occurrence, cast(floor(line_no / 12) as bigint) + 1 as reference_page,
       cast(floor((line_no + 3) / 12) as bigint) + 1 as body_page, concat('line-', line_no) as reference_line_id, body as sentence_proposition, concat('since ', body) as passage_since_prior_note from notes
"""


@query(
    "lkp_note_requests",
    f"""
with found as ({NOTES}),
asked as (select doc_id, cast(k as bigint) as request_id, k from (select doc_id, unnest([0, 1, 2, 3]) as k from documents) q),
hits as (select a.doc_id, a.request_id, a.k, f.place, f.pair_id, f.sentence_proposition, f.passage_since_prior_note, f.reference_line_id from asked a join found f on f.doc_id = a.doc_id
  and ((a.k < 3 and f.label = cast(a.doc_id % 9 as varchar)) or (a.k = 3 and f.pair_id = concat('note-', a.doc_id % 9)))
  and (a.k <> 1 or 1 in (f.reference_page, f.body_page)) and (a.k <> 2 or f.occurrence = 1)),
per as (select doc_id, request_id, count(*) as n, min(place) as place from hits group by doc_id, request_id),
lines as (select doc_id, concat('line-', line_no) as id, line from doc_lines)
select a.doc_id, a.request_id, case when p.n is null then 'not_found' when p.n > 1 then 'ambiguous' else 'found' end as status, coalesce(p.n, 0) as n_matches,
  case when p.n = 1 then case when a.k = 2 then h.passage_since_prior_note else h.sentence_proposition end else '' end as proposition,
  case when p.n = 1 then coalesce(left(l.line, 2000), '') else '' end as context
from asked a left join per p on p.doc_id = a.doc_id and p.request_id = a.request_id left join hits h on h.doc_id = p.doc_id and h.request_id = p.request_id and h.place = p.place
left join lines l on l.doc_id = h.doc_id and l.id = h.reference_line_id
""",
)
def lookup_footnote(spark, sf_dir):
    """JOIN-15: notes by label, by page, by occurrence and by pair, with what they speak of."""
    notes = dialect.run(spark, sf_dir, NOTES).withColumn("body_pages", F.array("body_page"))
    lines = dialect.run(spark, sf_dir, "select doc_id, line_no as place, array(concat('line-', line_no)) as line_ids, line as text from doc_lines")
    asked = dialect.run(
        spark,
        sf_dir,
        """select doc_id, cast(k as bigint) as request_id, case when k = 3 then concat('note-', doc_id % 9) else concat(' ', translate(cast(doc_id % 9 as string), '123', '¹²³')) end as query,
        case when k = 1 then 1L end as page, case when k = 2 then 1L end as occurrence, case when k = 2 then 'passage_since_prior_note' else 'sentence' end as mode from (select doc_id, explode(array(0, 1, 2, 3)) as k from documents) q""",
    )
    got = locators.lookup_footnote(notes, lines, asked)
    return got.select("doc_id", "request_id", "status", F.size("matches").cast("bigint").alias("n_matches"), "proposition", "context")


@query(
    "agg_token_usage",
    """
with lines as (select user_id, concat('{"event": [{"usage": {"input_tokens": ', cast(floor(value) as bigint), ', "total_tokens": ', event_id, '}, "props": ', props, '}]}') as line from events where event_id % 5 > 0
  union all select user_id, concat('{"input_tokens": {"output_tokens": 9}, "output_tokens": ', event_id % 97, '}') from events where event_id % 5 = 0)
select l.user_id as doc_id, t.key as counter, max(cast(t.atom as bigint)) as tokens from lines l, json_tree(l.line) t
where t.key in ('input_tokens', 'output_tokens', 'cached_input_tokens', 'total_tokens') and t.type in ('BIGINT', 'UBIGINT') and not contains(t.path, '_tokens') group by all
""",
)
def token_usage(spark, sf_dir):
    """AGG-23: the greatest counters of each user's JSON lines."""
    lines = dialect.run(
        spark,
        sf_dir,
        """select user_id as doc_id, case when event_id % 5 = 0 then concat('{"input_tokens": {"output_tokens": 9}, "output_tokens": ', event_id % 97, '}')
        else concat('{"event": [{"usage": {"input_tokens": ', cast(floor(value) as bigint), ', "total_tokens": ', event_id, '}, "props": ', props, '}]}') end as line from events""",
    )
    return evidence.token_usage(lines)


@query("seq_numeric_runs")
def numeric_runs(spark, sf_dir):
    """SEQ-17: candidate runs of the paragraph markers of each document."""
    rows = dialect.run(spark, sf_dir, "select m.doc_id, m.line_no as position, case when m.line_no % 4 = 3 then m.number + 30 else m.number end as number, m.style, length(d.text) as n_chars from markers m join documents d on d.doc_id = m.doc_id")
    return evidence.numeric_runs(rows)


@query("seq_note_modes")
def note_modes(spark, sf_dir):
    """SEQ-25: the modes of note lines, pages in order."""
    lines = dialect.run(spark, sf_dir, "select doc_id, page_number as page, source_index as place, case when (page_number + doc_id) % 4 = 0 and source_index % 12 = 2 then 'Notes' else text end as text, region_type, case when region_type = 'footnote' and source_index % 2 = 0 then source_index end as number, '' as mode from layout")
    return evidence.note_region_modes(lines).groupBy("doc_id", "page", "mode").agg(F.count("*").alias("n_lines"))


@query(
    "seq_isolated_references",
    "select doc_id, source_index as line_id, cast(source_index % 1000 as varchar) as note_id, cast(length(text) as bigint) as start_offset, cast(length(text) + length(cast(source_index % 1000 as varchar)) as bigint) as end_offset from layout where length(text) > 0 and source_index % 7 >= greatest(size, 1) * 0.25 and doc_id % 3 <> 2",
)
def isolated_references(spark, sf_dir):
    """SEQ-32: digits put behind lines, some raised and some apart."""
    lines = dialect.run(
        spark,
        sf_dir,
        """select doc_id, source_index as line_id, concat(text, source_index % 1000) as text, array(
          named_struct('text', text, 'start', 0, 'end', length(text), 'x0', x0, 'x1', x1, 'size', size, 'superscript', false),
          named_struct('text', cast(source_index % 1000 as string), 'start', length(text), 'end', length(text) + length(cast(source_index % 1000 as string)), 'x0', x1 + source_index % 7, 'x1', x1 + 12, 'size', 6.0e0, 'superscript', doc_id % 3 <> 2)) as spans
          from layout where length(text) > 0""",
    )
    return evidence.isolated_references(lines).withColumns({c: F.col(c).cast("bigint") for c in ("start_offset", "end_offset")})


@query(
    "join_detached_target",
    """
with marks as (select *, x1 + 4 as mx, y0 + (source_index % 5) - 1 as my from layout where source_index % 6 = 2),
near as (select m.doc_id, m.page_number as page, m.source_index as reference, l.source_index as target, l.x0, l.x1, l.text, m.mx, abs(l.y0 - m.my) as height, abs(l.source_index - m.source_index) as apart
  from marks m join layout l on l.doc_id = m.doc_id and l.page_number = m.page_number
  where l.region_type not in ('header', 'footer') and l.size >= 8 and abs(l.y0 - m.my) <= greatest(0.2 * (l.y1 - l.y0), 2.0)),
sided as (select *, least(abs(mx - x0), abs(mx - x1)) as distance, case when abs(mx - x1) <= abs(mx - x0) then length(text) else 0 end as edge from near),
ranked as (select *, row_number() over (partition by doc_id, page, reference order by distance, height, apart, target) as k from sided where distance <= 10)
select doc_id, page, reference, target, cast(edge as bigint) as "offset" from ranked where k = 1
""",
)
def detached_target(spark, sf_dir):
    """JOIN-07: marks set off behind lines, and the lines that they belong to."""
    columns = "doc_id, page_number as page, source_index, y0, y1, size, region_type, false as excluded"
    lines = dialect.run(
        spark,
        sf_dir,
        f"""select {columns}, source_index as place, x0, x1, array(named_struct('start', 0L, 'end', cast(length(text) as bigint), 'x0', x0, 'x1', x1)) as spans from layout
        union all select doc_id, page_number, source_index, y0 + (source_index % 5) - 1, y1, 1.0e0, region_type, true, 0 - source_index, x1 + 3, x1 + 5, cast(array() as array<struct<start: bigint, end: bigint, x0: double, x1: double>>) from layout where source_index % 6 = 2""",
    )
    marks = lines.where("place < 0").select("doc_id", "page", "place", F.lit(10.0).alias("body_size"))
    return evidence.detached_targets(lines, marks).withColumn("reference", -F.col("reference"))


@query(
    "src_block_json",
    """select doc_id, line_no, concat('{"kind":"', kind, '","label":"', label, '","start":', range_start, ',"end":', range_end, case when line_no % 2 = 0 then ',"anchor":"#a"' else '' end,
    case when line_no % 3 = 0 then concat(',"aliases":["', line_no, '"]') when line_no % 4 = 1 then ',"aliases":[]' else '' end, ',"origin":"', state, '"}') as json from claims""",
)
def block_json(spark, sf_dir):
    """SRC-21: blocks in the order of native providers."""
    rows = dialect.run(
        spark,
        sf_dir,
        """select doc_id, line_no, kind, label, range_start as start, range_end as end, state as origin, case when line_no % 3 = 0 then array(cast(line_no as string)) else cast(array() as array<string>) end as aliases,
        case when line_no % 2 = 0 then '#a' end as anchor, cast(null as string) as parent_label, case when line_no % 4 = 1 then 'native_with_aliases' else 'native' end as field_order from claims""",
    )
    return adapters.block_json(rows).select("doc_id", "line_no", "json")


@query("txt_sentence_at")
def sentence_at(spark, sf_dir):
    """TXT-22: the sentences at the begin, the middle and the end of each line of a document."""
    texts = dialect.run(spark, sf_dir, "select doc_id as text_id, text from documents")
    spots = dialect.run(spark, sf_dir, "select doc_id as text_id, explode(array(range_start, floor((range_start + range_end) / 2), range_end)) as offset from claims")
    return passages.sentences_at(texts, spots)


@query("agg_column_model")
def column_model(spark, sf_dir):
    """AGG-11: columns of each page, the odd lines of some documents set in a second one."""
    lines = dialect.run(
        spark,
        sf_dir,
        """select doc_id, page_number as page, 612.0e0 as page_width, y0, y1, region_type, false as excluded, x0 + side * 240 as x0, least(x1, x0 + 200) + side * 240 as x1
        from (select *, case when doc_id % 2 = 0 then source_index % 2 else 0 end as side from layout) l""",
    )
    return columns.page_columns(lines)
