"""Locator queries: requests against units, with neighbours and a status."""

from docloom.plans.registry import sql

#: A request asks for a claim's label, or for one that isn't there.
REQUESTS = "requests as (select doc_id, label as request_id, case when label % 5 = 0 then 'sec9999' when label % 2 = 0 then concat('SEC', line_no + 1) else concat('par', line_no + 1) end as locator, cast(label % 3 as bigint) as context from notes)"

# LKP-01, JOIN-14: the unit, as many neighbours as asked for, and found or not.
sql(
    "lkp_structure_lookup",
    f"""
with {REQUESTS},
units as (select doc_id, lower(label) as label, line_no, range_start, range_end from claims),
hits as (select r.doc_id, r.request_id, r.context, u.line_no from requests r left join units u on u.doc_id = r.doc_id and u.label = lower(r.locator))
select h.doc_id, h.request_id, case when max(h.line_no) is null then 'not_found' when count(distinct h.line_no) > 1 then 'ambiguous' else 'found' end as status,
       count(u.line_no) as n_units, min(u.range_start) as range_start, max(u.range_end) as range_end
from hits h left join units u on u.doc_id = h.doc_id and u.line_no between h.line_no - h.context and h.line_no + h.context group by h.doc_id, h.request_id
""",
)

# JOIN-15: notes by label, with hints of page and occurrence.
sql(
    "lkp_footnote",
    """
with found as (select doc_id, line_no % 4 as label, pair_id, cast(floor(line_no / 12) as bigint) + 1 as page_number from notes),
asked as (select doc_id, label, case when doc_id % 2 = 0 then 1 end as page_hint from (select distinct doc_id, label from found) f)
select a.doc_id, a.label, case count(f.pair_id) when 0 then 'not_found' when 1 then 'found' else 'ambiguous' end as status, min(f.pair_id) as first_pair
from asked a left join found f on f.doc_id = a.doc_id and f.label = a.label and (a.page_hint is null or f.page_number = a.page_hint) group by a.doc_id, a.label
""",
)

# LKP-02: pages and their text as blocks with UTF-16 offsets.
sql(
    "lkp_source_doc",
    """
with page_text as (select doc_id, page_number, @join(text, ' ', source_index) as body from layout group by doc_id, page_number),
flat as (select doc_id, page_number, concat('[page ', page_number, '] ', body) as block from page_text)
select doc_id, concat('page', page_number) as label, cast(coalesce(sum(@u16(block) + 1) over (partition by doc_id order by page_number rows between unbounded preceding and 1 preceding), 0) as bigint) as start_at, @u16(block) as n_utf16 from flat
""",
)

# LKP-03, CLS-03, CLS-04: observations and the nodes they make.
sql(
    "lkp_graph_nodes",
    """
select doc_id, 'page' as kind, concat('page-', page_number) as id, min(source_index) as first_line, max(source_index) as last_line from layout group by doc_id, page_number
union all select doc_id, 'heading', concat('heading-', source_index), source_index, source_index from layout where region_type = 'body' and length(text) between 1 and 24
union all select doc_id, 'prose', concat('prose-', block_index), min(source_index), max(source_index) from layout where region_type = 'body' and length(text) > 24 group by doc_id, block_index
""",
)
sql(
    "cls_observations",
    """
select doc_id, source_index, concat_ws(',', case when length(text) > 60 then 'BodyProseFlow' end, case when length(text) between 1 and 24 and @like(text, '^[A-Z]') then 'SectionHeading' end,
  case when @like(text, '[|].*[|]') then 'TableOrForm' end, case when @like(text, '[.]{3,} ?[0-9]+$') then 'ContentsRow' end, case when region_type in ('header', 'footer') then 'Furniture' end) as observed from layout
""",
)
# CLS-07: keys at page edges on two pages and more.
sql(
    "cls_edge_furniture",
    """
with edges as (select doc_id, page_number, @sub(lower(text), '[0-9]+', '#') as k, row_number() over (partition by doc_id, page_number order by source_index) as from_top,
                      row_number() over (partition by doc_id, page_number order by source_index desc) as from_end from layout)
select doc_id, k, count(distinct page_number) as n_pages from edges where from_top <= 4 or from_end <= 4 group by doc_id, k having count(distinct page_number) >= 2
""",
)
# CLS-08: what speaks against digits as a note reference.
sql(
    "cls_ref_penalty",
    """
select doc_id, label, case when @like(body, 'note [0-9]+(st|nd|rd|th)') then 1.0e0 when @like(body, 'note [0-9]+[.][0-9]') then 0.9e0 when @like(body, 'note [0-9]+,') then 0.2e0 else 0.0e0 end as penalty from notes
""",
)
# CLS-09
sql("cls_separator_y", "select doc_id, page_number, max(y0) as separator_y from layout where region_type = 'body' group by doc_id, page_number")
# OCR-02, OCR-05, OCR-09: words to lines, notes after columns, and jobs by width.
sql("ocr_tsv_lines", "select doc_id, block_index, page_number, @join(text, ' ', source_index) as text, min(x0) as x0, max(x1) as x1, @even(avg(length(text) * 1.0e0), 4) as confidence from layout group by doc_id, block_index, page_number")
sql("ocr_order_footnotes", "select doc_id, source_index, cast(row_number() over (partition by doc_id, page_number order by case when region_type = 'footnote' then 1 else 0 end, source_index % 2, source_index) as bigint) as place from layout")
sql(
    "ocr_recognition_jobs",
    """
select doc_id, bucket, job, count(*) as n_lines, max(w) as widest from (
  select doc_id, bucket, w, cast(floor((row_number() over (partition by doc_id, bucket order by source_index) - 1) / 16) as bigint) as job
  from (select doc_id, source_index, x1 - x0 as w, cast(ceil((x1 - x0) / 64.0e0) as bigint) as bucket from layout) l) j group by doc_id, bucket, job
""",
)
