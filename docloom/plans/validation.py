"""Constraint queries: violations are rows, not failures."""

from docloom.functions import dialect
from docloom.operators import pages
from docloom.plans.registry import query, sql

# VAL-01: each kind's ranges in order must not overlap, and the text must have its stated hash.
sql(
    "val_evidence_tiling",
    """
select doc_id, kind, count(*) as n_ranges,
       count(*) filter (where before is not null and range_start < before) as n_overlaps,
       count(*) filter (where before is not null and range_start > before) as n_gaps,
       min(range_start) as first_start, max(range_end) as last_end
from (select doc_id, kind, range_start, range_end, max(range_end) over (partition by doc_id, kind order by range_start, range_end rows between unbounded preceding and 1 preceding) as before from claims) c
group by doc_id, kind
""",
)
sql("val_text_hash", "select doc_id, @sha(text) as text_sha256, cast(length(text) as bigint) as n_scalars, @u16(text) as n_utf16 from documents")

# VAL-02: unique ids, and ranges that end inside the text.
sql(
    "val_document_ranges",
    """
select c.doc_id, count(*) as n_claims, count(distinct label) as n_labels,
       count(*) filter (where range_end > n_scalars) as n_beyond,
       count(*) filter (where range_start > range_end) as n_reversed
from claims c join (select doc_id, length(text) as n_scalars from documents) d on c.doc_id = d.doc_id group by c.doc_id
""",
)

# VAL-03: regions of a page partition its lines.
sql(
    "val_page_records",
    """
select doc_id, page_number, count(*) as n_lines, count(distinct source_index) as n_ids, count(distinct region_type) as n_regions,
       max(source_index) - min(source_index) + 1 - count(*) as n_missing,
       count(*) filter (where x1 < x0 or y1 < y0) as n_bad_boxes
from layout group by doc_id, page_number
""",
)

# VAL-04: as many footer separators as pages.
sql(
    "val_separators",
    """
select doc_id, count(distinct page_number) as n_pages, count(distinct case when region_type = 'footnote' then page_number end) as n_separators,
       case when count(distinct page_number) = count(distinct case when region_type = 'footnote' then page_number end) then 'ok' else 'mismatch' end as verdict
from layout group by doc_id
""",
)

# VAL-05: the worst of a document's pages.
sql(
    "val_status",
    """
select doc_id, case when bool_and(chars < 40) then 'ocr_required' when bool_or(chars < 40) then 'degraded' else 'ready' end as status, count(*) as n_pages
from (select doc_id, page_number, sum(length(text)) as chars from layout group by doc_id, page_number) p group by doc_id
""",
)

# VAL-06: inferred ranges are dropped inside complete coverage of their kind, else cut at the next one.
sql(
    "val_clip_inference",
    """
with stops as (select doc_id, kind, range_start as a, range_end as b from claims where state = 'complete' and range_end > range_start)
select r.doc_id, r.label, r.range_start, least(r.range_end, coalesce(min(s.a) filter (where s.a > r.range_start), r.range_end)) as range_end
from (select doc_id, 'section' as kind, label, range_start, range_end + 200 as range_end from claims where state <> 'complete') r
left join stops s on s.doc_id = r.doc_id and s.kind = r.kind and s.b > r.range_start and s.a < r.range_end
group by r.doc_id, r.label, r.range_start, r.range_end
having not coalesce(bool_or(s.a <= r.range_start and r.range_start < s.b), false)
""",
)

# VAL-07: paragraphs are cut at exclusions and dropped when no letter is left.
sql(
    "val_clip_paragraphs",
    """
select p.doc_id, p.label, p.range_start, least(p.range_end, coalesce(min(e.range_start), p.range_end)) as range_end
from claims p join documents d on d.doc_id = p.doc_id
left join claims e on e.doc_id = p.doc_id and e.state = 'augment' and e.range_start > p.range_start and e.range_start < p.range_end
where p.kind = 'paragraph' and @like(substring(d.text, cast(p.range_start as int) + 1, cast(p.range_end - p.range_start as int)), '[A-Za-z]')
group by p.doc_id, p.label, p.range_start, p.range_end
""",
)

# VAL-08
sql("val_needs_recovery", "select doc_id, bool_or(state <> 'complete') as needs_recovery, count(*) filter (where state <> 'complete') as n_open from claims group by doc_id")

# VAL-09: a lookup request is checked field by field.
sql(
    "val_lookup_request",
    """
select doc_id, label, kind, case
         when kind not in ('page', 'paragraph', 'section', 'footnote') then 'unknown kind'
         when @u16(locator) > 200 or locator = '' then 'bad locator'
         when context < 0 or context > 2 then 'bad context'
         when occurrence < 1 then 'bad occurrence' else 'ok' end as verdict
from (select doc_id, label, case label % 5 when 0 then 'page' when 1 then 'paragraph' when 2 then 'section' when 3 then 'footnote' else 'table' end as kind,
             @left(body, cast(label % 40 as int)) as locator, line_no % 4 as context, label % 3 as occurrence from notes) r
""",
)


# VAL-05 by diagnostics. The oracle counts pages in a query of their own.
@query(
    "val_document_status",
    """
with n as (select doc_id, count(*) as n_pages from (select distinct doc_id, floor(line_no / 5) as page from doc_lines) p group by doc_id),
ocr as (select doc_id, count(*) as n_ocr from (select distinct doc_id, page from diagnosed where code = 'OCR_REQUIRED') o group by doc_id)
select n.doc_id, case when n_ocr = n_pages then 'ocr_required' when exists (select 1 from diagnosed d where d.doc_id = n.doc_id and severity <> 'info' and code <> 'FONT_MISSING') then 'degraded' else 'ready' end as status, n_pages
from n left join ocr on ocr.doc_id = n.doc_id""",
)
def document_status(spark, sf_dir):
    """VAL-05: whether a document is ready, degraded or needs OCR."""
    counted = dialect.run(spark, sf_dir, "select distinct doc_id, cast(floor(line_no / 5) as bigint) as page from doc_lines")
    return pages.statuses(counted, dialect.run(spark, sf_dir, "select doc_id, page, code, severity from diagnosed"))


# AGG-09: the oracle tries every band of every page.
@query(
    "agg_line_number_pages",
    """
with numbers as (select doc_id, page, x0 as x, width, cast(regexp_extract(text, '^\\s*-?\\s*([0-9]{1,4})\\s*-?\\s*$', 1) as int) as number from transcripts where width > 0 and regexp_matches(text, '^\\s*-?\\s*([0-9]{1,4})\\s*-?\\s*$')),
bands as (
  select a.doc_id, a.page, a.x, count(*) as n, count(distinct b.number) as n_numbers, count(distinct b.number) filter (b.number between 1 and 15) as low
  from (select distinct doc_id, page, x from numbers where number <= 40) a join numbers b on b.doc_id = a.doc_id and b.page = a.page and b.number <= 40 and b.x <= a.x and a.x - b.x <= b.width * 0.03e0 group by a.doc_id, a.page, a.x),
best as (select *, row_number() over (partition by doc_id, page order by n desc, x) as place from bands)
select doc_id, page, n_numbers from best where place = 1 and low = 15""",
)
def line_number_pages(spark, sf_dir):
    """AGG-09: pages of transcripts, by the numbers of their lines."""
    return pages.transcript_pages(dialect.run(spark, sf_dir, "select doc_id, page, x0, width, text from transcripts"))
