"""Aggregations, distinct rows, top lists and orders."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import dialect
from docloom.operators import labels
from docloom.plans.registry import query, sql

# AGG-01: the numbered paragraphs of each document, with the missing ones.
RANGES = """
with bounds as (select doc_id, count(*) as n_blocks, min(number) as first_n, max(number) as last_n from markers group by doc_id),
wanted as (select doc_id, @seq(first_n, last_n) as number from bounds),
missing as (select w.doc_id, w.number, row_number() over (partition by w.doc_id order by w.number) as place, count(*) over (partition by w.doc_id) as n_missing
            from wanted w where not exists (select 1 from markers m where m.doc_id = w.doc_id and m.number = w.number)),
short as (select doc_id, max(n_missing) as n_missing, @join(cast(number as varchar(9)), ',', number) as missing from missing where place <= 64 group by doc_id)
select b.doc_id, n_blocks, first_n, last_n, coalesce(n_missing, 0) as n_missing, coalesce(missing, '') as missing, coalesce(n_missing, 0) > 64 as truncated
from bounds b left join short s on s.doc_id = b.doc_id
"""
sql("block_ranges", RANGES)

# AGG-02: labels that name one block only.
sql(
    "agg_label_index",
    """
with keys as (select distinct doc_id, lower(label) as label, line_no from claims union select distinct doc_id, concat('n', line_no % 9) as label, line_no from claims)
select doc_id, label, min(line_no) as line_no from keys group by doc_id, label having count(*) = 1
""",
)

# AGG-03: blocks in the order of start, end and label.
sql("agg_blocks", "select doc_id, label, kind, cast(row_number() over (partition by doc_id order by range_start, range_end, label) as bigint) as place, cast(row_number() over (partition by doc_id, kind order by range_start, label) as bigint) as of_kind from claims")

# AGG-04: corpus counts by two keys on their own, and the ten largest documents.
sql("agg_corpus_counts", "select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by grouping sets ((lang), (source))")
sql("agg_top_documents", "select doc_id, n_lines from (select doc_id, count(*) as n_lines from doc_lines group by doc_id) c order by n_lines desc, doc_id limit 10")

# AGG-05
sql(
    "agg_structure_stats",
    """
select c.doc_id, count(*) filter (where kind = 'section') as n_sections, count(*) filter (where kind = 'paragraph') as n_paragraphs, count(*) filter (where state = 'absent') as n_absent, min(text_sha256) as text_sha256
from claims c join (select doc_id, @sha(text) as text_sha256 from documents) d on d.doc_id = c.doc_id group by c.doc_id
""",
)

# AGG-06: running heads: keys at one place on enough pages.
sql(
    "agg_repeated_furniture",
    """
with keyed as (select doc_id, page_number, region_type, @sub(lower(text), '[0-9]+', '#') as key_text, y0 from layout where region_type in ('header', 'footer')),
pages_of as (select doc_id, max(page_number) as n_pages from layout group by doc_id)
select k.doc_id, region_type, key_text, count(distinct page_number) as n, min(y0) as y0
from keyed k join pages_of p on p.doc_id = k.doc_id group by k.doc_id, region_type, key_text, n_pages
having count(distinct page_number) >= least(4, greatest(2, ceil(0.35e0 * n_pages)))
""",
)

# AGG-07: the largest font size with a tenth of the characters.
sql(
    "agg_body_size",
    """
select doc_id, max(size) as body_size from (
  select doc_id, size, sum(length(text)) as chars, sum(sum(length(text))) over (partition by doc_id) as total from layout group by doc_id, size) s
where chars * 10 >= total group by doc_id
""",
)

# AGG-08: one printed label for a page, or none if they differ.
sql(
    "agg_page_labels",
    """
with found as (select doc_id, page_number, region_type, regexp_extract(text, '([0-9]+)$', 1) as label from layout where region_type in ('header', 'footer'))
select doc_id, page_number, case when count(distinct label) > 1 then 'ambiguous' else min(label) end as label, count(*) as n from found where label <> '' group by doc_id, page_number
""",
)

# AGG-09: pages whose numbers hold all of 1 to 6 (transcript line numbers).
sql(
    "agg_transcript_pages",
    """
select doc_id, page_number, count(distinct number) as n_numbers from (select doc_id, page_number, (source_index - 1) % 12 + 1 as number from layout) l
where number <= 6 group by doc_id, page_number having count(distinct number) = 6
""",
)

# AGG-10: rows of a table by their height on the page.
sql(
    "agg_table_rows",
    """
select doc_id, page_number, row_key, count(*) as n_cells, min(x0) as x0, max(x1) as x1, cast(sum(case when @like(text, '[0-9]') then 1 else 0 end) as bigint) as n_numeric
from (select doc_id, page_number, cast(floor(y0 / 81.0e0) as bigint) as row_key, x0, x1, text from layout) l group by doc_id, page_number, row_key having count(*) >= 2
""",
)

# AGG-12, AGG-13, AGG-22: orders by computed keys.
sql("agg_geometry_order", "select doc_id, source_index, cast(row_number() over (partition by doc_id, page_number order by (y0 + y1) / 2, (x0 + x1) / 2, x0, source_index) as bigint) as place from layout")
sql("agg_column_order", "select doc_id, source_index, cast(row_number() over (partition by doc_id, page_number order by floor(y0 / 216.0e0), case when (x0 + x1) / 2 < 220 then 0 else 1 end, y0, source_index) as bigint) as place from layout")
sql("agg_region_order", "select doc_id, source_index, cast(row_number() over (partition by doc_id, page_number order by case region_type when 'header' then 0 when 'body' then 1 when 'footnote' then 2 else 3 end, y0, x0, source_index) as bigint) as place from layout")

# AGG-14: source order stays unless the other order switches less.
sql(
    "agg_body_order",
    """
with rows_of as (select doc_id, source_index, case when source_index % 4 < 2 then 0 else 1 end as side, y0 from layout where region_type = 'body'),
a as (select doc_id, sum(case when side <> before then 1 else 0 end) as n from (select doc_id, side, lag(side) over (partition by doc_id order by source_index) as before from rows_of) x group by doc_id),
b as (select doc_id, sum(case when side <> before then 1 else 0 end) as n from (select doc_id, side, lag(side) over (partition by doc_id order by side, y0, source_index) as before from rows_of) x group by doc_id)
select a.doc_id, cast(a.n as bigint) as source_switches, cast(b.n as bigint) as other_switches, case when b.n < a.n then 'columns' else 'source' end as chosen from a join b on a.doc_id = b.doc_id
""",
)

# AGG-15: pages put together: head, body and notes, foot.
sql("agg_order_page", "select doc_id, page_number, @join(cast(source_index as varchar(9)), ',', band * 100000 + source_index) as reading_order from (select doc_id, page_number, source_index, case region_type when 'header' then 0 when 'footer' then 2 else 1 end as band from layout) l group by doc_id, page_number")

# AGG-16: relations once, the first of each.
sql(
    "agg_unique_relations",
    """
select doc_id, kind, from_id, to_id, seq from (
  select doc_id, kind, from_id, to_id, seq, row_number() over (partition by doc_id, kind, from_id, to_id order by seq) as place
  from (select doc_id, 'references' as kind, label % 4 as from_id, line_no % 6 as to_id, line_no as seq from notes) r) p where place = 1
""",
)

# AGG-18: notes with a counter of occurrences of their target.
sql("agg_note_occurrences", "select doc_id, pair_id, target, cast(row_number() over (partition by doc_id, target order by label) as bigint) as occurrence from (select doc_id, pair_id, label, regexp_extract(body, 'note ([0-9]+)', 1) as target from notes) n")

# AGG-19
sql("agg_recognition", "select lang, count(*) as n, @even(@pctl(n_chars, 0.5), 4) as p50, @even(@pctl(n_chars, 0.95), 4) as p95, cast(sum(n_chars) as bigint) as total, max(n_chars) as largest from documents group by lang")

# AGG-20
sql(
    "agg_image_routes",
    """
select doc_id, page_number, cast(row_number() over (partition by doc_id, page_number order by source_index) as bigint) as image, case when share >= 0.75e0 then 'ocr' when share < 0.01e0 or y0 < 80 then 'ignore' else 'vision' end as route
from (select doc_id, page_number, source_index, y0, (x1 - x0) * (y1 - y0) * (source_index % 11) / 48000.0e0 as share from layout) i
""",
)

# AGG-21: labels in the order of the law. The oracle takes the labels' numbers apart: two at most, no zeros, no letters.
ENTRIES = "select doc_id, index, label from section_maps"
TURNS = """
with entry as (select doc_id, index, label, @like(label, '^[0-9]+$') as whole, @like(label, '^[0-9.]+$') as numbered from section_maps),
mapped as (select *, row_number() over (partition by doc_id order by not whole, case when whole then cast(label as bigint) end, index) as place from entry),
numbers as (
  select *, case when numbered then cast(split_part(label, '.', 1) as bigint) end as a, case when numbered and not whole then cast(split_part(label, '.', 2) as bigint) end as b,
         case when numbered and not whole then cast('0.' || split_part(label, '.', 2) as decimal(10, 8)) end as f from mapped),
pairs as (
  select doc_id, a * 1000 + b < lag(a * 1000 + b) over w as c_turn, a < lag(a) over w or a = lag(a) over w and f < lag(f) over w as f_turn from numbers where numbered and not whole window w as (partition by doc_id order by place)),
turns as (
  select n.doc_id, coalesce(c, 0) as component_turns, coalesce(t, 0) as fraction_turns, coalesce(t < c, false) as fraction from (select distinct doc_id from entry) n
  left join (select doc_id, count(*) filter (c_turn) as c, count(*) filter (f_turn) as t from pairs group by doc_id) p on p.doc_id = n.doc_id)
"""


@query("agg_ordered_sections", TURNS + """
select n.doc_id, index, label, row_number() over (partition by n.doc_id order by case when label = 'Preamble' then 0 when numbered then 1 else 2 end,
       case when numbered then a end, case when numbered then b is not null end, case when numbered then case when fraction then f else b end end, place) as place
from numbers n join turns t on t.doc_id = n.doc_id""")
def ordered_sections(spark, sf_dir):
    """AGG-21: section maps in the order of the law."""
    return labels.ordered_sections(dialect.run(spark, sf_dir, ENTRIES))


@query("seq_label_order", TURNS + "select * from turns")
def label_order(spark, sf_dir):
    """SEQ-11: how the dotted labels of each section map count."""
    return labels.dotted_order(labels.map_order(dialect.run(spark, sf_dir, ENTRIES)))


# Measures of recognition quality.
sql("evl_edit_distance", "select doc_id, line_no, cast(@edit(line, after) as bigint) as distance, cast(length(line) as bigint) as n_gold from (select doc_id, line_no, line, lead(line) over (partition by doc_id order by line_no) as after from (select doc_id, line_no, @sub(line, '[^ -~]', '') as line from doc_lines) a) l where after is not null")
sql("evl_summary", "select doc_id, cast(sum(d) as bigint) as errors, cast(sum(n) as bigint) as gold, @even(sum(d) / cast(sum(n) as double), 6) as cer from (select doc_id, @edit(line, after) as d, length(line) as n from (select doc_id, line_no, line, lead(line) over (partition by doc_id order by line_no) as after from (select doc_id, line_no, @sub(line, '[^ -~]', '') as line from doc_lines) a) l where after is not null) e group by doc_id having sum(n) > 0")


# Pairs of lines in the same order by both orders. The oracle lists all pairs; the query counts, at each line, the lines before with each smaller rank.
RANKS = 11
AGREEMENT = "select doc_id, line_no, line_no * 7 % 11 as other from doc_lines"


@query("evl_order_agreement", f"select a.doc_id, count(*) as pairs, count(*) filter (where a.other < b.other) as concordant from ({AGREEMENT}) a join ({AGREEMENT}) b on a.doc_id = b.doc_id and a.line_no < b.line_no group by a.doc_id")
def order_agreement(spark, sf_dir):
    """Linear in the lines: ``other`` has RANKS values."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = dialect.run(spark, sf_dir, AGREEMENT)
    smaller = [F.when(F.col("other") > k, F.coalesce(F.sum(F.when(F.col("other") == k, 1)).over(before), F.lit(0))).otherwise(0) for k in range(RANKS)]
    rows = rows.select("doc_id", F.count("*").over(before).alias("n_before"), sum(smaller[1:], smaller[0]).alias("n_smaller"))
    return rows.groupBy("doc_id").agg(F.sum("n_before").alias("pairs"), F.sum("n_smaller").alias("concordant")).where("pairs > 0")


sql("evl_nearest_rank", "select doc_id, cast(max(n) as bigint) as p90 from (select doc_id, length(line) as n, row_number() over (partition by doc_id order by length(line)) - 1 as place, count(*) over (partition by doc_id) as total from doc_lines) r where place <= @even((total - 1) * 0.9e0, 0) group by doc_id")
