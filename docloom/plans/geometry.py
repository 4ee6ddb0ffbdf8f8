"""Boxes, font sizes and regions of a page layout."""

from docloom.plans.registry import sql

# GEO-01: the size at which half of a block's characters (at most 100 each) are reached.
sql(
    "geo_font_size",
    """
select doc_id, block_index, min(size) as font_size from (
  select doc_id, block_index, size, sum(w) over (partition by doc_id, block_index order by size) as upto, sum(w) over (partition by doc_id, block_index) as total
  from (select doc_id, block_index, size, greatest(1, least(100, length(text))) as w from layout) s) t
where upto > floor(total / 2) group by doc_id, block_index
""",
)

# GEO-02
sql("geo_union_bbox", "select doc_id, page_number, region_type, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from layout group by doc_id, page_number, region_type")

# GEO-04: small and raised.
sql(
    "geo_superscript",
    """
select doc_id, source_index, size <= 0.82e0 * body and y0 - line_y0 >= greatest(0.08e0 * body, 0.5e0) as is_superscript
from (select doc_id, source_index, size, y0, y0 - (source_index % 3) as line_y0, max(size) over (partition by doc_id) as body from layout) l
""",
)

# GEO-05: the smallest region that holds a line's centre, else the one it overlaps most.
sql(
    "geo_best_region",
    """
with regions as (select doc_id, page_number, region_type as region, min(x0) as rx0, min(y0) as ry0, max(x1) as rx1, max(y1) as ry1 from layout group by doc_id, page_number, region_type),
ranked as (
  select l.doc_id, l.source_index, r.region,
         row_number() over (partition by l.doc_id, l.source_index order by
           case when (l.x0 + l.x1) / 2 between rx0 and rx1 and (l.y0 + l.y1) / 2 between ry0 and ry1 then 0 else 1 end,
           (rx1 - rx0) * (ry1 - ry0), r.region) as place
  from layout l join regions r on r.doc_id = l.doc_id and r.page_number = l.page_number and r.ry0 <= l.y1 and r.ry1 >= l.y0)
select doc_id, source_index, region from ranked where place = 1
""",
)

# GEO-06, GEO-08, GEO-09: overlap of neighbours, scaled boxes and centres.
sql(
    "geo_iou",
    """
select doc_id, source_index, case when total > 0 then both_area / total else 0.0e0 end as iou from (
  select doc_id, source_index, both_area, (x1 - x0) * (y1 - y0) + (px1 - x0) * (y1 - y0) - both_area as total from (
    select doc_id, source_index, x0, x1, y0, y1, px1, greatest(0.0e0, least(x1, px1) - x0) * (y1 - y0) as both_area
    from (select doc_id, source_index, x0, x1, y0, y1, lag(x1) over (partition by doc_id, page_number order by source_index) as px1 from layout) a where px1 is not null) b) c
""",
)
sql("geo_scaled_boxes", "select doc_id, source_index, x0 * 0.24e0 as x0, y0 * 0.24e0 as y0, (x0 + x1) / 2 as center_x, x1 - x0 as width, x1 > x0 and y1 > y0 as valid from layout")

# GEO-07
sql("geo_percentile", "select doc_id, @even(@pctl(x1 - x0, 0.75), 6) as p75, @even(@pctl(x1 - x0, 0.5), 6) as p50 from layout group by doc_id")

# GEO-10: a blank where two items of a line are apart.
sql(
    "geo_assemble_line",
    """
with items as (select doc_id, block_index, source_index, text, 72.0e0 + source_index * 100.0e0 as x0, 72.0e0 + source_index * 100.0e0 + case when source_index % 3 = 0 then 99.5e0 else 80.0e0 end as x1, size from layout where length(text) > 0),
gaps as (select doc_id, block_index, source_index, text, x0 - lag(x1) over (partition by doc_id, block_index order by source_index) as gap, size from items)
select doc_id, block_index, @join(case when gap >= 0.15e0 * greatest(size, 10.0e0) then concat(' ', text) else text end, '', source_index) as line from gaps group by doc_id, block_index
""",
)

# GEO-12: one rule is a separator, two side by side are columns, more are unclear.
sql(
    "geo_separator",
    """
select doc_id, page_number, case when count(*) = 0 then 'none' when count(*) = 1 then 'found' when count(*) = 2 then 'two columns' else 'ambiguous' end as verdict, count(*) as n_rules
from layout where region_type = 'footnote' and x1 - x0 > 120 group by doc_id, page_number
""",
)

# GEO-13: the threshold of largest variance between classes, of a histogram of line lengths.
sql(
    "geo_otsu",
    """
with bins as (select doc_id, least(length(line), 255) as bin, cast(count(*) as double) as n from doc_lines group by doc_id, least(length(line), 255)),
sums as (
  select doc_id, bin, sum(n) over (partition by doc_id order by bin) as w0, sum(n * bin) over (partition by doc_id order by bin) as s0,
         sum(n) over (partition by doc_id) as w, sum(n * bin) over (partition by doc_id) as s from bins),
scored as (select doc_id, bin, case when w0 < w then w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) else 0.0e0 end as v from sums)
select doc_id, cast(min(bin) as bigint) as threshold from (select doc_id, bin, v, max(v) over (partition by doc_id) as best from scored) b where v = best group by doc_id
""",
)
