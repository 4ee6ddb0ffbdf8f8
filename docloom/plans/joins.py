"""Joins of ranges, positions and labels; all are keyed by document."""

from pyspark.sql import functions as F

from docloom.operators import phrases
from docloom.plans.registry import query, sql
from docloom.session import table

# JOIN-01: cross-references to notes by number.
sql(
    "join_crossrefs",
    """
with refs as (select doc_id, label, @int(regexp_extract(body, 'supra note ([0-9]+)', 1)) as target from notes)
select r.doc_id, r.label, r.target, min(n.pair_id) as pair_id, case count(n.pair_id) when 0 then 'unresolved' when 1 then 'resolved' else 'ambiguous' end as status
from refs r left join notes n on n.doc_id = r.doc_id and n.label = r.target and n.label < r.label group by r.doc_id, r.label, r.target
""",
)

# JOIN-03: blocks of twelve lines against claims that overlap them.
sql(
    "join_overlapping",
    """
with nodes as (select doc_id, cast(floor(line_no / 12) as bigint) as node, min(range_start) as a, max(range_end) as b from claims group by doc_id, cast(floor(line_no / 12) as bigint))
select n.doc_id, node, count(*) as n_lines, min(c.label) as first_label, max(c.range_end) - min(c.range_start) as reach
from nodes n join claims c on c.doc_id = n.doc_id and n.a < c.range_end and c.range_start < n.b group by n.doc_id, node
""",
)

# JOIN-04: the line of an offset, by one ordered pass over lines and offsets.
sql(
    "join_line_at",
    """
with points as (select doc_id, label, label * 97 as spot from notes),
both_kinds as (
  select doc_id, range_start as pos, 0 as what, line_no, cast(null as bigint) as label from claims where range_end > range_start
  union all select doc_id, spot as pos, 1 as what, cast(null as bigint) as line_no, label from points)
select doc_id, label, at_line from (
  select doc_id, label, what, max(line_no) over (partition by doc_id order by pos, what rows between unbounded preceding and current row) as at_line from both_kinds) f
where what = 1
""",
)

# JOIN-05: inferred blocks that no native claim names; then their parents by label.
sql(
    "join_infer_graph",
    """
with native as (select doc_id, kind, lower(label) as label from claims where state = 'complete'),
inferred as (select doc_id, kind, upper(label) as label, line_no from claims where state <> 'complete' union all select doc_id, kind, label, line_no from claims where line_no % 8 = 0)
select i.doc_id, i.kind, i.label, max(p.line_no) as parent_line
from inferred i left join claims p on p.doc_id = i.doc_id and p.label = concat('sec', cast(floor(i.line_no / 4) * 4 + 1 as bigint))
where not exists (select 1 from native n where n.doc_id = i.doc_id and n.kind = i.kind and n.label = lower(i.label))
group by i.doc_id, i.kind, i.label
""",
)

# JOIN-06: the smallest node around each node.
sql(
    "join_nesting",
    """
with nodes as (
  select doc_id, concat('line-', line_no) as id, range_start as a, range_end as b from claims where range_end > range_start
  union all select doc_id, concat('para-', cast(floor(line_no / 3) as bigint)), min(range_start), max(range_end) + 1 from claims group by doc_id, cast(floor(line_no / 3) as bigint)
  union all select doc_id, concat('page-', cast(floor(line_no / 9) as bigint)), min(range_start), max(range_end) + 2 from claims group by doc_id, cast(floor(line_no / 9) as bigint))
select doc_id, id, parent from (
  select n.doc_id, n.id, p.id as parent, row_number() over (partition by n.doc_id, n.id order by p.b - p.a, p.id) as place
  from nodes n join nodes p on p.doc_id = n.doc_id and p.a <= n.a and n.b <= p.b and p.b - p.a > n.b - n.a) r where place = 1
""",
)

# JOIN-08: the nearest body line on a note label's base line.
sql(
    "join_note_body",
    """
select doc_id, source_index, body_index from (
  select l.doc_id, l.source_index, b.source_index as body_index, row_number() over (partition by l.doc_id, l.source_index order by abs(b.y0 - l.y0), b.source_index) as place
  from layout l join layout b on b.doc_id = l.doc_id and b.page_number = l.page_number and b.region_type = 'body' and abs(b.y0 - l.y0) <= 220
  where l.region_type = 'footnote') r where place = 1
""",
)

# JOIN-09: phrases by their rarest word's postings; only single hits count. A document's lines are compared inside its own row.
@query(
    "join_phrase",
    """
with words as (select distinct doc_id, line_no, word from (select doc_id, line_no, @tokens(line) as word from doc_lines) w where length(word) > 3),
often as (select doc_id, word, count(*) as n from words group by doc_id, word),
phrases as (select doc_id, line_no as phrase_id, line as phrase from doc_lines where length(line) >= 30),
rarest as (
  select doc_id, phrase_id, phrase, word from (
    select p.doc_id, phrase_id, phrase, o.word, row_number() over (partition by p.doc_id, phrase_id order by o.n, o.word) as place
    from phrases p join words w on w.doc_id = p.doc_id and w.line_no = p.phrase_id join often o on o.doc_id = w.doc_id and o.word = w.word
    where position(concat(' ', o.word, ' ') in concat(' ', p.phrase, ' ')) > 0) r where place = 1)
select r.doc_id, phrase_id, min(l.line_no) as line_no
from rarest r join words w on w.doc_id = r.doc_id and w.word = r.word join doc_lines l on l.doc_id = w.doc_id and l.line_no = w.line_no and position(r.phrase in l.line) > 0
group by r.doc_id, phrase_id having count(*) = 1
""",
)
def phrase(spark, sf_dir):
    return phrases.single_hits(table(spark, sf_dir, "documents"))


# JOIN-10: values that occur exactly once in the text. A document's lines are looked up inside its own row.
@query(
    "join_unique_substring",
    """
select p.doc_id, p.line_no, cast(strpos(d.text, v) as bigint) - 1 as found_at
from (select doc_id, line_no, line as v from doc_lines where line <> '') p join documents d on d.doc_id = p.doc_id
where len(string_split(d.text, v)) = 2
""",
)
def unique_substring(spark, sf_dir):
    spots = F.transform(
        F.split("text", "\n", -1),
        lambda v: F.when(
            (v != "") & (F.length("text") - F.length(F.replace(F.col("text"), v, F.lit(""))) == F.length(v)), F.position(v, F.col("text")).cast("bigint") - 1
        ),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spots).alias("line_no", "found_at"))
    return rows.where("found_at is not null").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "found_at")


# JOIN-11, JOIN-12, JOIN-13: pairs to ranges, references that are new, references without a note.
sql(
    "join_note_pairs",
    """
select n.doc_id, n.pair_id, c.range_start, c.range_end, case when c.label is null then 'incomplete' else 'mapped' end as status
from notes n left join claims c on c.doc_id = n.doc_id and c.line_no = n.line_no + 1
""",
)
sql(
    "join_detached_refs",
    """
with known as (select doc_id, pair_id, line_no from notes where label % 2 = 0),
detached as (select doc_id, pair_id, line_no from notes where label % 3 = 0)
select d.doc_id, d.pair_id, d.line_no from detached d where not exists (select 1 from known k where k.doc_id = d.doc_id and k.pair_id = d.pair_id and k.line_no = d.line_no)
""",
)
sql(
    "join_unmatched_refs",
    """
with marks as (select doc_id, line_no, line_no % 7 + 1 as label from doc_lines)
select doc_id, line_no, label from marks m where not exists (select 1 from notes n where n.doc_id = m.doc_id and n.label = m.label)
""",
)

# JOIN-16: ibid takes the last full reference; supra goes to a labelled note.
sql(
    "join_ibid",
    """
with parts as (select doc_id, label, case when label % 3 = 0 then 'Ibid' else body end as body from notes),
runs as (select doc_id, label, body, max(case when body <> 'Ibid' then label end) over (partition by doc_id order by label rows between unbounded preceding and current row) as source from parts)
select r.doc_id, r.label, r.source, p.body from runs r left join parts p on p.doc_id = r.doc_id and p.label = r.source
""",
)
