"""Adapters of stored documents: unpivoted imports, upserts, caches and request envelopes."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.plans.registry import query, sql
from docloom.session import table

# SRC-03, SRC-04: page exports put together; marks leave the text.
sql(
    "src_journal_pages",
    """
select doc_id, page, first_line, @u16(body) as n_utf16, substring(body, 1, 40) as head from (
  select doc_id, page, min(line_no) as first_line, @join(line, ' ', line_no) as body from (
    select l.doc_id, l.line_no, l.line, max(p.page) as page from doc_lines l join (select doc_id, line_no, @int(regexp_extract(marker, '([0-9]+)', 1)) as page from paged) p on p.doc_id = l.doc_id and p.line_no <= l.line_no and p.line_no > l.line_no - 5
    group by l.doc_id, l.line_no, l.line) a group by doc_id, page) b
""",
)

# SRC-06, in part: the text of markup without tags.
sql("src_markup_text", "select page_id, @sub(@sub(@sub(@sub(html, '<(script|style)[^>]*>[^<]*', ' '), '<!--[^>]*-->', ' '), '<[^>]*>', ' '), '[ \t\n]+', ' ') as text from pages")
sql("src_markup_blocks", "select page_id, cast(@hits(html, '<p[ >]') as bigint) as n_paragraphs, cast(@hits(html, '<li[ >]') as bigint) as n_items, cast(@hits(html, '<a [^>]*href=') as bigint) as n_links, cast(@hits(html, '<h[1-6][ >]') as bigint) as n_headings from pages")

# SRC-07: two languages of a row as two rows, each with the other's value where it has none.
sql(
    "src_import",
    """
with stored as (select doc_id as id, case when lang = 'en' then text end as text_en, case when lang <> 'en' then text end as text_fr from documents)
select id, 'en' as language, @sha(coalesce(text_en, text_fr)) as text_sha256 from stored union all select id, 'fr', @sha(coalesce(text_fr, text_en)) from stored where text_fr is not null
""",
)

# SRC-08, SRC-09: the last version of a key wins.
sql(
    "src_upsert",
    """
select provider, source_id, version, text_sha256 from (
  select source as provider, doc_id % 50 as source_id, doc_id as version, @sha(text) as text_sha256, row_number() over (partition by source, doc_id % 50 order by doc_id desc) as place from documents) v
where place = 1
""",
)

# SRC-11: what a cache lacks, and what it must let go by age.
sql(
    "src_cache_misses",
    """
with wanted as (select doc_id, @sha(concat(text, '|v1')) as cache_key from documents),
cached as (select @sha(concat(text, '|v1')) as cache_key from documents where doc_id % 3 = 0)
select doc_id, cache_key from wanted w where not exists (select 1 from cached c where c.cache_key = w.cache_key)
""",
)
KEPT_CHARS, BUCKETS = 1_000_000, 4096


@query("src_cache_eviction", f"select doc_id, upto > {KEPT_CHARS} as evicted from (select doc_id, sum(n_chars) over (order by doc_id desc rows between unbounded preceding and current row) as upto from documents) c")
def cache_eviction(spark, sf_dir):
    """Newest first, what no longer fits goes: sums of at most BUCKETS ranges of ids first, then running sums inside of each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    rows = rows.join(F.broadcast(ends)).withColumn("bucket", F.floor((F.col("doc_id") - F.col("low")) * BUCKETS / (F.col("high") - F.col("low") + 1)))
    newer = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket").agg(F.sum("n_chars").alias("n")).select("bucket", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("above"))
    own = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(sums), "bucket").select("doc_id", (F.col("above") + F.sum("n_chars").over(own) > KEPT_CHARS).alias("evicted"))


# SRC-12: request envelopes are checked by field.
sql(
    "src_request_envelope",
    """
select event_id, @json(props, '$.page') as page, case when length(props) > 65536 then 'too large' when @json(props, '$.page') is null then 'no page' else 'ok' end as verdict from events
""",
)

# SRC-18, SRC-19: notes renumbered, and text units with marks taken out.
sql("src_renumbered_notes", "select doc_id, pair_id, cast(dense_rank() over (partition by doc_id order by label) as bigint) as internal_id, replace(concat(body, '⟦FN:', pair_id, '⟧'), concat('⟦FN:', pair_id, '⟧'), concat('⟦FN:', label, '⟧')) as body from notes where label % 4 <> 0")
sql("src_text_units", "select doc_id, 'body' as unit, line_no as place, line as text from doc_lines union all select doc_id, 'footnote', line_no, @sub(body, 'supra note [0-9]+, ', '') from notes")
