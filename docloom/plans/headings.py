"""Queries over heading ladders and the spines of statutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import dialect
from docloom.operators import headings, instruments, spine
from docloom.plans.registry import query

#: The ladder in DuckDB: one step of a recursive query goes one heading on in all documents, with the open counters as a list.
LADDER = """
recursive told as (
  select doc_id, position, kind, mark, punct, row_number() over (partition by doc_id order by position) as i from outlined),
numerals as (
  select n, array_to_string([a, b, c], '') as numeral from (
    select n, ['', 'C', 'CC'][n // 100 + 1] as a, ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] as b, ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] as c
    from range(1, 201) r(n))),
read as (
  select doc_id, position, i, kind = 'enumerator' as counts, list_filter([
    case when regexp_matches(mark, '^[0-9]{1,2}([.][0-9]{1,2}){1,3}$') then struct_pack(f := 'legal_numeric_' || punct, v := try_cast(regexp_extract(mark, '([0-9]+)$', 1) as bigint))
         when regexp_matches(mark, '^[0-9]+$') then struct_pack(f := 'numeric_' || punct, v := try_cast(mark as bigint))
         when m.n is not null then struct_pack(f := 'roman_' || punct, v := m.n) end,
    case when regexp_matches(mark, '^[A-Z]$') then struct_pack(f := 'upper_alpha_' || punct, v := cast(ord(mark) - 64 as bigint)) end],
    lambda x: x is not null and x.v between 1 and 200) as rs
  from told left join numerals m on m.numeral = mark),
steps as (
  select doc_id, cast(0 as bigint) as i, cast([] as struct(f varchar, v bigint)[]) as stack, cast(null as struct(f varchar, v bigint)) as c, '' as action from (select distinct doc_id from told)
  union all
  select doc_id, i, case when not counts or c is null then stack when slot is null then list_append(stack, c) else list_append(stack[1:slot - 1], c) end, c, action from (
    select *, list_position(fs, c.f) as slot, case when not counts then 'caps_observed' when c is null then 'violation' when up is not null then 'increment' when fresh is not null then 'open_level'
           when again is not null and c.v = 1 then 'illegal_restart' when again is not null then 'jump_forward' else 'open_midcounter' end as action from (
      select *, case when counts then coalesce(up, fresh, again, middle) end as c from (
        select r.doc_id, r.i, r.counts, r.rs, s.stack, s.fs,
               list_filter(r.rs, lambda x: list_contains(s.stack, struct_pack(f := x.f, v := x.v - 1)))[1] as up,
               case when len(s.stack) < 4 then list_filter(r.rs, lambda x: x.v = 1 and not list_contains(s.fs, x.f))[1] end as fresh,
               list_filter(r.rs, lambda x: list_contains(s.fs, x.f) and (x.v = 1 or x.v > s.stack[list_position(s.fs, x.f)].v + 1))[1] as again,
               case when len(s.stack) < 4 then list_filter(r.rs, lambda x: not list_contains(s.fs, x.f))[1] end as middle
        from (select *, list_transform(stack, lambda x: x.f) as fs from steps) s join read r on r.doc_id = s.doc_id and r.i = s.i + 1) a) b) d),
rungs as (
  select r.doc_id, r.position, case when s.action = 'caps_observed' then '' else coalesce(s.c.f, r.rs[1].f, 'unknown') end as family,
         case when s.action <> 'caps_observed' then coalesce(s.c.v, r.rs[1].v) end as value,
         case when s.c is not null then cast(len(s.stack) as bigint) end as level, s.action
  from steps s join read r on r.doc_id = s.doc_id and r.i = s.i)
"""


def rungs(spark, sf_dir):
    return headings.ladder(dialect.run(spark, sf_dir, "select doc_id, position, kind, mark, punct from outlined"))


@query("seq_heading_ladder", "with " + LADDER + "select * from rungs")
def ladder(spark, sf_dir):
    """SEQ-29: family, value, level and action of every heading."""
    return rungs(spark, sf_dir)


@query(
    "seq_heading_families",
    "with " + LADDER + """
select doc_id, family, cast(sum(n) as bigint) as n, coalesce(max(max_value), 0) as max_value, cast(sum(violations) as bigint) as violations, cast(sum(gaps) as bigint) as gaps,
       coalesce(string_agg(level || ':' || n, ',' order by level) filter (level is not null), '') as levels,
       regexp_matches(family, '^(legal_)?numeric_') and coalesce(max(max_value), 0) >= 15 and count(level) = 1 as footnote_suspect
from (select doc_id, family, level, count(*) filter (action <> 'violation') as n, max(value) filter (action <> 'violation') as max_value,
             count(*) filter (action in ('violation', 'illegal_restart')) as violations, count(*) filter (action in ('jump_forward', 'open_midcounter')) as gaps
      from rungs where action <> 'caps_observed' group by doc_id, family, level) v group by doc_id, family""",
)
def families(spark, sf_dir):
    """SEQ-29: what each family of enumerators does in a document."""
    return headings.families(rungs(spark, sf_dir))


@query(
    "seq_heading_status",
    "with " + LADDER + """
select *, case when n_enumerators = 0 then 'no_enumerators' when violations = 0 then 'parsed_clean' when violations <= greatest(n_enumerators // 5, 1) then 'parsed_with_violations' else 'unparseable' end as status
from (select doc_id, count(*) filter (action <> 'caps_observed') as n_enumerators, count(*) filter (action in ('violation', 'illegal_restart')) as violations,
             count(*) filter (action in ('jump_forward', 'open_midcounter')) as gaps from rungs group by doc_id) s""",
)
def statuses(spark, sf_dir):
    """SEQ-29: whether a document's headings make an outline."""
    return headings.statuses(rungs(spark, sf_dir))


@query("txt_enumerator_readings", "with " + LADDER + "select doc_id, position, array_to_string(list_transform(rs, lambda x: x.f || '=' || x.v), ' ') as readings from read")
def enumerator_readings(spark, sf_dir):
    """TXT-20: what each enumerator may count, the likelier reading first."""
    marks = dialect.run(spark, sf_dir, "select doc_id, position, mark, punct from outlined")
    pair = lambda r: F.concat_ws("=", r["family"], r["value"].cast("string"))
    return marks.select("doc_id", "position", F.array_join(F.transform(headings.readings(F.col("mark"), F.col("punct")), pair), " ").alias("readings"))


@query("seq_statute_spine")
def statute_spine(spark, sf_dir):
    """SEQ-10: the sections of each statute."""
    return spine.statute_spine(dialect.run(spark, sf_dir, "select doc_id, text from statutes"))


@query("seq_hyphen_spine")
def hyphen_spine(spark, sf_dir):
    """SEQ-10 with scopes of hyphened labels."""
    return spine.statute_spine(dialect.run(spark, sf_dir, "select doc_id, text from statutes"), allow_hyphen=True)


@query("seq_instrument_nodes")
def instrument_nodes(spark, sf_dir):
    """SEQ-14: parts, sections and points of each statute, with their ranges."""
    return instruments.instrument_nodes(dialect.run(spark, sf_dir, "select doc_id, text from statutes"))
