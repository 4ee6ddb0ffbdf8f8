"""DuckDB SQL for the operators that it can express in whole."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

#: Weights by the rank of the source; the sources that stay below their cap are those before the
#: point where, in order of cap to weight, the even share no longer passes the cap.
MIXING = f"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size,
         cast('0x' || substr(md5('mix-1|' || coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as draw
  from documents),
sources as (
  select source, source_size, 3 * source_size as cap, [5, 2, 1][cast((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1 as bigint)] as weight
  from (select source, cast(sum(size) as bigint) as source_size from sized group by source)),
ordered as (
  select *, coalesce(sum(cap) over w, 0) as cap_before, coalesce(sum(weight) over w, 0) as weight_before, sum(source_size) over () as total, sum(weight) over () as all_weight
  from sources window w as (order by cast(cap as double) / weight, source is null, source rows between unbounded preceding and 1 preceding)),
tested as (select *, (total - cap_before) * weight > cap * (all_weight - weight_before) as over_cap from ordered),
level as (select coalesce(sum(cap) filter (over_cap), 0) as capped, coalesce(sum(weight) filter (over_cap), 0) as capped_weight, any_value(total) as total, any_value(all_weight) as all_weight from tested),
goals as (
  select source, source_size, case when over_cap then cast(cap as double)
    else cast(cast((l.total - l.capped) * weight as bigint) as double) / cast(greatest(l.all_weight - l.capped_weight, 1) as double) end as target
  from tested, level l),
parts as (
  select source, source_size, target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole,
         target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size as open_words from goals),
run as (
  select s.source, draw, words, sum(words) over (partition by s.source order by draw) as upto, open_words
  from (select source, draw, sum(size) as words from sized group by source, draw) s join parts p on s.source is not distinct from p.source),
cut as (select source, max(draw) as cut, max(upto) as took from run where open_words > 0 and upto <= open_words group by source),
gap as (select p.source, coalesce(c.cut, -1) as cut, p.open_words - coalesce(c.took, 0) as gap from parts p left join cut c on c.source is not distinct from p.source where p.open_words > 0),
extra as (
  select source, draw from (
    select s.source, s.draw, row_number() over (partition by s.source order by abs(g.gap - s.size), s.draw) as place
    from sized s join gap g on g.source is not distinct from s.source where s.draw > g.cut and abs(g.gap - s.size) < g.gap) where place = 1)
select s.doc_id, s.size, p.source_size, p.target,
       s.size * (p.whole + case when p.open_words > 0 and (s.draw <= g.cut or s.draw = e.draw) then 1 else 0 end) as taken
from sized s join parts p on p.source is not distinct from s.source
left join gap g on g.source is not distinct from s.source left join extra e on e.source is not distinct from s.source
"""

#: Links by a join on shingles, components by the smallest id that a path reaches.
JACCARD = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[cast(i as bigint):cast(i + least(len(w), 5) - 1 as bigint)], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, cast(coalesce(z.n, 0) as bigint) as n_shingles, min(r.b) as component_id
from documents d left join sizes z on z.doc_id = d.doc_id left join reach r on r.a = d.doc_id group by d.doc_id, z.n
"""

ASSIGN = """((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1), ("forge", "gh[opsur]_[A-Za-z0-9]{36,}", 0, 40))

#: Matches have no places in SQL: they follow from the pieces between matches.
SECRETS = (
    "with pieces as ("
    + " union all ".join(
        f"select doc_id, {n} as rule, '{kind}' as kind, unnest(regexp_extract_all(t, '{pattern}')) as m, unnest(regexp_extract_all(t, '{pattern}', {group})) as part, {least} as least, "
        f"unnest(string_split_regex(t, '{pattern}')[:-2]) as gap, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) as i from (select doc_id, coalesce(text, '') as t from documents)"
        for n, (kind, pattern, group, least) in enumerate(KINDS)
    )
    + """),
ends as (select *, sum(length(gap) + length(m)) over (partition by doc_id, rule order by i) as e from pieces),
spans as (select doc_id, rule, kind, cast(e - length(m) as bigint) as s, cast(e as bigint) as e from ends where length(part) >= least),
found as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rule) filter (rule < 3), '') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rule) as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join found f on f.doc_id = d.doc_id
"""
)

BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {5 * g + 1}, 5) as bigint) >> {15 - 5 * k}) & 31 as bigint) + 1, 1)" for g in range(8) for k in range(4)
)
WARC = f"""
with hashed as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
first as (select h, min(page_id) as first_id from hashed group by h)
select page_id, cast(strlen(html) as bigint) as payload_bytes, {BASE32.replace("substr(h,", "substr(hashed.h,")} as payload_digest,
       case when page_id > first_id then 'revisit' else 'response' end as record_type, case when page_id > first_id then first_id end as refers_to, true as digest_ok
from hashed join first on first.h = hashed.h
"""

PHRASES = "all rights reserved|accept cookies|cookie policy|privacy policy|terms of service|terms of use|sign in to continue|subscribe to our newsletter|enable javascript|click here to"
QUALITY = f"""
with texts as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
places as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from texts),
runs as (select doc_id, i, word, lead(word, 1) over p as w1, lead(word, 2) over p as w2, lead(word, 3) over p as w3, lead(word, 4) over p as w4 from places window p as (partition by doc_id order by i)),
windows as (select doc_id, i, count(*) over (partition by doc_id, word, w1, w2, w3, w4) as n from runs where w4 is not null),
repeats as (select doc_id, cast(sum(least(5, coalesce(i - before, 5))) as bigint) as n_repeat_words from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from windows where n > 1) group by doc_id),
lines as (select doc_id, line, i, row_number() over (partition by doc_id, line order by i) > 1 as again, regexp_extract_all(line, '{WORD}') as own
          from (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from texts)),
judged as (
  select doc_id, again, length(array_to_string(own, '')) as chars,
         again or len(regexp_extract_all(line, '[#*$%&<>!]')) >= greatest(2, 0.5e0 * len(own)) or len(regexp_extract_all(line, '[|»›•]')) >= greatest(2, 0.3e0 * len(own))
         or (len(own) >= 4 and len(regexp_extract_all(line, '\\p{{L}}')) > 0 and len(regexp_extract_all(line, '\\p{{Lu}}')) >= 0.7e0 * len(regexp_extract_all(line, '\\p{{L}}')))
         or regexp_matches(line, '(?i){PHRASES}') as fails
  from lines where len(own) > 0),
by_line as (select doc_id, count(*) filter (again) as n_dup_lines, cast(coalesce(sum(chars) filter (fails), 0) as bigint) as lost_chars from judged group by doc_id),
base as (
  select t.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost_chars, 0) as lost_chars
  from texts t left join repeats r on r.doc_id = t.doc_id left join by_line l on l.doc_id = t.doc_id)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost_chars <= 0.3e0 * word_chars as kept from base
"""

#: Cuts at code points, forms by draws; the text is rebuilt from the output's own marks.
INFILL = """
with seeded as (
  select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as h1, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as h2,
         cast('0x' || substr(h, 17, 8) as bigint) % 100 as h3, cast('0x' || substr(h, 25, 8) as bigint) % 100 as h4 from seeded),
formed as (
  select *, least(h1, h2) as a, greatest(h1, h2) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from formed),
outputs as (
  select *, case form when 'plain' then t when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end as output from parts),
marks as (select *, strpos(output, '<P>') as p, strpos(output, '<S>') as s, strpos(output, '<M>') as m from outputs)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars, sha256(output) as output_sha256,
       sha256(case form when 'plain' then output
         when 'spm' then substring(output, p + 3, m - p - 3) || substring(output, m + 3) || substring(output, s + 3, p - s - 3)
         else substring(output, p + 3, s - p - 3) || substring(output, m + 3) || substring(output, s + 3, m - s - 3) end) as restored_sha256
from marks
"""

#: Whole prefixes compared as texts; a subtree's nodes are those whose smallest member passes through its top.
TRIE = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
placed as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as place from turns),
sizes as (select conv_id, count(*) as own, cast(conv_id as varchar) as name, conv_id - conv_id % 20 as stem from placed group by conv_id),
draws as (
  select *, xor(4294967295, list_reduce([4294967295] || flatten([[(ord(substr(name, cast(i as bigint), 1)) >> k) & 1 for k in range(8)] for i in range(1, length(name) + 1)]),
    lambda c, b: xor(c >> 1, case when c & 1 <> b then 3988292384 else 0 end))) % 4 as h from sizes),
known as (select d.*, least(d.h, coalesce(s.own, 0)) as taken from draws d left join sizes s on s.conv_id = d.stem),
rebuilt as (
  select k.conv_id, p.place as depth, role, text from known k join placed p on p.conv_id = k.stem and p.place <= k.taken
  union all select k.conv_id, p.place - k.h + k.taken, role, text from known k join placed p on p.conv_id = k.conv_id and p.place > k.h),
paths as (
  select conv_id, depth, cast(len(regexp_extract_all(text, '{WORD}')) as bigint) as words,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by depth) as path from rebuilt
  union all select conv_id, 0, 0, '' from known),
tops as (select depth, path, min(conv_id) as top, count(*) as n_convs, any_value(words) as words from paths group by depth, path),
members as (select p.conv_id, p.depth, t.top from paths p join tops t on t.depth = p.depth and t.path = p.path),
parents as (select t.*, m.top as parent from tops t left join members m on m.conv_id = t.top and m.depth = t.depth - 1),
children as (select parent, depth - 1 as depth, count(*) as n from parents where depth > 0 group by parent, depth),
nodes as (select p.*, coalesce(c.n, 0) as n_children from parents p left join children c on c.parent = p.top and c.depth = p.depth),
subtrees as (
  select m.top, m.depth, count(*) filter (n.n_children = 0) as n_leaves, sum((n.n_convs - 1) * n.words) as saved from nodes n join members m on m.conv_id = n.top and m.depth <= n.depth group by m.top, m.depth),
ends as (
  select top, depth, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from (
    select *, max(depth) over (partition by conv_id) as last from members) where depth = last group by top, depth)
select n.top as conv_id, cast(n.depth as bigint) as depth, n.parent as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join subtrees s on s.top = n.top and s.depth = n.depth left join ends e on e.top = n.top and e.depth = n.depth
"""

ORACLES = {
    "op5_source_mixing": MIXING,
    "op6_warc": WARC,
    "op7_secret_scan": SECRETS,
    "op9_ngram_jaccard": JACCARD,
    "op10_quality_rules": QUALITY,
    "op11_fill_in_middle": INFILL,
    "op12_conversation_trie": TRIE,
}
