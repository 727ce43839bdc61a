"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

_SPAN_KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "code_host": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "web_token": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
}


def _secret_kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    select doc_id, {order} as kind_order, '{kind}' as kind, w.i,
           list_sum(list_transform(gaps[1:w.i], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:w.i - 1], lambda x: length(x))), 0) as start_at,
           length(wholes[w.i]) as n, length(helds[w.i]) as held, {least} as least
    from (select doc_id, regexp_split_to_array(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as wholes,
                 regexp_extract_all(text, '{pattern}', {group}) as helds
          from (select doc_id, coalesce(text, '') as text from documents) where regexp_matches(text, '{pattern}')),
         lateral (select unnest(range(1, len(wholes) + 1)) as i) as w"""


OP3 = f"""
with found as ({" union all ".join(_secret_kind(i, k, *v) for i, (k, v) in enumerate(_SPAN_KINDS.items()))}),
spans as (select doc_id, kind_order, kind, start_at, kind || ':' || start_at || ':' || (start_at + n) as span from found where held >= least),
per as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
               count(*) filter (kind = 'hex') as n_hex,
               string_agg(span, ',' order by start_at, kind_order) filter (kind in ('assign', 'access', 'hex')) as base,
               string_agg(span, ',' order by start_at, kind_order) as spans
        from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per using (doc_id)"""

OP10 = r"""
with bodies as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents)
select doc_id, first_value(doc_id) over (partition by body order by chars desc, doc_id) as keep_id,
       count(*) over (partition by body) as group_size,
       doc_id = first_value(doc_id) over (partition by body order by chars desc, doc_id) as kept,
       sha256(body) as text_sha256
from bodies"""

OP5 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from words),
items as (select doc_id, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from shared join sets sa on sa.doc_id = a join sets sb on sb.doc_id = b
  where 100 * n >= 75 * (len(sa.s) + len(sb.s) - n)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from sets union select e.b, r.other from reach r join edges e on e.a = r.doc_id)
select s.doc_id, len(s.s) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join (select doc_id, min(other) as component_id from reach group by 1) c using (doc_id)"""

_CRC32 = """xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0::bigint for i in range(8)], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""

OP11 = f"""
with recursive fields as (
  select doc_id, lang, n_chars,
         case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
           || case when source is null then '-' else strlen(source) || ':' || source end
           || case when lang is null then '-' else strlen(lang) || ':' || lang end as head,
         case when text is null then '-' else strlen(text) || ':' || text end as tail
  from documents),
leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n
  from (select doc_id, lang, sha256(head || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end || tail) as leaf,
               sha256(head || case when n_chars is null then '-' else strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1) end || tail) as changed
        from fields)),
nodes as (
  select lang, 0 as level, pos, leaf as h, n from leaves
  union all
  select lang, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from nodes where n > 1 group by lang, level, pos // 2),
subroots as (
  select lang, level as depth, h as subroot, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, place as pos, subroot as h, n from subroots
  union all
  select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from tops where n > 1 group by level, pos // 2),
ladder as (
  select lang, level, pos, h from nodes where n > 1
  union all select lang, s.depth + t.level, t.pos, t.h from subroots s, tops t where t.n > 1),
ends as (select lang, subroot, depth, place, depth + (select max(level) from tops) as top, (select h from tops where n = 1) as root from subroots),
climb as (
  select l.lang, l.pos as id, 0 as level, case when e.depth = 0 then e.place else l.pos end as at, '' as proof,
         case when {_CRC32.format(text="l.doc_id::varchar")} % 7 = 0 then l.changed else l.leaf end as h
  from leaves l join ends e on e.lang is not distinct from l.lang
  union all
  select c.lang, c.id, c.level + 1, case when c.level + 1 = e.depth then e.place else c.at // 2 end, c.proof || coalesce(s.h, ''),
         sha256(case when c.at % 2 = 1 then s.h || c.h else c.h || coalesce(s.h, '') end)
  from climb c join ends e on e.lang is not distinct from c.lang
       left join ladder s on s.level = c.level and s.pos = xor(c.at, 1) and s.lang is not distinct from c.lang
  where c.level < e.top)
select l.doc_id, l.leaf, e.subroot, e.root, sha256(c.proof) as proof_sha256, c.h as folded_root, c.h = e.root as verified
from leaves l join ends e on e.lang is not distinct from l.lang
     join climb c on c.level = e.top and c.id = l.pos and c.lang is not distinct from l.lang"""

OP12 = r"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from split),
crowded as (
  select k, max(doc_id) as last from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
judged as (
  select doc_id, line, pos, last is not null and doc_id <> last as gone from keyed left join crowded using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id"""

STATEMENTS = {"op3_secrets": OP3, "op5_near_dedup": OP5, "op10_exact_dedup": OP10, "op11_merkle_manifest": OP11, "op12_line_dedup": OP12}
