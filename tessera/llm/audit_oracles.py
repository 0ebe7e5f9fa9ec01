"""DuckDB SQL for the Merkle manifest, the divergence audit and the sharding."""

from __future__ import annotations

from . import divergence, merkle, stratified_shards

_STEP = "lambda a, b: xor(a >> 1, (a & 1) * 3988292384)"


def crc_ctes(table: str) -> str:
    """CTEs up to ``crcs(r, crc)``, the unsigned CRC-32 of ``t`` in ``table(r, t)``.

    A CRC is linear over bits: each bit set adds what it has become by the end of the text, which
    only depends on how far that is (``pw``); the first 32 bits are inverted, as is the sum.
    """
    return f"""
pb(k, v) as (
  select 0, 3988292384::bigint
  union all select k + 1, list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], {_STEP}) from pb where k < (select max(strlen(t)) from {table})),
pw as (select 8 * k + j as k, list_reduce(list_resize([v], j + 1, 0), {_STEP}) as v from pb, range(0, 8) s(j)),
ch as (select r, 8 * strlen(t)::bigint as l, regexp_extract_all(hex(encode(t)), '..') as x from {table}),
bt as (select r, l, unnest(range(0, len(x))) as i, ('0x' || unnest(x))::bigint as b from ch),
se as (select r, l - 1 - (8 * i + j) as k from bt, range(0, 8) s(j) where ((b >> j) & 1) <> (case when i < 4 then 1 else 0 end)),
cr as (select r, bit_xor(v) as c from se join pw using (k) group by r),
crcs as (
  select r, xor(xor(coalesce(c, 0), case when strlen(t) < 4 then 4294967295 >> (8 * strlen(t)::bigint) else 0 end), 4294967295)::bigint as crc
  from {table} left join cr using (r))"""


def merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in merkle.FIELDS) + ")"
    low = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    return f"""
with recursive d as (select row_number() over () as r, * from documents),
ids as (select r, doc_id::varchar as t from d where doc_id is not null),
{crc_ctes("ids")},
lv as (
  select d.r, doc_id, source, {leaf("text")} as leaf, case when crc % 5 = 0 then {leaf(low)} else {leaf("text")} end as forged
  from d left join crcs using (r)),
pl as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n,
    dense_rank() over (order by source nulls first) - 1 as g from lv),
lo(g, lvl, pos, n, h) as (
  select g, 0, pos, n, leaf from pl
  union all (select g, lvl + 1, pos // 16, max((n + 15) // 16), sha256(string_agg(h, '' order by pos)) from lo where n > 1 group by g, lvl, pos // 16)),
sub as (select g, lvl as depth, h as subroot, (select count(distinct g) from pl) as n from lo where n = 1),
up(lvl, pos, n, h) as (
  select 0, g, n, subroot from sub
  union all (select lvl + 1, pos // 16, max((n + 15) // 16), sha256(string_agg(h, '' order by pos)) from up where n > 1 group by lvl, pos // 16)),
rt as (select h as root from up where n = 1),
fam as (
  select g, lvl, pos, coalesce(string_agg(h, '' order by pos) over (w rows between unbounded preceding and 1 preceding), '') as b,
    coalesce(string_agg(h, '' order by pos) over (w rows between 1 following and unbounded following), '') as a
  from lo where n > 1 window w as (partition by g, lvl, pos // 16 order by pos)),
ufam as (
  select lvl, pos, coalesce(string_agg(h, '' order by pos) over (w rows between unbounded preceding and 1 preceding), '') as b,
    coalesce(string_agg(h, '' order by pos) over (w rows between 1 following and unbounded following), '') as a
  from up where n > 1 window w as (partition by lvl, pos // 16 order by pos)),
way as (
  select r, lvl, fam.b, fam.a from pl join fam on fam.g = pl.g and fam.pos = pl.pos // (16 ** fam.lvl)::bigint
  union all select r, depth + lvl, ufam.b, ufam.a from pl join sub using (g) join ufam on ufam.pos = pl.g // (16 ** ufam.lvl)::bigint),
steps as (select r, list({{'b': b, 'a': a}} order by lvl) as s from way group by r),
fd(r, i, h) as (
  select r, 1, forged from pl
  union all select fd.r, i + 1, sha256(s[i].b || h || s[i].a) from fd join steps using (r) where i <= len(s))
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(s, lambda x: x.b || x.a), ''), '')) as proof_sha256,
  fd.h as folded_root, fd.h = root as verified
from pl join sub using (g) cross join rt left join steps using (r) join fd using (r) where fd.i = coalesce(len(s), 0) + 1"""


def divergence_sql() -> str:
    share = lambda n, total: f"(1 + ({divergence.UNIT}::hugeint * ({n} + 2)) // ({total} + 2 * v)::hugeint)"
    gap = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    return rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{merkle.UPPER}', '{merkle.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
tk as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term from tk group by all having count(distinct r) >= {divergence.LEAST_DOCS}),
c as (select lang, source, term, count(*) as n from tk join kept using (lang, term) group by all),
lc as (select lang, term, sum(n) as n from c group by all),
lt as (select lang, count(*) as v, sum(n) as total from lc group by lang),
g as (
  select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) left join c using (lang, source) group by all),
p as (
  select g.lang, g.source, lc.term, coalesce(c.n, 0) as n, {share("coalesce(c.n, 0)", "g.total")} as p, {share("lc.n", "lt.total")} as q
  from g join lc on lc.lang = g.lang join lt on lt.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = lc.term),
pr as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum({gap("a.p", "b.p")}) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
vs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pr.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pr on pr.lang = a.lang and pr.source = a.source and pr.item = b.source
  union all select lang, source, 'term', term, {gap("p", "q")} from p where n > 0 and p > q),
rk as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from vs)
select lang, source, part, item, value::bigint as value, rank::integer as rank from rk where part = 'pair' or rank <= {divergence.TOP}"""


def shards_sql(n: int = stratified_shards.SHARDS, seed: int = 0) -> str:
    return f"""
with recursive d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
{crc_ctes("d")},
k as (select r, doc_id, source, strlen(t)::bigint + {stratified_shards.ROW_BYTES} as size, crc, md5('{seed}|' || coalesce(doc_id::varchar, '') || '|' || crc) as key from d join crcs using (r)),
f as (
  select *, (2 * (row_number() over (partition by source order by key) - 1) + 1)::double / (2 * count(*) over (partition by source))::double as fraction from k),
p as (select *, row_number() over (order by fraction, source nulls first, key) - 1 as place, count(*) over () as total from f),
s as (select *, place * {n} // total as shard from p)
select doc_id, size, crc as text_crc32, 'rows' as law, shard::integer as shard, (place - (shard * total + {n - 1}) // {n})::bigint as slot,
  null::integer as grown_shard from s"""
