"""DuckDB SQL that gives the same rows as the numbered queries."""

from __future__ import annotations

from . import license_scan as ls
from . import quality_rules as qr
from . import secret_scan as ss


def quality_counts_ctes() -> str:
    """CTEs up to ``counted``: doc_id and all counts, one row per document."""
    return r"""
d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
toks as (select r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
pos as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from toks),
win as (select r, i, word as a, lead(word) over o as b, lead(word, 2) over o as c from pos window o as (partition by r order by i)),
dup as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as k from win where c is not null) where k > 1),
rep as (select r, count(distinct i + k) as n from dup, (values (0), (1), (2)) s(k) group by r),
ln as (select r, unnest(string_split(t, chr(10))) as l from d),
lines as (select r, count(*) as n, count(*) - count(distinct l) as dups from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
counted as (
  select d.doc_id, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(lines.dups, 0) as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
    cast(coalesce(lines.n, 0) as bigint) as n_lines,
    cast(length(regexp_replace(t, '[^A-Z]', '', 'g')) as bigint) as n_capitals,
    cast(length(regexp_replace(t, '[^!]', '', 'g')) as bigint) as n_exclaims
  from d join toks using (r) left join rep using (r) left join lines using (r))"""


def quality_model_ctes() -> str:
    """CTEs from ``counted`` to ``judged``: the same expectation-maximisation, one step a CTE."""
    m = range(len(qr.RULES))
    votes = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as v{j}" for j, (_, bad, good) in enumerate(qr.RULES))
    vs = ", ".join(f"v{j}" for j in m)
    start = qr.LabelModel.start()
    lists = lambda k: ", ".join(f"[{', '.join(f'{x!r}::double' for x in start.votes[j][k])}] as {'gb'[k]}{j}" for j in m)
    logit = "ln(good / (1 - good)) + " + " + ".join(f"ln(g{j}[v{j} + 2] / b{j}[v{j} + 2])" for j in m)
    out = [f"voted as (select *, {votes} from counted)", f"pat as (select {vs}, count(*)::double as n from voted group by all)",
           f"par0 as (select {start.good!r}::double as good, {lists(0)}, {lists(1)})"]
    for k in range(1, qr.ITERATIONS + 1):
        out.append(f"post{k} as (select pat.*, 1 / (1 + exp(-({logit}))) as p from pat, par{k - 1})")
        cells = lambda s, j, w: ", ".join(f"(0.5 + coalesce(sum(n * {w}) filter (v{j} = {v}), 0)) / (sum(n * {w}) + 1.5)" for v in (-1, 0, 1))
        raw = ", ".join(f"[{cells('g', j, 'p')}] as g{j}, [{cells('b', j, '(1 - p)')}] as y{j}" for j in m)
        out.append(f"raw{k} as (select (sum(n * p) + 0.5) / (sum(n) + 1) as good, {raw} from post{k})")
        out.append(f"par{k} as (select good, " + ", ".join(f"g{j}, [greatest(y{j}[1], g{j}[1]), y{j}[2], least(y{j}[3], g{j}[3])] as b{j}" for j in m) + f" from raw{k})")
    failed = f"n_words < {qr.MIN_WORDS} or 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words"
    out.append(f"judged as (select *, ({failed}) as base_failed, 1 / (1 + exp(-({logit}))) as p_good from voted, par{qr.ITERATIONS})")
    return ",\n".join(out)


def quality_rules_sql() -> str:
    return (
        f"with {quality_counts_ctes()},\n{quality_model_ctes()}\n"
        "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
        "(not base_failed and p_good >= 0.5) as kept, round(p_good, 6) as p_good from judged"
    )


def license_scan_sql() -> str:
    rules = ",\n".join(f"({n}, '{k}', '{label}', {p}, '{text}')" for n, k, label, p, text in ls.rules())
    keys = ", ".join(f"'{k}'" for k in sorted({r[1] for r in ls.rules()} | {b[1][0] for b in ls.BASE}))
    base = " union all ".join(
        f"select r, i, '{label}' as label from w4 where " + " and ".join(f"{c} = '{part}'" for c, part in zip(("a", "b", "c"), parts, strict=False))
        for label, parts in ls.BASE
    )
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
ws as (select r, doc_id, t, regexp_extract_all(translate(t, '{ls.UPPER}', '{ls.LOWER}'), '{word}') as w from d),
pos as (select r, w, unnest(w) as a, generate_subscripts(w, 1) - 1 as i from ws),
w4 as (select r, i, a, w[i + 2] as b, w[i + 3] as c, array_to_string(w[i + 1 :], ' ') || ' ' as x from pos where a in ({keys})),
based as ({base}),
rules(n, k, label, p, re) as (values {rules}),
hits as (
  select r, i as s, i + len(string_split(regexp_extract(x, re, 1), ' ')) as e, p, n, label
  from w4 join rules on w4.a = rules.k where regexp_matches(x, re)),
kept as (
  select * from hits x where not exists (
    select 1 from hits y where y.r = x.r and y.s <= x.s and y.e >= x.e
      and (y.p > x.p or (y.p = x.p and (y.e - y.s > x.e - x.s or (y.e - y.s = x.e - x.s and y.n < x.n)))))),
b1 as (select r, count(*) as n, min(i) as f, max(i) as l, string_agg(distinct label, ',' order by label) as s from based group by r),
l1 as (select r, string_agg(distinct label, ',' order by label) as s from (select r, label from based union all select r, label from kept) group by r),
k1 as (select r, max(p) as p, list({{'start': s::int, 'end': e::int, 'label': label, 'priority': p::int}} order by s, e, p, n) as det from kept group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(b1.n, 0) as bigint) as n_base, cast(b1.f as bigint) as first_word,
  cast(b1.l as bigint) as last_word, coalesce(b1.s, '') as base_labels, coalesce(l1.s, '') as labels,
  greatest(case when b1.n > 0 then 50 else 0 end, coalesce(k1.p, 0)) / 100.0::double as score
from ws left join b1 using (r) left join l1 using (r) left join k1 using (r)"""


def secret_spans_ctes() -> str:
    """CTEs up to ``spans(r, o, s, e)``: matches of all rules, in code points."""
    out = ["d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as x from documents)"]
    for o, rule in enumerate(ss.RULES):
        e = rule.expression.replace("'", "''")
        size = f"length(regexp_extract(p, '{e}', {rule.group}))" if rule.group else "length(p)"
        out.append(f"f{o} as (select r, string_split_regex(regexp_replace(x, '{e}', chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]') as ps from d where regexp_matches(x, '{e}'))")
        out.append(f"u{o} as (select r, unnest(ps) as p, generate_subscripts(ps, 1) as k from f{o})")
        out.append(f"c{o} as (select *, sum(length(p)) over (partition by r order by k) as e from u{o})")
        out.append(f"s{o} as (select r, {o} as o, cast(e - length(p) as bigint) as s, cast(e as bigint) as e from c{o} where k % 2 = 0 and {size} >= {rule.least})")
    return ",\n".join(out) + ",\nspans as (" + " union all ".join(f"select * from s{o}" for o in range(len(ss.RULES))) + ")"


def secret_scan_sql() -> str:
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in ss.RULES) + "]"
    text = f"{kinds}[o + 1] || ':' || s || ':' || e"
    base = len(ss.BASE)
    counts = ", ".join(f"count(*) filter (o = {k}) as n{k}" for k in range(base))
    return f"""
with {secret_spans_ctes()},
g as (select r, {counts}, string_agg({text}, ',' order by s, o) filter (o < {base}) as b, string_agg({text}, ',' order by s, o, e) as a from spans group by r)
select doc_id, {", ".join(f"cast(coalesce(n{k}, 0) as bigint) as n_{r.kind}" for k, r in enumerate(ss.BASE))},
  sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
from d left join g using (r)"""


def source_mix_sql(alpha: float = 0.5, seed: int = 0) -> str:
    u = f"cast(('0x' || substr(md5('{seed}|n|' || i || '|' || mix_id), 1, 13)) as bigint)::double / 4503599627370496.0"
    return f"""
with recursive d as (select row_number() over () as r, *, coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, '')) as mix_id from documents),
sz as (select source, sum(greatest(coalesce(length(text), 0), 1))::bigint as n from d group by source),
sh as (select source, n, pow(n::double, {alpha}) as w from sz),
rt as (select source, w / (select sum(w) from sh) * (select sum(n)::double from sh) / n as rate from sh),
pt as (select r, mix_id, rate / greatest(ceil(rate / 8), 1) as m, unnest(range(1, greatest(ceil(rate / 8), 1)::bigint + 1)) as i
  from d join rt on d.source is not distinct from rt.source),
us as (select r, m, i, {u} as u from pt),
cdf(m, k, p, c) as (
  select distinct m, 0, exp(-m), exp(-m) from pt
  union all select m, k + 1, p * m / (k + 1), c + p * m / (k + 1) from cdf where k < 47),
dr as (select us.r, us.i, count(*) filter (us.u >= cdf.c) as k from us join cdf using (m) group by us.r, us.i),
nn as (select r, sum(k)::bigint as n from dr group by r)
select doc_id, text, lang, source, n_chars, k as copy_no, md5('{seed}|o|' || k || '|' || mix_id) as mix_key
from (select d.*, unnest(range(0, nn.n)) as k from d join nn using (r))"""


def near_copies_ctes(size: int = 5, num: int = 4, den: int = 5) -> str:
    """CTEs up to ``classed(doc_id, class_id)``: components of documents of similar shingle sets."""
    return f"""
nd as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
ni as (select doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, least(len(w), 1)) + 1)) as i from nd),
nsh as (select distinct doc_id, array_to_string(w[i : i + {size - 1}], ' ') as s from ni),
nn as (select doc_id, count(*) as n from nsh group by doc_id),
np as (select a.doc_id as a, b.doc_id as b, count(*) as i from nsh a join nsh b on a.s = b.s and a.doc_id < b.doc_id group by all),
nl as (select a, b from np join nn x on x.doc_id = a join nn y on y.doc_id = b where {den} * i >= {num} * (x.n + y.n - i)),
ne as (select a, b from nl union all select b, a from nl),
nr(a, b) as (select doc_id, doc_id from documents union select nr.a, ne.b from nr join ne on nr.b = ne.a),
classed as (select a as doc_id, min(b) as class_id from nr group by a)"""


def dart_minhash_sql() -> str:
    return f"with recursive {near_copies_ctes()}\nselect doc_id, class_id, doc_id = class_id as kept from classed"


def pq_dedup_sql(least: float = 0.98) -> str:
    return f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
n as (select *, sqrt(list_dot_product(x, x)) as l from v where x is not null and label is not null and list_dot_product(x, x) > 0),
p as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.x, b.x) / (a.l * b.l) >= {least}),
k as (select a, count(*) as n from p group by a),
r(a, b) as (select vec_id, vec_id from v union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as b from r group by a)
select v.vec_id, cast(coalesce(k.n, 0) as bigint) as n_links, c.b as component_id, v.vec_id = c.b as kept
from v join c on c.a = v.vec_id left join k on k.a = v.vec_id"""
