"""DuckDB SQL with the rows of the core queries."""

from __future__ import annotations

CELLS = """cells as (select o_orderkey::varchar as cell_id, o_totalprice as x, c_acctbal + o_orderkey % 100 as y, o_custkey::varchar as region_id,
  c_nationkey::varchar as structure_id, n_name as structure_label, c_mktsegment as slide_id, o_orderstatus as cluster, o_orderkey as row_pos
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
EXPR = "expr as (select l_orderkey::varchar as cell_id, p_brand as gene, sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey group by all)"
MEANS = """size as (select region_id, count(*) as n from cells group by 1),
means as (select region_id, gene, sum(value) / n as value from expr join cells using (cell_id) join size using (region_id) group by region_id, gene, n)"""
VALUES = f"{CELLS}, {EXPR}, {MEANS}, vals as (select region_id, gene, round(value, 3) as value from means)"
CUST = """cust as (select printf('%08d', c_custkey) as region_id, c_acctbal as x, c_acctbal * (c_custkey % 17 + 1) as y, c_mktsegment as slide_id, c_nationkey from customer)"""
SPLIT = "case when {0} % 10 < 7 then 'train' when {0} % 10 = 7 then 'val' else 'test' end"
EMB = f"""e0 as (select vec_id as id, embedding::double[] as vec, label::varchar as label, {SPLIT.format("vec_id")} as split, (vec_id % 3)::varchar as batch,
  embedding[1:32]::double[] as p, embedding[33:64]::double[] as q from embeddings),
e1 as (select *, list_transform(p, lambda v: v / sqrt(list_dot_product(p, p))) as a, list_transform(q, lambda v: v / sqrt(list_dot_product(q, q))) as b from e0),
e as (select *, unnest(['overall', split]) as scope from e1)"""
KNN = f"""{EMB}, nn as (select l.scope, l.id, r.id as neighbor_id, l.label as l, r.label as m, r.batch as rb,
  row_number() over (partition by l.scope, l.id order by list_dot_product(l.vec, r.vec) desc, r.id) as rank
  from e l join e r on l.scope = r.scope and l.id <> r.id qualify rank <= 5)"""
PRED = f"""p as (select {SPLIT.format("l_orderkey")} as split, l_extendedprice / 1000 as pred, l_quantity as target from lineitem where l_linenumber % 2 = 1),
g as (select coalesce(split, 'overall') as split, count(*) as n, avg((pred - target) * (pred - target)) as mse, corr(pred, target) as c from p group by rollup (split))"""
PANEL = "panel as (select distinct trim(g) as gene from (values ('Brand#11'), ('Brand#12'), ('Brand#13'), ('Brand#99'), (' Brand#21 '), ('')) t(g) where trim(g) <> ''), genes as (select distinct p_brand as gene from part)"


def _blocks(seed: int, strategy: str, group: str | None, key: str, source: str) -> str:
    name = f"'{group}'" if group else "null::varchar"
    return f"""{source},
bl as (select block_id, count(*) as n, md5('{seed}|' || block_id) as k from b group by 1),
cum as (select block_id, coalesce(sum(n) over (order by k, block_id rows between unbounded preceding and 1 preceding), 0) + n / 2 as mid, sum(n) over () as t from bl),
sp as (select block_id, case when mid < t * 0.7 then 'train' when mid < t * (0.7 + 0.15) then 'val' else 'test' end as split from cum),
made as (select region_id, split, '{strategy}' as split_strategy, {name} as split_group_key, block_id from b join sp using (block_id))"""


SPATIAL = f"""{CUST}, side as (select least(32, greatest(2, ceil(sqrt(greatest(4.0, count(*) / 4)))))::bigint as s, count(*) as n from cust),
rk as (select *, row_number() over (order by x, region_id) - 1 as rx, row_number() over (order by y, region_id) - 1 as ry from cust),
b as (select region_id, 'x' || least(rx * s // n, s - 1) || '_y' || least(ry * s // n, s - 1) as block_id from rk, side)"""
SLIDES = f"{CUST}, b as (select region_id, slide_id as block_id from cust)"
NATIONS = f"{CUST}, b as (select region_id, c_nationkey::varchar as block_id from cust)"
NEAR = """near as (select a.region_id, b.region_id as neighbor_id, row_number() over (partition by a.region_id order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.region_id) as rank
  from cust a join cust b on a.region_id <> b.region_id{0} qualify rank <= {1})"""
PATCHES = """patches as (select doc_id::varchar as contour_id, doc_id % 30 || '.0' as structure_id, 'o' || doc_id as cell_id, 'img' || doc_id % 500 as image_path, case when lang = 'de' then source end as pl,
  n_chars::double as patch_x, (n_chars % 7)::double as patch_y, (n_chars % 3)::double as patch_size, lang as source_image from documents),
images as (select distinct 'img' || doc_id % 500 as image_path from labels)"""
REGIONS = f"""{CELLS}, {PATCHES},
r0 as (select region_id, count(*) as n_cells, avg(x) as x, avg(y) as y, arg_min(structure_id, row_pos) as structure_id, arg_min(slide_id, row_pos) as slide_id, arg_min(cluster, row_pos) as cluster from cells group by 1),
lab as (select structure_id, arg_max(structure_label, row_pos) as l from cells group by 1),
regs as (select r0.region_id, r0.region_id as contour_id, n_cells, x, y, coalesce(p.structure_id, r0.structure_id) as structure_id, coalesce(pl, l, p.structure_id, r0.structure_id, 'unknown') as structure_label,
  slide_id, cluster, p.image_path, case when i.image_path is not null then 'ok' else 'no_image' end as qc_flag, patch_x, patch_y, patch_size, source_image, null::varchar as registration_transform
  from r0 left join patches p on p.contour_id = r0.region_id left join images i on i.image_path = p.image_path
  left join lab on lab.structure_id::double = coalesce(p.structure_id, r0.structure_id)::double)"""
MASK = "h as (select *, md5('1|' || region_id || '|' || gene) as k from vals), m as (select *, substr(k, 1, 8) as h8, min(substr(k, 1, 8) || gene) over (partition by region_id) as first from h)"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["region_mean_expression"] = f"with {CELLS}, {EXPR}, {MEANS} select region_id, gene, round(value, 6) as value from means"
    out["matrix_market_means"] = out["region_mean_expression"]
    out["region_table"] = f"with {CELLS} select region_id, count(*) as n_cells, round(avg(x), 7) as x, round(avg(y), 7) as y from cells group by 1 having count(*) >= 5"
    out["region_rows"] = f"""with {REGIONS} select region_id, contour_id, n_cells, round(x, 6) as x, round(y, 6) as y, structure_id, structure_label, image_path, qc_flag, cluster, patch_x, patch_y, patch_size,
  source_image, registration_transform, null::varchar as bbox_level_xy, null::varchar as bbox_level0_xy, null::varchar as pyramid_level, slide_id, null::varchar as patient_id, null::varchar as organ,
  null::varchar as batch_id, null::varchar as stain, null::varchar as scanner from regs order by region_id"""
    out["first_non_null_domain"] = f"""with {CELLS} select region_id, arg_min(cluster, row_pos) filter (row_pos % 3 <> 0) as cluster, arg_min(slide_id, row_pos) as slide_id from cells group by 1"""
    out["membership_edges"] = f"with {CELLS} select region_id, 'inner' as membership, count(*) as n_edges, count(*)::double as weight from cells group by 1"
    out["structure_counts"] = f"with {CELLS} select structure_label as label, count(*) as n from cells group by 1"
    out["domain_counts"] = f"with {CELLS} select 'slide_id' as domain, slide_id as value, count(*) as n from cells group by 2 union all select 'cluster', cluster, count(*) from cells group by 2"
    out["distinct_coverage"] = f"with {EMB} select split, 'label' as domain, count(distinct label) as n_values from e1 group by 1 union all select split, 'batch', count(distinct batch) from e1 group by 1"
    out["spatial_bounds"] = f"with {CELLS} select min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max from cells"
    out["matrix_density"] = f"with {EXPR} select round(count(*) filter (value <> 0) / ((select count(*) from orders) * (select count(distinct p_brand) from part))::double, 9) as density from expr"
    out["coverage_ratios"] = "select round(count(quality) / count(*), 6) as labelled, round(count(*) filter (quality = 1) / count(*), 6) as good, round(count(*) filter (lang not in ('', 'nan', 'None', 'unknown')) / count(*), 6) as with_lang from documents left join labels using (doc_id)"
    out["structure_summary"] = f"""with {EMB}, s as (select case when id % 11 <> 0 then label end as l, id % 7 as n, vec from e1),
u as (select l, unnest(vec) as v, generate_subscripts(vec, 1) - 1 as place from s where l is not null)
select l as structure_label, (select sum(n) from s t where t.l = u.l)::bigint as n_cells, place::int as place, round(avg(v), 6) as v from u group by l, place"""
    out["cluster_embedding_mean"] = f"with {EMB}, u as (select batch, unnest(vec) as v, generate_subscripts(vec, 1) - 1 as place from e1) select batch, place::int as place, round(avg(v), 6) as v from u group by all"
    out["masked_mse_by_split"] = f"with {PRED} select split, n as n_masked_values, round(mse, 4) as mse from g"
    out["pearson_by_split"] = f"with {PRED} select split, round(c, 6) as correlation from g"
    out["retrieval_topk"] = f"""with {EMB}, s as (select l.scope, l.id, list_dot_product(l.a, r.b) as ab, list_dot_product(l.b, r.a) as ba, list_dot_product(l.a, l.b) as own, r.id as other from e l join e r on l.scope = r.scope),
c as (select scope, id, count(*) filter (other <> id and (ab > own + 1e-12 or (abs(ab - own) <= 1e-12 and other < id))) as x, count(*) filter (other <> id and (ba > own + 1e-12 or (abs(ba - own) <= 1e-12 and other < id))) as y from s group by all),
n as (select scope, count(*) as n from c group by 1), k as (select unnest([1, 5])::bigint as k)
select scope, k, least(k, n) as effective_k, n as n_regions, round(avg((x < least(k, n))::int), 6) as a_to_b_topk, round(avg((y < least(k, n))::int), 6) as b_to_a_topk from c join n using (scope), k group by scope, k, n"""
    out["same_label_hit"] = f"""with {KNN}, k as (select unnest([1, 5])::bigint as k), n as (select scope, count(*) as n from e group by 1),
h as (select scope, id, k, max((rank <= k and l = m)::int) as hit from nn, k group by all)
select scope, k, least(k, n - 1) as effective_k, n as n_regions, round(avg(hit), 6) as same_label_recall from h join n using (scope) group by scope, k, n"""
    out["batch_mixing_entropy"] = f"""with {KNN}, c as (select scope, id, rb, count(*) as c from nn group by all), t as (select scope, id, sum(c) as n from c group by all),
h as (select scope, id, -sum(c / n * ln(c / n + 1e-12)) as h from c join t using (scope, id) group by all), s as (select scope, count(*) as n, count(distinct batch) as b from e group by 1)
select scope, 5::bigint as k, least(5, n - 1)::bigint as effective_k, n as n_regions, round(avg(h) / ln(b), 6) as batch_mixing_entropy from h join s using (scope) group by scope, n, b"""
    out["silhouette_by_scope"] = f"""with {EMB}, d as (select l.scope, l.id, l.label as l, r.label as m, avg(list_distance(l.vec, r.vec)) as s from e l join e r on l.scope = r.scope and l.id <> r.id group by all),
ab as (select scope, id, max(s) filter (l = m) as a, min(s) filter (l <> m) as b from d group by all),
n as (select scope, count(*) as n, count(distinct label) as k from e group by 1)
select scope, n as n_regions, k as n_labels, round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab join n using (scope) group by scope, n, k"""
    out["embedding_knn"] = f"with {KNN} select scope, id, neighbor_id, rank::int as rank from nn where rank <= 3"
    out["duplicate_names"] = "select count(p_brand) - count(distinct p_brand) as n_duplicates from part"
    out["panel_metrics"] = f"""with {PANEL}, m as (select gene from panel except select gene from genes), o as (select gene from genes except select gene from panel)
select (select count(*) from panel) as n_panel, (select count(*) from genes) as n_data, (select count(*) from panel semi join genes using (gene)) as n_overlap, (select count(*) from m) as n_missing,
  (select count(*) from o) as n_outside, coalesce((select list(gene order by gene) from m), []) as missing_first, (select list(gene order by gene)[1:20] from o) as outside_first"""
    out["panel_semi_anti"] = f"with {PANEL} select gene, 'both' as kind from genes semi join panel using (gene) union all select gene, 'missing' from panel anti join genes using (gene) union all select gene, 'outside' from genes anti join panel using (gene)"
    out["split_provenance"] = f"with {_blocks(0, 'slide_holdout', 'slide_id', '', SLIDES)} select split, count(*) as n_regions, string_agg(distinct block_id, ',' order by block_id) as blocks from made group by 1"
    out["image_qc_rollup"] = "select count(*) as n_regions, count(*) filter (quality = 1) as n_with_image, count(*) filter (quality is null or quality <> 1) as n_without_image, round(count(*) filter (quality = 1) / count(*), 4) as image_coverage from documents left join labels using (doc_id)"
    out["missing_images"] = "select doc_id, doc_id::varchar as image_path from documents anti join labels using (doc_id)"
    out["failure_analysis"] = f"""with {PATCHES}, {PANEL},
rg as (select c_custkey::varchar as region_id, {SPLIT.format("c_custkey")} as split, (select count(*) from orders where o_custkey = c_custkey) as n_cells, c_mktsegment as slide_id, case when c_nationkey <> 3 then c_nationkey end as batch_id from customer),
sc as (select 'overall' as scope, * from rg union all select split, * from rg),
one as (select (select count(*) from rg) as n, (select count(*) from patches) as p, (select count(distinct contour_id) from patches semi join rg on contour_id = region_id) as c,
  (select count(*) from patches anti join images using (image_path)) as m, (select count(*) from rg where n_cells <= 0) as l,
  (select count(*) from panel) as pn, (select count(*) from panel anti join genes using (gene)) as pm, (select count(*) from genes anti join panel using (gene)) as po)
select scope as split, 'split' as category, 'n_regions' as metric, count(*)::double as value, 'slide_holdout' as detail from sc group by 1
union all select scope, 'domain', 'slide_id_unique_values', count(distinct slide_id), 'slide_id' from sc group by 1
union all select scope, 'domain', 'batch_id_unique_values', count(distinct coalesce(batch_id, -1)), 'batch_id' from sc group by 1
union all select 'overall', 'patch', 'patch_rows', p, 'Rows in patch manifest.' from one
union all select 'overall', 'patch', 'region_image_coverage', round(c / greatest(n, 1), 6), 'Region-level patch coverage.' from one
union all select 'overall', 'patch', 'missing_image_count', m, 'Patch image files missing on disk.' from one
union all select 'overall', 'region', 'low_cell_region_count', l, 'Regions without member cells.' from one
union all select 'overall', 'registration', 'has_patch_coordinates', 1, 'patch_x,patch_y' from one
union all select 'overall', 'registration', 'has_registration_metadata', 0, 'no registration columns' from one
union all select 'overall', 'panel', 'panel_gene_count', pn, 'Configured panel size.' from one
union all select 'overall', 'panel', 'missing_from_data_count', pm, 'Configured panel genes absent from AnnData.' from one
union all select 'overall', 'panel', 'outside_panel_count', po, 'AnnData genes absent from configured panel.' from one"""
    figures = f"""{REGIONS}, {EXPR},
fig as (select (select count(*) from cells)::double as n_cells, 0::double as missing_spatial_count, (select count(*) from regs)::double as n_regions, (select count(*) from regs where n_cells > 0)::double as regions_with_cells,
  (select count(*) from regs where n_cells < 5)::double as low_cell_region_count, (select count(*) filter (qc_flag = 'ok') / count(*) from regs) as region_image_coverage,
  (select count(*) filter (structure_label not in ('', 'nan', 'None', 'unknown')) / count(*) from regs) as structure_assignment_coverage, (select count(*) from part)::double as n_genes,
  (select count(*) - count(distinct p_brand) from part)::double as duplicate_gene_count, (select count(*) from patches)::double as patch_count, (select count(distinct cell_id) from patches)::double as patch_cell_count,
  (select count(distinct structure_id) from patches)::double as patch_structure_count, (select count(*) from patches anti join images using (image_path))::double as missing_image_count,
  (select count(distinct s) filter (s in (select structure_id::double from patches)) / count(distinct s) from (select structure_id::double as s from regs)) as patch_structure_coverage,
  (select min(x) from cells) as x_min, (select max(x) from cells) as x_max, (select min(y) from cells) as y_min, (select max(y) from cells) as y_max, 1::double as cell_assignment_coverage,
  (select count(*) filter (value <> 0) from expr) / ((select count(*) from cells) * (select count(*) from part)) as matrix_density, (select count(*) filter (qc_flag = 'ok') / count(*) from regs) as patch_cell_coverage)"""
    out["case_metrics"] = f"with {figures}, u as (unpivot fig on * into name metric value value) select metric, round(value, 6) as value from u"
    out["verdict_rules"] = f"""with {figures}, {PANEL},
p as (select (select count(*) from panel anti join genes using (gene)) as m, (select count(*) from genes anti join panel using (gene)) as o),
t as (select unnest([
  ('no_coordinates', 'fatal', false), ('coordinates_not_finite', 'fatal', missing_spatial_count > 0), ('duplicate_genes', 'warning', duplicate_gene_count > 0), ('panel_missing', 'warning', m > 0), ('panel_outside', 'warning', o > 0),
  ('no_patches', 'warning', patch_count = 0), ('patch_coverage', 'warning', patch_count > 0 and region_image_coverage < 1 and patch_structure_coverage < 1), ('missing_images', 'warning', missing_image_count > 0),
  ('no_patch_coordinates', 'warning', false), ('no_registration', 'warning', patch_count > 0), ('structure_coverage', 'warning', structure_assignment_coverage < 0.95), ('no_regions', 'fatal', n_regions = 0)]) as t from fig, p)
select t[1] as rule, t[2] as level, t[3] as fired from t"""
    out["manifest_domains"] = f"""with {REGIONS} select 'slide_id' as domain, slide_id as value, count(*) as n from regs group by 2
union all select 'organ', case when n_cells % 2 = 0 then 'even' else 'missing' end, count(*) from regs group by 2 union all select 'cluster', cluster, count(*) from cells group by 2"""
    out["patch_provenance"] = f"""with {PATCHES}, p as (select *, case when contour_id::bigint % 3 > 0 then patch_size end as level, case when contour_id::bigint % 7 = 0 then source_image end as affine from patches)
select * from (select 'coordinate_columns' as kind, 'patch_x' as name, count(patch_x) as n_patches from p union all select 'coordinate_columns', 'patch_y', count(patch_y) from p
union all select 'image_columns', 'image_path', count(image_path) from p union all select 'image_columns', 'source_image', count(source_image) from p union all select 'registration_columns', 'affine', count(affine) from p
union all select 'parameter_columns', 'patch_x', count(patch_x) from p union all select 'parameter_columns', 'patch_y', count(patch_y) from p union all select 'parameter_columns', 'patch_size', count(patch_size) from p
union all select 'parameter_columns', 'level', count(level) from p)"""
    out["cell_flags"] = f"with {CELLS}, {PATCHES}, ok as (select distinct cell_id from patches semi join images using (image_path)) select 'o' || cells.cell_id as cell_id, case when ok.cell_id is null then 'no_image' else 'ok' end as qc_flag from cells left join ok on ok.cell_id = 'o' || cells.cell_id"
    out["image_manifest"] = f"with {REGIONS} select region_id, image_path, patch_x, patch_size, source_image, registration_transform from regs"
    out["manifest_records"] = """select event_id, 'r' || event_id as contour_id, event_type as image_path, (event_id % 5)::double as patch_x, 4::double as patch_y, '{"a":2,"b":1}' as registration_transform,
  case when event_id % 5 = 0 then 9 else event_id % 5 end::double as patch_x_falsy from events where event_id % 6 <> 5"""
    out["structure_map_last_wins"] = f"""with {CELLS}, t as (select c_mktsegment as slide_id, arg_max(c_nationkey, c_custkey) as s from customer group by 1)
select cell_id, coalesce(s, 0)::int as structure_id from cells left join t using (slide_id)"""
    out["contour_map_first_wins"] = f"""with {CELLS}, t as (select l_orderkey::varchar as cell_id, 's' || arg_min(l_suppkey, l_linenumber * 1000000000000 + l_suppkey * 1000000 + l_partkey) as c, arg_min(l_partkey % 5, l_linenumber * 1000000000000 + l_suppkey * 1000000 + l_partkey)::varchar as s from lineitem group by 1)
select cell_id, coalesce(case when row_pos % 4 = 0 then region_id end, c) as contour_id, s as structure_id from cells left join t using (cell_id)"""
    out["patch_left_join"] = f"""with {CELLS}, t as (select (doc_id % 700)::varchar as region_id, arg_max(source, doc_id) as image_path from documents group by 1)
select region_id, count(*) as n_cells, image_path from cells left join t using (region_id) group by all"""
    out["label_lookup"] = f"with {CELLS} select structure_id, arg_max(structure_label, row_pos) as structure_label from cells group by 1"
    out["split_completeness"] = f"with {_blocks(0, 'slide_holdout', 'slide_id', '', SLIDES)} select split, count(*) as n from made group by 1"
    out["spatial_knn"] = f"with {CUST}, {NEAR.format('', 4)} select * from near"
    out["neighbor_mean_expression"] = f"""with {CELLS}, {EXPR}, {MEANS}, {CUST}, {NEAR.format("", 3)}
select near.region_id, gene, round(sum(value) / 3, 6) as value from near join means on lpad(means.region_id, 8, '0') = neighbor_id group by 1, 2"""
    out["global_rank"] = f"with {CUST} select region_id, row_number() over (order by x, region_id) - 1 as rank0 from cust"
    out["rank_bins"] = f"with {CUST}, r as (select region_id, row_number() over (order by x, region_id) - 1 as r, count(*) over () as n from cust) select region_id, least(r * 7 // n, 6)::bigint as bin from r"
    out["spatial_blocks"] = f"with {SPATIAL} select region_id, block_id from b"
    out["block_splits"] = f"with {_blocks(3, 'spatial_block', None, '', SPATIAL)} select * from made"
    out["group_holdout"] = f"with {_blocks(5, 'group_holdout', 'c_nationkey', '', NATIONS)} select region_id, split, split_group_key, block_id from made"
    out["leaking_groups"] = f"with {CUST} select slide_id as block_id, count(distinct x > 9000) as n_splits from cust group by 1 having n_splits > 1"
    out["label_codes"] = f"with {CUST}, l as (select region_id, coalesce(case when slide_id <> 'BUILDING' then slide_id end, 'unknown') as l from cust) select region_id, dense_rank() over (order by l) - 1 as code from l"
    out["unique_names"] = "with g as (select p_brand as f, p_partkey - 1 as p, row_number() over (partition by p_brand order by p_partkey) - 1 as t from part) select p as gene_pos, case when t > 0 then f || '.' || t else f end as vocab_name, p + 1 as vocab_id from g"
    out["expression_bins"] = f"with {VALUES}, v as (select *, ln(1 + ln(1 + greatest(value, 0))) as w from vals), m as (select *, max(w) over (partition by region_id) as m from v) select region_id, gene, case when m > 0 then floor(w / m * 7) else 0 end::bigint as bin from m"
    out["coord_zscore"] = f"with {CUST}, s as (select avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, stddev_pop(y) as sy from cust) select region_id, round((x - mx) / sx, 6) as x_z, round((y - my) / sy, 6) as y_z from cust, s"
    out["cell_sample"] = f"with {CELLS} select region_id, cell_id from cells qualify row_number() over (partition by region_id order by md5('1|' || cell_id), cell_id) <= 3"
    out["gene_selection"] = f"with {VALUES} select region_id, gene from vals qualify row_number() over (partition by region_id order by case when value > 0 then 0 else 1 end, md5('1|' || region_id || '|' || gene), gene) <= 6"
    out["mask_selection"] = f"with {VALUES}, {MASK} select region_id, gene, h8 < '{int(0.15 * 2**32):08x}' or h8 || gene = first as mask from m"
    out["corpus_union"] = """with s as (select c_mktsegment as m, row_number() over (order by c_mktsegment) % 2 as odd from (select distinct c_mktsegment from customer))
select c_custkey || '-' || m as cell_id, case when odd = 1 then c_acctbal end as c_acctbal, case when odd = 0 then c_name end as c_name, m as slide_id, m as batch_id, m as source from customer join s on m = c_mktsegment"""
    out["manifest_coalesce"] = "select event_id, coalesce(nullif(event_id % 2, 0), nullif(event_id % 3, 0), 9) as patch_x from events"
    out["manifest_json"] = "select event_id, nullif(nullif(nullif(props ->> '$.k', ''), 'nan'), 'None') as k from events"
    out["null_like_clean"] = """with t as (select event_id, case when event_id % 12 < 6 then (['', 'nan', 'None', null, 'unknown', '<NA>'])[event_id % 12 + 1] else event_type end as v from events),
c as (select event_id, v, case when v not in ('', 'nan', 'None') then v end as cleaned from t)
select event_id, cleaned, coalesce(cleaned, 'missing') as filled, coalesce(v not in ('', 'nan', 'None', 'unknown'), false) as is_label from c"""
    out["id_normalise"] = """with t as (select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then l_quantity::varchar when 1 then l_discount::varchar else l_suppkey || 'e2' end as v from lineitem),
n as (select *, try_cast(v as double) as d from t)
select l_orderkey, l_linenumber, case when d is not null and not isnan(d) and abs(d) < 9e15 and d = floor(d) then d::bigint::varchar else v end as normal from n"""
    out["contrastive_loss"] = f"""with {EMB}, s as (select l.scope, l.id, list_dot_product(l.a, r.b) / 0.07 as ab, list_dot_product(l.b, r.a) / 0.07 as ba, list_dot_product(l.a, l.b) / 0.07 as own from e l join e r on l.scope = r.scope),
c as (select scope, id, ln(sum(exp(ab - own))) as x, ln(sum(exp(ba - own))) as y from s group by all) select scope, count(*) as n, round(avg((x + y) / 2), 6) as loss from c group by 1"""
    out["masked_mse_zero"] = f"with {PRED} select round(mse, 4) as masked_mse from g where split = 'overall'"
    out["loss_total"] = "select l_orderkey, l_linenumber, round(l_quantity + 0.5::double * l_discount + 0.25::double * l_tax + 0.001::double * l_extendedprice, 6) as total from lineitem"
    out["lr_cosine"] = """select step, count(*) as n, round(case when step + 1 <= 20 then (step + 1) / 20 else greatest(1e-8, 0.5 * (1 + cos(pi() * (step + 1 - 20) / 180))) end, 9) as factor
from (select l_partkey % 200 as step from lineitem) group by step"""
    out["lr_one_cycle"] = """select step, count(*) as n, round(case when step <= 19 then 1 + (0.04::double - 1) / 2 * (1 + cos(pi() * step / 19)) else 0.000004::double + (1 - 0.000004::double) / 2 * (1 + cos(pi() * (step - 19) / 180)) end, 9) as factor
from (select l_partkey % 200 as step from lineitem) group by step"""
    out["structure_loss"] = "with l as (select embedding[1:10]::double[] as x, label from embeddings) select round(avg(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[label + 1]), 7) as structure_loss from l"
    out["loss_warmup"] = "select step, count(*) as n, round(0.3::double * least(1.0, step / 20), 9) as weight from (select l_partkey % 50 as step from lineitem) group by step"
    brands = [f"Brand#{i}" for i in range(1, 26)]
    out["gene_widening"] = f"with {VALUES}, s as (select region_id, count(*) as n_cells from cells group by 1) select region_id, n_cells, " + ", ".join(f"coalesce(max(value) filter (gene = '{g}'), 0) as \"gene_{g}\"" for g in brands) + " from s left join vals using (region_id) group by all"
    digits = lambda text: f"('0x' || substr(md5({text}), 1, 8))::bigint"
    out["linear_embed"] = f"""with {VALUES}, w as (select region_id, j as place, sum(ln(1 + greatest(value, 0)) * ({digits("'0|' || gene || '|' || j")} / 2147483648.0::double - 1)) as v from vals, range(8) t(j) group by 1, 2)
select region_id, place::int as place, round(v / sqrt(sum(v * v) over (partition by region_id)), 6) as v from w"""
    out["synthetic_case"] = f"""with g as (select c.range as id, g.range as gene from range((select count(*) from customer)) c, range(12) g), s as (select id % 12 as r, count(*) as n from range((select count(*) from customer)) t(id) group by 1),
v as (select id, gene, floor(-ln(({digits("'5|' || id || '|' || gene")} + 1)::double / 4294967297) * case when gene % 3 = id % 12 % 3 then 4.0 else 0.7 end) as value from g)
select 'contour_' || id % 12 as region_id, 'gene_' || gene as gene, round(sum(value) / any_value(n), 6) as value from v join s on r = id % 12 where value > 0 group by id % 12, gene"""
    filled = f"""{VALUES}, gs as (select gene, row_number() over (order by md5('1|' || gene), gene) - 1 as i, count(*) over () as n from (select distinct p_brand as gene from part)),
have as (select region_id, count(*) filter (value > 0) as n0 from vals group by 1),
own as (select region_id, gene, value from vals where value > 0 qualify row_number() over (partition by region_id order by md5('1|' || region_id || '|' || gene), gene) <= 20),
zero as (select have.region_id, gs.gene, (gs.i - {digits("'1|' || region_id")} % gs.n + gs.n) % gs.n as j, n0 from have, gs where n0 < 20 and not exists (select 1 from own where own.region_id = have.region_id and own.gene = gs.gene)),
sel as (select region_id, gene, value from own union all select region_id, gene, 0 from zero where j < 20 qualify row_number() over (partition by region_id order by j) <= 20 - n0)"""
    out["gene_selection_filled"] = f"with {filled} select region_id, gene, value::double as value from sel"
    tokens = f"""{filled},
lg as (select *, ln(1 + greatest(value, 0)) as w, md5('1|' || region_id || '|' || gene) as k from sel),
lm as (select *, max(ln(1 + w)) over (partition by region_id) as top, substr(k, 1, 8) as h8, min(substr(k, 1, 8) || gene) over (partition by region_id) as f from lg),
tok as (select *, row_number() over (partition by region_id order by gene) - 1 as place, count(*) over (partition by region_id) as len, h8 < '{int(0.15 * 2**32):08x}' or h8 || gene = f as mask from lm)"""
    out["region_batches"] = f"""with {tokens} select region_id, (20 - len)::int as padding, place::int as place, gene, round(w, 6) as value, round(case when mask then 0 else w end, 6) as input,
  case when top > 0 then floor(ln(1 + w) / top * 7) else 0 end::bigint as bin, mask from tok"""
    out["batch_cells"] = f"""with {tokens}, sc as (select region_id, cell_id from cells qualify row_number() over (partition by region_id order by md5('1|' || cell_id), cell_id) <= 3)
select region_id, sc.cell_id, place::int as place, round(coalesce(ln(1 + greatest(e.value, 0)), 0), 6) as value from sc join tok using (region_id) left join expr e on e.cell_id = sc.cell_id and e.gene = tok.gene"""
    out["epoch_batches"] = f"with {CUST}, o as (select region_id, row_number() over (order by md5('7|3|' || region_id), region_id) - 1 as r from cust) select region_id, r // 64 as batch, r % 64 as place from o"
    out["neighbor_targets"] = f"""with {filled}, {CUST}, {NEAR.format("", 3)},
nm as (select near.region_id, gene, sum(value) / 3 as value from near join vals on lpad(vals.region_id, 8, '0') = neighbor_id group by 1, 2)
select lpad(sel.region_id, 8, '0') as region_id, sel.gene, round(ln(1 + greatest(coalesce(nm.value, 0), 0)), 6) as neighbor
from sel left join nm on nm.region_id = lpad(sel.region_id, 8, '0') and nm.gene = sel.gene"""
    out["region_items"] = f"""with {CUST}, s as (select avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, stddev_pop(y) as sy from cust)
select region_id, round((x - mx) / sx, 6) as x_z, round((y - my) / sy, 6) as y_z, dense_rank() over (order by slide_id) - 1 as code, dense_rank() over (order by slide_id) as context_id from cust, s"""
    out["validation_mean"] = "select round(avg(l_discount), 9) as val_gene_loss, round(avg(l_tax), 9) as val_total_loss from lineitem"
    return out
