"""The operators as queries over the shared tables.

Orders stand for cells, customers for regions, brands for genes, quantities for expression;
nations are structures, market segments slides; documents with labels are patches with images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, first_true, normal_id, or_missing, unit, valid_label
from ..operators import encoder, epochs, export, features, metrics, neighbors, network, quality, ranking, regions, similarity, splits
from ..sources import matrix_market, readers
from ..tables import new_folder, to_table

PANEL = ["Brand#11", "Brand#12", "Brand#13", "Brand#99", " Brand#21 ", ""]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    customer = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = _read(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("cell_id"), F.col("o_totalprice").alias("x"), (F.col("c_acctbal") + F.col("o_orderkey") % 100).alias("y"),
        F.col("o_custkey").cast("string").alias("region_id"), F.col("c_nationkey").cast("string").alias("structure_id"), F.col("n_name").alias("structure_label"),
        F.col("c_mktsegment").alias("slide_id"), F.col("o_orderstatus").alias("cluster"), F.col("o_orderkey").alias("row_pos"),
    )


def expr(spark: SparkSession, d: str) -> DataFrame:
    lines = _read(spark, d, "lineitem").join(_read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select(F.col("l_orderkey").cast("string").alias("cell_id"), F.col("p_brand").alias("gene"), "l_quantity")
    return lines.repartition("cell_id").groupBy("cell_id", "gene").agg(F.sum("l_quantity").alias("value"))  # cells are small, and what joins them needs no other shuffle


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with a split, two unit halves and labels."""
    e = _read(spark, d, "embeddings")
    split = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 == 7, "val").otherwise("test")
    vec = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("id"), vec.alias("vec"), F.col("label").cast("string").alias("label"), split.alias("split"),
        (F.col("vec_id") % 3).cast("string").alias("batch"), unit(F.slice(vec, 1, 32)).alias("a"), unit(F.slice(vec, 33, 32)).alias("b"),
    )


def region_mean_expression(spark: SparkSession, d: str) -> DataFrame:
    return regions.mean_expression(expr(spark, d), cells(spark, d)).select("region_id", "gene", F.round("value", 6).alias("value"))


def region_table(spark: SparkSession, d: str) -> DataFrame:
    out = regions.region_table(cells(spark, d), min_cells=5)
    return out.select("region_id", "n_cells", F.round("x", 7).alias("x"), F.round("y", 7).alias("y")).orderBy("region_id")


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """Documents as patches of the customers of the same number."""
    return _read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("contour_id"), F.concat(F.col("doc_id") % 30, F.lit(".0")).alias("structure_id"), F.concat(F.lit("o"), "doc_id").alias("cell_id"),
        F.concat(F.lit("img"), F.col("doc_id") % 500).alias("image_path"), F.lit(None).cast("string").alias("structure_name"), F.when(F.col("lang") == "de", F.col("source")).alias("structure_label"),
        F.col("n_chars").cast("double").alias("patch_x"), (F.col("n_chars") % 7).cast("double").alias("patch_y"), (F.col("n_chars") % 3).cast("double").alias("patch_size"), F.col("lang").alias("source_image"),
        F.col("doc_id").alias("row_pos"),
    )


def _images(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "labels").select(F.concat(F.lit("img"), F.col("doc_id") % 500).alias("image_path"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return regions.region_rows(c, _patches(spark, d), _images(spark, d), regions.label_table(c, "structure_id", "structure_label", "row_pos"))


def region_rows(spark: SparkSession, d: str) -> DataFrame:
    out = _regions(spark, d).select(
        "region_id", "contour_id", "n_cells", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "structure_id", "structure_label", "image_path", "qc_flag", "cluster",
        *regions.PATCH_COLUMNS, *regions.METADATA,
    )
    return out.orderBy("region_id")


def first_non_null_domain(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("cluster", F.when(F.col("row_pos") % 3 == 0, F.lit("nan")).otherwise(F.col("cluster")))
    return regions.first_non_null(c, "region_id", ["cluster", "slide_id"], "row_pos")


def membership_edges(spark: SparkSession, d: str) -> DataFrame:
    return regions.membership(cells(spark, d)).groupBy("region_id", "membership").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight"))


def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.label_counts(cells(spark, d), "structure_label")


def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.domain_counts(cells(spark, d), ["slide_id", "cluster", "organ"])


def distinct_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.distinct_per_split(embedded(spark, d), ["label", "batch"])


def spatial_bounds(spark: SparkSession, d: str) -> DataFrame:
    return quality.spatial_bounds(cells(spark, d))


def matrix_density(spark: SparkSession, d: str) -> DataFrame:
    n_cells, n_genes = _read(spark, d, "orders").count(), _read(spark, d, "part").select("p_brand").distinct().count()
    return quality.density(expr(spark, d), n_cells, n_genes).select(F.round("density", 9).alias("density"))


def coverage_ratios(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id", "left")
    return docs.agg(F.round(quality.share(F.col("quality").isNotNull()), 6).alias("labelled"), F.round(quality.share(F.col("quality") == 1), 6).alias("good"), F.round(quality.share(valid_label("lang")), 6).alias("with_lang"))


def structure_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d).withColumn("n_cells", F.col("id") % 7).withColumn("structure_label", F.when(F.col("id") % 11 != 0, F.col("label")))
    out = export.structure_summary(rows)
    return out.select("structure_label", F.col("n_cells").cast("long"), F.posexplode("vec").alias("place", "v")).select("structure_label", "n_cells", "place", F.round("v", 6).alias("v"))


def cluster_embedding_mean(spark: SparkSession, d: str) -> DataFrame:
    return export.mean_vectors(embedded(spark, d), "batch").select("batch", F.posexplode("vec").alias("place", "v")).select("batch", "place", F.round("v", 6).alias("v"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    line = _read(spark, d, "lineitem")
    split = F.when(F.col("l_orderkey") % 10 < 7, "train").when(F.col("l_orderkey") % 10 == 7, "val").otherwise("test")
    return line.select(split.alias("split"), (F.col("l_extendedprice") / 1000).alias("pred"), F.col("l_quantity").alias("target"), (F.col("l_linenumber") % 2 == 1).alias("mask"))


def masked_mse_by_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.prediction_summary(_predictions(spark, d)).select("split", "n_masked_values", F.round("mse", 4).alias("mse"))


def pearson_by_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.prediction_summary(_predictions(spark, d)).select("split", F.round("correlation", 6).alias("correlation")).orderBy("split")


def retrieval_topk(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.retrieval(metrics.scopes(embedded(spark, d)))
    out = out.select("scope", "k", "effective_k", "n_regions", F.round("a_to_b_topk", 6).alias("a_to_b_topk"), F.round("b_to_a_topk", 6).alias("b_to_a_topk"))
    return metrics.scope_order(out, "k")


def same_label_hit(spark: SparkSession, d: str) -> DataFrame:
    return metrics.same_label_hit(metrics.scopes(embedded(spark, d)), "label").withColumn("same_label_recall", F.round("same_label_recall", 6))


def batch_mixing_entropy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.batch_mixing(metrics.scopes(embedded(spark, d)), "batch").withColumn("batch_mixing_entropy", F.round("batch_mixing_entropy", 6))


def silhouette_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return metrics.silhouette(metrics.scopes(embedded(spark, d)), "label").withColumn("silhouette", F.round("silhouette", 6))


def embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    return similarity.nearest(metrics.scopes(embedded(spark, d)), 3).select("scope", "id", "neighbor_id", "rank")


def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_count(_read(spark, d, "part"), "p_brand")


def panel_metrics(spark: SparkSession, d: str) -> DataFrame:
    panel = readers.read_panel(spark, None, PANEL)
    return quality.panel_metrics(_read(spark, d, "part").select(F.col("p_brand").alias("gene")), panel)


def panel_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    genes, panel = _read(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct(), readers.read_panel(spark, None, PANEL).select("gene")
    both = genes.join(panel, "gene", "left_semi").withColumn("kind", F.lit("both"))
    return both.unionByName(panel.subtract(genes).withColumn("kind", F.lit("missing"))).unionByName(genes.join(panel, "gene", "left_anti").withColumn("kind", F.lit("outside")))


def split_provenance(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_summary(splits.make_splits(_customers(spark, d), "slide_holdout")).withColumn("blocks", F.array_join("blocks", ","))


def image_qc_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id", "left")
    return quality.image_rollup(docs.select(F.when(F.col("quality") == 1, F.col("source")).alias("image_path")))


def missing_images(spark: SparkSession, d: str) -> DataFrame:
    patches = _read(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("image_path"))
    return quality.missing_images(patches, _read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("image_path"))).select("doc_id", "image_path")


def failure_analysis(spark: SparkSession, d: str) -> DataFrame:
    size = _read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_cells"))
    c = _read(spark, d, "customer").join(size, F.col("c_custkey") == F.col("o_custkey"), "left")
    split = F.when(F.col("c_custkey") % 10 < 7, "train").when(F.col("c_custkey") % 10 == 7, "val").otherwise("test")
    rows = c.select(
        F.col("c_custkey").cast("string").alias("region_id"), split.alias("split"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.col("c_mktsegment").alias("slide_id"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey").cast("string")).alias("batch_id"),
    )
    genes = _read(spark, d, "part").select(F.col("p_brand").alias("gene"))
    out = quality.failure_analysis(rows, _patches(spark, d).drop("row_pos"), _images(spark, d), "slide_holdout", readers.read_panel(spark, None, PANEL), genes)
    return metrics.scope_order(out.withColumn("value", F.round("value", 6)), "category", "metric", scope="split")


def _case_row(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    genes = _read(spark, d, "part").select(F.col("p_brand").alias("feature_name"))
    return quality.case_metrics(c, _regions(spark, d), regions.membership(c), genes, expr(spark, d), _patches(spark, d), _images(spark, d), min_cells=5)


def case_metrics(spark: SparkSession, d: str) -> DataFrame:
    row = _case_row(spark, d)
    return row.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.round(F.col(c).cast("double"), 6)) for c in row.columns]))).alias("metric", "value"))


def verdict_rules(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    genes = _read(spark, d, "part").select(F.col("p_brand").alias("feature_name"))
    m = quality.case_manifest(c, _regions(spark, d), regions.membership(c), genes, expr(spark, d), _patches(spark, d), _images(spark, d), readers.read_panel(spark, None, PANEL), domains=regions.METADATA, min_cells=5)
    return spark.createDataFrame([(rule, level, bool(hit)) for rule, level, hit, _ in quality.verdict_rules(m)], "rule string, level string, fired boolean")


def manifest_domains(spark: SparkSession, d: str) -> DataFrame:
    c, r = cells(spark, d), _regions(spark, d).withColumn("organ", F.when(F.col("n_cells") % 2 == 0, F.lit("even")))
    return quality.domain_counts(r, ["slide_id", "organ"]).unionByName(quality.domain_counts(c, ["cluster"]))


def patch_provenance(spark: SparkSession, d: str) -> DataFrame:
    """What the columns of the patches say by their names, and how many patches have each."""
    patches = _patches(spark, d).withColumns({"level": F.when(F.col("row_pos") % 3 > 0, F.col("patch_size")), "affine": F.when(F.col("row_pos") % 7 == 0, F.col("source_image"))})
    origin = quality.provenance(patches.columns)
    kinds = [(k, c) for k in ("coordinate_columns", "image_columns", "registration_columns", "parameter_columns") for c in origin[k]]
    filled = patches.agg(*[F.count(c).alias(c) for c in patches.columns])
    return filled.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("name"), F.col(c).alias("n_patches")) for k, c in kinds])).alias("r")).select("r.*")


def cell_flags(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).select(F.concat(F.lit("o"), "cell_id").alias("cell_id"))
    return export.cell_flags(c, _patches(spark, d), _images(spark, d))


def image_manifest(spark: SparkSession, d: str) -> DataFrame:
    return export.image_manifest(_regions(spark, d).drop("patch_y"))


def manifest_records(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    text = F.concat(F.lit('{"region_id": "r'), "event_id", F.lit('", "x": '), F.col("event_id") % 5, F.lit(', "patch": {"patch_x": 9, "image_path": "'), "event_type", F.lit('", "center_y": 4}, "transform": {"b": 1, "a": 2}}'))
    text = F.when(F.col("event_id") % 6 == 5, F.lit('"no record"')).otherwise(text)
    rows = e.select("event_id", F.parse_json(text).alias("record"))
    plain, falsy = readers.patch_manifest(rows), readers.patch_manifest(rows, falsy_zero=True)
    return plain.select("event_id", "contour_id", "image_path", "patch_x", "patch_y", "registration_transform").join(falsy.select("event_id", F.col("patch_x").alias("patch_x_falsy")), "event_id")


def structure_map_last_wins(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).drop("structure_id").select("cell_id", "slide_id")
    table = _read(spark, d, "customer").select(F.col("c_mktsegment").alias("slide_id"), F.col("c_nationkey").alias("structure_id"), "c_custkey")
    return regions.add_structure(c, table, "slide_id", "c_custkey").select("cell_id", "structure_id")


def contour_map_first_wins(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).select("cell_id", F.when(F.col("row_pos") % 4 == 0, F.col("region_id")).when(F.col("row_pos") % 4 == 1, F.lit("nan")).alias("contour_id"))
    table = _read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("cell_id"), F.concat(F.lit("s"), "l_suppkey").alias("contour_id"), (F.col("l_partkey") % 5).cast("string").alias("structure_id"), (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("position"))
    return regions.add_contour(c, table, "position")


def patch_left_join(spark: SparkSession, d: str) -> DataFrame:
    base = regions.region_table(cells(spark, d)).select("region_id", "n_cells")
    patches = _read(spark, d, "documents").select((F.col("doc_id") % 700).cast("string").alias("region_id"), F.col("source").alias("image_path"), "doc_id")
    return regions.look_up(base, patches, "region_id", ["image_path"], "doc_id", last=True)


def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("structure_id", F.when(F.col("row_pos") % 2 == 0, F.concat("structure_id", F.lit(".0"))).otherwise(F.col("structure_id")))
    return regions.label_table(c, "structure_id", "structure_label", "row_pos")


def split_completeness(spark: SparkSession, d: str) -> DataFrame:
    r = _customers(spark, d)
    return regions.with_splits(r.select("region_id"), splits.make_splits(r, "slide_holdout")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    return c.select(F.format_string("%08d", "c_custkey").alias("region_id"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") * (F.col("c_custkey") % 17 + 1)).alias("y"), F.col("c_mktsegment").alias("slide_id"), "c_nationkey")


def spatial_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.spatial_knn(_customers(spark, d), 4).select("region_id", "neighbor_id", F.col("rank").cast("long").alias("rank"))


def neighbor_mean_expression(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.spatial_knn(_customers(spark, d), 3)
    means = regions.mean_expression(expr(spark, d), cells(spark, d)).withColumn("region_id", F.lpad("region_id", 8, "0"))
    return regions.neighbor_mean(means, near).select("region_id", "gene", F.round("value", 6).alias("value"))


def global_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.global_rank(_customers(spark, d), "x", "region_id").select("region_id", "rank0")


def rank_bins(spark: SparkSession, d: str) -> DataFrame:
    return splits.rank_bins(_customers(spark, d), "x", 7).select("region_id", F.col("bin").cast("long").alias("bin"))


def spatial_blocks(spark: SparkSession, d: str) -> DataFrame:
    return splits.spatial_blocks(_customers(spark, d)).select("region_id", "block_id")


def block_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.make_splits(_customers(spark, d), "spatial_block", seed=3)


def group_holdout(spark: SparkSession, d: str) -> DataFrame:
    return splits.make_splits(_customers(spark, d), "group_holdout", "c_nationkey", seed=5).select("region_id", "split", "split_group_key", "block_id")


def leaking_groups(spark: SparkSession, d: str) -> DataFrame:
    mixed = _customers(spark, d).select(F.col("slide_id").alias("block_id"), F.when(F.col("x") > 9000, "test").otherwise("train").alias("split"))
    return splits.leaking_groups(mixed)


def label_codes(spark: SparkSession, d: str) -> DataFrame:
    r = _customers(spark, d).withColumn("slide_id", F.when(F.col("slide_id") != "BUILDING", F.col("slide_id")))
    return features.label_codes(r, "slide_id").select("region_id", F.col("code").cast("long").alias("code"))


def unique_names(spark: SparkSession, d: str) -> DataFrame:
    genes = _read(spark, d, "part").select(F.col("p_brand").alias("feature_name"), (F.col("p_partkey") - 1).alias("gene_pos"))
    return features.unique_names(genes).select("gene_pos", "vocab_name", F.col("vocab_id").cast("long").alias("vocab_id"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return regions.mean_expression(expr(spark, d), cells(spark, d)).withColumn("value", F.round("value", 3))


def expression_bins(spark: SparkSession, d: str) -> DataFrame:
    return features.expression_bins(_values(spark, d), 8).select("region_id", "gene", F.col("bin").cast("long").alias("bin"))


def coord_zscore(spark: SparkSession, d: str) -> DataFrame:
    return features.z_scores(_customers(spark, d)).select("region_id", F.round("x_z", 6).alias("x_z"), F.round("y_z", 6).alias("y_z"))


def cell_sample(spark: SparkSession, d: str) -> DataFrame:
    return features.sample_cells(cells(spark, d).select("region_id", "cell_id"), 3, 1)


def gene_selection(spark: SparkSession, d: str) -> DataFrame:
    return features.select_genes(_values(spark, d), 6, 1).select("region_id", "gene")


def mask_selection(spark: SparkSession, d: str) -> DataFrame:
    return features.mask_genes(_values(spark, d), 0.15, 1).select("region_id", "gene", "mask")


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct()


def gene_selection_filled(spark: SparkSession, d: str) -> DataFrame:
    return features.select_genes(_values(spark, d), 20, 1, _genes(spark, d))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return features.region_batches(_values(spark, d), 20, 8, 0.15, 1, _genes(spark, d), cells(spark, d), expr(spark, d), 3)


def region_batches(spark: SparkSession, d: str) -> DataFrame:
    out = _batches(spark, d).select("region_id", "padding", F.posexplode("tokens").alias("place", "t"))
    return out.select("region_id", "padding", "place", "t.gene", F.round("t.value", 6).alias("value"), F.round("t.input", 6).alias("input"), F.col("t.bin").cast("long").alias("bin"), "t.mask")


def batch_cells(spark: SparkSession, d: str) -> DataFrame:
    out = _batches(spark, d).select("region_id", F.explode_outer("cells").alias("c")).where("c is not null").select("region_id", "c.cell_id", F.posexplode("c.values").alias("place", "value"))
    return out.select("region_id", "cell_id", "place", F.round("value", 6).alias("value"))


def region_items(spark: SparkSession, d: str) -> DataFrame:
    out = features.region_items(_customers(spark, d), "slide_id")
    return out.select("region_id", F.round("x_z", 6).alias("x_z"), F.round("y_z", 6).alias("y_z"), "code", "context_id")


def validation_mean(spark: SparkSession, d: str) -> DataFrame:
    terms = _read(spark, d, "lineitem").select(F.col("l_discount").alias("gene_loss"), F.col("l_tax").alias("total_loss"))
    return metrics.validation_mean(terms).select(*[F.round(c, 9).alias(c) for c in ("val_gene_loss", "val_total_loss")])


def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """A case for each segment, every other one with its names in place of balances."""
    c = _read(spark, d, "customer")
    names = sorted(r["c_mktsegment"] for r in c.select("c_mktsegment").distinct().collect())
    cases = {n: c.where(F.col("c_mktsegment") == n).select(F.col("c_custkey").alias("cell_id"), "c_name" if i % 2 else "c_acctbal") for i, n in enumerate(names)}
    return readers.corpus_union(cases, ("cell_id",))


def manifest_coalesce(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    return e.select("event_id", first_true(F.col("event_id") % 2, F.col("event_id") % 3, F.lit(9).cast("long")).alias("patch_x"))


def manifest_json(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").select("event_id", F.from_json("props", "k string").alias("patch"))
    return e.select("event_id", clean_text(F.col("patch.k")).alias("k"))


def null_like_clean(spark: SparkSession, d: str) -> DataFrame:
    """Types of events, some of them written as missing values are."""
    e = _read(spark, d, "events")
    odd = F.get(F.array(*[F.lit(v) for v in ("", "nan", "None", None, "unknown", "<NA>")]), (F.col("event_id") % 12).cast("int"))
    t = e.select("event_id", F.when(F.col("event_id") % 12 < 6, odd).otherwise(F.col("event_type")).alias("v"))
    return t.select("event_id", clean_text("v").alias("cleaned"), or_missing("v").alias("filled"), valid_label("v").alias("is_label"))


def id_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Quantities, discounts and modes of lines as ids: whole numbers lose their fraction, others stay."""
    line = _read(spark, d, "lineitem")
    v = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity").cast("string")).when(F.col("l_linenumber") % 3 == 1, F.col("l_discount").cast("string")).otherwise(F.concat(F.col("l_suppkey"), F.lit("e2")))
    return line.select("l_orderkey", "l_linenumber", normal_id(v).alias("normal"))


def contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.contrastive_loss(metrics.scopes(embedded(spark, d))).withColumn("loss", F.round("loss", 6))


def masked_mse_zero(spark: SparkSession, d: str) -> DataFrame:
    return metrics.masked_mse(_predictions(spark, d)).select(F.round("masked_mse", 4).alias("masked_mse"))


def loss_total(spark: SparkSession, d: str) -> DataFrame:
    line = _read(spark, d, "lineitem")
    total = metrics.total_loss(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice"), 0.5, 0.25, 0.001)
    return line.select("l_orderkey", "l_linenumber", F.round(total, 6).alias("total"))


def _steps(spark: SparkSession, d: str, most: int) -> DataFrame:
    """Steps of a run, one for each line."""
    return _read(spark, d, "lineitem").select((F.col("l_partkey") % most).alias("step"))


def lr_cosine(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.cosine_schedule(_steps(spark, d, 200), 200, 20)
    return out.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("factor"), 9).alias("factor"))


def lr_one_cycle(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.one_cycle_schedule(_steps(spark, d, 200), 200, 20)
    return out.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("factor"), 9).alias("factor"))


def structure_loss(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("logits"), "label")
    return metrics.structure_loss(e).select(F.round("structure_loss", 7).alias("structure_loss"))


def loss_warmup(spark: SparkSession, d: str) -> DataFrame:
    weight = metrics.warmup_weight(F.col("step"), 0.3, 20)
    return _steps(spark, d, 50).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(weight), 9).alias("weight"))


def linear_embed(spark: SparkSession, d: str) -> DataFrame:
    out = export.linear_embed(_values(spark, d), 8).select("region_id", F.posexplode("vec").alias("place", "v"))
    return out.select("region_id", "place", F.round("v", 6).alias("v"))


def gene_widening(spark: SparkSession, d: str) -> DataFrame:
    sizes = regions.region_table(cells(spark, d)).select("region_id", "n_cells")
    return export.widen_genes(_values(spark, d), sizes, sorted(r["gene"] for r in _genes(spark, d).collect()))


def synthetic_case(spark: SparkSession, d: str) -> DataFrame:
    """A made-up case with a cell for each customer."""
    c, e = readers.synthetic_case(spark, _read(spark, d, "customer").count(), 12, 3, 5)
    return regions.mean_expression(e, regions.with_region_key(c)).withColumn("value", F.round("value", 6))


def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batch of each region in one epoch, and its place there."""
    return epochs.epoch_order(_customers(spark, d), 3, 64, 7)


def neighbor_targets(spark: SparkSession, d: str) -> DataFrame:
    """What the network is to tell of each region's neighbourhood, at the places of its tokens."""
    values = to_table(_values(spark, d), "values")
    near = regions.neighbor_mean(values.withColumn("region_id", F.lpad("region_id", 8, "0")), neighbors.spatial_knn(_customers(spark, d), 3))
    batches = features.region_batches(values, 20, 8, 0.15, 1, _genes(spark, d)).withColumn("region_id", F.lpad("region_id", 8, "0"))
    rows = encoder.inputs(batches, features.region_items(_customers(spark, d), "slide_id"), None, near)
    return rows.select("region_id", F.explode_outer("tokens").alias("t")).where("t is not null").select("region_id", "t.gene", F.round("t.neighbor", 6).alias("neighbor"))


def region_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of all regions by a seeded network, which has not been trained; they are checked against loops in the tests."""
    genes = sorted(r["gene"] for r in _genes(spark, d).collect())
    items = features.region_items(_customers(spark, d).withColumn("region_id", F.col("region_id").cast("int").cast("string")), "slide_id")
    shape = network.Shape(size=16, heads=2, layers=1, bins=8, image_size=8, structures=5, use_image=False)
    return encoder.embed(encoder.inputs(_batches(spark, d), items), encoder.new_network(shape, genes, 1)).select("region_id", "vec")


def matrix_market_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean expression of all regions, of a case written as an instrument's folder and read from it."""
    folder, c = new_folder(spark, "instrument"), cells(spark, d)
    genes = ranking.global_rank(_genes(spark, d), "gene", "gene", "gene_pos")
    matrix_market.write_case(c, genes, expr(spark, d), folder)
    case = matrix_market.read_case(spark, folder)
    members = to_table(case["cells"].select("row_pos", "region_id"), "members")
    return regions.mean_expression(case["entries"], members, key="row_pos").select("region_id", "gene", F.round("value", 6).alias("value"))


NAMES = [
    "region_mean_expression", "region_table", "region_rows", "first_non_null_domain", "membership_edges", "structure_counts", "domain_counts", "distinct_coverage",
    "spatial_bounds", "matrix_density", "coverage_ratios", "structure_summary", "cluster_embedding_mean", "masked_mse_by_split", "pearson_by_split", "retrieval_topk",
    "same_label_hit", "batch_mixing_entropy", "silhouette_by_scope", "embedding_knn", "duplicate_names", "panel_metrics", "panel_semi_anti", "split_provenance",
    "image_qc_rollup", "missing_images", "failure_analysis", "structure_map_last_wins", "contour_map_first_wins", "patch_left_join", "label_lookup", "split_completeness",
    "spatial_knn", "neighbor_mean_expression", "global_rank", "rank_bins", "spatial_blocks", "block_splits", "group_holdout", "leaking_groups", "label_codes", "unique_names",
    "expression_bins", "coord_zscore", "cell_sample", "gene_selection", "mask_selection", "region_batches", "corpus_union", "manifest_coalesce", "manifest_json",
    "null_like_clean", "id_normalise", "contrastive_loss", "masked_mse_zero", "loss_total", "lr_cosine", "loss_warmup", "linear_embed", "gene_widening", "synthetic_case",
    "case_metrics", "verdict_rules", "manifest_domains", "patch_provenance", "cell_flags", "image_manifest", "manifest_records", "gene_selection_filled", "batch_cells", "lr_one_cycle", "structure_loss", "region_items", "validation_mean",
    "matrix_market_means", "epoch_batches", "neighbor_targets", "region_embeddings",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}
