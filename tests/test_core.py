"""Core operators on tiny tables whose results are plain to see."""

import dataclasses
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import clean_text, normal_id
from tessera.operators import encoder, export, features, metrics, neighbors, quality, ranking, regions, splits
from tessera.plans import evaluation
from tessera.sources import cases, config, readers, writers


def cells(spark):
    return spark.createDataFrame([("a", 1.0, 2.0, "contour_a", "s1", 0), ("b", 2.0, 3.0, "contour_a", "s1", 1), ("c", 9.0, 9.0, "nan", None, 2)], "cell_id string, x double, y double, contour_id string, structure_id string, row_pos long")


def test_mean_counts_zeros(spark):
    c = regions.with_region_key(cells(spark))
    expr = spark.createDataFrame([("a", "g1", 1.0), ("a", "g3", 2.0), ("b", "g2", 3.0), ("b", "g3", 1.0), ("c", "g1", 7.0)], "cell_id string, gene string, value double")
    got = {(r.region_id, r.gene): r.value for r in regions.mean_expression(expr, c).collect()}
    assert got == {("contour_a", "g1"): 0.5, ("contour_a", "g2"): 1.5, ("contour_a", "g3"): 1.5}
    row = regions.region_table(c).first()
    assert (row.region_id, row.n_cells, row.x, row.y) == ("contour_a", 2, 1.5, 2.5)
    assert regions.region_table(c, min_cells=3).count() == 0


def test_region_key_fallbacks(spark):
    c = cells(spark)
    assert [r.region_id for r in regions.with_region_key(c.drop("contour_id")).orderBy("row_pos").collect()][:2] == ["region_s1", "region_s1"]
    assert [r.region_id for r in regions.with_region_key(c.drop("contour_id", "structure_id")).orderBy("row_pos").collect()] == ["a", "b", "c"]


def test_region_rows_take_last_patch(spark):
    c = regions.with_region_key(cells(spark))
    patches = spark.createDataFrame([("contour_a", "one.png", 0), ("contour_a", "two.png", 1), (None, "x", 2)], "contour_id string, image_path string, row_pos long")
    images = spark.createDataFrame([("two.png",)], "image_path string")
    row = regions.region_rows(c, patches, images).first()
    assert (row.image_path, row.qc_flag, row.structure_label) == ("two.png", "ok", "s1")


def test_region_rows_take_structure_from_patch(spark):
    c = regions.with_region_key(cells(spark)).withColumn("structure_id", F.lit("3"))
    labels = spark.createDataFrame([("3", "lab3"), ("9", "lab9")], "structure_id string, structure_label string")
    given = lambda value: spark.createDataFrame([("contour_a", value, 0)], "contour_id string, structure_id string, row_pos long")
    row = lambda value: (lambda r: (r.structure_id, r.structure_label))(regions.region_rows(c, given(value), None, labels).where("region_id = 'contour_a'").first())
    assert row("9") == ("9", "lab9") and row("9.0") == ("9.0", "lab9")
    assert row("7.0") == ("7.0", "7.0") and row(None) == ("3", "lab3") and row("nan") == ("3", "lab3")
    number = given("9").withColumn("structure_id", F.lit(9))
    assert regions.region_rows(c, number, None, labels).where("region_id = 'contour_a'").first().structure_label == "lab9"
    assert len(regions.region_rows(c).columns) == 24


def test_cells_are_exported_and_reported(spark):
    c = cells(spark)
    patches = spark.createDataFrame([("a", "one.png"), ("b", "gone.png")], "cell_id string, image_path string")
    flags = export.cell_flags(c, patches, spark.createDataFrame([("one.png",)], "image_path string"))
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.5, 0.5])], "cell_id string, vec array<double>")
    rows = export.cell_table(c, vectors, flags, 2)
    assert rows.columns == ["cell_id", "x", "y", "structure_label", "qc_flag", "emb_0", "emb_1"]
    assert {tuple(r) for r in rows.collect()} == {("a", 1.0, 2.0, "s1", "ok", 1.0, 0.0), ("b", 2.0, 3.0, "s1", "no_image", 0.0, 1.0), ("c", 9.0, 9.0, "unknown", "no_image", 0.5, 0.5)}
    assert export.cell_report(rows, "one", "run/best") == {
        "case_name": "one", "checkpoint": "run/best", "n_cells_total": 3, "n_cells_with_image": 1, "n_cells_no_image": 2, "image_coverage": 0.3333, "structure_counts": {"s1": 2, "unknown": 1},
    }
    assert export.cell_report(rows.limit(0), "none")["image_coverage"] == 0


def test_with_splits_is_total(spark):
    r = spark.createDataFrame([("a",), ("b",)], "region_id string")
    s = spark.createDataFrame([("a", "train"), ("b", "test"), ("z", "val")], "cell_id string, split string")
    assert {tuple(x) for x in regions.with_splits(r, s).collect()} == {("a", "train"), ("b", "test")}
    with pytest.raises(ValueError, match="without a split"):
        regions.with_splits(r, s.where("cell_id = 'a'"))
    with pytest.raises(ValueError, match="several splits"):
        regions.with_splits(r, s.union(s))


def test_rank_bins_are_not_ntile(spark):
    d = spark.createDataFrame([(f"{i}", float(i)) for i in range(10)], "region_id string, x double")
    got = [r.bin for r in splits.rank_bins(d, "x", 4).orderBy("x").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]
    tied = d.withColumn("x", F.lit(1.0))
    assert [r.rank0 for r in ranking.global_rank(tied, "x", "region_id").orderBy("region_id").collect()] == list(range(10))


@pytest.mark.parametrize(("strategy", "column"), [("spatial_block", None), ("slide_holdout", None), ("group_holdout", "slide_id")])
def test_splits_keep_blocks_together(spark, strategy, column):
    d = spark.createDataFrame([(f"r{i:03d}", float(i % 13), float(i % 7), f"s{i % 9}" if i % 9 else None) for i in range(120)], "region_id string, x double, y double, slide_id string")
    s = splits.make_splits(d, strategy, column, seed=2)
    assert s.count() == 120 and splits.leaking_groups(s).count() == 0
    assert sorted(map(tuple, s.collect()), key=str) == sorted(map(tuple, splits.make_splits(d, strategy, column, seed=2).collect()), key=str)
    with pytest.raises(ValueError):
        splits.make_splits(d.drop("slide_id"), "slide_holdout")


def test_spatial_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(50, 0.1, (60, 2)), [[200.0, 200.0]]])
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(999, None, 1.0)], "region_id long, x double, y double")
    got = {}
    for r in neighbors.spatial_knn(d, 5).collect():
        got.setdefault(r.region_id, {})[r.rank] = r.neighbor_id
    for i in range(len(p)):
        dist = np.sqrt(((p - p[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(len(p)), dist)) if j != i][:5]
        assert [got[i][k] for k in range(1, 6)] == want
    assert neighbors.spatial_knn(d.limit(1), 5).count() == 0


def brute_knn(p, ids, k):
    p, ids = np.asarray(p), np.asarray(ids)
    out = {}
    for i in range(len(p)):
        d = np.sqrt(((p - p[i]) ** 2).sum(1))
        out[ids[i]] = [ids[j] for j in np.lexsort((ids, d)) if j != i][:k]
    return out


@pytest.mark.parametrize("shape", ["crowd", "line", "cloud"])
def test_spatial_knn_in_small_cells(spark, shape):
    """Crowds at one place, points of one line, and many cells."""
    rng = np.random.default_rng(7)
    p = {
        "crowd": np.concatenate([np.zeros((60, 2)), np.ones((9, 2)), rng.normal(size=(40, 2))]),
        "line": np.stack([np.full(150, 2.0), rng.permutation(150) // 2], 1),
        "cloud": np.round(rng.normal(size=(300, 2)) * [30, 1], 1),
    }[shape]
    ids = [f"r{j:04d}" for j in rng.permutation(len(p))]
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, p)], "region_id string, x double, y double").repartition(3)
    got = {}
    for r in neighbors.spatial_knn(d, 4, per_cell=10).collect():
        got.setdefault(r.region_id, {})[r["rank"]] = r.neighbor_id
    want = brute_knn(p, ids, 4)
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == want


def test_embedding_metrics(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = spark.createDataFrame([(i, x[i].tolist(), f"l{i % 3}") for i in range(40)], "id long, vec array<double>, label string").withColumn("scope", F.lit("overall"))
    knn = neighbors.embedding_knn(d, 3, block=16)
    got = {(r.id, r["rank"]): r.neighbor_id for r in knn.collect()}
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    for i in range(40):
        assert [got[i, k] for k in (1, 2, 3)] == np.argsort(-sim[i])[:3].tolist()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    lab, s = np.arange(40) % 3, []
    for i in range(40):
        a = dist[i][(lab == lab[i]) & (np.arange(40) != i)].mean()
        b = min(dist[i][lab == m].mean() for m in range(3) if m != lab[i])
        s.append((b - a) / max(a, b))
    assert math.isclose(metrics.silhouette(d, "label").first().silhouette, np.mean(s), rel_tol=1e-9)
    assert metrics.silhouette(d.limit(2), "label").first().silhouette is None
    assert metrics.batch_mixing(d.withColumn("one", F.lit("x")), "one", knn=knn).first().batch_mixing_entropy is None


def test_pearson_guards(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0)], "split string, pred double, target double").withColumn("mask", F.lit(True))
    assert {r.split: r.correlation for r in metrics.prediction_summary(d).collect()} == {"a": None, "b": None, "overall": None}
    assert metrics.masked_mse(d.withColumn("mask", F.lit(False))).first().masked_mse == 0


def test_names_bins_masks(spark):
    g = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("a", 3)], "feature_name string, gene_pos int")
    assert [r.vocab_name for r in features.unique_names(g).orderBy("gene_pos").collect()] == ["a", "b", "a.1", "a.2"]
    v = spark.createDataFrame([("r", "a", 0.0), ("r", "b", 5.0), ("z", "a", 0.0)], "region_id string, gene string, value double")
    assert {(r.region_id, r.gene): r.bin for r in features.expression_bins(v, 8).collect()} == {("r", "a"): 0, ("r", "b"): 7, ("z", "a"): 0}
    assert {r.region_id for r in features.mask_genes(v, 0.0).where("mask").collect()} == {"r", "z"}
    assert [r.gene for r in features.select_genes(v, 1).where("region_id = 'r'").collect()] == ["b"]


def test_scalars(spark):
    d = spark.createDataFrame([("7.0",), ("nan",), (None,)], "v string")
    assert [r[0] for r in d.select(normal_id("v")).collect()] == ["7", "nan", None]
    assert [r[0] for r in d.select(clean_text("v")).collect()] == ["7.0", None, None]


def case(spark, n_cells=18, patches=None, **data):
    cfg = config.from_mapping({"case_name": "c", "data": {"mode": "synthetic", "n_cells": n_cells, "n_genes": 24, "n_structures": 3, "seed": 7, **data}, "split": {"seed": 13}})
    got = cases.load_case(spark, cfg.data)
    return cfg, cases.build_regions(got if patches is None else dataclasses.replace(got, patches=patches), cfg.data)


def test_verdict_rules(spark):
    """Each rule by a case that breaks it, as fixtures of the quality checks do."""
    cfg, c = case(spark)
    m = cases.describe(spark, c, cfg)
    assert (m["n_cells"], m["n_regions"], m["n_genes"], m["patch_count"], m["has_spatial"], m["cell_assignment_coverage"]) == (18, 12, 24, 0, True, 1.0)
    assert m["structure_counts"] == {"0": 4, "1": 4, "2": 4} and m["split"]["seed"] == 13 and m["spatial_bounds"]["x_min"] is not None
    fired = lambda m, context=True: {rule for rule, _, hit, _ in quality.verdict_rules(m, context) if hit}
    assert fired(m) == {"no_patches"} and not cfg.data.structure_context
    report = quality.verdict(m)
    assert report["status"] == "pass" and len(report["warnings"]) == 1 and not report["fatal_errors"]
    few = {"panel": m["panel"] | {"configured": True, "n_missing": 1, "n_outside": 3}, "duplicate_gene_count": 2, "structure_assignment_coverage": 0.94, "patch_count": 1, "region_image_coverage": 0.5, "missing_image_count": 1}
    want = {"duplicate_genes", "panel_missing", "panel_outside", "patch_coverage", "missing_images", "no_patch_coordinates", "no_registration"}
    assert fired(m | few) == want | {"structure_coverage"} and fired(m | few, False) == want
    assert quality.verdict(m | few)["status"] == "pass"
    for broken, rule in (({"has_spatial": False}, "no_coordinates"), ({"missing_spatial_count": 1}, "coordinates_not_finite"), ({"n_regions": 0}, "no_regions")):
        assert rule in fired(m | broken) and quality.verdict(m | broken)["status"] == "fail"
    text = quality.render_markdown(report, m)
    assert "Status: **pass**" in text and "- n_cells: 18" in text and "- seed: 13" in text


def test_panel_and_provenance(spark):
    genes = spark.createDataFrame([("a",), ("b",), ("b",)], "gene string")
    panel = readers.read_panel(spark, None, ["b", " z ", "b", ""])
    r = quality.panel_metrics(genes, panel).first()
    assert (r.n_panel, r.n_data, r.n_overlap, r.n_missing, r.n_outside, r.missing_first, r.outside_first) == (2, 2, 1, 1, 1, ["z"], ["a"])
    r = quality.panel_metrics(genes, panel.limit(0)).first()
    assert (r.n_panel, r.n_data, r.n_missing, r.n_outside, r.outside_first) == (0, 2, 0, 0, [])
    p = quality.provenance(["X", "tile_y", "x_centroid", "WSI_path", "thumb_image", "affine2", "patch_size", "stride"])
    assert (p["coordinate_columns"], p["image_columns"]) == (["X", "tile_y", "x_centroid"], ["WSI_path", "thumb_image"])
    assert (p["registration_columns"], p["parameter_columns"]) == (["affine2"], ["patch_size", "stride"])
    assert quality.provenance(["x_centroid"], narrow=True)["has_coordinates"] is False


def test_failure_rows(spark):
    r = spark.createDataFrame([("a", "train", 1, "s1"), ("b", "train", 0, None), ("c", "test", 2, "s1")], "region_id string, split string, n_cells long, slide_id string")
    patches = spark.createDataFrame([("a", "one.png"), ("a", "two.png"), ("z", "gone.png"), (None, None)], "contour_id string, image_path string")
    images = spark.createDataFrame([("one.png",), ("two.png",)], "image_path string")
    genes = spark.createDataFrame([("g1",), ("g2",)], "gene string")
    got = {(x.split, x.metric): x.value for x in quality.failure_analysis(r, patches, images, "spatial_block", readers.read_panel(spark, None, ["g1", "h"]), genes).collect()}
    assert got == {
        ("overall", "n_regions"): 3, ("train", "n_regions"): 2, ("test", "n_regions"): 1, ("overall", "slide_id_unique_values"): 2, ("train", "slide_id_unique_values"): 2,
        ("test", "slide_id_unique_values"): 1, ("overall", "patch_rows"): 4, ("overall", "region_image_coverage"): 1 / 3, ("overall", "missing_image_count"): 1,
        ("overall", "low_cell_region_count"): 1, ("overall", "has_patch_coordinates"): 0, ("overall", "has_registration_metadata"): 0, ("overall", "panel_gene_count"): 2,
        ("overall", "missing_from_data_count"): 1, ("overall", "outside_panel_count"): 1,
    }
    assert quality.failure_analysis(r.limit(0), patches.limit(0), images, "x").where("metric = 'patch_rows'").first().value == 0


def test_written_case(spark, tmp_path):
    """A case from canonical tables through regions, quality, evidence and back from what was written."""
    cells = spark.createDataFrame([("a", 1.0, 2.0, "k1", 0), ("b", 2.0, 3.0, "k1", 1), ("c", 5.0, 5.0, "k2", 2)], "cell_id string, x_centroid double, y_centroid double, cluster string, row_pos long")
    cells.write.parquet(f"{tmp_path}/one/cells.parquet")
    spark.createDataFrame([("g1",), ("g2",)], "gene string").write.parquet(f"{tmp_path}/one/genes.parquet")
    spark.createDataFrame([("a", "g1", 1.0), ("b", "g2", 3.0), ("c", "g1", 4.0)], "cell_id string, gene string, value double").write.parquet(f"{tmp_path}/one/expr.parquet")
    spark.createDataFrame([("a", "r1"), ("b", "r1"), ("c", "r2"), ("c", "r9")], "cell_id string, contour_id string").coalesce(1).write.parquet(f"{tmp_path}/one/cell_to_contour.parquet")
    (tmp_path / "structures.csv").write_text("graphclust,structure\nk1,3\nk1,4\n")
    (tmp_path / "patches.json").write_text('{"patches": [7, {"region_id": "r1", "image_path": "i.png", "registration_transform": {"b": 1, "a": 2}, "structure_id": "4.0"}]}')
    cfg = config.from_mapping({"case_name": "one", "data": {"mode": "tables", "root": f"{tmp_path}/one", "structures": f"{tmp_path}/structures.csv", "patches": f"{tmp_path}/patches.json", "slide_id": "s"}, "split": {"strategy": "slide_holdout"}})
    c = cases.build_regions(cases.load_case(spark, cfg.data), cfg.data)
    assert {(r.region_id, r.n_cells, r.structure_id, r.slide_id, r.image_path, r.registration_transform) for r in c.regions.collect()} == {
        ("r1", 2, "4.0", "s", "i.png", '{"a":2,"b":1}'), ("r2", 1, "0", "s", None, None),
    }
    out = str(tmp_path / "out")
    short = writers.write_case(spark, c, cfg, out)
    report = writers.write_quality(spark, c, cfg, out)
    assert writers.read_json(spark, f"{out}/qc_report.json") == report and writers.read_json(spark, f"{out}/training_manifest.json")["n_regions"] == short["n_regions"] == 2
    assert writers.read_json(spark, f"{out}/case_manifest.json")["domain_counts"] == {"slide_id": {"s": 2}} | {c: {"missing": 2} for c in ("patient_id", "organ", "batch_id", "stain", "scanner")}
    made = readers.read_table(spark, f"{out}/splits.csv")
    assert {(r.region_id, r.block_id) for r in regions.with_splits(c.regions.select("region_id"), made).join(made.select("region_id", "block_id"), "region_id").collect()} == {("r1", "s"), ("r2", "s")}
    assert readers.read_table(spark, f"{out}/region_table.csv").count() == 2 and "# Quality report: one" in spark.read.text(f"{out}/qc_report.md", wholetext=True).first()[0]
    places = writers.write_evidence(spark, c, export.linear_embed(c.region_expr, 4), 4, out, "one", ["g1", "g2"])
    e = spark.read.parquet(places["region_embeddings"])
    assert {"region_id", "x", "y", "structure_label", "n_cells", "qc_flag", "emb_3"} <= set(e.columns) and e.count() == 2
    assert {tuple(r) for r in spark.read.parquet(places["region_molecular_summary"]).collect()} == {("r1", 2, 0.5, 1.5), ("r2", 1, 4.0, 0.0)}
    assert spark.read.parquet(places["structure_summary"]).agg(F.sum("n_cells")).first()[0] == 3 and spark.read.json(places["region_image_manifest"]).count() == 2
    assert writers.read_json(spark, places["region_qc_report"])["n_cells_assigned"] == 3 and writers.read_json(spark, places["evidence_manifest"])["artifacts"].keys() <= places.keys()
    writers.write_embeddings(c.regions.join(export.linear_embed(c.region_expr, 4), "region_id"), 4, out)
    assert spark.read.parquet(f"{out}/embeddings.parquet").columns[:2] == ["region_id", "0"] and spark.read.parquet(f"{out}/structure_id_embeddings.parquet").count() == 2
    with pytest.raises(FileNotFoundError):
        cases.load_case(spark, config.DataConfig(mode="tables", root=f"{tmp_path}/none"))
    with pytest.raises(ValueError, match="canonical"):
        cases.load_case(spark, config.DataConfig(mode="h5ad"))


def test_corpus_keeps_equal_ids_apart(spark, tmp_path):
    for name, gene in (("a", "g1"), ("b", "g2")):
        spark.createDataFrame([("c1", 1.0, 2.0, "k")], "cell_id string, x double, y double, contour_id string").write.parquet(f"{tmp_path}/{name}/cells.parquet")
        spark.createDataFrame([("g1",), (gene,)], "gene string").distinct().write.parquet(f"{tmp_path}/{name}/genes.parquet")
        spark.createDataFrame([("c1", gene, 2.0)], "cell_id string, gene string, value double").write.parquet(f"{tmp_path}/{name}/expr.parquet")
    cfg = config.DataConfig(mode="corpus", roots=(f"{tmp_path}/a", f"{tmp_path}/b"))
    c = cases.build_regions(cases.load_case(spark, cfg), cfg)
    assert {(r.region_id, r.n_cells, r.slide_id, r.batch_id) for r in c.regions.collect()} == {("k-a", 1, "a", "a"), ("k-b", 1, "b", "b")}
    assert {(r.region_id, r.gene, r.value) for r in c.region_expr.collect()} == {("k-a", "g1", 2.0), ("k-b", "g2", 2.0)} and c.genes.count() == 2
    one = config.DataConfig(mode="corpus", roots=(f"{tmp_path}/a",))
    assert cases.load_case(spark, one).cells.first().cell_id == "c1"


def test_json_safe():
    got = writers.json_safe({1: [float("nan"), np.float64("inf"), np.int64(3), (1.5, None)], "k": {"x": np.bool_(True)}})
    assert got == {"1": [None, None, 3, [1.5, None]], "k": {"x": True}}


def test_vocabulary(spark):
    g = spark.createDataFrame([("x", "a", 0), ("y", "b", 1), ("z", "a", 2)], "gene string, name string, gene_pos int")
    v = features.vocabulary(g)
    assert [(r.vocab_name, r.vocab_id) for r in v.orderBy("gene_pos").collect()] == [("a", 1), ("b", 2), ("a.1", 3)]
    assert [r.vocab_name for r in features.vocabulary(g.drop("name")).orderBy("gene_pos").collect()] == ["x", "y", "z"]
    features.check_vocabulary(v, v)
    with pytest.raises(ValueError, match="from id 3"):
        features.check_vocabulary(v, v.where("vocab_id < 3"))
    assert [r.feature_name for r in readers.normalize_genes(g).orderBy("gene_pos").collect()] == ["x", "y", "z"]


def test_zero_fill_and_batches(spark):
    v = spark.createDataFrame([("r", "g1", 2.0), ("r", "g2", 1.0), ("q", "g3", 1.0), ("z", "g1", 0.0)], "region_id string, gene string, value double")
    genes = spark.createDataFrame([(f"g{i}",) for i in range(6)], "gene string")
    got = {}
    for r in features.select_genes(v, 4, 3, genes).collect():
        got.setdefault(r.region_id, {})[r.gene] = r.value
    assert {k: (len(x), {g for g, y in x.items() if y}) for k, x in got.items()} == {"r": (4, {"g1", "g2"}), "q": (4, {"g3"}), "z": (4, set())}
    assert features.select_genes(v, 9, 3, genes).groupBy("region_id").count().where("count <> 6").count() == 0
    members = spark.createDataFrame([("r", "c1"), ("r", "c2"), ("q", "c3")], "region_id string, cell_id string")
    expr = spark.createDataFrame([("c1", "g1", 3.0), ("c3", "g0", 1.0)], "cell_id string, gene string, value double")
    rows = {r.region_id: r for r in features.region_batches(v, 4, 8, 0.0, 3, genes, members, expr, 5).collect()}
    r = rows["r"]
    assert r.padding == 0 and [t.gene for t in r.tokens] == sorted(got["r"]) and sum(t.mask for t in r.tokens) == 1 and all(t.input == (0.0 if t.mask else t.value) for t in r.tokens)
    at = [t.gene for t in r.tokens].index("g1")
    assert [c.cell_id for c in r.cells] == ["c1", "c2"] and math.isclose(r.cells[0]["values"][at], math.log(4)) and r.cells[1]["values"] == [0.0] * 4 and rows["z"].cells == []


def test_batches_work_where_the_region_is(spark):
    v = spark.createDataFrame([("r", "g1", 2.0), ("r", "g2", 1.0), ("q", "g3", 1.0)], "region_id string, gene string, value double")
    genes = spark.createDataFrame([(f"g{i}",) for i in range(6)], "gene string")
    members = spark.createDataFrame([("r", "c1"), ("q", "c3")], "region_id string, cell_id string")
    expr = spark.createDataFrame([("c1", "g1", 3.0), ("c1", "g1", 1.0), ("c3", "g0", 1.0)], "cell_id string, gene string, value double")
    shuffles = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin")
    assert shuffles(features.mask_genes(features.expression_bins(v, 8), 0.1)) == 0  # one by the region before, and one more
    out = features.region_batches(v, 4, 8, 0.0, 3, genes, members, expr, 5)
    assert shuffles(out) <= 2
    r = next(r for r in out.collect() if r.region_id == "r")  # what stands there twice is added up
    assert math.isclose(r.cells[0]["values"][[t.gene for t in r.tokens].index("g1")], math.log(5))


def test_neighbours_values_travel_in_rows(spark):
    v = spark.createDataFrame([("a", "g1", 2.0), ("b", "g1", 1.0), ("b", "g2", 4.0)], "region_id string, gene string, value double")
    near = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "a")], "region_id string, neighbor_id string")
    out = regions.neighbor_mean(v, near)
    assert "SortAggregate" not in (plan := out._jdf.queryExecution().sparkPlan().toString()) and plan.count("Join") == 1
    assert {(r.region_id, r.gene): r.value for r in out.collect()} == {("a", "g1"): 0.5, ("a", "g2"): 2.0, ("b", "g1"): 2.0}
    genes = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene string")
    items = spark.createDataFrame([("a", 0.0, 0.0, 0, 0), ("b", 0.0, 0.0, 0, 0)], "region_id string, x_z double, y_z double, context_id long, code long")
    rows = encoder.inputs(features.region_batches(v, 3, 4, 0.0, 1, genes), items, None, out)
    assert not re.search(r"Join \[region_id#\d+, gene", rows._jdf.queryExecution().sparkPlan().toString())  # a region's genes meet where it is
    got = {(r.region_id, t.gene): t.neighbor for r in rows.collect() for t in r.tokens}
    assert len(got) == 6 and all(math.isclose(got["a", g], math.log1p(x)) for g, x in (("g1", 0.5), ("g2", 2.0), ("g3", 0.0))) and math.isclose(got["b", "g1"], math.log1p(2))


def test_split_seed_and_orders(spark):
    assert [splits.split_seed(*a) for a in ((0, 5, 7), (None, 5, 7), (None, 0, 7))] == [0, 5, 7]
    d = spark.createDataFrame([(f"r{i:02d}", float(i), float(i % 5)) for i in range(40)], "region_id string, x double, y double")
    s = splits.make_splits(d, seed=3, order="numpy")
    assert s.count() == 40 and splits.leaking_groups(s).count() == 0
    assert {r.block_id for r in splits.make_splits(d.drop("x")).collect()} == {f"idx_{i:04d}" for i in range(40)}
    assert splits.make_splits(d.limit(0)).count() == 0
    train, val = splits.training_rows(s)
    assert train.count() + val.count() < 40 and splits.training_rows(s.where("split = 'val'"))[0].count() == s.where("split = 'val'").count()


def test_running_total_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PER_RANGE", 7)
    d = spark.createDataFrame([(f"{i:02d}", float(i // 9) if i % 10 else None, i) for i in range(50)], "k string, v double, n long").repartition(3)
    got = {r.k: (r.rank0, r.before) for r in ranking.running_total(ranking.global_rank(d, "v", "k"), ["rank0"], "n", "before").collect()}
    rows = sorted(d.collect(), key=lambda r: (r.v is not None, r.v or 0, r.k))
    total = 0
    for i, r in enumerate(rows):
        assert got[r.k] == (i, total)
        total += r.n


def test_evaluation_tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=4))
    rows = spark.createDataFrame([(i, "train" if i % 3 else "test", unit(), unit(), unit(), f"l{i % 2}", "one", f"s{i % 4}") for i in range(24)], "id long, split string, vec array<double>, a array<double>, b array<double>, structure_label string, cluster string, slide_id string")
    pred = spark.createDataFrame([("train", 1.0, 2.0, True), ("test", 2.0, 2.5, True)], "split string, pred double, target double, mask boolean")
    fail = quality.failure_analysis(rows.select(F.col("id").cast("string").alias("region_id"), "split", F.lit(1).alias("n_cells")), spark.createDataFrame([], "contour_id string"), spark.createDataFrame([], "image_path string"), "x")
    tables = evaluation.evaluate(rows, pred, fail)
    p = evaluation.payload(tables, {"case_name": "c"})
    assert {r.label_column for r in tables["embedding_qc"].collect()} == {"structure_label"} and {r.batch_column for r in tables["batch_mixing_metrics"].collect()} == {"slide_id"}
    assert [r.scope for r in tables["retrieval_metrics"].collect()] == ["overall"] * 2 + ["test"] * 2 + ["train"] * 2
    assert p["overall_prediction_summary"]["n_masked_values"] == 2 and len(p["overall_label_retrieval_metrics"]) == 2 and p["n_embedding_qc_rows"] == 3 and p["case_name"] == "c"
    writers.write_evaluation(spark, tables, p, str(tmp_path))
    assert writers.read_json(spark, f"{tmp_path}/evaluation_metrics.json")["n_retrieval_metrics_rows"] == 6
    assert readers.read_table(spark, f"{tmp_path}/failure_analysis.csv").where("metric = 'n_regions'").count() == 3
    flags = export.cell_flags(spark.createDataFrame([("a",), ("b",)], "cell_id string"), spark.createDataFrame([("a", "i"), ("b", "gone")], "cell_id string, image_path string"), spark.createDataFrame([("i",)], "image_path string"))
    assert {tuple(r) for r in flags.collect()} == {("a", "ok"), ("b", "no_image")}
    assert metrics.validation_mean(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "b double, a double")).first().asDict() == {"val_a": 3.0, "val_b": 2.0}


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"patches": [{"contour_id": "c1", "patch": {"image_path": "i.png", "patch_x": 0}, "transform": {"a": 1}}, {"contour_id": "nan"}]}')
    rows = readers.read_patch_manifest(spark, str(tmp_path / "p.json")).collect()
    assert [(r.contour_id, r.image_path, r.patch_x, r.registration_transform) for r in rows] == [("c1", "i.png", 0.0, '{"a":1}'), (None, None, None, None)]
    (tmp_path / "l.json").write_text('[1, null, "x", {"x": 0, "patch": {"center_x": 4, "image_path": "j"}, "contour_id": "", "region_id": "r"}]')
    first, falsy = (readers.read_patch_manifest(spark, str(tmp_path / "l.json"), z).first() for z in (False, True))
    assert (first.patch_x, falsy.patch_x, falsy.contour_id, falsy.image_path) == (0.0, 4.0, "r", "j")
    (tmp_path / "g.csv").write_text("gene\n b \na\nb\n")
    assert {r.gene for r in readers.read_panel(spark, str(tmp_path / "g.csv"), ["a", " c "]).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="coordinates"):
        readers.normalize_cells(cells(spark).drop("x"))
    c, e = readers.synthetic_case(spark, 12, 20, 3)
    assert c.count() == 12 and c.select("contour_id").distinct().count() == 12 and e.where("value <= 0").count() == 0


def test_config(monkeypatch):
    monkeypatch.setenv("SOME_ROOT", "/data")
    assert config.from_mapping({"data": {"root": "$SOME_ROOT/c", "patches": "$NOT_SET_X/g"}}).data == config.DataConfig(root="/data/c", patches=None)
    with pytest.raises(ValueError, match="unknown keys"):
        config.from_mapping({"data": {"cell": 1}})
    weights = {m: tuple(w > 0 for w in (t.image_gene_weight, t.neighborhood_weight, t.structure_weight)) for m in config.ABLATIONS for t in [config.with_ablation(config.Config(), m).training]}
    none = (False, False, False)
    assert weights == {"full": (True, True, True), "gene_only": none, "image_only": none, "spatial_only": none, "image_gene": (True, False, False), "image_gene_spatial": (True, True, False)}
    m = config.with_ablation(config.Config(), " Image_Gene ").model
    assert (m.use_expression, m.use_image, m.use_spatial, m.use_structure, m.use_cells) == (True, True, False, False, False)
    small = config.from_mapping({"case_name": "x", "training": {"workers": 4}}, "smoke")
    assert (small.case_name, small.model.size, small.training.max_steps, small.training.workers) == ("x", 64, 2, 0)
    for bad in ({"split": {"train": 0.9}}, {"split": {"train": 0.0, "val": 0.5, "test": 0.5}}):
        with pytest.raises(ValueError, match="shares"):
            config.from_mapping(bad)
    with pytest.raises(ValueError, match="ablation"):
        config.with_ablation(config.Config(), "no_image")


def test_widening(spark):
    v = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 2.0)], "region_id string, gene string, value double")
    e = export.widen(export.linear_embed(v, 4), 4)
    assert {"emb_0", "emb_3", "structure_label", "qc_flag"} <= set(e.columns)
    assert math.isclose(sum(e.first()[f"emb_{i}"] ** 2 for i in range(4)), 1, rel_tol=1e-5)
    with pytest.raises(ValueError, match="long form"):
        export.widen_genes(v, v, ["a", "b"], most=1)
    assert export.embedding_columns(["region_id", "0", "emb_1"]) == ["0", "emb_1"]
