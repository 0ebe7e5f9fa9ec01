"""A case: canonical tables from a configuration, brought together into regions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regions as R
from ..operators import splits as S
from ..tables import exists, to_table
from . import matrix_market
from .config import Config, DataConfig
from .readers import corpus_union, list_images, normalize_cells, normalize_genes, read_panel, read_patch_manifest, read_table, stamp, synthetic_case

# The canonical tables of a case, and a cell map that can lie beside them.
TABLES = ("cells", "genes", "expr")
CELL_MAP = "cell_to_contour"
POSITION = "row_pos"


@dataclass(frozen=True)
class Case:
    """Tables of a case, none of them collected; the last three once regions are built."""

    cells: DataFrame
    genes: DataFrame
    expr: DataFrame
    patches: DataFrame
    images: DataFrame
    regions: DataFrame | None = None
    members: DataFrame | None = None
    region_expr: DataFrame | None = None


def _tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Canonical tables below ``root``, or those of an instrument's folder there; FileNotFoundError if there is neither."""
    out = {}
    if not exists(spark, f"{root.rstrip('/')}/{TABLES[-1]}.parquet") and matrix_market.find_folder(spark, root):
        return matrix_market.read_case(spark, root)
    for name in TABLES:
        path = f"{root.rstrip('/')}/{name}.parquet"
        if not exists(spark, path):
            raise FileNotFoundError(f"a case needs {path}")
        out[name] = read_table(spark, path)
    if POSITION not in out["cells"].columns:
        out["cells"] = out["cells"].withColumn(POSITION, F.monotonically_increasing_id())
    return out


def _one(spark: SparkSession, cfg: DataConfig, tables: dict[str, DataFrame], root: str | None, source: str | None) -> dict[str, DataFrame]:
    """Normalised, stamped, and joined with a cell map that lies beside the tables."""
    cells = stamp(normalize_cells(tables["cells"]), {c: getattr(cfg, c) for c in R.METADATA}, source)
    if cfg.region_key != "contour_id" and cfg.region_key in cells.columns:
        cells = cells.withColumn("contour_id", F.col(cfg.region_key))
    here = root.rstrip("/") if root else None
    beside = [f"{place}/{CELL_MAP}.parquet" for place in ([here, here.rpartition("/")[0]] if cfg.mode == "xenium" else [here])] if here else []
    map_path = cfg.contour_map or next((p for p in beside if exists(spark, p)), None)
    if map_path and exists(spark, map_path):
        mapping = read_table(spark, map_path, POSITION)
        if {"cell_id", "contour_id"} <= set(mapping.columns):
            cells = R.add_contour(cells, mapping.withColumn("cell_id", F.col("cell_id").cast("string")), POSITION)
    if cfg.structures and exists(spark, cfg.structures) and cfg.structure_key not in cells.columns and cfg.cluster_key in cells.columns:
        given = read_table(spark, cfg.structures, POSITION)
        found = R.assignment_columns(given.columns, cfg.cluster_key, cfg.structure_key)
        if found:
            table = given.select(F.col(found[0]).alias(cfg.cluster_key), F.col(found[1]).alias("structure_id"), POSITION)
            cells = R.add_structure(cells, table, cfg.cluster_key, POSITION)
    return {"cells": cells, "genes": normalize_genes(tables["genes"], cfg.gene_name), "expr": tables["expr"].withColumn("cell_id", F.col("cell_id").cast("string"))}


def load_case(spark: SparkSession, cfg: DataConfig) -> Case:
    """Tables of a case by ``mode``; ValueError for a mode whose format has no reader here.

    In a corpus each case is normalised and stamped by itself; ids of cells and contours of
    several cases get the case's name, so that equal ones stay apart.  Patches, images and
    panel are optional.
    """
    if cfg.mode == "synthetic":
        cells, expr = synthetic_case(spark, cfg.n_cells, cfg.n_genes, cfg.n_structures, cfg.seed)
        genes = spark.range(cfg.n_genes).select(F.col("id").cast("int").alias("gene_pos"), F.concat(F.lit("gene_"), "id").alias("gene"))
        tables = _one(spark, cfg, {"cells": cells, "genes": genes, "expr": expr}, None, None)
    elif cfg.mode == "tables":
        if not cfg.root:
            raise FileNotFoundError("mode 'tables' needs data.root")
        tables = _one(spark, cfg, _tables(spark, cfg.root), cfg.root, None)
    elif cfg.mode == "xenium":
        if not cfg.root:
            raise FileNotFoundError("mode 'xenium' needs data.root")
        tables = _one(spark, cfg, matrix_market.read_case(spark, cfg.root), cfg.root, None)
    elif cfg.mode == "corpus":
        if not cfg.roots:
            raise FileNotFoundError("mode 'corpus' needs data.roots")
        parts = {}
        for root in cfg.roots:
            name = PurePosixPath(root.rstrip("/")).name
            parts[name if name not in parts else f"{name}_{len(parts)}"] = (root, name)
        each = {key: _one(spark, cfg, _tables(spark, root), root, key) for key, (root, _) in parts.items()}
        tables = {t: corpus_union({k: v[t] for k, v in each.items()}, ("cell_id", "contour_id") if t != "genes" else ()) for t in TABLES}
        if len(each) > 1:  # the axis of genes is the union
            own = [c for c in tables["genes"].columns if c not in ("source", *R.METADATA, "gene_pos")]
            tables["genes"] = tables["genes"].select(*own).dropDuplicates([cfg.gene_name])
            tables["expr"] = tables["expr"].drop("source", *R.METADATA)
    else:
        raise ValueError(f"mode {cfg.mode!r}: bring its tables to the canonical form and use 'tables'")
    patches = read_patch_manifest(spark, cfg.patches) if cfg.patches and exists(spark, cfg.patches) else spark.createDataFrame([], "cell_id string, structure_id string, image_path string")
    images = list_images(spark, cfg.images) if cfg.images else spark.createDataFrame([], "image_path string")
    return Case(patches=patches, images=images, **tables)


def build_regions(case: Case, cfg: DataConfig) -> Case:
    """The case with regions, members and mean expression, as far as it has none yet."""
    if case.regions is not None:
        return case
    cells = R.with_region_key(case.cells)
    patches = case.patches if {"contour_id", "region_id"} & set(case.patches.columns) else None
    if patches is not None and POSITION not in patches.columns:
        patches = patches.withColumn(POSITION, F.monotonically_increasing_id())
    if patches is not None and "contour_id" not in patches.columns:
        patches = patches.withColumn("contour_id", F.col("region_id"))
    label = "structure_label" if "structure_label" in cells.columns else cfg.cluster_key
    labels = R.label_table(cells, "structure_id", label, POSITION) if {"structure_id", label} <= set(cells.columns) else None
    rows = R.region_rows(cells, patches, case.images, labels, POSITION, cfg.min_cells)
    kept = cells.join(rows.select("region_id"), "region_id", "left_semi")
    return replace(case, cells=cells, regions=rows, members=R.membership(kept), region_expr=R.mean_expression(case.expr, kept))


def settle(case: Case) -> Case:
    """The case with all its tables written once, for uses that read them many times, as training does."""
    return Case(**{f.name: None if (df := getattr(case, f.name)) is None else to_table(df, f"case-{f.name}") for f in fields(case)})


def describe(spark: SparkSession, case: Case, cfg: Config, output: str | None = None) -> dict:
    """The manifest of a case with regions: figures, counts, panel, provenance, paths, metadata and split."""
    from ..operators.quality import case_manifest

    d = cfg.data
    panel = read_panel(spark, d.panel, list(d.panel_genes)) if d.panel or d.panel_genes else None
    about = {
        "case_name": cfg.case_name, "mode": d.mode, "case_metadata": {c: getattr(d, c) for c in R.METADATA},
        "paths": {k: v for k, v in asdict(d).items() if k in ("root", "roots", "patches", "images", "structures", "contour_map", "panel")} | {"output": output},
        "region_id_key": d.region_key, "structure_key": d.structure_key, "include_structure_context": d.structure_context,
        "split": {
            "strategy": cfg.split.strategy, "group_key": cfg.split.group, "train_fraction": cfg.split.train, "val_fraction": cfg.split.val,
            "test_fraction": cfg.split.test, "seed": S.split_seed(cfg.split.seed, cfg.training.seed, d.seed),
        },
    }
    return case_manifest(case.cells, case.regions, case.members, case.genes, case.expr, case.patches, case.images, panel, about, R.METADATA, d.min_cells, d.gene_name)


def splits_of(case: Case, cfg: Config) -> DataFrame:
    """Splits of a case's regions as the configuration asks for."""
    s = cfg.split
    return S.make_splits(case.regions, s.strategy, s.group, s.train, s.val, s.seed, cfg.training.seed, cfg.data.seed)
