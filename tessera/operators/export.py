"""Embeddings and evidence tables: a default embedder, summaries, wide forms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, hash_order, unit

REQUIRED = {"region_id": "unknown", "x": 0.0, "y": 0.0, "structure_label": "unknown", "n_cells": 0, "qc_flag": "unknown"}


def linear_embed(values: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``(region_id, vec)``: a seeded random projection of log expression, at length one.

    Stands where a trained network would; it is no substitute for one.
    """
    # The weight of a gene in a dimension is a hash of the two, so no table of weights is needed.
    weight = lambda j: F.conv(F.substring(hash_order(F.lit(seed), F.col("gene"), F.lit(j)), 1, 8), 16, 10).cast("double") / float(1 << 31) - 1
    v = F.log1p(F.greatest(F.col("value").cast("double"), F.lit(0.0)))
    d = values.groupBy("region_id").agg(*[F.sum(v * weight(j)).alias(f"e{j}") for j in range(size)])
    return d.select("region_id", unit(F.array(*[F.col(f"e{j}") for j in range(size)])).alias("vec"))


def structure_summary(rows: DataFrame, label: str = "structure_label", vec: str = "vec") -> DataFrame:
    """``(structure_label, n_cells, vec)``: cells in sum, and the unweighted mean vector of the regions; null labels are left out."""
    d = rows.where(F.col(label).isNotNull())
    size = d.groupBy(label).agg(F.sum("n_cells").alias("n_cells"))
    return size.join(mean_vectors(d, label, vec), label)


def mean_vectors(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """``(key, vec)``: mean by place in the vector; null keys are left out."""
    places = rows.where(F.col(key).isNotNull()).select(key, F.posexplode(vec).alias("p", "v")).groupBy(key, "p").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return places.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias(vec))


def widen(rows: DataFrame, size: int, vec: str = "vec") -> DataFrame:
    """``rows`` with ``emb_0`` .. in place of the vector, and required columns filled in where absent."""
    out = rows
    for c, v in REQUIRED.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    return widen_vector(out, size, vec)


def widen_vector(rows: DataFrame, size: int, vec: str = "vec") -> DataFrame:
    """``rows`` with ``emb_0`` .. in place of the vector."""
    return rows.select(*[c for c in rows.columns if c != vec], *[F.get(vec, F.lit(i)).cast("float").alias(f"emb_{i}") for i in range(size)])


def widen_genes(values: DataFrame, sizes: DataFrame, genes: list[str], most: int = 5000) -> DataFrame:
    """``region_id``, ``n_cells`` and a column for each gene, absent ones 0; long tables only beyond ``most`` genes."""
    if len(genes) > most:
        raise ValueError(f"{len(genes)} genes: keep the long form")
    wide = values.groupBy("region_id").pivot("gene", genes).agg(F.first("value"))
    wide = wide.select("region_id", *[F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).alias(f"gene_{g}") for g in genes])
    return sizes.select("region_id", "n_cells").join(wide, "region_id", "left").fillna(0.0)


def embedding_columns(columns: list[str]) -> list[str]:
    """Columns of digits only or beginning with ``emb_``; else all but ids and labels."""
    found = [c for c in columns if re.fullmatch(r"\d+|emb_.*", c)]
    return found or [c for c in columns if c not in ("region_id", "cell_id", "cluster", "structure_id", "structure_label")]


# Columns of the image manifest, where regions have them.
IMAGE_COLUMNS = ("region_id", "image_path", "patch_x", "patch_y", "patch_size", "source_image", "registration_transform")


def image_manifest(regions: DataFrame) -> DataFrame:
    """Those of ``IMAGE_COLUMNS`` that ``regions`` has."""
    return regions.select(*[c for c in IMAGE_COLUMNS if c in regions.columns])


def embedding_table(rows: DataFrame, size: int, labels: tuple[str, ...] = ("cluster", "structure_id", "structure_label"), vec: str = "vec") -> DataFrame:
    """``region_id`` (else ``cell_id``), a column for each place of the vector, and the label columns that are there, as text."""
    key = "region_id" if "region_id" in rows.columns else "cell_id"
    places = [F.get(vec, F.lit(i)).cast("float").alias(str(i)) for i in range(size)]
    return rows.select(F.col(key).cast("string").alias(key), *places, *[F.col(c).cast("string").alias(c) for c in labels if c in rows.columns])


def cell_flags(cells: DataFrame, patches: DataFrame, images: DataFrame) -> DataFrame:
    """``(cell_id, qc_flag)``: ``ok`` where a patch of the cell has an image that is there."""
    there = patches.select(clean_text("cell_id").alias("cell_id"), "image_path").where("cell_id is not null").join(images.select("image_path").distinct(), "image_path", "left_semi")
    covered = there.select("cell_id").distinct().withColumn("ok_", F.lit(True))
    return cells.select(F.col("cell_id").cast("string").alias("cell_id")).join(covered, "cell_id", "left").select("cell_id", F.when(F.col("ok_"), "ok").otherwise("no_image").alias("qc_flag"))


def cell_table(cells: DataFrame, vectors: DataFrame, flags: DataFrame, size: int, structure: str = "structure_id", vec: str = "vec") -> DataFrame:
    """A row for each cell with a vector: id, place, structure (``unknown`` without one), image flag and ``emb_0`` ..; cells without a place have nulls."""
    id_ = F.col("cell_id").cast("string").alias("cell_id")
    place = [F.col(c).cast("double").alias(c) if c in cells.columns else F.lit(None).cast("double").alias(c) for c in ("x", "y")]
    label = F.coalesce(F.col(structure).cast("string"), F.lit("unknown")) if structure in cells.columns else F.lit("unknown")
    rows = cells.select(id_, *place, label.alias("structure_label")).join(flags.select("cell_id", "qc_flag"), "cell_id", "left").withColumn("qc_flag", F.coalesce("qc_flag", F.lit("no_image")))
    return widen_vector(rows.join(vectors.select(id_, vec), "cell_id"), size, vec)


def cell_report(rows: DataFrame, case_name: str, network: str | None = None) -> dict:
    """Figures of exported cells: with and without an image, their share to four places, cells of each structure."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("qc_flag") == "ok", 1)).alias("ok")).first()
    counts = rows.groupBy("structure_label").agg(F.count(F.lit(1)).alias("n")).orderBy("structure_label").collect()
    return {
        "case_name": case_name, "checkpoint": network, "n_cells_total": n["n"], "n_cells_with_image": n["ok"], "n_cells_no_image": n["n"] - n["ok"],
        "image_coverage": round(n["ok"] / max(1, n["n"]), 4), "structure_counts": {str(r["structure_label"]): r["n"] for r in counts},
    }
