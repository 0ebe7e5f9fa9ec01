"""Tables as Parquet or CSV, documents as JSON or Markdown, in whatever store Spark writes to."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export, quality
from .cases import Case, describe, splits_of
from .config import Config


def json_safe(value: Any) -> Any:
    """``value`` as plain JSON at any depth: numbers that aren't finite become null, keys text."""
    if isinstance(value, Mapping):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small document as a folder with one text file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """A small document as JSON with sorted keys, without NaN."""
    write_text(spark, json.dumps(json_safe(value), indent=2, sort_keys=True, allow_nan=False), path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_csv(df: DataFrame, path: str) -> None:
    """``df`` as CSV with a header; arrays, maps and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_case(spark: SparkSession, case: Case, cfg: Config, out: str) -> dict:
    """Patch and region tables as CSV and the training manifest, which is returned."""
    write_csv(case.patches, f"{out}/patch_table.csv")
    write_csv(case.regions.orderBy("region_id"), f"{out}/region_table.csv")
    m = describe(spark, case, cfg, out)
    short = {k: m[k] for k in ("case_name", "mode", "case_metadata", "n_cells", "n_regions", "n_genes", "training_unit", "region_id_key", "has_spatial", "patch_count")}
    short |= {"output_dir": out, "patch_table": f"{out}/patch_table.csv", "region_table": f"{out}/region_table.csv"}
    write_json(spark, short, f"{out}/training_manifest.json")
    return short


def write_quality(spark: SparkSession, case: Case, cfg: Config, out: str) -> dict:
    """Case manifest, quality report (JSON and Markdown) and splits; returns the report."""
    manifest = describe(spark, case, cfg, out)
    report = quality.verdict(manifest, cfg.data.structure_context)
    write_json(spark, manifest, f"{out}/case_manifest.json")
    write_json(spark, report, f"{out}/qc_report.json")
    write_text(spark, quality.render_markdown(report, manifest), f"{out}/qc_report.md")
    write_csv(splits_of(case, cfg), f"{out}/splits.csv")
    return report


def write_evaluation(spark: SparkSession, tables: dict[str, DataFrame], payload: dict, out: str) -> None:
    """The tables of an evaluation as CSV, and its payload."""
    for name, df in tables.items():
        write_csv(df, f"{out}/{name}.csv")
    write_json(spark, payload, f"{out}/evaluation_metrics.json")


def write_embeddings(rows: DataFrame, size: int, out: str) -> None:
    """The embedding table, and the mean vectors of clusters and structures where rows have these labels."""
    write_parquet(export.embedding_table(rows, size), f"{out}/embeddings.parquet")
    for key in ("cluster", "structure_id"):
        if key in rows.columns:
            means = export.widen_vector(export.mean_vectors(rows, key), size)
            write_parquet(means, f"{out}/{key}_embeddings.parquet")
            write_csv(means, f"{out}/{key}_embeddings.csv")


def write_evidence(spark: SparkSession, case: Case, vectors: DataFrame, size: int, out: str, case_name: str | None = None, genes: list[str] | None = None) -> dict:
    """Region embeddings, members, molecular summary, structure summary, image manifest, region report and evidence manifest.

    ``vectors`` has region_id and vec.  The molecular summary is wide over ``genes``, else long.  Returns the
    places of what was written.
    """
    rows = case.regions.join(vectors, "region_id")
    wide = export.widen(rows, size)
    summary = export.widen_vector(export.structure_summary(rows), size)
    places = {k: f"{out}/{k}.{end}" for k, end in (
        ("region_embeddings", "parquet"), ("region_cell_membership", "parquet"), ("region_molecular_summary", "parquet"), ("region_image_manifest", "json"), ("region_qc_report", "json"),
    )}
    write_parquet(wide, places["region_embeddings"])
    write_parquet(case.members, places["region_cell_membership"])
    write_parquet(export.widen_genes(case.region_expr, case.regions, genes) if genes else case.region_expr, places["region_molecular_summary"])
    export.image_manifest(case.regions).write.mode("overwrite").json(places["region_image_manifest"])  # a record a line, as there can be many
    write_parquet(summary, f"{out}/structure_summary.parquet")
    write_csv(summary, f"{out}/structure_embedding_summary.csv")
    write_json(spark, quality.region_report(wide, case.members, case_name), places["region_qc_report"])
    write_json(spark, {"case_name": case_name, "training_unit": "region", "artifacts": places}, f"{out}/evidence_manifest.json")
    return places | {"structure_summary": f"{out}/structure_summary.parquet", "evidence_manifest": f"{out}/evidence_manifest.json"}
