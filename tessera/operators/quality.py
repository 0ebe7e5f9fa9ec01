"""Quality checks of a case: counts, coverages, provenance, panel, failures, manifest and verdict."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, finite, normal_id, or_missing, valid_label

# Domains that failure rows count.
FAILURE_DOMAINS = ("batch", "batch_id", "case_id", "slide_id", "donor_id", "stain_id", "platform")
# Categories and details of failure rows, by metric.
FAILURES = {
    "patch_rows": ("patch", "Rows in patch manifest."),
    "region_image_coverage": ("patch", "Region-level patch coverage."),
    "missing_image_count": ("patch", "Patch image files missing on disk."),
    "low_cell_region_count": ("region", "Regions without member cells."),
    "panel_gene_count": ("panel", "Configured panel size."),
    "missing_from_data_count": ("panel", "Configured panel genes absent from AnnData."),
    "outside_panel_count": ("panel", "AnnData genes absent from configured panel."),
}
# Names, endings and parts by which columns of a patch manifest are told apart.
COORDINATE_NAMES = ("x", "y", "patch_x", "patch_y", "center_x", "center_y", "x_centroid", "y_centroid", "pixel_x", "pixel_y")
COORDINATE_END = r"(_x|_y)$"
IMAGE_PART = "image"
IMAGE_NAMES = ("image_path", "source_image", "wsi_path", "slide_path", "he_image_path")
TRANSFORM_PART = "registration|transform|affine|matrix"
PARAMETER_NAMES = ("patch_size", "level", "magnification", "mpp", "scale", "stride")
PARAMETER_START = "^patch_"
#: Least share of regions with a structure where structures are a context.
STRUCTURE_SHARE = 0.95


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """``(label, n)`` in the order of labels, nulls as a label of their own."""
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label")


def domain_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(domain, value, n)`` of several columns in one pass; missing values are ``missing``."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return df.sparkSession.createDataFrame([], "domain string, value string, n long")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("domain"), or_missing(c).alias("value")) for c in have]))
    return df.select(pairs.alias("p")).groupBy(F.col("p.domain").alias("domain"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_per_split(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """``(split, domain, n_values)``: distinct valid values of each column in each split."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("domain"), F.when(valid_label(c), F.col(c).cast("string")).alias("value")) for c in columns]))
    return df.select(split, pairs.alias("p")).groupBy(split, F.col("p.domain").alias("domain")).agg(F.count_distinct("p.value").alias("n_values"))


def spatial_bounds(df: DataFrame) -> DataFrame:
    """One row of least and greatest coordinates over finite rows; null if there are none."""
    ok = finite("x") & finite("y")
    return df.agg(*[f(F.when(ok, F.col(c))).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])


def density(expr: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """One row: the share of non-zero entries, 0 for an empty matrix."""
    return expr.agg((F.count(F.when(F.col("value") != 0, 1)) / F.lit(float(max(n_cells * n_genes, 1)))).alias("density"))


def share(condition: Column) -> Column:
    """Rows for which ``condition`` holds by all rows, of which one at least is assumed."""
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0)).cast("double") / F.greatest(F.count(F.lit(1)), F.lit(1))


def duplicate_count(df: DataFrame, name: str) -> DataFrame:
    """One row: how many rows repeat a name."""
    return df.agg((F.count(name) - F.count_distinct(name)).alias("n_duplicates"))


def panel_metrics(genes: DataFrame, panel: DataFrame, most: int = 20) -> DataFrame:
    """One row: sizes, overlap, what is missing or outside and the first of these; zeros without a panel, but for the data's genes."""
    g = genes.select(F.trim("gene").alias("gene")).where("gene <> ''").distinct()
    p = panel.select(F.trim("gene").alias("gene")).where("gene <> ''").distinct()
    both = g.withColumn("data", F.lit(1)).join(p.withColumn("panel", F.lit(1)), "gene", "full")

    def previews(df: DataFrame, name: str) -> DataFrame:
        return df.select("gene").orderBy("gene").limit(most).agg(F.array_sort(F.collect_list("gene")).alias(name))

    n = both.agg(
        F.count("panel").alias("n_panel"), F.count("data").alias("n_data"), F.count(F.when(F.col("panel").isNotNull() & F.col("data").isNotNull(), 1)).alias("n_overlap"),
        F.count(F.when(F.col("data").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("panel").isNull(), 1)).alias("n_outside"),
    )
    n = n.select(*[(F.col(c) if c == "n_data" else F.when(F.col("n_panel") > 0, F.col(c)).otherwise(0)).alias(c) for c in n.columns])
    # One row each.
    n = n.join(previews(p.join(g, "gene", "left_anti"), "missing_first"), F.lit(True)).join(previews(g.join(p, "gene", "left_anti"), "outside_first"), F.lit(True))
    return n.withColumn("outside_first", F.when(F.col("n_panel") > 0, F.col("outside_first")).otherwise(F.slice("outside_first", 1, 0)))


def image_rollup(regions: DataFrame, image: str = "image_path") -> DataFrame:
    """One row: regions with and without image and the share with one, to four places."""
    has = clean_text(image).isNotNull()
    return regions.agg(
        F.count(F.lit(1)).alias("n_regions"), F.count(F.when(has, 1)).alias("n_with_image"), F.count(F.when(~has, 1)).alias("n_without_image"),
        F.round(share(has), 4).alias("image_coverage"),
    )


def missing_images(patches: DataFrame, images: DataFrame) -> DataFrame:
    """Patches that name an image that is not there."""
    return patches.where(clean_text("image_path").isNotNull()).join(images.select("image_path").distinct(), "image_path", "left_anti")


def provenance(columns: list[str], narrow: bool = False) -> dict:
    """What a patch manifest tells about its origin, by the names of its columns.

    ``narrow`` does without the centroid columns, as failure rows do.
    """
    names = [c for c in COORDINATE_NAMES if not (narrow and c.endswith("_centroid"))]

    def of(listed: tuple[str, ...] | list[str], pattern: str) -> list[str]:
        return [c for c in columns if c.lower() in listed or re.search(pattern, c.lower())]

    found = {
        "coordinate_columns": of(names, COORDINATE_END), "image_columns": of(IMAGE_NAMES, IMAGE_PART),
        "registration_columns": of((), TRANSFORM_PART), "parameter_columns": of(PARAMETER_NAMES, PARAMETER_START),
    }
    return {"columns": list(columns), **found, "has_coordinates": bool(found["coordinate_columns"]), "has_source_image": bool(found["image_columns"]), "has_registration_metadata": bool(found["registration_columns"])}


def _unpivoted(row: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """A one-row aggregate as rows (split ``overall``, category, metric, value, detail)."""
    structs = [F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(d).alias("detail")) for m, (c, d) in fields.items()]
    return row.select(F.lit("overall").alias("split"), F.explode(F.array(*structs)).alias("r")).select("split", "r.category", "r.metric", "r.value", "r.detail")


def failure_analysis(regions: DataFrame, patches: DataFrame, images: DataFrame, strategy: str, panel: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Long table ``(split, category, metric, value, detail)``.

    For each split and ``overall`` the regions and the distinct values of each domain (a null is a value
    too); for ``overall`` patches, images, regions without cells, registration by column names, and the
    panel's genes where there is a panel.  ``regions`` has region_id, split and n_cells; a patch covers the
    region of its contour_id, whether its image is there or not.
    """
    domains = [c for c in FAILURE_DOMAINS if c in regions.columns]
    sizes = regions.rollup("split").agg(
        F.grouping("split").alias("all_"), F.count(F.lit(1)).alias("n_regions"), *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("None"))).alias(c) for c in domains],
    )
    each = [F.struct(F.lit("split").alias("category"), F.lit("n_regions").alias("metric"), F.col("n_regions").cast("double").alias("value"), F.lit(strategy).alias("detail"))]
    each += [F.struct(F.lit("domain").alias("category"), F.lit(f"{c}_unique_values").alias("metric"), F.col(c).cast("double").alias("value"), F.lit(c).alias("detail")) for c in domains]
    rows = sizes.select(F.when(F.col("all_") == 1, "overall").otherwise(F.col("split")).alias("split"), F.explode(F.array(*each)).alias("r")).select("split", "r.category", "r.metric", "r.value", "r.detail")
    # One row each.
    covered = patches.select(F.col("contour_id").cast("string").alias("region_id")).where("region_id is not null") if "contour_id" in patches.columns else patches.sparkSession.createDataFrame([], "region_id string")
    lost = missing_images(patches, images) if "image_path" in patches.columns else patches.limit(0)
    facts = regions.agg(F.count(F.lit(1)).alias("n_"), F.count(F.when(F.col("n_cells") <= 0, 1)).alias("low_cell_region_count"))
    for one in (
        patches.agg(F.count(F.lit(1)).alias("patch_rows")), lost.agg(F.count(F.lit(1)).alias("missing_image_count")),
        covered.join(regions.select(F.col("region_id").cast("string").alias("region_id")), "region_id", "left_semi").agg(F.count_distinct("region_id").alias("c_")),
    ):
        facts = facts.join(one, F.lit(True))
    facts = facts.withColumn("region_image_coverage", F.col("c_") / F.greatest("n_", F.lit(1)))
    used = ["patch_rows", "region_image_coverage", "missing_image_count", "low_cell_region_count"]
    out = [rows, _unpivoted(facts, {m: FAILURES[m] for m in used})]
    origin = provenance([c for c in patches.columns], narrow=True)
    told = {
        "has_patch_coordinates": (origin["has_coordinates"], ",".join(origin["coordinate_columns"]) or "no coordinate columns"),
        "has_registration_metadata": (origin["has_registration_metadata"], ",".join(origin["registration_columns"]) or "no registration columns"),
    }
    out.append(regions.sparkSession.createDataFrame([("overall", "registration", m, float(v), d) for m, (v, d) in told.items()], rows.schema))
    if panel is not None and genes is not None:
        p = panel_metrics(genes, panel).select(F.col("n_panel").alias("panel_gene_count"), F.col("n_missing").alias("missing_from_data_count"), F.col("n_outside").alias("outside_panel_count"))
        out.append(_unpivoted(p.where("panel_gene_count > 0"), {m: FAILURES[m] for m in p.columns}))
    return reduce(DataFrame.unionByName, out)


def case_metrics(cells: DataFrame, regions: DataFrame, members: DataFrame, genes: DataFrame, expr: DataFrame, patches: DataFrame, images: DataFrame, min_cells: int = 1, gene_name: str = "feature_name") -> DataFrame:
    """One row: the figures of a case's manifest, from one-row aggregates that are put side by side."""
    placed = finite("x") & finite("y")
    with_patch = lambda c: F.count_distinct(clean_text(c)) if c in patches.columns else F.lit(0).cast("long")
    structures = regions.select(normal_id("structure_id").alias("s")).where("s is not null").distinct() if "structure_id" in regions.columns else None
    if structures is None or "structure_id" not in patches.columns:
        covered = cells.limit(1).agg(F.lit(0.0).alias("patch_structure_coverage"))
    else:
        seen = patches.select(normal_id("structure_id").alias("s")).where("s is not null").distinct().withColumn("p", F.lit(1))
        covered = structures.join(seen, "s", "left").agg((F.count("p") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("patch_structure_coverage"))
    lost = missing_images(patches, images) if "image_path" in patches.columns else patches.limit(0)
    one_rows = [
        cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count(F.when(~placed, 1)).alias("missing_spatial_count")),
        regions.agg(
            F.count(F.lit(1)).alias("n_regions"), F.count(F.when(F.col("n_cells") > 0, 1)).alias("regions_with_cells"), F.count(F.when(F.col("n_cells") < min_cells, 1)).alias("low_cell_region_count"),
            share(F.col("qc_flag") == "ok").alias("region_image_coverage"), share(valid_label("structure_label")).alias("structure_assignment_coverage"),
        ),
        members.agg(F.count_distinct("cell_id").alias("assigned_")),
        genes.agg(F.count(F.lit(1)).alias("n_genes"), (F.count(F.lit(1)) - F.count_distinct(F.coalesce(F.col(gene_name), F.lit("None")))).alias("duplicate_gene_count")),
        expr.agg(F.count(F.when(F.col("value") != 0, 1)).alias("nnz_")),
        patches.agg(F.count(F.lit(1)).alias("patch_count"), with_patch("cell_id").alias("patch_cell_count"), with_patch("structure_id").alias("patch_structure_count")),
        lost.agg(F.count(F.lit(1)).alias("missing_image_count")), covered, spatial_bounds(cells),
    ]
    row = reduce(lambda a, b: a.join(b, F.lit(True)), one_rows)  # one row each
    entries = F.col("n_cells") * F.col("n_genes")
    return row.withColumns({
        "cell_assignment_coverage": F.col("assigned_") / F.greatest("n_cells", F.lit(1)),
        "matrix_density": F.when(entries > 0, F.col("nnz_") / entries).otherwise(0.0), "patch_cell_coverage": F.col("region_image_coverage"),
    }).drop("assigned_", "nnz_")


def case_manifest(
    cells: DataFrame, regions: DataFrame, members: DataFrame, genes: DataFrame, expr: DataFrame, patches: DataFrame, images: DataFrame, panel: DataFrame | None = None,
    case: dict | None = None, domains: tuple[str, ...] = (), min_cells: int = 1, gene_name: str = "feature_name", label: str = "structure_label",
) -> dict:
    """The manifest of a case: its figures, structure and domain counts, panel and provenance, with what ``case`` says about it.

    A domain is counted over regions, or over cells where regions lack it.
    """
    out = dict(case or {}) | case_metrics(cells, regions, members, genes, expr, patches, images, min_cells, gene_name).first().asDict()
    bounds = ("x_min", "x_max", "y_min", "y_max")
    out["spatial_bounds"] = {k: out.pop(k) for k in bounds}
    out |= {"training_unit": "region", "min_cells_per_region": min_cells, "gene_name_key": gene_name, "has_spatial": {"x", "y"} <= set(cells.columns)}
    out["structure_counts"] = {str(r["label"]): r["n"] for r in label_counts(regions, label).collect()} if label in regions.columns else {}
    counts = domain_counts(regions, [c for c in domains if c in regions.columns]).unionByName(domain_counts(cells, [c for c in domains if c not in regions.columns]))
    out["domain_counts"] = {}
    for r in counts.orderBy("domain", "value").collect():  # a row for each slide, batch and the like
        out["domain_counts"].setdefault(r["domain"], {})[r["value"]] = r["n"]
    g = genes.select(F.col(gene_name).alias("gene"))
    figures = panel_metrics(g, panel if panel is not None else g.limit(0)).first().asDict()
    out["panel"] = {"configured": figures["n_panel"] > 0, **figures}
    out["patch_provenance"] = provenance([c for c in patches.columns if c != "row_pos"])
    return out


def verdict_rules(m: dict, structure_context: bool = True) -> list[tuple[str, str, bool, str]]:
    """``(rule, level, fired, message)`` of all rules, in order; ``m`` is a manifest."""
    panel, origin, some = m["panel"], m["patch_provenance"], m["patch_count"] > 0
    images, structures = m["region_image_coverage"], m["patch_structure_coverage"]
    return [
        ("no_coordinates", "fatal", not m["has_spatial"], "cells have no coordinates"),
        ("coordinates_not_finite", "fatal", m["has_spatial"] and m["missing_spatial_count"] > 0, f"{m['missing_spatial_count']} cells have coordinates that are missing or not finite"),
        ("duplicate_genes", "warning", m["duplicate_gene_count"] > 0, f"{m['duplicate_gene_count']} gene names are repeated"),
        ("panel_missing", "warning", panel["configured"] and panel["n_missing"] > 0, f"{panel['n_missing']} genes of the panel are not in the data"),
        ("panel_outside", "warning", panel["configured"] and panel["n_outside"] > 0, f"{panel['n_outside']} genes of the data are not in the panel"),
        ("no_patches", "warning", not some, "there are no patches, images are empty"),
        ("patch_coverage", "warning", some and images < 1 and structures < 1, f"patches cover {images:.1%} of regions and {structures:.1%} of structures"),
        ("missing_images", "warning", m["missing_image_count"] > 0, f"{m['missing_image_count']} patches name images that are not there"),
        ("no_patch_coordinates", "warning", some and not origin["has_coordinates"], "patches have no coordinates"),
        ("no_registration", "warning", some and not origin["has_registration_metadata"], "patches tell nothing about registration"),
        ("structure_coverage", "warning", structure_context and m["structure_assignment_coverage"] < STRUCTURE_SHARE, f"only {m['structure_assignment_coverage']:.1%} of regions have a structure"),
        ("no_regions", "fatal", m["n_regions"] == 0, "there are no regions"),
    ]


# Figures of a manifest that the report repeats.
REPORTED = (
    "patch_cell_coverage", "patch_structure_coverage", "n_regions", "regions_with_cells", "region_image_coverage", "cell_assignment_coverage", "low_cell_region_count",
    "missing_image_count", "duplicate_gene_count", "missing_spatial_count", "structure_assignment_coverage", "matrix_density",
)


def verdict(manifest: dict, structure_context: bool = True) -> dict:
    """The report: ``fail`` with any fatal finding, else ``pass``; warnings change nothing."""
    fired = [(level, text) for _, level, hit, text in verdict_rules(manifest, structure_context) if hit]
    fatal = [t for level, t in fired if level == "fatal"]
    metrics = {k: manifest[k] for k in REPORTED} | {"panel_missing_from_data_count": manifest["panel"]["n_missing"], "panel_outside_panel_count": manifest["panel"]["n_outside"]}
    return {"case_name": manifest.get("case_name"), "status": "fail" if fatal else "pass", "fatal_errors": fatal, "warnings": [t for level, t in fired if level == "warning"], "metrics": metrics}


def region_report(regions: DataFrame, members: DataFrame, case_name: str | None = None) -> dict:
    """Figures of exported regions: with and without image, cells, share with image to four places, structures."""
    r = regions.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("qc_flag") == "ok", 1)).alias("i")).first()
    return {
        "case_name": case_name, "training_unit": "region", "n_regions_total": r["n"], "n_regions_with_image": r["i"], "n_regions_no_image": r["n"] - r["i"],
        "n_cells_assigned": members.select("cell_id").distinct().count(), "image_coverage": round(r["i"] / max(1, r["n"]), 4),
        "structure_counts": {str(x["label"]): x["n"] for x in label_counts(regions, "structure_label").collect()} if "structure_label" in regions.columns else {},
    }


def render_markdown(report: dict, manifest: dict) -> str:
    """The verdict, the main figures and the split as Markdown."""
    lines = [f"# Quality report: {report['case_name']}", "", f"Status: **{report['status']}**", "", "## Case", ""]
    lines += [f"- {k}: {manifest[k]}" for k in ("mode", "n_cells", "n_regions", "n_genes", "patch_count") if k in manifest]
    lines += [f"- {k}: {report['metrics'][k]:.1%}" for k in ("region_image_coverage", "cell_assignment_coverage", "structure_assignment_coverage")]
    lines += [f"- matrix_density: {manifest['matrix_density']:.6f}", f"- panel genes: {manifest['panel']['n_panel']}, not in the data: {manifest['panel']['n_missing']}"]
    for k in ("coordinate_columns", "registration_columns"):
        lines.append(f"- {k}: {', '.join(manifest['patch_provenance'][k]) or 'none'}")
    for title, key in (("Fatal", "fatal_errors"), ("Warnings", "warnings")):
        lines += ["", f"## {title}", "", *[f"- {x}" for x in report[key] or ["none"]]]
    if "split" in manifest:
        lines += ["", "## Split", "", *[f"- {k}: {v}" for k, v in manifest["split"].items()]]
    return "\n".join(lines) + "\n"
