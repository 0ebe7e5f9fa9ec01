"""From cells to regions: members, counts, centroids, zero-inclusive means, labels, images.

Tables are long: ``cells(cell_id, ..., contour_id)`` and ``expr(cell_id, gene, value)`` with
non-zero values only.  Everything is one shuffle by the grouping key with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, normal_id

# Metadata columns of a case, and columns that a region has from its patch.
METADATA = ("slide_id", "patient_id", "organ", "batch_id", "stain", "scanner")
PATCH_COLUMNS = ("patch_x", "patch_y", "patch_size", "source_image", "registration_transform", "bbox_level_xy", "bbox_level0_xy", "pyramid_level")


def with_region_key(cells: DataFrame, region_col: str | None = "contour_id", structure_col: str | None = "structure_id") -> DataFrame:
    """``cells`` with ``region_id``: the contour, else ``region_<structure>``, else the cell itself."""
    has = lambda c: c is not None and c in cells.columns
    if has(region_col):
        key = clean_text(region_col)
    elif has(structure_col):
        key = F.concat(F.lit("region_"), F.col(structure_col).cast("string"))
    else:
        key = F.col("cell_id").cast("string")
    return cells.withColumn("region_id", key)


def region_table(cells: DataFrame, region_col: str = "region_id", min_cells: int = 1) -> DataFrame:
    """``(region_id, n_cells, x, y)`` of regions with enough cells; missing regions are left out."""
    named = cells.select(clean_text(region_col).alias("region_id"), "x", "y").where("region_id is not null")
    return named.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("x").alias("x"), F.avg("y").alias("y")).where(F.col("n_cells") >= min_cells)


def mean_expression(expr: DataFrame, cells: DataFrame, region_col: str = "region_id", key: str = "cell_id") -> DataFrame:
    """``(region_id, gene, value)``: sum over members by the number of *all* members, zeros included.

    ``key`` tells cells apart in both tables.  The number goes with the members, which are fewer than the sums.
    """
    member = cells.select(key, clean_text(region_col).alias("region_id")).where("region_id is not null")
    size = member.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_cells"))
    total = expr.join(member.join(size, "region_id"), key).groupBy("region_id", "gene").agg(F.sum("value").alias("total"), F.max("n_cells").alias("n_cells"))
    return total.select("region_id", "gene", (F.col("total") / F.col("n_cells")).alias("value"))


def first_non_null(cells: DataFrame, key: str, columns: list[str], position: str) -> DataFrame:
    """For each key and column the value of the row of least position that has one."""
    value = lambda c: clean_text(c)
    return cells.groupBy(key).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), F.col(position))).alias(c) for c in columns])


def membership(cells: DataFrame, region_col: str = "region_id") -> DataFrame:
    """Region to cell edges, one row for each member."""
    named = cells.withColumn("region_id", clean_text(region_col)).where("region_id is not null")
    return named.select("region_id", "cell_id", F.col("x").cast("float"), F.col("y").cast("float"), F.lit("inner").alias("membership"), F.lit(1.0).alias("weight"))


def keep_one(df: DataFrame, keys: list[str], position: str, last: bool = False) -> DataFrame:
    """One row for each key: that of least position, or with ``last`` the greatest; null keys go."""
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(pick(F.struct(*others), F.col(position)).alias("r_")).select(*keys, "r_.*")


def look_up(df: DataFrame, table: DataFrame, key: str, columns: list[str], position: str, last: bool = False) -> DataFrame:
    """Left join with one row of ``table`` for each key (``keep_one``)."""
    return df.join(keep_one(table, [key], position, last).select(key, *columns), key, "left")


# Columns that an assignment table can name clusters and structures by, in order of preference.
CLUSTERS, STRUCTURES = ("cluster", "cluster_id", "graphclust"), ("structure_id", "structure", "structure_label")


def assignment_columns(columns: list[str], cluster: str = "cluster", structure: str = "structure_id") -> tuple[str, str] | None:
    """The columns of an assignment table that are there, by preference; None if either is absent."""
    a, b = (next((c for c in (own, *names) if c in columns), None) for own, names in ((cluster, CLUSTERS), (structure, STRUCTURES)))
    return (a, b) if a and b else None


def add_structure(cells: DataFrame, assignments: DataFrame, cluster_col: str, position: str) -> DataFrame:
    """``structure_id`` by cluster: the last assignment wins, unmatched ones get 0; kept if there is one."""
    if "structure_id" in cells.columns:
        return cells
    table = assignments.select(F.col(cluster_col).cast("string").alias("k_"), F.col("structure_id").alias("s_"), F.col(position).alias("p_"))
    named = look_up(cells.withColumn("k_", F.col(cluster_col).cast("string")), table, "k_", ["s_"], "p_", last=True)
    return named.withColumn("structure_id", F.coalesce(F.col("s_"), F.lit(0)).cast("int")).drop("k_", "s_")


def add_contour(cells: DataFrame, mapping: DataFrame, position: str) -> DataFrame:
    """Fill missing ``contour_id`` from a cell map: the first entry of a cell wins, valid ones stay.

    Structure columns of the map come along where the cells have none.
    """
    more = [c for c in ("structure_id", "structure_label") if c in mapping.columns and c not in cells.columns]
    table = mapping.select("cell_id", F.col("contour_id").alias("m_"), *more, F.col(position).alias("p_"))
    named = look_up(cells, table, "cell_id", ["m_", *more], "p_")
    own = clean_text("contour_id") if "contour_id" in cells.columns else F.lit(None).cast("string")
    return named.withColumn("contour_id", F.coalesce(own, clean_text("m_"))).drop("m_")


def label_table(cells: DataFrame, id_col: str, label_col: str, position: str) -> DataFrame:
    """``(structure_id, structure_label)``: the last label seen with each normalised id."""
    pairs = cells.select(normal_id(id_col).alias("structure_id"), clean_text(label_col).alias("structure_label"), F.col(position).alias("p_"))
    return keep_one(pairs.where("structure_label is not null"), ["structure_id"], "p_", last=True).drop("p_")


def region_rows(
    cells: DataFrame, patches: DataFrame | None = None, images: DataFrame | None = None, labels: DataFrame | None = None,
    position: str = "row_pos", min_cells: int = 1, first_columns: tuple[str, ...] = ("structure_id", "cluster", *METADATA),
) -> DataFrame:
    """The region table: one row a region with centroid, structure, patch, image flag, cluster and domains.

    The last patch of a contour wins.  The structure is the patch's, else the first that a cell has,
    as it stands there; the label is the patch's, else that of the structure (ids compared in normal
    form), else the structure's id, else ``unknown``; ``qc_flag`` is ``ok`` where the patch's image is
    in ``images(image_path)``.  Columns that neither cells nor patches have are null.
    """
    base = region_table(cells, "region_id", min_cells)
    have = [c for c in first_columns if c in cells.columns]
    rows = base.join(first_non_null(cells, "region_id", have, position), "region_id", "left") if have else base
    if patches is not None:
        named = patches.withColumn("region_id", F.coalesce(clean_text("contour_id"), clean_text("region_id")) if "region_id" in patches.columns else clean_text("contour_id"))
        keep = [c for c in ("image_path", "structure_id", "structure_label", "structure_name", *PATCH_COLUMNS) if c in patches.columns]
        table = keep_one(named.select("region_id", position, *[F.col(c).alias(f"patch_{c}" if c.startswith("structure") else c) for c in keep]), ["region_id"], position, last=True)
        rows = rows.join(table.drop(position), "region_id", "left")
    for c in ("image_path", "patch_structure_id", "patch_structure_label", "patch_structure_name", "structure_id", "cluster", *METADATA, *PATCH_COLUMNS):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    structure = F.coalesce(clean_text(F.col("patch_structure_id").cast("string")), clean_text(F.col("structure_id").cast("string")))
    rows = rows.withColumn("contour_id", F.col("region_id")).withColumn("structure_id", structure)
    if labels is not None:
        named = labels.select(F.col("structure_id").alias("s_"), "structure_label")
        rows = rows.join(named, normal_id("structure_id") == F.col("s_"), "left").drop("s_")
    else:
        rows = rows.withColumn("structure_label", F.lit(None).cast("string"))
    label = F.coalesce(clean_text("patch_structure_label"), clean_text("patch_structure_name"), "structure_label", "structure_id", F.lit("unknown"))
    rows = rows.withColumn("structure_label", label).drop("patch_structure_id", "patch_structure_label", "patch_structure_name")
    if images is not None:
        there = images.select("image_path", F.lit(True).alias("there_")).dropDuplicates(["image_path"])
        rows = rows.join(there, "image_path", "left")
        return rows.withColumn("qc_flag", F.when(F.col("there_"), "ok").otherwise("no_image")).drop("there_")
    return rows.withColumn("qc_flag", F.when(clean_text("image_path").isNotNull(), "ok").otherwise("no_image"))


def with_splits(regions: DataFrame, splits: DataFrame) -> DataFrame:
    """Regions with their split.

    ValueError if an id stands twice in ``splits`` or a region has none; other split rows are ignored.
    A table with ``cell_id`` in place of ``region_id`` is accepted.
    """
    if "region_id" not in splits.columns and "cell_id" in splits.columns:
        splits = splits.withColumnRenamed("cell_id", "region_id")
    if not {"region_id", "split"} <= set(splits.columns):
        raise ValueError("splits need region_id and split")
    twice = splits.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(20).collect()
    if twice:
        raise ValueError(f"regions with several splits: {sorted(r['region_id'] for r in twice)}")
    missing = regions.join(splits, "region_id", "left_anti").select("region_id").limit(20).collect()
    if missing:
        raise ValueError(f"regions without a split: {sorted(r['region_id'] for r in missing)}")
    return regions.join(splits.select("region_id", "split"), "region_id")


def neighbor_mean(region_expr: DataFrame, neighbors: DataFrame) -> DataFrame:
    """``(region_id, gene, value)``: mean over each region's neighbours, absent genes as zero."""
    near = neighbors.select("region_id", "neighbor_id", F.count(F.lit(1)).over(Window.partitionBy("region_id")).alias("k"))
    # A region's values travel in one row to each that is its neighbour, and are added up where that one is.
    packed = region_expr.groupBy(F.col("region_id").alias("neighbor_id")).agg(F.collect_list(F.struct("gene", "value")).alias("v_"))
    dealt = near.join(packed, "neighbor_id").select("region_id", "k", "v_").repartition("region_id")
    rows = dealt.select("region_id", "k", F.explode("v_").alias("v_")).select("region_id", "k", "v_.gene", "v_.value")
    total = rows.groupBy("region_id", "k", "gene").agg(F.sum("value").alias("total"))
    return total.select("region_id", "gene", (F.col("total") / F.col("k")).alias("value"))
