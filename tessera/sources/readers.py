"""Readers that bring tables to their canonical columns, with missing values as nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, first_true, hash_order
from ..operators.regions import METADATA

# Pairs of coordinate columns in order of preference, and columns that hold row names.
COORDINATES = (("x", "y"), ("x_centroid", "y_centroid"), ("cell_x_centroid", "cell_y_centroid"))
ROW_NAMES = ("__index_level_0__", "index")
# Where a manifest's record has a field, in order of preference.
MANIFEST = {
    "cell_id": ("cell_id",),
    "contour_id": ("contour_id", "region_id"),
    "structure_id": ("structure_id",),
    "structure_label": ("structure_label",),
    "structure_name": ("structure_name",),
    "image_path": ("image_path", "patch.image_path"),
    "patch_x": ("patch_x", "x", "patch.patch_x", "patch.x", "patch.center_x"),
    "patch_y": ("patch_y", "y", "patch.patch_y", "patch.y", "patch.center_y"),
    "patch_size": ("patch_size", "patch.patch_size", "patch.patch_size_px"),
    "source_image": ("source_image", "patch.source_image"),
    "registration_transform": ("registration_transform", "transform", "patch.registration_transform"),
    "bbox_level_xy": ("bbox_level_xy", "patch.bbox_level_xy"),
    "bbox_level0_xy": ("bbox_level0_xy", "patch.bbox_level0_xy"),
    "pyramid_level": ("pyramid_level", "patch.pyramid_level"),
}
MANIFEST_TYPES = {"patch_x": "double", "patch_y": "double", "patch_size": "int", "pyramid_level": "int", "bbox_level_xy": "array<double>", "bbox_level0_xy": "array<double>"}


def read_table(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """Parquet, JSON, CSV or TSV by its ending, CSV as text; ``position`` names a column for the order of rows."""
    if path.endswith((".csv", ".tsv")):
        df = spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",")
    elif path.endswith(".json"):
        df = spark.read.json(path, multiLine=True)
    else:
        df = spark.read.parquet(path)
    return df.withColumn(position, F.monotonically_increasing_id()) if position else df


def normalize_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with text ``cell_id`` and double ``x``, ``y`` from the first pair that is there, else ValueError.

    Without ``cell_id`` the row's name stands for it, or its number where rows have none.
    """
    pair = next((p for p in COORDINATES if set(p) <= set(cells.columns)), None)
    if pair is None:
        raise ValueError(f"no coordinates: none of {COORDINATES}")
    name = next((F.col(c) for c in ROW_NAMES if c in cells.columns), F.monotonically_increasing_id())
    named = cells if "cell_id" in cells.columns else cells.withColumn("cell_id", name)
    named = named.withColumn("cell_id", F.col("cell_id").cast("string")).withColumns({c: F.col(p).cast("double") for c, p in zip("xy", pair, strict=True)})
    texts = [c for c, t in named.dtypes if t == "string" and c != "cell_id"]
    return named.withColumns({c: clean_text(c) for c in texts})


def stamp(cells: DataFrame, values: dict[str, str | None], source: str | None = None) -> DataFrame:
    """Case metadata where configured and absent; in a corpus slide and batch default to the source's name."""
    values = {"slide_id": source, "batch_id": source} | {k: v for k, v in values.items() if v is not None}
    return cells.withColumns({c: F.lit(values[c]) for c in METADATA if values.get(c) is not None and c not in cells.columns})


def normalize_genes(genes: DataFrame, name: str = "feature_name") -> DataFrame:
    """``genes`` with text ``name``; where it is absent, the gene's own name (``gene`` or the row's name) stands for it."""
    found = next((c for c in (name, "gene", *ROW_NAMES) if c in genes.columns), None)
    if found is None:
        raise ValueError(f"genes have neither {name!r} nor a name of their own")
    return genes.withColumn(name, F.col(found).cast("string"))


def corpus_union(cases: dict[str, DataFrame], suffix: tuple[str, ...] = ()) -> DataFrame:
    """Cases one under another with their ``source``, columns that one lacks as nulls; a single one as it is.

    Values of the columns ``suffix`` get ``-<source>``, so that equal ids of two cases stay apart.
    """
    if len(cases) == 1:
        return next(iter(cases.values()))

    def one(name: str, df: DataFrame) -> DataFrame:
        named = {c: F.concat(F.col(c).cast("string"), F.lit(f"-{name}")) for c in suffix if c in df.columns}
        return stamp(df.withColumns(named) if named else df, {}, name).withColumn("source", F.lit(name))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(name, df) for name, df in cases.items()])


def patch_manifest(records: DataFrame, record: str = "record", falsy_zero: bool = False) -> DataFrame:
    """Records of a manifest, a column of variants, flattened to the canonical columns; others are carried along.

    Only objects are records, whatever else is skipped.  A field is taken from the first place that
    has it; with ``falsy_zero`` a zero or empty value falls through too.  Nested transforms become JSON
    text with sorted keys.
    """
    pick = first_true if falsy_zero else F.coalesce

    def field(name: str) -> Column:
        kind = MANIFEST_TYPES.get(name, "string")
        found = [F.try_variant_get(record, f"$.{place}", kind) for place in MANIFEST[name]]
        if falsy_zero and kind.startswith("array"):
            found = [F.when(F.size(c) > 0, c) for c in found]
        elif kind in ("double", "int", "string"):
            return pick(*found) if kind != "string" else clean_text(pick(*found))
        return F.coalesce(*found)

    others = [c for c in records.columns if c != record]
    return records.where(F.schema_of_variant(record).startswith("OBJECT")).select(*others, *[field(c).alias(c) for c in MANIFEST])


def read_patch_manifest(spark: SparkSession, path: str, falsy_zero: bool = False) -> DataFrame:
    """A CSV as it is; a JSON list, or an object with ``patches`` or ``records``, flattened; both with ``row_pos``."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True).withColumn("row_pos", F.monotonically_increasing_id())
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.coalesce(*[F.try_variant_get("v", f"$.{c}", "variant") for c in ("patches", "records")]))
    rows = spark.sql("select pos as row_pos, value as record from {t}, lateral variant_explode(items)", t=whole.select(items.alias("items")))
    return patch_manifest(rows, falsy_zero=falsy_zero)


def read_panel(spark: SparkSession, path: str | None, inline: list[str] | None = None) -> DataFrame:
    """``(gene, position)``: an inline list and a file (first column, or a gene a line), trimmed, first mention kept."""
    frames = [spark.createDataFrame([(g, i) for i, g in enumerate(inline or [])], "gene string, position long")]
    if path:
        text = spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",") if path.endswith((".csv", ".tsv")) else spark.read.text(path)
        frames.append(text.select(F.col(text.columns[0]).alias("gene"), (F.monotonically_increasing_id() + (1 << 40)).alias("position")))
    both = reduce(DataFrame.unionByName, frames).select(F.trim("gene").alias("gene"), "position").where("gene <> ''")
    return both.groupBy("gene").agg(F.min("position").alias("position"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """``(image_path)`` of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("image_path"))


def synthetic_case(spark: SparkSession, n_cells: int, n_genes: int, n_structures: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``expr`` of a made-up case: regions round about structures, counts by structure programs."""
    regions = min(n_cells, max(8, 4 * n_structures))
    ids = spark.range(n_cells)
    cells = ids.select(
        F.concat(F.lit("cell_"), "id").alias("cell_id"), F.concat(F.lit("contour_"), F.pmod("id", F.lit(regions))).alias("contour_id"),
        F.pmod(F.pmod("id", F.lit(regions)), F.lit(n_structures)).cast("string").alias("structure_id"),
        (F.pmod("id", F.lit(regions)) * 100 + F.randn(seed)).alias("x"), (F.floor(F.col("id") / regions) + F.randn(seed + 1)).alias("y"), F.col("id").alias("row_pos"),
    )
    digest = F.substring(hash_order(F.lit(seed), F.col("id"), F.col("gene")), 1, 8)
    u = (F.conv(digest, 16, 10).cast("double") + 1) / float((1 << 32) + 1)
    grid = ids.withColumn("gene", F.explode(F.sequence(F.lit(0), F.lit(n_genes - 1))))
    own = F.pmod(F.col("gene"), F.lit(n_structures)) == F.pmod(F.pmod("id", F.lit(regions)), F.lit(n_structures))
    value = F.floor(-F.log(u) * F.when(own, 4.0).otherwise(0.7))
    expr = grid.select(F.concat(F.lit("cell_"), "id").alias("cell_id"), F.concat(F.lit("gene_"), "gene").alias("gene"), value.cast("float").alias("value")).where("value > 0")
    return cells, expr
