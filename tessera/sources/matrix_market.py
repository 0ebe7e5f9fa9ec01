"""A case in an instrument's folder: counts as Matrix-Market text, with features, barcodes and cells beside them.

Rows and columns of the matrix are line numbers of the files of features and barcodes.  Spark deals
text files out in blocks, so a line's number is its place in its block and the lines of all blocks
before it; that is one row for each block to gather, and no file is read in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.features import unique_names
from ..operators.ranking import global_rank
from ..tables import exists, to_table, write_small

# Names of the format's files, where they can lie, and the features that are genes.
MATRIX, BARCODES, FEATURES = "matrix.mtx", "barcodes.tsv", "features.tsv"
FOLDERS = ("cell_feature_matrix", "filtered_feature_bc_matrix", "")
CELLS = ("cells.parquet", "cells.csv.gz", "cells.csv")
GENE_TYPES = ("Gene Expression",)


@dataclass(frozen=True)
class Folder:
    """Where the files are; each may be a file, plain or gzipped, or a folder of parts in the order of their names."""

    matrix: str
    barcodes: str
    features: str
    cells: str | None


def _first(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def find_folder(spark: SparkSession, root: str) -> Folder | None:
    """The folder's files, or None if one of the three of the matrix is not there."""
    root = root.rstrip("/")
    for folder in FOLDERS:
        base = f"{root}/{folder}".rstrip("/")
        found = [_first(spark, [f"{base}/{n}.gz", f"{base}/{n}"]) for n in (MATRIX, BARCODES, FEATURES)]
        if all(found):
            return Folder(*found, _first(spark, [f"{root}/{c}" for c in CELLS]))
    return None


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines(value, file_, block_, id_)`` (see ``_read``) with ``line``, its number from 0 over all files in order of their paths."""
    blocks = lines.groupBy("file_", "block_").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(F.lit(0)).orderBy("file_", "block_").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file_", "block_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("shift_"))  # a row for each block
    return lines.join(starts, ["file_", "block_"]).withColumn("line", F.col("id_") + F.col("shift_")).drop("shift_")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file_, block_, id_)``: lines, the file and block they are from, and a number that ascends in a block."""
    meta = F.col("_metadata")
    return spark.read.text(path).select("value", meta["file_path"].alias("file_"), meta["file_block_start"].alias("block_"), F.monotonically_increasing_id().alias("id_"))


def _names(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, int]:
    """``(line, fields)`` of a file of tab-separated fields, and how many there are."""
    lines = to_table(_read(spark, path), f"mtx-{name}")  # written, as blocks may be dealt out otherwise when read again
    return numbered_lines(lines).select("line", F.split("value", "\t").alias("fields")), lines.count()


def _fields(value: Column) -> Column:
    """The fields of a line between white space.

    Most lines have single blanks, which are found without a regular expression.
    """
    odd = [value.contains(c) for c in ("  ", "\t", "\x0b", "\f")]
    plain = F.when(odd[0] | odd[1] | odd[2] | odd[3], F.regexp_replace(value, r"\s+", " ")).otherwise(value)
    return F.split(F.trim(plain), " ")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """``(i, j, value)`` from 0 of the entries that are not zero, the number of rows, and that of columns.

    ValueError if the file isn't a general coordinate matrix, or its size line doesn't agree with the
    entries: their number, and that each lies inside.  An entry that stands there twice stays twice,
    which is how the format adds them up.
    """
    raw = _read(spark, path)
    parts = _fields(F.col("value"))
    head = F.col("value").startswith("%%")
    rows = raw.where((F.trim("value") != "") & (head | ~F.col("value").startswith("%")))
    rows = rows.select(
        "file_", "block_", "id_", F.when(head, F.col("value")).alias("banner"), F.get(parts, F.lit(0)).try_cast("long").alias("i"),
        F.get(parts, F.lit(1)).try_cast("long").alias("j"), F.get(parts, F.lit(2)).try_cast("double").alias("v"), F.size(parts).alias("n"),
    )
    table = to_table(rows, "mtx-entries")
    entry, placed = F.col("banner").isNull(), (F.col("i") > 0) & (F.col("j") > 0)
    good = {2: placed & (F.col("n") == 2), 3: placed & (F.col("n") == 3) & F.col("v").isNotNull()}
    # One pass: a row for each block, of numbers only.
    blocks = table.groupBy("file_", "block_").agg(
        F.min(F.when(~entry, F.col("id_"))).alias("banner_at"), F.min(F.when(entry, F.col("id_"))).alias("at"), F.count(F.when(entry, 1)).alias("n"),
        *[F.count(F.when(entry & g, 1)).alias(f"good{k}") for k, g in good.items()], F.max(F.when(entry, F.col("i"))).alias("i"), F.max(F.when(entry, F.col("j"))).alias("j"),
    )
    place = F.struct("file_", "block_")
    found = to_table(blocks, "mtx-blocks").agg(
        F.min_by("banner_at", F.when(F.col("banner_at").isNotNull(), place)).alias("banner_at"), F.min_by("at", F.when(F.col("at").isNotNull(), place)).alias("at"),
        *[F.sum(c).alias(c) for c in ("n", "good2", "good3")], F.max("i").alias("i"), F.max("j").alias("j"),
    ).first()
    banner = table.where(F.col("id_") == found["banner_at"]).first()["banner"] if found["banner_at"] is not None else ""
    kind = re.fullmatch(r"%%MatrixMarket\s+matrix\s+coordinate\s+(integer|real|pattern)\s+general\s*", banner, re.IGNORECASE)
    if kind is None:
        raise ValueError(f"{path}: not a general coordinate matrix: {banner!r}")
    if found["at"] is None:
        raise ValueError(f"{path}: no size line")
    is_size = F.col("id_") == found["at"]  # tells all rows of the table apart
    fields = 2 if kind[1].lower() == "pattern" else 3
    size = table.where(is_size).select("*", good[fields].alias("good")).first()
    entries = table.where(entry & ~is_size)
    n_rows, n_columns, n_entries = size["i"], size["j"], int(size["v"] if size["v"] is not None else -1)
    n, fit = found["n"] - 1, found[f"good{fields}"] - bool(size["good"])
    if n and (n_rows is None or n_columns is None or found["i"] > n_rows or found["j"] > n_columns):  # some are outside
        fit = entries.where(good[fields] & (F.col("i") <= n_rows) & (F.col("j") <= n_columns)).count()
    if n != n_entries or fit != n:
        raise ValueError(f"{path}: {n_entries} entries of {n_rows} by {n_columns} are announced, {n} are there, {n - fit} of them malformed or outside")
    value = F.lit(1.0) if fields == 2 else F.col("v")
    return entries.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), value.alias("value")).where("value <> 0"), n_rows, n_columns


def read_case(spark: SparkSession, root: str, types: tuple[str, ...] = GENE_TYPES) -> dict[str, DataFrame]:
    """``cells``, ``genes``, ``expr`` and ``entries`` of an instrument's folder; FileNotFoundError if files of the matrix are not there.

    Genes are the features of ``types`` (all, if the file has no third column), numbered in order; a gene
    goes by its name, made unique.  Cells are the barcodes in order (``row_pos``), with the columns that
    the file of cells has for them; ValueError if files and matrix differ in length.  ``entries`` is ``expr`` by
    ``row_pos`` instead of the cell's name, as the matrix has it.
    """
    folder = find_folder(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no {MATRIX}, {BARCODES} and {FEATURES} in {root}")
    triplets, n_rows, n_columns = read_matrix(spark, folder.matrix)
    field = lambda k: F.get("fields", F.lit(k))
    feature_lines, n_features = _names(spark, folder.features, "features")
    barcode_lines, n_barcodes = _names(spark, folder.barcodes, "barcodes")
    features = feature_lines.select("line", field(0).alias("feature_id"), F.coalesce(field(1), field(0)).alias("feature_name"), field(2).alias("feature_type"))
    barcodes = barcode_lines.select(F.col("line").alias("row_pos"), field(0).alias("cell_id"))
    for path, lines, n in ((folder.features, n_features, n_rows), (folder.barcodes, n_barcodes, n_columns)):
        if lines != n:
            raise ValueError(f"{path}: {lines} lines, the matrix has {n}")
    kept = features.where(F.col("feature_type").isNull() | F.col("feature_type").isin(*types))
    genes = to_table(unique_names(global_rank(kept, "line", "feature_id", "gene_pos")), "mtx-genes")
    genes = genes.withColumnRenamed("vocab_name", "gene").drop("vocab_id")
    entries = triplets.join(genes.select(F.col("line").alias("i"), "gene"), "i").select(F.col("j").alias("row_pos"), "gene", F.col("value").cast("float").alias("value"))
    cells = barcodes
    if folder.cells:
        about = spark.read.parquet(folder.cells) if folder.cells.endswith(".parquet") else spark.read.csv(folder.cells, header=True)
        about = about.withColumn("cell_id", F.col("cell_id").cast("string"))
        cells = barcodes.join(about.drop("row_pos"), "cell_id", "left")
    return {"cells": cells, "genes": genes.drop("line"), "expr": entries.join(barcodes, "row_pos").select("cell_id", "gene", "value"), "entries": entries}


def write_case(cells: DataFrame, genes: DataFrame, expr: DataFrame, path: str, cell_position: str = "row_pos", gene_position: str = "gene_pos") -> None:
    """Write canonical tables as an instrument's folder of plain text in parts, which ``read_case`` reads.

    ``cells`` needs ``cell_id`` and a position, ``genes`` ``gene`` and one; values of ``expr`` for cells or genes that
    are in neither are left out.
    """
    spark, base = cells.sparkSession, f"{path.rstrip('/')}/{FOLDERS[0]}"
    about = cells.withColumn("p_", F.col(cell_position)).drop(cell_position, "row_pos").withColumnRenamed("p_", "row_pos")  # which a reader numbers anew
    about.write.parquet(f"{path.rstrip('/')}/{CELLS[0]}")
    kept = spark.read.schema(about.schema).parquet(f"{path.rstrip('/')}/{CELLS[0]}")  # what is ranked is read from there, so ``cells`` is worked out once
    c = global_rank(kept.select("cell_id", "row_pos"), "row_pos", "cell_id", "j")
    g = to_table(global_rank(genes.select("gene", F.col(gene_position).alias("p_")), "p_", "gene", "i"), "mtx-genes")
    body = expr.join(c.select("cell_id", "j"), "cell_id").join(g.select("gene", "i"), "gene").select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("value")).alias("value"))
    body.write.text(f"{base}/{MATRIX}")
    size = f"{g.count()} {kept.count()} {spark.read.text(f'{base}/{MATRIX}').count()}"
    write_small(spark, f"{base}/{MATRIX}/head", "%%MatrixMarket matrix coordinate real general\n%\n" + size + "\n")  # by its name before all parts
    ordered = lambda t, by, *out: t.repartitionByRange(by).sortWithinPartitions(by).select(F.concat_ws("\t", *out).alias("value"))
    ordered(c, "j", "cell_id").write.text(f"{base}/{BARCODES}")
    ordered(g, "i", "gene", "gene", F.lit(GENE_TYPES[0])).write.text(f"{base}/{FEATURES}")
