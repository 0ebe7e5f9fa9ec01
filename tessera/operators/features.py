"""Model inputs: codes, names, bins, selections and masks, all decided by hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_order, or_missing
from .ranking import global_rank

# Columns that can name genes, in order of preference.
GENE_NAMES = ("feature_name", "gene_name", "name")


def label_codes(regions: DataFrame, label: str, name: str = "code") -> DataFrame:
    """``regions`` with the 0-based number of its label among the sorted labels; null is ``unknown``."""
    d = regions.withColumn("l_", or_missing(label, "unknown"))
    codes = global_rank(d.select("l_").distinct(), "l_", "l_", name)  # a row a label
    return d.join(codes, "l_").drop("l_")


def vocabulary(genes: DataFrame, name: str | None = None, position: str = "gene_pos", row_name: str = "gene") -> DataFrame:
    """``genes`` with ``vocab_name`` and ``vocab_id`` from the first naming column that is there, else from the row's own name."""
    found = next((c for c in ((name,) if name else ()) + GENE_NAMES if c in genes.columns), row_name)
    return unique_names(genes.withColumn(found, F.col(found).cast("string")), found, position)


def colliding_names(vocabulary: DataFrame) -> DataFrame:
    """``(vocab_name, n)`` of names that several genes still have: a suffix can give what another gene is called."""
    return vocabulary.groupBy("vocab_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_vocabulary(mine: DataFrame, other: DataFrame) -> None:
    """ValueError unless both ``(vocab_id, vocab_name)`` tables have the same names in the same order."""
    a, b = (v.select("vocab_id", F.col("vocab_name").alias(n)) for v, n in ((mine, "a_"), (other, "b_")))
    apart = a.join(b, "vocab_id", "full").where(~F.col("a_").eqNullSafe(F.col("b_"))).orderBy("vocab_id").limit(1).collect()
    if apart:
        raise ValueError(f"vocabularies differ from id {apart[0]['vocab_id']}: {apart[0]['a_']!r}, {apart[0]['b_']!r}")


def unique_names(genes: DataFrame, name: str = "feature_name", position: str = "gene_pos") -> DataFrame:
    """``genes`` with ``vocab_name``: the n-th repeat of a name gets the suffix ``.n``, and ``vocab_id`` = position + 1."""
    turn = F.row_number().over(Window.partitionBy(name).orderBy(position)) - 1
    d = genes.withColumn("turn_", turn)
    text = F.when(F.col("turn_") > 0, F.concat_ws(".", F.col(name), F.col("turn_").cast("string"))).otherwise(F.col(name))
    return d.withColumn("vocab_name", text).withColumn("vocab_id", (F.col(position) + 1).cast("int")).drop("turn_")


def expression_bins(values: DataFrame, bins: int, key: str = "region_id", value: str = "value", logged: bool = True) -> DataFrame:
    """``values`` with ``bin``: ``floor(log1p(v) / greatest of the row * (bins - 1))``, 0 where that is not positive.

    ``logged`` first takes log1p of the non-negative value, as the batches do before binning.
    """
    v = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    d = values.where(F.col(key).isNotNull()).withColumn("v_", F.log1p(F.log1p(v) if logged else v))
    d = d.withColumn("m_", F.max("v_").over(Window.partitionBy(key)))
    return d.withColumn("bin", F.when(F.col("m_") > 0, F.floor(F.col("v_") / F.col("m_") * (bins - 1))).otherwise(0).cast("int")).drop("v_", "m_")


def z_scores(points: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``points`` with ``<c>_z``; a deviation below 1e-6 counts as 1."""
    r = points.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = points
    for c in columns:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        out = out.withColumn(f"{c}_z", (F.col(c) - F.lit(m if m is not None else 0.0)) / F.lit(s if s is not None and s >= 1e-6 else 1.0))
    return out


def sample_cells(members: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` cells of each region, by hash of seed and cell."""
    order = Window.partitionBy("region_id").orderBy(hash_order(F.lit(seed), F.col("cell_id")), "cell_id")
    return members.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= most).drop("r_")


def select_genes(values: DataFrame, most: int, seed: int = 0, genes: DataFrame | None = None) -> DataFrame:
    """At most ``most`` genes of each region: non-zero ones first, then by hash of seed, region and gene.

    With ``genes(gene)``, all distinct genes there are, a region with fewer non-zero ones is filled up with
    zeros: genes stand in a hashed order, and those after the region's own hashed place come first.
    """
    key = hash_order(F.lit(seed), F.col("region_id"), F.col("gene"))
    order = Window.partitionBy("region_id").orderBy(F.when(F.col("value") > 0, 0).otherwise(1), key, "gene")
    if genes is None:
        return values.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= most).drop("r_")
    names = global_rank(genes.select("gene").distinct().withColumn("k_", hash_order(F.lit(seed), F.col("gene"))), "k_", "gene", "i_").select("gene", "i_")
    n = names.count()
    names = F.broadcast(names)  # the vocabulary
    place = F.pmod(F.conv(F.substring(hash_order(F.lit(seed), F.col("region_id")), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1)))
    # A row a region: all that follows stays where the region is.
    own = F.when(F.col("value") > 0, F.struct(key.alias("k_"), "gene", F.col("value").cast("double").alias("value")))
    rows = values.join(names, "gene", "left").groupBy("region_id").agg(F.collect_list(own).alias("own_"), F.collect_list(F.when(F.col("value") > 0, F.col("i_"))).alias("have_"))
    rows = rows.select("region_id", "have_", F.size("own_").alias("n_"), place.alias("p_"), F.when(F.size("own_") <= most, F.col("own_")).otherwise(F.slice(F.sort_array("own_"), 1, most)).alias("own_"))
    chosen = F.transform("own_", lambda g: F.struct(g["gene"].alias("gene"), g["value"].alias("value"), F.lit(None).cast("long").alias("i_")))
    if n:
        # Of n_ + (most - n_) genes in a row, n_ at most are non-zero: so many are looked at, however many genes there are.
        ahead = F.sequence(F.lit(0).cast("long"), F.lit(max(min(most, n), 1) - 1).cast("long"))
        free = F.array_except(ahead, F.transform("have_", lambda i: F.pmod(i - F.col("p_"), F.lit(n))))
        fill = F.slice(free, 1, F.greatest(F.lit(most) - F.col("n_"), F.lit(0)))
        name = lambda j: F.struct(F.lit(None).cast("string").alias("gene"), F.lit(0.0).alias("value"), F.pmod(F.col("p_") + j, F.lit(n)).alias("i_"))
        chosen = F.concat(chosen, F.transform(fill, name))
    # From a plain explode Spark infers a filter on the array's size and works the array out a second time for it.
    flat = rows.select("region_id", F.explode_outer(chosen).alias("c_")).where("c_ is not null").select("region_id", "c_.*")
    flat = flat.join(names.withColumnRenamed("gene", "name_"), "i_", "left")
    return flat.select("region_id", F.coalesce("gene", "name_").alias("gene"), "value")


def mask_genes(values: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """``values`` with ``mask``: true for about ``share`` of a region's genes, for one at least."""
    key = hash_order(F.lit(seed), F.col("region_id"), F.col("gene"))
    d = values.where("region_id is not null").withColumn("h_", F.substring(key, 1, 8))
    d = d.withColumn("f_", F.min(F.struct("h_", "gene")).over(Window.partitionBy("region_id")))
    limit = f"{min(int(share * 2**32), 2**32 - 1):08x}"
    return d.withColumn("mask", (F.col("h_") < limit) | (F.col("gene") == F.col("f_.gene"))).drop("h_", "f_")


def context_id(code: Column, on: bool) -> Column:
    """Label code + 1 when structure context is on, else 0."""
    return code + 1 if on else F.lit(0)


def region_items(regions: DataFrame, label: str = "structure_label", structure_context: bool = True) -> DataFrame:
    """What a model gets of each region besides its genes: z-scored place, label code, context id, cells, image."""
    d = label_codes(z_scores(regions), label)
    d = d.withColumn("context_id", context_id(F.col("code"), structure_context))
    return d.select("region_id", "x_z", "y_z", F.col("code").cast("long").alias("code"), F.col("context_id").cast("long").alias("context_id"), *[c for c in ("n_cells", "image_path") if c in d.columns])


def region_batches(
    values: DataFrame, max_genes: int, bins: int, share: float, seed: int = 0, genes: DataFrame | None = None, members: DataFrame | None = None,
    expr: DataFrame | None = None, max_cells: int = 0,
) -> DataFrame:
    """One row a region: ``tokens``, ``padding`` and, with ``members`` and ``expr``, ``cells``.

    Tokens are the selected genes in order, as structs: log value, the value as input (0 where
    masked), bin and mask.  ``padding`` is the number of places up to ``max_genes`` that stay empty.  Cells are
    sampled members in order, each with its log values at the tokens' places; a cell without any of the genes has zeros.
    """
    d = mask_genes(expression_bins(select_genes(values, max_genes, seed, genes), bins), share, seed)
    log = lambda v: F.log1p(F.greatest(v.cast("double"), F.lit(0.0)))
    token = F.struct("gene", log(F.col("value")).alias("value"), F.when(F.col("mask"), 0.0).otherwise(log(F.col("value"))).alias("input"), "bin", "mask")
    out = d.groupBy("region_id").agg(F.sort_array(F.collect_list(token)).alias("tokens")).withColumn("padding", F.lit(max_genes) - F.size("tokens"))
    if members is None or expr is None or max_cells < 1:
        return out
    # What a sampled cell has comes to it by its id, and then to the region in one row a cell.
    sampled = sample_cells(members.select("region_id", "cell_id"), max_cells, seed)
    had = sampled.join(expr.select("cell_id", "gene", F.col("value").cast("double").alias("v_")), "cell_id", "left").groupBy("region_id", "cell_id", "gene").agg(F.sum("v_").alias("v_"))
    entry = F.when(F.col("gene").isNotNull(), F.struct("gene", log(F.col("v_")).alias("v")))
    cells = had.groupBy("region_id", "cell_id").agg(F.collect_list(entry).alias("m_")).groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("cell_id", "m_"))).alias("cells"))
    named = F.transform("cells", lambda c: F.struct(c["cell_id"].alias("cell_id"), F.map_from_entries(c["m_"]).alias("m")))
    row = lambda c: F.transform("tokens", lambda t: F.coalesce(F.try_element_at(c["m"], t["gene"]), F.lit(0.0)))
    none = F.expr("cast(array() as array<struct<cell_id string, values array<double>>>)")
    dense = F.transform(named, lambda c: F.struct(c["cell_id"].alias("cell_id"), row(c).alias("values")))
    return out.join(cells, "region_id", "left").withColumn("cells", F.coalesce(dense, none))
