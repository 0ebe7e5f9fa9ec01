"""Train, validation and test splits that keep blocks together."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, hash_order, or_missing
from ..tables import to_table
from .ranking import global_rank, running_total


def rank_bins(df: DataFrame, value: str, bins: int, tie: str = "region_id", name: str = "bin") -> DataFrame:
    """``df`` with ``min(rank * bins / n, bins - 1)``: bins of equal numbers of rows."""
    n = df.count()
    ranked = global_rank(df, value, tie, "rank_")
    return ranked.withColumn(name, F.least(F.expr(f"rank_ * {bins} div {max(n, 1)}"), F.lit(bins - 1)).cast("int")).drop("rank_")


def block_side(n: int) -> int:
    """Bins of each axis for n regions."""
    return min(32, max(2, math.ceil(math.sqrt(max(4.0, n / 4)))))


def spatial_blocks(regions: DataFrame, bins: int | None = None) -> DataFrame:
    """``regions`` with ``block_id`` ``x<i>_y<j>``; a coordinate that isn't finite counts as 0."""
    b = bins or block_side(regions.count())
    d = regions.withColumn("x_", F.when(finite("x"), F.col("x")).otherwise(0.0)).withColumn("y_", F.when(finite("y"), F.col("y")).otherwise(0.0))
    d = rank_bins(rank_bins(d, "x_", b, name="bx_"), "y_", b, name="by_")
    return d.withColumn("block_id", F.format_string("x%d_y%d", "bx_", "by_")).drop("x_", "y_", "bx_", "by_")


def group_blocks(regions: DataFrame, column: str | None = None, strategy: str = "group_holdout") -> DataFrame:
    """``regions`` with ``block_id`` from a column; nulls are the block ``missing``.

    ``slide_holdout`` falls back on slide_id, then patient_id.
    """
    names = [column] if column else []
    if strategy == "slide_holdout":
        names += ["slide_id", "patient_id"]
    found = next((c for c in names if c in regions.columns), None)
    if found is None:
        raise ValueError(f"{strategy}: none of {names} is there")
    return regions.withColumn("block_id", or_missing(found)).withColumn("split_group_key", F.lit(found))


def assign_splits(blocked: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """``blocked`` with ``split`` by whole blocks.

    Blocks are put in an order (by hash of seed and name, or as given in ``order``); a block whose
    middle row falls below the train share is train, below train and val together val, else test.
    """
    blocks = blocked.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_"))
    if order is not None:
        spark = blocked.sparkSession
        ranks = spark.createDataFrame([(b, f"{i:012d}") for i, b in enumerate(order)], "block_id string, key_ string")
        blocks = blocks.join(ranks, "block_id")
    else:
        blocks = blocks.withColumn("key_", hash_order(F.lit(seed), F.col("block_id")))
    # One row a block: the cumulative size is taken over blocks, not over regions.
    blocks = running_total(blocks, ["key_", "block_id"], "n_", "before_")
    total = blocks.agg(F.sum("n_").alias("t")).first()["t"] or 0
    middle = F.col("before_") + F.col("n_") / 2
    split = F.when(middle < total * train, "train").when(middle < total * (train + val), "val").otherwise("test")
    return blocked.join(blocks.select("block_id", split.alias("split")), "block_id")


def shuffled_blocks(blocked: DataFrame, seed: int, most: int = 1024) -> list[str]:
    """Sorted distinct blocks in NumPy's seeded order; for spatial blocks, of which there are at most ``most``."""
    names = [r["block_id"] for r in blocked.select("block_id").distinct().orderBy("block_id").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} blocks: order them by hash")
    return [names[i] for i in np.random.default_rng(seed).permutation(len(names))]


def split_seed(split: int | None, training: int = 0, data: int = 0) -> int:
    """The split's own seed, else the training's if it is not zero, else the data's."""
    return split if split is not None else training or data


def make_splits(
    regions: DataFrame, strategy: str = "spatial_block", group_col: str | None = None, train: float = 0.7, val: float = 0.15, seed: int | None = None,
    training_seed: int = 0, data_seed: int = 0, order: str = "hash",
) -> DataFrame:
    """``(region_id, split, split_strategy, split_group_key, block_id)`` by one of three strategies.

    The seed is resolved by ``split_seed``.  Blocks are ordered by ``hash``, or for spatial blocks as
    NumPy's generator shuffles their sorted names (``numpy``).  Regions without coordinates are
    blocks of their own, numbered in the order of their ids.  An empty table gives an empty one.
    """
    if strategy not in ("spatial_block", "group_holdout", "slide_holdout"):
        raise ValueError(f"unknown strategy {strategy!r}")
    seed = split_seed(seed, training_seed, data_seed)
    if strategy == "spatial_block":
        if {"x", "y"} <= set(regions.columns):
            d = spatial_blocks(regions)
        else:
            d = global_rank(regions, "region_id", "region_id", "rank_").withColumn("block_id", F.format_string("idx_%04d", "rank_"))
        d = d.withColumn("split_group_key", F.lit(None).cast("string"))
    else:
        d = group_blocks(regions, group_col, strategy)
    d = to_table(d.select("region_id", "block_id", "split_group_key"), "blocks")
    d = assign_splits(d, train, val, seed, shuffled_blocks(d, seed) if order == "numpy" else None)
    return d.select("region_id", "split", F.lit(strategy).alias("split_strategy"), "split_group_key", "block_id")


def training_rows(regions: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Rows to train and to validate on; all rows train where none is marked ``train``."""
    train = regions.where(F.col(split) == "train")
    return (train if train.limit(1).count() else regions), regions.where(F.col(split) == "val")


def leaking_groups(splits: DataFrame, group: str = "block_id") -> DataFrame:
    """Groups that stand in more than one split; empty for a sound one."""
    return splits.groupBy(group).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def split_summary(splits: DataFrame, most: int = 100) -> DataFrame:
    """For each split its number of regions and at most ``most`` of its blocks, sorted."""
    n = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n_regions"))
    first = splits.select("split", "block_id").distinct().withColumn("r_", F.row_number().over(Window.partitionBy("split").orderBy("block_id")))
    blocks = first.where(F.col("r_") <= most).groupBy("split").agg(F.array_sort(F.collect_list("block_id")).alias("blocks"))
    return n.join(blocks, "split")
