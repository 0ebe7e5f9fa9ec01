"""Regions in batches of one size, each once an epoch, in an order that is another in every epoch.

The order is a hash of seed, epoch and region, so it doesn't depend on how rows are dealt, and any
step's batch is found without going through those before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_order
from ..tables import drop_tables, to_table
from . import encoder, features
from .ranking import global_rank


def epoch_order(regions: DataFrame, epoch: int | None, size: int, seed: int = 0) -> DataFrame:
    """``(region_id, batch, place)``: the region's batch in the epoch, from 0, and its place in it.

    Without an epoch, regions stand in the order of their ids.  All batches have ``size`` regions, but for the last.
    """
    key: Column = F.lit(0) if epoch is None else hash_order(F.lit(seed), F.lit(epoch), F.col("region_id"))
    ranked = global_rank(regions.select("region_id", key.alias("k_")), "k_", "region_id", "r_")
    return ranked.select("region_id", F.floor(F.col("r_") / size).alias("batch"), (F.col("r_") % size).alias("place"))


@dataclass
class RegionDataset:
    """Inputs of the network, epoch by epoch.

    ``values`` are the regions' mean expression, ``genes`` all genes, ``items`` what else is known of a region
    (``features.region_items``; a region without items is no part of the data set), ``neighbors`` the neighbourhoods' means.
    Genes are chosen and masked anew in each epoch.
    """

    values: DataFrame
    genes: DataFrame
    items: DataFrame
    size: int
    max_genes: int
    bins: int
    share: float = 0.15
    seed: int = 0
    members: DataFrame | None = None
    expr: DataFrame | None = None
    max_cells: int = 0
    neighbors: DataFrame | None = None
    images: DataFrame | None = None
    _tables: dict[int | None, DataFrame] = field(default_factory=dict)
    _count: int | None = None

    def __len__(self) -> int:
        if self._count is None:
            self._count = self.items.count()
        return self._count

    @property
    def n_batches(self) -> int:
        return math.ceil(len(self) / self.size)

    def rows(self, seed: int) -> DataFrame:
        """The network's inputs of all regions, as chosen and masked by ``seed``."""
        own = self.items.select("region_id")
        of = lambda df: df if df is None else df.join(own, "region_id", "left_semi")
        batches = features.region_batches(of(self.values), self.max_genes, self.bins, self.share, seed, self.genes, of(self.members), self.expr, self.max_cells)
        return encoder.inputs(batches, self.items, self.images, self.neighbors)

    def epoch(self, epoch: int | None) -> DataFrame:
        """All inputs with ``batch`` and ``place``, as a table sorted by batch; that of the epoch before is given up.

        None is the fixed order.
        """
        if epoch not in self._tables:
            order = epoch_order(self.items, epoch, self.size, self.seed)
            rows = self.rows(self.seed + 1_000_003 * (0 if epoch is None else epoch + 1)).join(order, "region_id")
            table = to_table(rows.repartitionByRange("batch").sortWithinPartitions("batch", "place"), "epoch")
            for old in [e for e in self._tables if (e is None) == (epoch is None)]:
                drop_tables(self._tables.pop(old))
            self._tables[epoch] = table
        return self._tables[epoch]

    def batch(self, step: int) -> DataFrame:
        """The inputs of a step, from 0: only the part of the epoch's table that holds its batch is read."""
        epoch, batch = divmod(step, self.n_batches)
        return self.epoch(epoch).where(F.col("batch") == batch)

    def close(self) -> None:
        drop_tables(*self._tables.values())
        self._tables.clear()
