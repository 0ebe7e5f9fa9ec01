"""Regions through the network: inputs as rows, embeddings and predictions as rows.

Weights are read from a table and go to every task; they are bounded by the model, not by the data.
Regions stay where they are: each task takes its rows through the network a few at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.images import tensor, with_pixels
from . import network as N

#: Columns of the network's inputs, as ``inputs`` gives them.
TOKENS = "array<struct<gene: string, value: double, input: double, bin: int, mask: boolean, neighbor: double>>"
COLUMNS = ("region_id", "tokens", "cells", "x_z", "y_z", "context_id", "code", "pixels")


@dataclass(frozen=True)
class Network:
    shape: N.Shape
    genes: tuple[str, ...]
    weights: dict[str, np.ndarray]


def new_network(shape: N.Shape, genes: list[str], seed: int = 0) -> Network:
    """A network that has not been trained, for genes in the order of the vocabulary."""
    return Network(shape, tuple(genes), N.initial(shape, len(genes), seed))


def to_rows(spark: SparkSession, network: Network) -> DataFrame:
    """``(name, shape, values, text)``: a row for each array, and one each for the genes and the shape."""
    rows = [(k, list(v.shape), v.ravel().tolist(), None) for k, v in network.weights.items()]
    rows += [("=genes", None, None, json.dumps(network.genes)), ("=shape", None, None, network.shape.to_json())]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>, text string")


def from_rows(table: DataFrame) -> Network:
    """The network of such rows; ValueError if arrays are missing or have another shape than the network's."""
    rows = {r["name"]: r for r in table.collect()}  # bounded by the model
    shape, genes = N.Shape.from_json(rows.pop("=shape")["text"]), tuple(json.loads(rows.pop("=genes")["text"]))
    want = N.names(shape, len(genes))
    have = {k: tuple(r["shape"]) for k, r in rows.items()}
    if have != want:
        odd = sorted(k for k in want.keys() | have.keys() if want.get(k) != have.get(k))
        raise ValueError(f"weights don't fit the network: {odd[:5]}")
    return Network(shape, genes, {k: np.array(rows[k]["values"], np.float64).reshape(s) for k, s in want.items()})


def inputs(batches: DataFrame, items: DataFrame, images: DataFrame | None = None, neighbors: DataFrame | None = None) -> DataFrame:
    """What the network gets of each region, a row each.

    ``batches`` are those of ``features.region_batches``, ``items`` those of ``features.region_items`` (a region that
    is only there has no tokens, one without items is left out); ``images`` are
    ``(image_path, pixels)`` and ``neighbors(region_id, gene, value)`` the neighbourhood's means, zero where absent.
    """
    if neighbors is None:
        tokens = batches.withColumn("tokens", F.transform("tokens", lambda t: t.withField("neighbor", F.lit(0.0))))
    else:
        # Tokens and neighbours' genes of a region meet by gene where the region is.
        near = neighbors.groupBy("region_id").agg(F.collect_list(F.struct("gene", F.log1p(F.greatest(F.col("value").cast("double"), F.lit(0.0))).alias("n_"))).alias("near_"))
        both = batches.select("region_id", F.transform("tokens", lambda t: t["gene"]).alias("own_")).join(near, "region_id")
        no_place, no_value = F.lit(None).cast("int"), F.lit(None).cast("double")
        own = F.transform("own_", lambda g, i: F.struct(g.alias("gene"), i.alias("at_"), no_value.alias("n_")))
        other = F.transform("near_", lambda n: F.struct(n["gene"].alias("gene"), no_place.alias("at_"), n["n_"].alias("n_")))
        flat = both.select("region_id", F.explode_outer(F.concat(own, other)).alias("t_")).select("region_id", "t_.*")
        met = flat.withColumn("n_", F.max("n_").over(Window.partitionBy("region_id", "gene"))).where("at_ is not null")
        found = met.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("at_", "n_"))).alias("found_"))  # one for each token, in their order
        value = lambda i: F.coalesce(F.get("found_", i)["n_"], F.lit(0.0))
        tokens = batches.join(found, "region_id", "left").withColumn("tokens", F.transform("tokens", lambda t, i: t.withField("neighbor", value(i)))).drop("found_")
    no_cells = F.array().cast("array<array<double>>")
    cells = F.transform("cells", lambda c: c["values"]) if "cells" in batches.columns else no_cells
    rows = items.join(tokens.select("region_id", "tokens", cells.alias("cells")), "region_id", "left")
    rows = rows.withColumn("tokens", F.coalesce("tokens", F.array().cast(TOKENS))).withColumn("cells", F.coalesce("cells", no_cells))
    if images is not None and "image_path" in rows.columns:
        rows = with_pixels(rows, images)
    else:
        rows = rows.withColumn("pixels", F.lit(None).cast("binary"))
    return rows.select(*COLUMNS)


def _ragged(values: np.ndarray, first: np.ndarray, width: int, empty: float = 0) -> np.ndarray:
    """Rows ``values[first[i]:first[i + 1]]`` filled up to ``width``."""
    out = np.full((len(first) - 1, width), empty, values.dtype)
    n = np.diff(first)
    out[np.repeat(np.arange(len(n)), n), np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], n)] = values[first[0] : first[-1]]
    return out


class Reader:
    """Rows of ``inputs`` as arrays."""

    def __init__(self, batch: pa.RecordBatch, network: Network) -> None:
        col = {c: batch.column(c) for c in COLUMNS if c in batch.schema.names}
        self.shape, self.region = network.shape, col["region_id"]
        self.first = np.asarray(col["tokens"].offsets).astype(np.int64)
        tokens = col["tokens"].values
        self.gene = tokens.field("gene")
        at = pc.index_in(self.gene, pa.array(network.genes, self.gene.type))
        if at.null_count:
            raise ValueError(f"a gene that the network doesn't know: {pc.filter(self.gene, pc.is_null(at))[0]}")
        self.ids = np.asarray(at).astype(np.int64) + 1
        self.bins = np.asarray(tokens.field("bin")).astype(np.int64)
        self.mask = np.asarray(tokens.field("mask").to_numpy(zero_copy_only=False)).astype(bool)
        self.value, self.input, self.neighbor = (np.asarray(tokens.field(k)).astype(np.float64) for k in ("value", "input", "neighbor"))
        self.cell = np.asarray(col["cells"].offsets).astype(np.int64)
        self.cell_first, self.cell_values = np.asarray(col["cells"].values.offsets).astype(np.int64), np.asarray(col["cells"].values.values).astype(np.float64)
        self.spatial = np.stack([np.asarray(col[k]).astype(np.float64) for k in ("x_z", "y_z")], 1)
        self.context, self.code = (np.asarray(col[k]).astype(np.int64) for k in ("context_id", "code"))
        self.pixels = col["pixels"]

    def pieces(self) -> Iterator[tuple[int, int]]:
        return N.micro_batches(np.diff(self.first).tolist(), np.diff(self.cell).tolist(), self.shape)

    def arrays(self, a: int, b: int) -> dict[str, np.ndarray]:
        first, cell, s = self.first[a : b + 1], self.cell[a : b + 1], self.shape
        width, n_cells = max(1, int(np.diff(first).max())), int(np.diff(cell).max())
        pad = lambda x, empty=0: _ragged(x, first, width, empty)
        cells, no_cell = np.zeros((b - a, n_cells, width)), np.ones((b - a, n_cells), bool)
        if cell[-1] > cell[0]:
            dense = _ragged(self.cell_values, self.cell_first[cell[0] : cell[-1] + 1], width)
            n = np.diff(cell)
            row, place = np.repeat(np.arange(b - a), n), np.arange(len(dense)) - np.repeat(cell[:-1] - cell[0], n)
            cells[row, place], no_cell[row, place] = dense, False
        image = np.stack([tensor(p.as_py(), s.image_size, s.channels) for p in self.pixels[a:b]]).astype(np.float64) if s.use_image else np.zeros((b - a, 0))
        return {
            "ids": pad(self.ids), "bins": pad(self.bins), "input": pad(self.input), "target": pad(self.value), "neighbor": pad(self.neighbor), "mask": pad(self.mask, False),
            "cells": cells, "no_cell": no_cell, "image": image, "spatial": self.spatial[a:b], "context": self.context[a:b], "code": self.code[a:b],
        }


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel().astype(np.float32)))


def _outputs(batch: pa.RecordBatch, network: Network) -> Iterator[tuple[Reader, int, int, dict[str, np.ndarray]]]:
    reader = Reader(batch, network)
    N.Var.recording = False
    try:
        weights = {k: N.Var(v) for k, v in network.weights.items()}
        for a, b in reader.pieces():
            yield reader, a, b, {k: v.data for k, v in N.forward(weights, network.shape, reader.arrays(a, b)).items()}
    finally:
        N.Var.recording = True


def embed(rows: DataFrame, network: Network) -> DataFrame:
    """``(region_id, vec, image_vec)`` of ``inputs``, at length one; without an image in the network's sight ``image_vec`` is zero.

    ValueError in the task for a gene that isn't in the network's vocabulary; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reader, a, b, out in _outputs(batch, network):
                yield pa.RecordBatch.from_arrays([reader.region[a:b], _lists(out["region"]), _lists(out["image"])], names=["region_id", "vec", "image_vec"])

    return rows.select(*COLUMNS).mapInArrow(run, "region_id string, vec array<float>, image_vec array<float>")


def predict(rows: DataFrame, network: Network) -> DataFrame:
    """``(region_id, gene, pred, target, mask, neighbor_pred, neighbor_target)``: a row for each token of ``inputs``."""
    names = ("region_id", "gene", "pred", "target", "mask", "neighbor_pred", "neighbor_target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reader, a, b, out in _outputs(batch, network):
                first = reader.first[a : b + 1]
                n = np.diff(first)
                here = slice(first[0], first[-1])
                own = np.arange(out["genes"].shape[1]) < n[:, None]
                columns = [reader.region[a:b].take(pa.array(np.repeat(np.arange(b - a), n))), reader.gene[here], out["genes"][own], reader.value[here], reader.mask[here], out["neighbors"][own], reader.neighbor[here]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list(names))

    return rows.select(*COLUMNS).mapInArrow(run, "region_id string, gene string, pred double, target double, mask boolean, neighbor_pred double, neighbor_target double")
