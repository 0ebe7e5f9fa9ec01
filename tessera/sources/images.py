"""Images of patches as tensors: decoded by Spark's own image source, resampled in Arrow batches.

An image is brought to its target size where it is decoded, so that what is shuffled to its regions
is a few kilobytes, however large the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed-point bits of the weights, so that results are the same whatever adds them up.
BITS = 22


@cache
def _weights(n_in: int, n_out: int) -> np.ndarray:
    """Weights of ``n_in`` samples in each of ``n_out``: a triangle as wide as two samples of the coarser grid, in fixed point."""
    scale = n_in / n_out
    wide = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale
    low = np.maximum(0, np.trunc(centre - wide + 0.5)).astype(int)
    high = np.minimum(n_in, np.trunc(centre + wide + 0.5)).astype(int)
    at = np.arange(n_in)
    w = np.maximum(0.0, 1.0 - np.abs((at + 0.5 - centre[:, None]) / wide))
    w[(at < low[:, None]) | (at >= high[:, None])] = 0.0
    return np.floor(0.5 + w / w.sum(1, keepdims=True) * (1 << BITS))


def resample(pixels: np.ndarray, size: int) -> np.ndarray:
    """Bytes (height, width, channels) at ``size`` by ``size``: along the width, then along the height, rounded each time."""
    out = pixels
    for axis, n in ((1, pixels.shape[1]), (0, pixels.shape[0])):
        if n != size:
            sums = np.moveaxis(np.tensordot(_weights(n, size), out.astype(np.float64), (1, axis)), 0, axis)  # exact: below 2**53
            out = np.clip(np.floor((sums + (1 << BITS - 1)) / (1 << BITS)), 0, 255).astype(np.uint8)
    return out


def tensor(pixels: bytes | None, size: int, channels: int) -> np.ndarray:
    """Floats from 0 to 1, channel by channel: zeros without an image, the mean as a single channel, zeros beyond three."""
    if pixels is None:
        return np.zeros((channels, size, size), np.float32)
    rgb = np.moveaxis(np.frombuffer(pixels, np.uint8).reshape(size, size, 3).astype(np.float32) / np.float32(255), 2, 0)
    if channels == 1:
        return rgb.mean(0, keepdims=True, dtype=np.float32)
    return np.concatenate([rgb, np.zeros((max(0, channels - 3), size, size), np.float32)])[:channels]


def plain_path(path: Column) -> Column:
    """A path as it can be compared: a local one without its scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_images(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """``(image_path, pixels)`` of the image files below ``folder``: red, green and blue bytes at ``size`` by ``size``.

    Grey images have three equal channels, transparency is left out.  A file that can't be decoded is an
    error that names it.
    """
    raw = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    columns = ("origin", "height", "width", "nChannels", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, height, width, n, data in zip(*(batch.column(c) for c in columns), strict=True):
                if n.as_py() not in (1, 3, 4):
                    raise ValueError(f"not an image: {path}")
                # stored as blue, green, red and transparency, row by row
                pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(height.as_py(), width.as_py(), n.as_py())
                rgb = np.repeat(pixels, 3, axis=2) if n.as_py() == 1 else pixels[:, :, 2::-1]
                out.append(resample(rgb, size).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("origin"), pa.array(out, pa.binary())], names=["image_path", "pixels"])

    fields = raw.select(*[F.col(f"image.{c}").alias(c) for c in columns])
    return fields.mapInArrow(run, "image_path string, pixels binary").withColumn("image_path", plain_path(F.col("image_path")))


def with_pixels(rows: DataFrame, images: DataFrame) -> DataFrame:
    """``rows(image_path, ..)`` with the ``pixels`` of their image, null where there is none; several rows may share one."""
    named = images.select(F.col("image_path").alias("p_"), "pixels")
    return rows.join(named, plain_path(F.col("image_path")) == F.col("p_"), "left").drop("p_")


def image_tensors(rows: DataFrame, images: DataFrame, size: int, channels: int = 3) -> DataFrame:
    """``(region_id, image)`` of ``rows(region_id, image_path)``: channel by channel, row by row, as floats."""
    if channels < 1:
        raise ValueError(f"channels: {channels}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                flat = [tensor(p.as_py(), size, channels).ravel() for p in part.column(1)]
                values = pa.array(np.concatenate(flat), pa.float32())
                image = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * channels * size * size, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), image], names=["region_id", "image"])

    return with_pixels(rows.select("region_id", "image_path"), images).select("region_id", "pixels").mapInArrow(run, "region_id string, image array<float>")
