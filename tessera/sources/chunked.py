"""Chunked arrays: a folder with a JSON description and a file for each block of an array.

Spark lists and reads the chunk files as it does any others, so they can lie in whatever store it
reads; each is decoded where it is read.  A range of rows reads only the files that hold some of it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import exists, read_small

# The description's file name, and the types of elements by kind and size.
META = ".zarray"
TYPES = {"f4": "float", "f8": "double", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "decimal(20,0)", "b1": "boolean"}


@dataclass(frozen=True)
class Array:
    """What the description says."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: float | int | bool | str | None
    packed: bool
    order: str
    separator: str

    @property
    def grid(self) -> tuple[int, ...]:
        """Chunks along each axis."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    @property
    def kind(self) -> str:
        """Spark's type of an element."""
        d = np.dtype(self.dtype)
        return "string" if d.kind in "US" else TYPES[f"{d.kind}{d.itemsize}"]


def describe(spark: SparkSession, path: str) -> Array:
    """The description of an array; ValueError for what can't be read here: other versions, filters, compressors, types or ranks."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/{META}"):
        raise FileNotFoundError(f"no array in {path}")
    m = json.loads(read_small(spark, f"{path}/{META}"))
    packer = (m.get("compressor") or {}).get("id")
    d = np.dtype(m["dtype"]) if isinstance(m["dtype"], str) else None
    if m.get("zarr_format") != 2 or m.get("filters") or packer not in (None, "zlib", "gzip"):
        raise ValueError(f"{path}: version {m.get('zarr_format')}, filters {m.get('filters')}, compressor {packer!r}")
    if d is None or (d.kind not in "US" and f"{d.kind}{d.itemsize}" not in TYPES) or len(m["shape"]) not in (1, 2) or m["order"] not in "CF":
        raise ValueError(f"{path}: elements {m['dtype']!r}, shape {m['shape']}, order {m['order']!r}")
    fill = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}.get(m.get("fill_value"), m.get("fill_value")) if isinstance(m.get("fill_value"), str) and d.kind == "f" else m.get("fill_value")
    return Array(path, tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], fill, packer is not None, m["order"], m.get("dimension_separator", "."))


def _unpack(data: bytes, a: Array) -> np.ndarray:
    raw = zlib.decompress(data, 47) if a.packed else data  # either head
    return np.frombuffer(raw, np.dtype(a.dtype)).reshape(a.chunks, order=a.order)


def _plain(x: np.ndarray) -> np.ndarray:
    """Values as Arrow takes them: native bytes, the type that ``TYPES`` says, text without its filling."""
    if x.dtype.kind == "S":
        x = np.char.decode(x, "utf-8")
    if x.dtype.kind == "U":
        return x.astype(object)
    wider = {"u1": "i2", "u2": "i4", "u4": "i8"}.get(f"{x.dtype.kind}{x.dtype.itemsize}")
    return x.astype(wider) if wider else x.astype(x.dtype.newbyteorder("="))


def _files(spark: SparkSession, a: Array, first: int, last: int) -> DataFrame:
    """``(at, content)`` of the chunk files with rows from chunk ``first`` to before ``last``, ``at`` being the chunk's place."""
    tail = f"{a.separator}*" if len(a.shape) > 1 else ""
    whole = (first, last) == (0, a.grid[0])
    names = ["*" if whole else "{" + ",".join(str(i) for i in range(first, last)) + "}"]
    files = spark.read.format("binaryFile").load([f"{a.path}/{n}{tail}" if not whole or a.separator == "/" else a.path for n in names])
    place = F.substring(F.col("path"), F.lit(1), F.length("path"))
    at = F.regexp_extract(place, r"((?:[0-9]+" + re.escape(a.separator) + r")?[0-9]+)$" if len(a.shape) > 1 else r"/([0-9]+)$", 1)
    ends = F.col("path").rlike(r"/[0-9]+" + (re.escape(a.separator) + "[0-9]+" if len(a.shape) > 1 else "") + "$")
    return files.where(ends).select(F.transform(F.split(at, re.escape(a.separator)), lambda s: s.cast("long")).alias("at"), "content")


def _present(spark: SparkSession, a: Array) -> bool:
    """Whether there is any chunk file: an array of fill values has none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(a.path)
    return any(not f.getPath().getName().startswith(".") for f in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path))


def read_array(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """``(row, value)`` of an array of one dimension, ``(row, values)`` of one of two; ``rows`` is a range, its end left out.

    Chunks that are not there hold the fill value, null without one.  A row that several chunks hold parts of is put
    together by a shuffle; without such rows there is none.
    """
    a = describe(spark, path)
    n, width = a.shape[0], a.shape[1] if len(a.shape) > 1 else 1
    low, high = (0, n) if rows is None else (max(0, rows[0]), min(n, rows[1]))
    flat = len(a.shape) == 1
    out_type = f"row long, {'value ' + a.kind if flat else f'first int, part array<{a.kind}>'}"
    step = a.chunks[0]
    if low >= high:
        return spark.createDataFrame([], f"row long, {'value ' + a.kind if flat else f'values array<{a.kind}>'}")
    first, last = low // step, -(-high // step)
    parts = a.grid[1] if not flat else 1
    grid = spark.range(first, last).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("j"))
    if _present(spark, a):
        files = _files(spark, a, first, last).select(F.get("at", F.lit(0)).alias("i"), F.coalesce(F.get("at", F.lit(1)), F.lit(0).cast("long")).alias("j"), "content")
        missing = grid.join(files.select("i", "j"), ["i", "j"], "left_anti").withColumn("content", F.lit(None).cast("binary"))
        chunks = files.unionByName(missing)
    else:
        chunks = grid.withColumn("content", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data in zip(*(batch.column(c) for c in ("i", "j", "content")), strict=True):
                i, j = i.as_py(), j.as_py()
                from_, to = max(low, i * step), min(high, (i + 1) * step)
                if from_ >= to:
                    continue
                here = slice(from_ - i * step, to - i * step)
                columns = slice(0, 1 if flat else min(a.chunks[1], width - j * a.chunks[1]))
                shape = (to - from_, columns.stop)
                if data.as_py() is not None:
                    block = _plain(_unpack(data.as_py(), a).reshape(step, -1, order=a.order)[here, columns])
                elif a.fill is None:
                    block = np.full(shape, None, object)
                else:
                    block = _plain(np.full(shape, a.fill, np.dtype(a.dtype)))
                kind = {"float": pa.float32(), "double": pa.float64(), "byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}.get(a.kind, pa.decimal128(20, 0))
                values = pa.array(block.ravel().tolist() if a.kind.startswith("decimal") else block.ravel(), kind)
                row = pa.array(np.arange(from_, to), pa.int64())
                if flat:
                    yield pa.RecordBatch.from_arrays([row, values], names=["row", "value"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1) * shape[1], pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([row, pa.array(np.full(shape[0], j * a.chunks[1]), pa.int32()), lists], names=["row", "first", "part"])

    read = chunks.mapInArrow(run, out_type)
    if flat:
        return read
    if parts == 1:
        return read.select("row", F.col("part").alias("values"))
    whole = read.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "part"))).alias("p"))
    return whole.select("row", F.flatten(F.col("p.part")).alias("values"))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """``(i, j, value)`` of a matrix by compressed rows: arrays ``data``, ``indices`` and ``indptr`` in one folder.

    Entries are dealt by stretches of their position; each stretch meets the rows that reach into it, so no array is
    in one place.  ValueError if their lengths don't agree.
    """
    path = path.rstrip("/")
    data, indices, pointer = (describe(spark, f"{path}/{n}") for n in ("data", "indices", "indptr"))
    total = data.shape[0]
    ends = read_array(spark, pointer.path)
    last = read_array(spark, pointer.path, (pointer.shape[0] - 1, pointer.shape[0])).first()["value"]
    if total != indices.shape[0] or last != total:
        raise ValueError(f"{path}: {total} values, {indices.shape[0]} columns, rows end at {last}")
    step = max(data.chunks[0], 1)
    starts = ends.select(F.col("row").alias("i"), F.col("value").cast("long").alias("start"))
    stops = ends.select((F.col("row") - 1).alias("i"), F.col("value").cast("long").alias("stop"))
    rows = starts.join(stops, "i").where("start < stop")
    rows = rows.select("i", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("stop") - 1) / step))).alias("stretch"))
    entries = read_array(spark, data.path).withColumnRenamed("value", "v").join(read_array(spark, indices.path).select("row", F.col("value").cast("long").alias("j")), "row")
    entries = entries.select(F.floor(F.col("row") / step).alias("stretch"), "row", "j", F.col("v").cast("double").alias("v"))

    def assign(r: pa.Table, e: pa.Table) -> pa.Table:
        """The row of each entry of a stretch."""
        r = r.sort_by("start")
        at = np.searchsorted(np.asarray(r.column("start")), np.asarray(e.column("row")), side="right") - 1
        return pa.table({"i": r.column("i").take(pa.array(at)), "j": e.column("j"), "value": e.column("v")})

    return rows.groupBy("stretch").cogroup(entries.groupBy("stretch")).applyInArrow(assign, "i long, j long, value double")
