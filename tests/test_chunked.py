"""Chunked arrays against numpy, whatever their types, orders and chunks."""

import gzip
import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import chunked

RNG = np.random.default_rng(6)


def write(path, array, chunks, packer=None, order="C", fill=0, leave=(), separator="."):
    path.mkdir(parents=True)
    about = {"zarr_format": 2, "shape": list(array.shape), "chunks": list(chunks), "dtype": array.dtype.str, "fill_value": fill, "order": order, "filters": None, "compressor": packer and {"id": packer, "level": 1}}
    (path / ".zarray").write_text(json.dumps(about | ({"dimension_separator": separator} if separator != "." else {})))
    grid = [range(-(-n // c)) for n, c in zip(array.shape, chunks, strict=True)]
    for at in np.ndindex(*map(len, grid)):
        if at in leave:
            continue
        block = np.zeros(chunks, array.dtype)
        part = array[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes(order)
        file = path / separator.join(map(str, at))
        file.parent.mkdir(exist_ok=True)
        file.write_bytes({None: lambda x: x, "zlib": zlib.compress, "gzip": gzip.compress}[packer](raw))
    return str(path)


ONE = {
    "f4": (RNG.normal(size=23).astype("<f4"), (5,), {}), "big": (RNG.integers(-9, 9, 23).astype(">i4"), (23,), {"packer": "zlib"}), "u8": (np.array([0, 2**64 - 1, 5], "<u8"), (2,), {"packer": "gzip"}),
    "text": (np.array(["a", "", "Ünï"] * 4, "<U3"), (5,), {}), "bytes": (np.array([b"ab", b"c"] * 3, "S2"), (4,), {}), "flags": (RNG.integers(0, 2, 9).astype("|b1"), (4,), {}), "bytes of numbers": (np.arange(250, 256).astype("u1"), (4,), {}),
}


@pytest.mark.parametrize("name", ONE)
def test_one_dimension(spark, tmp_path, name):
    array, chunks, how = ONE[name]
    path = write(tmp_path / "a", array, chunks, **how)
    got = [r.value for r in chunked.read_array(spark, path).orderBy("row").collect()]
    assert [int(v) if name == "u8" else v for v in got] == [x.decode() if isinstance(x, bytes) else x for x in array.tolist()]
    part = chunked.read_array(spark, path, (2, 100)).orderBy("row").collect()
    assert [r.row for r in part] == list(range(2, len(array)))


@pytest.mark.parametrize(("chunks", "how"), [((4, 7), {}), ((4, 3), {"packer": "zlib"}), ((30, 2), {"order": "F"}), ((3, 7), {"order": "F", "packer": "gzip"}), ((5, 4), {"separator": "/"})])
def test_two_dimensions(spark, tmp_path, chunks, how):
    array = RNG.normal(size=(17, 7))
    path = write(tmp_path / "a", array, chunks, **how)
    assert np.array_equal([r["values"] for r in chunked.read_array(spark, path).orderBy("row").collect()], array)
    got = chunked.read_array(spark, path, (6, 11)).orderBy("row").collect()
    assert [r.row for r in got] == list(range(6, 11)) and np.array_equal([r["values"] for r in got], array[6:11])
    assert chunked.read_array(spark, path, (20, 30)).count() == 0


def test_missing_chunks_hold_the_fill_value(spark, tmp_path):
    array = RNG.normal(size=(9, 4))
    path = write(tmp_path / "a", array, (3, 2), fill="NaN", leave={(1, 0)})
    want = array.copy()
    want[3:6, :2] = np.nan
    assert np.array_equal([r["values"] for r in chunked.read_array(spark, path).orderBy("row").collect()], want, equal_nan=True)
    none = write(tmp_path / "b", np.arange(6), (4,), fill=None, leave={(0,), (1,)})
    assert [r.value for r in chunked.read_array(spark, none).collect()] == [None] * 6


def test_only_files_of_the_rows_are_read(spark, tmp_path):
    path = write(tmp_path / "a", np.arange(100), (10,))
    for k in set(range(10)) - {3, 4}:
        os.remove(f"{path}/{k}")
        with open(f"{path}/{k}", "wb") as f:
            f.write(b"broken")
    assert [r.value for r in chunked.read_array(spark, path, (35, 45)).orderBy("row").collect()] == list(range(35, 45))
    with pytest.raises(Exception, match="buffer"):
        chunked.read_array(spark, path, (35, 55)).collect()
    assert "/3" in str(chunked._files(spark, chunked.describe(spark, path), 3, 5).inputFiles()) and len(chunked._files(spark, chunked.describe(spark, path), 3, 5).inputFiles()) == 2


def test_sparse_rows(spark, tmp_path):
    dense = RNG.integers(0, 5, (25, 9)) * (RNG.random((25, 9)) < 0.4)
    dense[[3, 4, 24]] = 0
    row, column = np.nonzero(dense)
    for name, x, chunks in (("data", dense[row, column].astype("<f4"), 7), ("indices", column.astype("<i4"), 10), ("indptr", np.concatenate([[0], np.cumsum((dense > 0).sum(1))]).astype("<i8"), 6)):
        write(tmp_path / "x" / name, x, (chunks,))
    got = {(r.i, r.j): r.value for r in chunked.read_sparse(spark, f"{tmp_path}/x").collect()}
    assert got == {(int(i), int(j)): float(dense[i, j]) for i, j in zip(row, column, strict=True)}
    write(tmp_path / "y" / "data", np.arange(3.0), (3,))
    write(tmp_path / "y" / "indices", np.arange(2), (3,))
    write(tmp_path / "y" / "indptr", np.array([0, 3]), (3,))
    with pytest.raises(ValueError, match="3 values"):
        chunked.read_sparse(spark, f"{tmp_path}/y")


def test_what_cannot_be_read_is_said(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        chunked.describe(spark, f"{tmp_path}/none")
    for k, change in enumerate([{"zarr_format": 3}, {"compressor": {"id": "blosc"}}, {"filters": [{"id": "delta"}]}, {"dtype": "<c8"}, {"shape": [2, 2, 2]}]):
        path = tmp_path / str(k)
        write(path, np.arange(4), (4,))
        (path / ".zarray").write_text(json.dumps(json.loads((path / ".zarray").read_text()) | change))
        with pytest.raises(ValueError):
            chunked.describe(spark, str(path))
    assert chunked.read_array(spark, write(tmp_path / "empty", np.zeros(0), (4,))).select(F.count("row")).first()[0] == 0
