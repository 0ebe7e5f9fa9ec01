"""Image tensors against pixel loops over images made here."""

import math
import struct
import zlib

import numpy as np
import pytest

from tessera.sources import images

RNG = np.random.default_rng(4)


def png(pixels):
    """Bytes of a PNG of (height, width) or (height, width, 3 or 4) bytes."""
    height, width = pixels.shape[:2]
    colour = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def slow_line(line, size):
    """One line of bytes at another length, sample by sample."""
    scale = len(line) / size
    wide = max(1.0, scale)
    out = []
    for k in range(size):
        centre = (k + 0.5) * scale
        low, high = max(0, int(centre - wide + 0.5)), min(len(line), int(centre + wide + 0.5))
        w = [max(0.0, 1 - abs((i + 0.5 - centre) / wide)) for i in range(low, high)]
        fixed = [int(0.5 + x / sum(w) * (1 << 22)) for x in w]
        out.append(min(255, max(0, (sum(f * int(line[i]) for f, i in zip(fixed, range(low, high), strict=True)) + (1 << 21)) >> 22)))
    return out


def slow_resample(pixels, size):
    height, width, n = pixels.shape
    rows = [[slow_line(pixels[y, :, c], size) for c in range(n)] for y in range(height)] if width != size else [[list(pixels[y, :, c]) for c in range(n)] for y in range(height)]
    columns = [[slow_line([rows[y][c][x] for y in range(height)], size) if height != size else [rows[y][c][x] for y in range(height)] for c in range(n)] for x in range(size)]
    return np.array([[[columns[x][c][y] for c in range(n)] for x in range(size)] for y in range(size)], np.uint8)


SHAPES = {"a/wide": (5, 23, 3), "a/tall": (31, 4, 3), "same": (8, 8, 3), "small": (3, 2, 3), "grey": (9, 12), "clear": (10, 7, 4), "one": (1, 1, 3)}


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    root = tmp_path_factory.mktemp("patches")
    out = {}
    for name, shape in SHAPES.items():
        out[name] = RNG.integers(0, 256, shape).astype(np.uint8)
        (root / f"{name}.png").parent.mkdir(exist_ok=True)
        (root / f"{name}.png").write_bytes(png(out[name]))
    return root, out


@pytest.mark.parametrize(("n_in", "n_out"), [(23, 8), (8, 23), (8, 8), (1, 5), (5, 1), (100, 7), (7, 6)])
def test_resampling_equals_a_loop(n_in, n_out):
    line = RNG.integers(0, 256, n_in)
    got = images.resample(np.tile(line.astype(np.uint8)[None, :, None], (n_out, 1, 1)), n_out)
    assert got[0, :, 0].tolist() == (slow_line(line, n_out) if n_in != n_out else line.tolist())
    assert (images._weights(n_in, n_out).sum(1) - (1 << 22)).astype(int).max() <= n_in


@pytest.mark.parametrize("channels", [1, 3, 5])
def test_tensors_of_regions(spark, made, channels):
    root, pixels = made
    rows = [(name, f"{root}/{name}.png") for name in SHAPES] + [("again", f"file://{root}/same.png"), ("gone", f"{root}/none.png"), ("without", None), (None, f"{root}/one.png")]
    table = spark.createDataFrame(rows, "region_id string, image_path string").repartition(3)
    got = {r.region_id: np.array(r.image, np.float32) for r in images.image_tensors(table, images.read_images(spark, str(root), 8), 8, channels).collect()}
    assert set(got) == {r[0] for r in rows}
    for name, path in rows:
        own = next((k for k in SHAPES if path and path.endswith(f"/{k}.png")), None)
        want = np.zeros((channels, 8, 8), np.float32)
        if own:
            p = pixels[own]
            rgb = slow_resample(np.stack([p] * 3, 2) if p.ndim == 2 else p[:, :, :3], 8).astype(np.float32) / np.float32(255)
            if channels == 1:
                want[0] = rgb.mean(2)
            else:
                want[:3] = np.moveaxis(rgb, 2, 0)
        assert np.allclose(got[name].reshape(channels, 8, 8), want, atol=1e-7), name
        assert channels == 1 or np.array_equal(got[name].reshape(channels, 8, 8), want)


def test_empty_tables_and_bad_files(spark, made, tmp_path):
    root, _ = made
    read = images.read_images(spark, str(root), 4)
    assert images.image_tensors(spark.createDataFrame([], "region_id string, image_path string"), read, 4).count() == 0
    assert sorted(math.prod((4, 4, 3)) == len(r.pixels) for r in read.collect()) == [True] * len(SHAPES)
    with pytest.raises(ValueError):
        images.image_tensors(read, read, 4, 0)
    (tmp_path / "broken.png").write_bytes(b"no picture")
    with pytest.raises(Exception, match=r"broken\.png"):
        images.read_images(spark, str(tmp_path), 4).collect()
