"""Words of whole Arrow batches as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text is looked at by itself.
CHUNK = 500_000
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20
#: Powers of a base up to this number are kept in a Python worker, which serves many tasks.
KEPT = 1 << 19
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser of the splitmix family: spreads the bits of 64-bit numbers."""
    x = x + np.uint64(salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        step, at = base, 1
        while at < size:
            out[at : 2 * at] = out[:at] * np.uint64(step)
            step = step * step & (1 << 64) - 1
            at *= 2
        have = out
        if size <= KEPT:
            _powers[base] = out
    return have[:n]


@dataclass
class Words:
    """Words of some texts in order: a hash each, and where each text's words begin."""

    hash: np.ndarray
    #: word bounds in ``raw``
    start: np.ndarray
    end: np.ndarray
    #: n + 1 word numbers
    first: np.ndarray
    raw: np.ndarray
    #: n + 1 byte places in ``raw``
    byte: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self) -> np.ndarray:
        """The number of its text, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words between ASCII white space; with ``lower`` A-Z count as a-z.  Null texts have none."""
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    byte = offsets - offsets[0]
    if texts.null_count:
        keep = ~np.asarray(texts.is_null())
        sizes = np.diff(byte) * keep
        if sizes.sum() != len(raw):  # a null's bytes, if it has any, don't count
            raw = np.concatenate([raw[a:b] for a, b, k in zip(byte[:-1], byte[1:], keep, strict=True) if k] or [raw[:0]])
        byte = np.concatenate([[0], np.cumsum(sizes)])
    if lower:
        raw = _LOW[raw]
    n = len(raw)
    full = ~_BLANK[raw]
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    ends = full.copy()
    ends[:-1] &= ~full[1:]
    inner = byte[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] = full[inner]
    ends[inner - 1] = full[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(ends) + 1
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=run[1:])
    h = mix((run[end] - run[start]) * powers(_P_INV, n + 1)[start] + (end - start).astype(np.uint64))
    return Words(h, start, end, np.searchsorted(start, byte), raw, byte)


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of text."""
    col = batch.column(column)
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)
    offsets = offsets[col.offset : col.offset + len(col) + 1].astype(np.int64)
    at = 0
    while at < len(col):
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(col))
        yield batch.slice(at, to - at)
        at = to


def shingles(w: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, and n + 1 places where a text's begin.

    A text of fewer words has one shingle of them all; one without words has none.
    """
    count = w.count
    m = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(m)])
    at = np.repeat(w.first[:-1], m) + np.arange(first[-1]) - np.repeat(first[:-1], m)
    left = np.repeat(np.minimum(count, size), m)
    padded = np.concatenate([w.hash, np.zeros(size, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out * np.uint64(_P) + np.where(j < left, padded[at + j], np.uint64(j))
    return mix(out, salt), first
