"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut by a pattern and each piece is merged by itself: always the pair of neighbours of
least rank, the leftmost of equal ones.  A segment tree over the piece's byte positions holds
the least pair rank and where it stands; a merge changes the ranks at two live neighbours and
takes one position away, which are point updates of logarithmic cost.  The trees of many
pieces are stacked and updated together in numpy; a piece longer than ``STACKED`` bytes
gets a tree of its own.

Spark deals out the texts; each task handles whole texts and no row leaves its partition.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

#: Longest piece, in bytes, whose tree is stacked with others.
STACKED = 64
#: Pieces whose ids a Python worker remembers, and their characters; when there are more of
#: either, all are forgotten, and encoded again when they come up.
REMEMBERED = 200_000
REMEMBERED_CHARS = 4_000_000
#: Bytes of text that are encoded together.
AT_ONCE = 500_000
#: Leaves of the trees in one stack.
STACK = 1 << 17
NONE = np.int64(1) << 40


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file as bytes: from the driver's disk, else through Spark.  It has one line a token."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return "\n".join(r["value"] for r in spark.read.text(path).collect()).encode()


class Vocabulary:
    """Token bytes by rank, and the rank of every pair of tokens that make another token."""

    def __init__(self, data: bytes) -> None:
        self.rank: dict[bytes, int] = {}
        for line in data.splitlines():
            if line.strip():
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        self.base = max(self.rank.values()) + 1
        self.token = [b""] * self.base
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.size = np.fromiter(map(len, self.token), np.int64, self.base)
        #: bytes of all tokens one after another, and where each token's begin
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pair: dict[int, int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    self.pair[a * self.base + b] = rank
        keys = np.array(list(self.pair), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.pair.values()), dtype=np.int64)[order]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where a pair is no token; a negative id is no token either."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_stack(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of at most ``STACKED`` bytes: their segment trees side by side."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        width = 1 << max(1, int(sizes.max() - 1).bit_length())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        col = np.arange(width)
        live = col < sizes[:, None]
        ids = np.where(live, self.byte[raw], -1)
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)  # column width: nothing
        nxt = np.where(col + 1 < sizes[:, None], col + 1, width)
        nxt = np.concatenate([nxt, np.full((n, 1), width)], axis=1)
        prv = np.concatenate([np.tile(np.arange(-1, width - 1), (n, 1)), np.full((n, 1), width - 1)], axis=1)
        # A node has rank * width + position, so that the least node is the leftmost least rank.
        tree = np.full((n, 2 * width), NONE * width)
        tree[:, width:] = self.pairs(ids[:, :width].ravel(), np.take_along_axis(ids, nxt[:, :width], 1).ravel()).reshape(n, width) * width + col
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE * width)

        def put(r: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = at + width
            tree[r, node] = rank * width + at
            while node[0] > 1:
                node = node // 2
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while len(rows):
            top = tree[rows, 1]
            at = top % width
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            ids[rows, at] = top // width
            ids[rows, gone] = -1
            nxt[rows, at] = after
            prv[rows, np.minimum(after, width)] = at  # column width takes what is past the end
            put(rows, gone, np.full(len(rows), NONE))
            put(rows, at, self.pairs(ids[rows, at], ids[rows, after]))
            before = prv[rows, at]
            has = before >= 0
            put_rows, put_at = rows[has], before[has]
            if len(put_rows):
                put(put_rows, put_at, self.pairs(ids[put_rows, put_at], ids[put_rows, at[has]]))
            rows = rows[tree[rows, 1] < NONE * width]
        kept = ids[:, :width] >= 0
        ends = np.cumsum(kept.sum(1))
        flat = ids[:, :width][kept].tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length by its own segment tree."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        pair, base, none = self.pair.get, self.base, int(NONE)
        ids = [int(x) for x in self.byte[np.frombuffer(piece, np.uint8)]]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none * width] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pair(ids[i] * base + ids[i + 1], none) * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, rank: int) -> None:
            node = at + width
            tree[node] = rank * width + at
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none * width:
            rank, at = divmod(tree[1], width)
            gone = nxt[at]
            after = nxt[gone]
            ids[at], ids[gone] = rank, -1
            nxt[at] = after
            put(gone, none)
            if after < n:
                prv[after] = at
                put(at, pair(rank * base + ids[after], none))
            else:
                put(at, none)
            if prv[at] >= 0:
                put(prv[at], pair(ids[prv[at]] * base + rank, none))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece: the token of the whole piece if there is one, else the merges."""
        out: list[list[int]] = [[]] * len(pieces)
        short: list[tuple[int, bytes]] = []
        for i, piece in enumerate(pieces):
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.rank.get(raw)
            if whole is not None:
                out[i] = [whole]
            elif len(raw) <= STACKED:
                short.append((i, raw))
            else:
                out[i] = self.merge_one(raw)
        short.sort(key=lambda x: len(x[1]))
        for width, same in groupby(short, lambda x: 1 << (len(x[1]) - 1).bit_length()):
            while part := list(islice(same, STACK // width)):
                for (i, _), ids in zip(part, self.merge_stack([raw for _, raw in part]), strict=True):
                    out[i] = ids
        return out


class _Numbers(dict):
    """Numbers of pieces; a piece that has none yet gets the next one."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Codec:
    """Encodes and decodes texts; remembers the ids of pieces, up to a bound."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.vocabulary = Vocabulary(ranks)
        import regex

        self.pieces = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known, self.chars = _Numbers(), 0
        #: ids of all known pieces one after another, and where each piece's begin and end
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids = self.vocabulary.encode_pieces(new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.chars += sum(map(len, new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n + 1 places where a text's begin."""
        cut = [self.pieces(t) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        before = len(self.known)
        piece = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        del cut
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        sizes = np.diff(self.ends)[piece]
        first = np.concatenate([[0], np.cumsum(sizes)])
        out = self.ids[np.repeat(self.ends[piece] - first[:-1], sizes) + np.arange(first[-1])]
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        return out, first[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids, and where those of each text begin."""
        size = self.vocabulary.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        # each byte's place in the tokens' bytes: as far from its token's begin there as here
        return self.vocabulary.flat[np.repeat(self.vocabulary.at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes(), ends[first]


_codecs: dict[tuple[bytes, str], Codec] = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker, which serves many tasks."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _coded(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of ``doc_id, ids, decoded`` for those of ``batch``, in parts of ``AT_ONCE`` bytes."""
    for part in W.chunks(batch, 1, AT_ONCE):
        ids, first = codec.encode(part.column(1).to_pylist())
        data, at = codec.decode(ids, first)
        decoded = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)), decoded], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``ids`` and ``decoded`` (the bytes of these ids).

    Null and empty texts have no ids.  Ids of documents may be null or repeated; other columns
    are not looked at; an empty table gives an empty one.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            yield from _coded(codec, batch)

    return d.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of the ids of each text, and digest of what they decode to."""
    e = encode(docs, ranks, pattern, id_col, text_col)
    return e.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
