"""Quality classifier by Bradley-Terry ranking.

A labelled good document is preferred to a labelled bad one.  The score of a document is linear
in features of its text; the weights minimise the logistic loss of score differences over all
pairs of labelled documents.  The chance that a document loses against the other class depends
on its score alone, so a pass over the labelled rows adds up counts and features by score, and
sums over all pairs are sums over pairs of scores.  The threshold is the quantile of all
training scores that leaves the training share of good documents above it; scores are mapped
to (0, 1) so that the threshold falls on ``CUT``.

Features come from the text alone, in numpy over whole batches; Spark deals out the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ..tables import drop_tables
from .ordering import drop_placed, placed
from .shared import to_table

CUT = 0.7
#: Newton steps at most, and the change of a weight below which they end.
STEPS, SETTLED = 40, 1e-9
#: Scores that sums are kept for; a row counts for the two nearest, by how near they are.
GRID = np.linspace(-32, 32, 1025)
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]^~=_\\@"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
NAMES = (
    "log_words", "word_length", "symbols", "upper", "digits", "stops", "exclaims", "wide", "distinct", "most", "pairs",
    "again", "triples", "newlines", "short", "long", "lines_again", "log_line",
)


def _share(flag: np.ndarray, byte: np.ndarray, per: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flag)])
    return (run[byte[1:]] - run[byte[:-1]]) / np.maximum(per, 1)


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: different hashes, and how often the most frequent one occurs."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(h))))
    return np.bincount(doc[at], minlength=n), most


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text; all zero for a text without words."""
    w = W.split(texts)
    n = len(w.first) - 1
    raw, byte, count = w.raw, w.byte, w.count
    size = np.diff(byte)
    doc = w.text()
    length = w.end - w.start
    words = np.maximum(count, 1)
    letters = np.bincount(doc, length, n)
    distinct, most = _repeats(w.hash, doc, n)
    same = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    s2, f2 = W.shingles(w, 2)
    s3, f3 = W.shingles(w, 3)
    d2, _ = _repeats(s2, np.repeat(np.arange(n), np.diff(f2)), n)
    d3, _ = _repeats(s3, np.repeat(np.arange(n), np.diff(f3)), n)
    # Lines by their last word's hash run: a line is known by the words that it ends with.
    lines = _share(raw == 10, byte, np.ones(n)) + 1
    line_no = np.cumsum(raw == 10)[w.start] if len(w.start) else np.zeros(0, np.int64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(w.hash, 5))])
    cut = np.flatnonzero(np.concatenate([[True], (line_no[1:] != line_no[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    line_hash = run[np.append(cut[1:], len(doc))[: len(cut)]] - run[cut]
    line_doc = doc[cut]
    different, _ = _repeats(line_hash, line_doc, n)
    full = np.maximum(np.bincount(line_doc, minlength=n), 1)
    out = np.stack([
        np.log1p(count), letters / words / 10, _share(_SYMBOL[raw], byte, letters), _share(_UPPER[raw], byte, letters), _share(_DIGIT[raw], byte, letters),
        _share(_STOP[raw], byte, words), _share(raw == 33, byte, words), _share(raw >= 0x80, byte, letters), distinct / words, most / words,
        1 - d2 / np.maximum(np.diff(f2), 1), np.bincount(doc[1:][same], minlength=n) / words if len(doc) else np.zeros(n), 1 - d3 / np.maximum(np.diff(f3), 1),
        _share(raw == 10, byte, size), np.bincount(doc, length <= 2, n) / words, np.bincount(doc, length >= 14, n) / words,
        1 - different / full, np.log1p(count / lines),
    ], axis=1)
    out[count == 0] = 0
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)``: features of each row's text (null counts as empty)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, 1):
                x = text_features(part.column(1))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["doc_id", "x"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z, np.abs(z)], axis=1)


@dataclass
class Ranker:
    """Centre and scale of the features, weights, and the mapping to (0, 1)."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = _expand(x, self.mean, self.scale) @ self.weight
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + math.log(CUT / (1 - CUT)), -500, 500)))


def _moments(x: np.ndarray, good: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """A row each for bad and good: number of rows, sums of the features and of their squares, from ``mean``."""
    parts = [x[good == k] - mean for k in (False, True)]
    return np.array([np.concatenate([[len(p)], p.sum(0), (p * p).sum(0)]) for p in parts])


def _by_score(x: np.ndarray, good: np.ndarray, model: Ranker, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the features at each score, bad ones first, and the features' products weighted by ``curve`` of class and score."""
    z = _expand(x, model.mean, model.scale)
    at = np.clip((z @ model.weight - GRID[0]) / (GRID[1] - GRID[0]), 0, len(GRID) - 1)
    low = np.minimum(at.astype(np.int64), len(GRID) - 2)
    part = at - low
    first = good * len(GRID) + low
    columns = [np.bincount(first, (1 - part) * v, 2 * len(GRID)) + np.bincount(first + 1, part * v, 2 * len(GRID)) for v in (np.ones(len(z)), *z.T)]
    weight = (1 - part) * curve[first] + part * curve[first + 1]
    return np.array(columns).T, z.T @ (weight[:, None] * z)


def _learn(moments: Callable[[np.ndarray], np.ndarray], by_score: Callable[[Ranker, np.ndarray], tuple[np.ndarray, np.ndarray]], decay: float = 1e-3) -> Ranker:
    """Weights by Newton steps on the mean logistic loss over all pairs, from passes over all labelled rows.

    With only one class there is no pair: all scores are then equal, on the side of that class.  The
    Hessian takes the last pass's curve, which changes the way to the minimum and not the minimum.
    """
    k = len(NAMES)
    m = moments(np.zeros(k))
    n_bad, n_good = m[:, 0]
    if not n_bad or not n_good:
        return Ranker(np.zeros(k), np.ones(k), np.zeros(3 * k), 0.0 if n_good or not n_bad else 1.0)
    mean = m[:, 1 : k + 1].sum(0) / m[:, 0].sum()
    scale = np.sqrt(moments(mean)[:, k + 1 :].sum(0) / m[:, 0].sum())
    model = Ranker(mean, np.maximum(scale, 1e-6), np.zeros(3 * k), 0.0)
    behind = GRID[None, :] - GRID[:, None]  # of a good score, row, a bad one is ahead by so much
    lose, loss = 1 / (1 + np.exp(-behind)), np.logaddexp(0, behind)
    curve = np.repeat([0.25 / n_bad, 0.25 / n_good], len(GRID))
    best, start = math.inf, model.weight
    for _ in range(STEPS):
        sums, products = by_score(model, curve)
        (q_n, q), (p_n, p) = ((v[:, 0], v[:, 1:]) for v in (sums[: len(GRID)], sums[len(GRID) :]))
        value = p_n @ loss @ q_n / (n_good * n_bad) + decay / 2 * (model.weight**2).sum()
        if value > best * 1.001:  # too far
            model.weight = (model.weight + start) / 2
            continue
        best, start = value, model.weight
        grad = ((p_n @ lose) @ q - (lose @ q_n) @ p) / (n_good * n_bad) + decay * model.weight
        bend = lose * (1 - lose)
        cross = p.T @ bend @ q / (n_good * n_bad)
        curve = np.concatenate([p_n @ bend, bend @ q_n]) / (n_good * n_bad)
        step = np.linalg.solve(products - cross - cross.T + decay * np.eye(3 * k), grad)
        model.weight = start - step
        if np.abs(step).max() < SETTLED:
            break
    return model


def fit(good: np.ndarray, bad: np.ndarray) -> Ranker:
    """The ranker of labelled rows that are all at hand."""
    x, of = np.concatenate([good, bad]), np.repeat([True, False], [len(good), len(bad)])
    return _learn(lambda mean: _moments(x, of, mean), lambda model, curve: _by_score(x, of, model, curve))


def _cut_rank(n: int, share: float) -> int:
    """The rank from 0 of the training score below the threshold; the threshold is halfway to the next."""
    return max(0, min(math.ceil((1 - share) * n - 1e-6) - 1, n - 2))


def _threshold(raw_good: np.ndarray, raw_bad: np.ndarray, share: float) -> float:
    """Quantile of the training scores that leaves ``share`` of them above it."""
    raw = np.sort(np.concatenate([raw_good, raw_bad]))
    i = _cut_rank(len(raw), share)
    return float(raw[i] + raw[i + 1]) / 2


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0).flatten()).reshape(len(batch), len(NAMES))


def _total(taught: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Row by row, the sum over all of ``taught(x, good)`` of the matrices that ``part`` gives of some of it; rows of zeros are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                m = part(_rows(batch), np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(bool))
                total = m if total is None else total + m
        if total is not None:
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["at", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(0)
        return pa.table({"at": table.column("at")[:1], "v": pa.array([v], pa.list_(pa.float64()))})

    kind = "at long, v array<double>"
    return {r["at"]: np.array(r["v"]) for r in taught.select("x", "good").mapInArrow(run, kind).groupBy("at").applyInArrow(add, kind).collect()}


def _fill(rows: dict[int, np.ndarray], n: int, width: int) -> np.ndarray:
    out = np.zeros((n, width))
    for i, v in rows.items():
        out[i] = v
    return out


def _learn_table(taught: DataFrame) -> Ranker:
    """The ranker of ``taught(x, good)``; the driver gets sums by score, however many rows there are."""
    k = len(NAMES)

    def by_score(model: Ranker, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(x: np.ndarray, good: np.ndarray) -> np.ndarray:
            sums, products = _by_score(x, good, model, curve)
            return np.concatenate([sums, np.pad(products, ((0, 0), (1, 0)))])

        both = _fill(_total(taught, part), 2 * len(GRID) + 3 * k, 3 * k + 1)
        return both[: 2 * len(GRID)], both[2 * len(GRID) :, 1:]

    return _learn(lambda mean: _fill(_total(taught, lambda x, good: _moments(x, good, mean)), 2, 2 * k + 1), by_score)


def _cut(taught: DataFrame, model: Ranker, share: float, n: int) -> float:
    """``_threshold`` of all rows of ``taught``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_expand(_rows(batch), model.mean, model.scale) @ model.weight)], names=["raw"])

    ranked = placed(taught.select("x").mapInArrow(run, "raw double"), [], ["raw"], "pairwise-raw")
    i = _cut_rank(n, share)
    low, high = (r["raw"] for r in ranked.where(F.col("place").isin(i, i + 1)).orderBy("place").collect())
    drop_placed(ranked)
    return (low + high) / 2


def classify(
    docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "quality",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learned from all labelled rows whose crc32 of the id modulo ``fold`` is not ``held``.  Null labels and ids teach nothing;
    several labels of a document count once each; a null or empty text has a score like any
    other; a null id is held out by the crc32 of the empty text; equal texts get equal scores;
    other columns are not looked at.  Without labels all scores are equal; an empty table of
    documents gives an empty one.
    """
    x = to_table(features(docs, id_col, text_col), "pairwise-features")
    crc = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % fold == held
    taught = labels.select(F.col(label_id_col).alias("doc_id"), (F.col(label_col) > 0).alias("good")).where("doc_id is not null and good is not null")
    taught = to_table(x.join(taught.distinct(), "doc_id").where(~crc("doc_id")), "pairwise-taught")
    n = {r["good"]: r["n"] for r in taught.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = _learn_table(taught)
    if len(n) == 2:
        model.threshold = _cut(taught, model, n[True] / (n[True] + n[False]), n[True] + n[False])
    drop_tables(taught)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(2).flatten()).reshape(len(batch), len(NAMES))
            s = model.scores(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    id_type = x.schema["doc_id"].dataType.simpleString()
    return x.select("doc_id", crc("doc_id").alias("held_out"), "x").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
