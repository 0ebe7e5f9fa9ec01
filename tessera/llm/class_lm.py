"""Language-model scores by Brown class-based bigrams.

Exchange clustering assigns words to classes so that the likelihood of the class bigrams is
greatest; a text's probability is the product of class transitions and word emissions.

Words with at least 1 / ``SHARE`` of the training tokens, and the ``SEEDS`` most frequent ones
anyway, are exchanged between ``CLASSES`` classes (there are at most ``SHARE`` or ``SEEDS`` such
words, however large the corpus); every other known word then goes to the class where the
likelihood gains most, by all its neighbours' classes.  Words not in the training part belong to
the open class of their form, by last letter and length, for which known words of one occurrence
stand in.  All counts are of the whole training part.  Word counts never meet in one place:
they are made slice by slice of the hash range; the driver gets the words to be exchanged, chosen
over all slices, and no others.  Documents are dealt into batches; the contexts of all other words are gathered
by slice, where each gets its count and its class, and each batch gets back those of its own
words together with its texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ..tables import drop_tables
from .shared import to_table

SHARE = 4096
#: So many words are exchanged at least, however flat the frequencies.
SEEDS = 1024
CLASSES = 48
#: Sweeps of the exchange.
SWEEPS = 3
#: Text bytes of a batch; tokens that a task gathers before it sends them on.
BATCH_BYTES = 8_000_000
GATHER = 4_000_000
#: Smoothing of transitions (observations of the class unigram) and of open emissions.
ALPHA, DELTA = 5.0, 0.5
#: The end of a text is a token of its own, with this hash and a class of its own.
END = np.uint64(1)
FORMS = 32

_GROUP = np.full(256, 7, np.uint8)
for _i, _letters in enumerate((b"aeiou", b"s", b"nr", b"td", b"bcfghjklmpqvwxyz", b".!?", b",;:")):
    _GROUP[list(_letters)] = _i


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and forms of each text's tokens, and n + 1 places where the texts begin."""
    w = W.split(texts, lower=True)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    ends = first[1:] - 1
    h = np.full(first[-1], END)
    form = np.zeros(first[-1], np.uint8)
    inner = np.ones(first[-1], bool)
    inner[ends] = False
    h[inner] = w.hash
    form[inner] = _GROUP[w.raw[w.end - 1]] * 4 + np.searchsorted([3, 6, 10], w.end - w.start)
    return h, form, first


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at) if len(at) else x[:0]


def _count(docs: DataFrame, slices: int) -> DataFrame:
    """``(slice, words)``: distinct words of the training texts with counts, added up as far as a task holds them."""
    shift = np.uint64(64 - slices.bit_length() + 1) if slices > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            h, f = (np.concatenate(x) for x in zip(*have, strict=True))
            order = np.argsort(h)
            h, f = h[order], f[order]
            at = _runs(h)
            n = np.diff(np.append(at, len(h)))
            h, f = h[at], f[at]
            s = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
            bounds = [*_runs(s).tolist(), len(h)]
            packed = [_pack(h[i:j], n[i:j], f[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(s[bounds[:-1]]), pa.array(packed, pa.binary())], names=["slice", "words"])

        for batch in batches:
            for part in W.chunks(batch, 0):
                h, f, _ = _tokens(part.column(0))
                have.append((h[h != END], f[h != END]))
                size += len(have[-1][0])
                if size >= GATHER:
                    yield from send()
                    have.clear()
                    size = 0
        if size:
            yield from send()

    return docs.where("not held_out").select("t").mapInArrow(run, "slice long, words binary")


def _pack(h: np.ndarray, n: np.ndarray, f: np.ndarray) -> bytes:
    return len(h).to_bytes(8, "little") + h.tobytes() + f.astype(np.uint8).tobytes() + zlib.compress(n.astype(np.int64).tobytes(), 1)


def _unpack(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(x[:8], "little")
    return np.frombuffer(x, np.uint64, k, 8), np.frombuffer(zlib.decompress(x[8 + 9 * k :]), np.int64), np.frombuffer(x, np.uint8, k, 8 + 8 * k)


def _tops(table: pa.Table) -> pa.Table:
    """For one slice of the hash range: its most frequent words, and a row with types and tokens of all its words."""
    h, n, f = (np.concatenate(x) for x in zip(*[_unpack(x) for x in table.column("words").to_pylist()], strict=True))
    order = np.argsort(h)
    at = _runs(h[order])
    c = _sums(n[order], at)
    top = np.argsort(-c, kind="stable")[: max(SHARE, SEEDS)]
    none = [None] * len(top)
    return pa.table({
        "word": pa.array([*h[order][at][top].view(np.int64).tolist(), None], pa.int64()), "n": pa.array([*c[top].tolist(), None], pa.int64()),
        "types": pa.array([*none, len(c)], pa.int64()), "tokens": pa.array([*none, int(c.sum())], pa.int64()),
    })


def exchange(pairs: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each of ``words`` words by exchange clustering.

    ``pairs`` is the square count matrix of successions; rows beyond ``words`` are classes that
    don't change (they get the numbers from ``classes`` on).  Words start dealt out by rank;
    in each sweep every word, in order, goes to the class where the log likelihood of the
    class bigrams is greatest, ties to the lower class, and none leaves a class empty.
    """
    size = len(pairs)
    fixed = size - words
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(fixed)])
    k = classes + fixed
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    table = member.T @ pairs @ member
    left = pairs.T @ member  # left[w, g]: how often class g stands before w
    right = pairs @ member
    count = np.bincount(of, minlength=k)
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    total_in, total_out = pairs.sum(0), pairs.sum(1)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a = of[w]
            if count[a] == 1:
                continue
            self_ = pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= self_
            l[a] -= self_
            table[a] -= right[w]
            table[:, a] -= left[w]
            table[a, a] += self_
            # Gain of adding w to class g: its row, its column and its corner, less the margins.
            rows, cols = table[:classes], table[:, :classes].T
            gain = (xlogx(rows + r) - xlogx(rows)).sum(1) + (xlogx(cols + l) - xlogx(cols)).sum(1)
            g = np.arange(classes)
            corner = table[g, g]
            gain -= xlogx(corner + r[g]) + xlogx(corner + l[g]) - 2 * xlogx(corner)
            gain += xlogx(corner + r[g] + l[g] + self_) - xlogx(corner)
            out_, in_ = table.sum(1)[:classes], table.sum(0)[:classes]
            gain -= xlogx(out_ + total_out[w]) - xlogx(out_) + xlogx(in_ + total_in[w]) - xlogx(in_)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += self_
            if b != a:
                moved += 1
                count[a] -= 1
                count[b] += 1
                of[w] = b
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
        if not moved:
            break
    return of[:words]


@dataclass
class Model:
    """What the exchange gives; its size is bounded."""

    tokens: int
    types: int
    #: training texts
    ends: int
    #: exchanged words: sorted hashes and their classes
    words: np.ndarray
    of: np.ndarray
    #: and their counts
    counts: np.ndarray
    #: successions of classes, with all words that were not exchanged in the classes of their forms
    table: np.ndarray

    def classes_of(self, h: np.ndarray, form: np.ndarray, classes: int) -> np.ndarray:
        out = classes + 1 + form.astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            out = np.where(self.words[at] == h, self.of[at], out)
        out[h == END] = classes
        return out


def _successions(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``(a, b, n)``: how often unit b follows a in training texts.

    Units are the frequent words by number, then the end of a text, then the forms.
    """
    m = len(words)

    size = m + 1 + FORMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        have: list[np.ndarray] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(have), return_counts=True)
            both, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            return both, np.bincount(back, np.concatenate([counts, n])).astype(np.int64)

        for batch in batches:
            for part in W.chunks(batch, 0):
                h, f, first = _tokens(part.column(0))
                unit = m + 1 + f.astype(np.int64)
                if m:
                    at = np.minimum(np.searchsorted(words, h), m - 1)
                    unit = np.where(words[at] == h, at, unit)
                unit[h == END] = m
                before = np.concatenate([[m], unit[:-1]])  # a text begins after an end
                have.append(before * size + unit)
                if sum(map(len, have)) >= GATHER // 4:
                    keys, counts = added()
                    have.clear()
        if have:
            keys, counts = added()
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k // size), pa.array(k % size), pa.array(counts[i : i + 100_000])], names=["a", "b", "n"])

    pairs = docs.where("not held_out").select("t").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return to_table(pairs, "lm-pairs")


def _train(docs: DataFrame, tops: DataFrame, classes: int) -> Model:
    ends = docs.where("not held_out").count()
    sums = tops.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    tokens, types = (sums["tokens"] or 0) + ends, (sums["types"] or 0) + (ends > 0)
    words_ = tops.where("word is not null").select("word", "n")
    often = words_.where(F.col("n") * SHARE >= tokens)
    best = words_.orderBy(F.desc("n"), F.col("word") < 0, "word").limit(SEEDS)  # hashes are unsigned
    # at most SHARE and SEEDS words come to the driver, whatever the number of slices
    top = {r["word"] & (1 << 64) - 1: r["n"] for r in often.unionByName(best).collect()}
    chosen = sorted(top, key=lambda h: (-top[h], h))
    k = min(classes, max(1, len(chosen)))
    words = np.array(sorted(chosen), np.uint64)
    size = len(words) + 1 + FORMS
    pairs = np.zeros((size, size))
    found = _successions(docs, words)
    for r in found.toLocalIterator():  # at most (SHARE + 1 + FORMS) ** 2
        pairs[r["a"], r["b"]] = r["n"]
    drop_tables(found)
    # The exchange takes words by rank.
    rank = np.searchsorted(words, np.array(chosen, np.uint64)) if chosen else np.zeros(0, np.int64)
    order = np.concatenate([rank, np.arange(len(words), size)]).astype(np.int64)
    of = np.zeros(len(words), np.int64)
    of[rank] = exchange(pairs[np.ix_(order, order)], len(words), k)
    all_ = np.concatenate([of, np.arange(k, k + 1 + FORMS)])
    member = np.zeros((size, k + 1 + FORMS))
    member[np.arange(size), all_] = 1
    return Model(tokens, types, ends, words, of, np.array([top[h] for h in words.tolist()], np.int64), member.T @ pairs @ member)


def gains(table: np.ndarray, classes: int, form: np.ndarray, left: np.ndarray, right: np.ndarray, self_: np.ndarray) -> np.ndarray:
    """Log likelihood that each word would gain in each exchange class, up to a constant of the word.

    ``table`` has the words in the classes ``form``; ``left[w, g]`` is how often class g stands before
    w and ``right[w, g]`` after it, without the ``self_[w]`` times that w follows itself.  The words are
    looked at one by one, each taken out of its class first.
    """
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    inner = table[:classes, :classes]
    out = np.zeros((len(form), classes))
    for own, other, lines in ((right, left, table[:classes].T), (left, right, table[:, :classes])):
        w, j = np.nonzero(own)
        for lo in range(0, len(w), 20_000):
            x, y = w[lo : lo + 20_000], j[lo : lo + 20_000]
            was = lines[y] - np.where((y == form[x])[:, None], other[x, :classes], 0)
            at = _runs(x)
            out[x[at]] += np.add.reduceat(xlogx(was + own[x, y][:, None]) - xlogx(was), at)
    corner, l, r = np.diag(inner), left[:, :classes], right[:, :classes]
    out += xlogx(corner + l + r + self_[:, None]) + xlogx(corner) - xlogx(corner + l) - xlogx(corner + r)
    for side, axis in ((right, 1), (left, 0)):
        margin, n = table.sum(axis)[:classes], (side.sum(1) + self_)[:, None]
        out -= xlogx(margin + n) - xlogx(margin)
    return out


def _planar(x: np.ndarray) -> bytes:
    """32-bit numbers, low bytes first, as most are small."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _contexts(docs: DataFrame, model: Model, slices: int) -> DataFrame:
    """``(slice, contexts)``: for the words of each batch that were not exchanged, how often they have which neighbours.

    A row holds what a task has gathered for a slice, of whichever batches, so that rows grow with the texts and not
    with batches times slices.  Packed are hashes and forms of the words and in how many batches each stands, then these batches and numbers
    of codes in them, then the codes and how often each occurs.  Codes are the class before, the class after (from the number of classes on), and the word itself
    after; one more, with no count, names the words of texts held out.
    """
    shift = np.uint64(64 - slices.bit_length() + 1) if slices > 1 else None
    size = len(model.table)
    k = size - 1 - FORMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, ...]] = []
        n_have = 0

        def send() -> Iterator[pa.RecordBatch]:
            b, h, f, c, n = (np.concatenate(x) for x in zip(*have, strict=True))
            key = b.astype(np.int64) << 16 | c
            order = np.lexsort((key, h))
            key, h, f, n = key[order], h[order], f[order], n[order]
            at = _runs(h, key)
            n, key, h, f = _sums(n, at).astype(np.int64), key[at], h[at], f[at]
            b, c = key >> 16, (key & 0xFFFF).astype(np.uint16)
            s = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
            rows = []
            for i, j in zip(at := _runs(s), np.append(at[1:], len(s)), strict=True):
                word, unit = _runs(h[i:j]), _runs(h[i:j], b[i:j])
                per_word = np.diff(np.append(np.searchsorted(unit, word), len(unit)))
                m = np.diff(np.append(unit, j - i)).astype(np.uint16)
                rest = zlib.compress(_planar(per_word) + _planar(b[i:j][unit]) + m.tobytes() + c[i:j].tobytes() + _planar(n[i:j]), 1)
                rows.append((int(s[i]), len(word).to_bytes(4, "little") + len(unit).to_bytes(4, "little") + h[i:j][word].tobytes() + f[i:j][word].tobytes() + rest))
            for lo in range(0, len(rows), 4096):
                slice_, packed = zip(*rows[lo : lo + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(slice_, pa.int64()), pa.array(packed, pa.binary())], names=["slice", "contexts"])

        for batch in batches:
            for part in W.chunks(batch, 2):
                h, f, first = _tokens(part.column(2))
                cls = model.classes_of(h, f, k)
                text = np.diff(first)
                train, b = np.repeat(np.asarray(part.column(0)).astype(bool), text), np.repeat(np.asarray(part.column(1)), text)
                before, after = np.concatenate([[k], cls[:-1]]), np.append(cls[1:], k)
                again = np.append(h[1:] == h[:-1], False)
                rare = cls > k
                for mask, code in (
                    (rare & train & ~np.append(False, again[:-1]), before), (rare & train & ~again, size + after),
                    (rare & train & again, np.full(len(h), 2 * size)), (rare & ~train, np.full(len(h), 2 * size + 1)),
                ):
                    have.append((b[mask].astype(np.int32), h[mask], f[mask], code[mask].astype(np.uint16), train[mask].astype(np.int32)))
                    n_have += int(mask.sum())
                if n_have >= GATHER // 3:
                    yield from send()
                    have.clear()
                    n_have = 0
        if n_have:
            yield from send()

    return docs.select(F.expr("cast(not held_out as int)").alias("train"), "batch", "t").mapInArrow(run, "slice long, contexts binary")


def _assign(table: pa.Table, model: Model) -> pa.Table:
    """``(batch, words)``: each batch's words with their training counts and classes, for one slice of the hash range."""
    size = len(model.table)
    k = size - 1 - FORMS
    cols, units = [], []
    for x in table.column("contexts").to_pylist():
        n_words, n_units = (int.from_bytes(x[i : i + 4], "little") for i in (0, 4))
        rest, at = zlib.decompress(x[8 + 9 * n_words :]), 0

        def take(n: int, planar: bool = False) -> np.ndarray:
            nonlocal at
            at += n * (4 if planar else 2)
            return np.frombuffer(rest, np.uint8, 4 * n, at - 4 * n).reshape(4, n).T.copy().view("<u4").ravel() if planar else np.frombuffer(rest, np.uint16, n, at - 2 * n)

        per_word, batch, m = take(n_words, True), take(n_units, True), take(n_units)
        code = take(int(m.sum()))
        word, of_unit = np.repeat(np.arange(n_words), per_word), np.frombuffer(x, np.uint64, n_words, 8)
        of_entry = np.repeat(word, m)
        units.append((batch, of_unit[word]))
        cols.append((of_unit[of_entry], np.frombuffer(x, np.uint8, n_words, 8 + 8 * n_words)[of_entry], code, take(len(code), True)))
    h, f, code, n = (np.concatenate(x) for x in zip(*cols, strict=True))
    del cols
    order = np.lexsort((code, h))
    h, f, code, n = h[order], f[order], code[order], n[order]
    at = _runs(h, code)
    n, h, f, code = _sums(n.astype(np.int64), at), h[at], f[at], code[at]
    first = _runs(h)
    types, form = h[first], k + 1 + f[first].astype(np.int64)
    bounds = np.append(first, len(h))
    of, count = np.empty(len(types), np.uint8), np.empty(len(types), np.int64)
    for lo in range(0, len(types), 2000):
        hi = min(lo + 2000, len(types))
        i, j = bounds[lo], bounds[hi]
        dense = np.zeros((hi - lo, 2 * size + 2))
        dense[np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])), code[i:j]] = n[i:j]
        # Each occurrence follows another word or itself.
        count[lo:hi] = dense[:, :size].sum(1) + dense[:, 2 * size]
        of[lo:hi] = np.argmax(gains(model.table, k, form[lo:hi], dense[:, :size], dense[:, size : 2 * size], dense[:, 2 * size]), axis=1)
    batch, own = (np.concatenate(x) for x in zip(*units, strict=True))
    del units
    order = np.lexsort((own, batch))
    batch, own = batch[order], own[order]
    at = _runs(batch, own)
    batch, own = batch[at], own[at]
    first = _runs(batch)
    place = np.searchsorted(types, own)
    count, of = count[place], of[place]
    packed = [_pack(own[i:j], count[i:j], of[i:j]) for i, j in zip(first, np.append(first[1:], len(own)), strict=True)]
    return pa.table({"batch": pa.array(batch[first].astype(np.int64)), "words": pa.array(packed, pa.binary())})


def _class_pairs(coded: DataFrame, size: int) -> np.ndarray:
    """Successions of classes in the training texts; known words of one occurrence count for their form's class too."""
    k = size - 1 - FORMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for part in (x for batch in batches for x in W.chunks(batch, 0)):
            code = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint16).astype(np.int64)
            cls, form = code % size, code // size - 1
            before, after = np.concatenate([[k], cls[:-1]]), np.append(cls[1:], k)
            once = np.flatnonzero(form >= 0)
            for a, b in ((before, cls), (before[once], k + 1 + form[once]), (k + 1 + form[once], after[once])):
                table += np.bincount(a * size + b, minlength=size * size)
        keys = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(keys // size), pa.array(keys % size), pa.array(table[keys])], names=["a", "b", "n"])

    out = np.zeros((size, size))
    sums = coded.where("not held_out").select("classes").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # at most size ** 2
        out[r["a"], r["b"]] = r["n"]
    return out


def score(docs: DataFrame, classes: int = CLASSES, fold: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the base score, the class model's log10 probability and its perplexity a token.

    Learned from rows whose crc32 of the id modulo ``fold`` is not ``held``.  Null and empty texts
    are an end alone; a null id counts as empty text; repeated rows are learned as often as they
    stand there and scored alike; other columns are not looked at; an empty table gives an empty
    one, and without training rows each word is unknown.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = d.withColumn("held_out", crc % fold == held)
    size = d.agg(F.sum(F.octet_length("t").cast("long")).alias("n")).first()["n"] or 0
    n_batches = max(1, -(-size // BATCH_BYTES))
    slices = 1 << max(2, (n_batches // 2).bit_length())
    d = d.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.length("t"), F.substring("t", 1, 64)), F.lit(n_batches)))
    tops = to_table(_count(d, slices).groupBy("slice").applyInArrow(lambda t: _tops(t), "word long, n long, types long, tokens long"), "lm-tops")
    model = _train(d, tops, classes)
    drop_tables(tops)
    size = len(model.table)
    k = size - 1 - FORMS
    places = _contexts(d, model, slices).groupBy("slice").applyInArrow(lambda t: _assign(t, model), "batch long, words binary")
    # Added to counts: DELTA in the open classes, and what keeps an end possible without training texts.
    add = np.where(np.arange(size) > k, DELTA, 0.0)
    add[k] = 0.0 if model.ends else 1.0

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        # Slices of the hash range are apart, so all words of a batch are distinct.
        own, counts, place = (np.concatenate([x, *y]) for x, y in zip(
            (np.append(model.words, END), np.append(model.counts, model.ends), np.append(model.of, k)),
            list(zip(*[_unpack(x) for x in right.column("words").to_pylist()], strict=True)) or [[]] * 3, strict=True,
        ))
        order = np.argsort(own)
        own, counts, place = own[order], counts[order], place[order].astype(np.int64)
        out = []
        for batch in left.combine_chunks().to_batches():
            for part in W.chunks(batch, 2):
                h, f, first = _tokens(part.column(2))
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                c = np.where(own[at] == h, counts[at], 0)
                cls = np.where(c > 0, place[at], k + 1 + f.astype(np.int64))
                cls[h == END] = k
                n, begin = np.diff(first), first[:-1]
                once = (c == 1) & (h != END) & ~np.repeat(np.asarray(part.column(1)).astype(bool), n)
                coded = (cls + np.where(once, size * (1 + f.astype(np.int64)), 0)).astype(np.uint16).tobytes()
                base = np.add.reduceat(np.log10(c + 1.0), begin) - n * np.log10(model.tokens + (model.types + 1.0))
                out.append(pa.table({
                    "doc_id": part.column(0), "held_out": pa.array(np.asarray(part.column(1)).astype(bool)), "n_tokens": pa.array(n.astype(np.int64)),
                    "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)), "train_tokens": pa.array(np.full(len(n), model.tokens, np.int64)),
                    "base_score": pa.array(base), "emitted": pa.array(np.add.reduceat(np.log10(np.maximum(c + add[cls], 1e-300)), begin)),
                    "classes": pa.array([coded[2 * i : 2 * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()),
                }))
        return pa.concat_tables(out)

    id_type = d.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
    texts = d.select("doc_id", "held_out", "t", "batch").groupBy("batch")
    coded = to_table(texts.cogroup(places.groupBy("batch")).applyInArrow(code, ddl + ", emitted double, classes binary"), "lm-classes")
    table = _class_pairs(coded, size)
    seen = table.sum(0)
    unigram = (seen + 1) / (seen.sum() + size)
    move = np.log10((table + ALPHA * unigram) / (table.sum(1, keepdims=True) + ALPHA))
    total = np.log10(np.maximum(np.where(np.arange(size) > k, seen + DELTA * (seen + 1), seen), 1e-300 if model.ends else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for y in batches for x in W.chunks(y, 7)):
            cls = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint16).astype(np.int64) % size
            logp = move[np.concatenate([[k], cls[:-1]]), cls] - total[cls]
            begin = np.concatenate([[0], np.cumsum(np.asarray(batch.column("n_tokens")))[:-1]])
            score_ = np.asarray(batch.column("emitted")) + np.add.reduceat(logp, begin)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(score_)], names=[*batch.schema.names[:6], "score"])

    return coded.mapInArrow(run, ddl + ", score double").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
