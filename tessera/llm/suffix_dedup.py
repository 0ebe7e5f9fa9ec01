"""Removal of repeated byte strings by suffix arrays.

Each byte covered by a string of ``length`` bytes that also starts earlier (in a smaller
document, or earlier in the same one) is removed, judged on the input as it stands.

Equal strings are brought together without comparing every shard with every other.  A string
of ``length`` bytes has a least hashed gram, and equal strings have the same one at the same
place, so a string can be repeated only where its least gram (its anchor) occurs again.  Around
every repeated anchor the bytes that its strings can cover are cut out as a segment; a shard
holds all segments of its anchors, sorts their suffixes by Larsson-Sadakane refinement as far as
a string is long and takes common prefixes of neighbours.  An anchor with very many segments is
spread over sub-shards with suffix arrays of their own; these then merge: the sorted strings of
each, byte by byte, are looked up by binary search among the earliest ones of all.  Copies of
whole documents and equal segments of a batch are one before any of this.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ..tables import drop_tables
from .shared import rows_by_ids, to_table

#: Bytes of an anchor's gram.
GRAM = 40
#: Anchors that a task gathers before it sends them on; text bytes of a batch; bytes of a shard.
GATHER = 1_000_000
BATCH_BYTES = 4_000_000
SHARD_BYTES = 1_000_000
#: Segments of an anchor beyond which it is spread over sub-shards of about this many.
SPREAD = 20_000
#: Batches or shards of a partition, on average.
PER_PART = 2
_P1 = 0xD6E8FEB86659FD93
_TOP = np.uint64((1 << 64) - 1)


def _slide(x: np.ndarray, size: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over x[i : i + size] for each i; past the end stands ``fill``."""
    n = len(x)
    m = -(-(n + size) // size) * size
    y = np.full(m, fill, x.dtype)
    y[:n] = x
    blocks = y.reshape(-1, size)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[size - 1 : size - 1 + n])


def _window_hash(raw: np.ndarray, size: int, base: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes."""
    n = len(raw)
    if n < size:
        return np.zeros(0, np.uint64)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * W.powers(base, n), out=run[1:])
    return W.mix((run[size:] - run[:-size]) * W.powers(pow(base, -1, 1 << 64), n - size + 1), salt)


def anchors(raw: np.ndarray, byte: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the texts ``byte[i]:byte[i + 1]`` of ``raw``.

    Each string of ``length`` bytes within a text holds at least one; whether a place is an
    anchor of a string depends on that string only.
    """
    n = len(raw)
    size = length - gram + 1
    h = np.full(n, _TOP)
    found = _window_hash(raw, gram, _P1, 21)
    h[: len(found)] = found
    left = np.repeat(byte[1:], np.diff(byte)) - np.arange(n)  # bytes from here to the text's end
    h[left < gram] = _TOP
    least = _slide(h, size, np.minimum, int(_TOP))
    least[left < length] = 0
    # A place is an anchor if it is the least of some string that begins up to size - 1 before it.
    greatest = _slide(least[::-1], size, np.maximum, 0)[::-1]
    at = np.flatnonzero((greatest == h) & (h != _TOP))
    return at, h[at]


def _gather(docs: DataFrame, slices: int, length: int) -> DataFrame:
    """``(slice, anchors)``: packed anchors of ``docs(key, t)``, dealt by hash."""
    shift = np.uint64(65 - slices.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            h, key, pos = (np.concatenate(x) for x in zip(*have, strict=True))
            order = np.argsort(h, kind="stable")
            h, key, pos = h[order], key[order], pos[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, len(h)))
            many = np.repeat(n > 1, n)
            # 0: once here; 1: stands for several here; 2: one of these, known to be repeated.
            kind = np.concatenate([many[at].astype(np.uint8), np.full(many.sum(), 2, np.uint8)])
            h, key, pos = (np.concatenate([x[at], x[many]]) for x in (h, key, pos))
            spread = np.arange(len(h)) % slices
            to = np.where(kind == 2, spread, (h >> shift).astype(np.int64) if slices > 1 else 0)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(slices + 1))
            packed = [_pack(h[o], key[o], pos[o], kind[o]) for a, b in zip(cut[:-1], cut[1:], strict=True) for o in [order[a:b]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices)), pa.array(packed, pa.binary())], names=["slice", "anchors"])

        for batch in batches:
            for part in W.chunks(batch, 1):
                raw, byte = _bytes(part.column(1))
                at, h = anchors(raw, byte, length)
                doc = np.searchsorted(byte, at, side="right") - 1
                have.append((h, np.asarray(part.column(0))[doc], (at - byte[doc]).astype(np.int64)))
                size += len(at)
                if size >= GATHER:
                    yield from send()
                    have.clear()
                    size = 0
        if have:
            yield from send()

    return docs.select("key", "t").mapInArrow(run, "slice long, anchors binary")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _pack(h: np.ndarray, key: np.ndarray, pos: np.ndarray, kind: np.ndarray) -> bytes:
    low = int(key.min(initial=0)) if len(key) else 0
    near = len(key) and int(key.max()) - low < 1 << 32
    keys = (key - low).astype(np.uint32).tobytes() if near else key.astype(np.int64).tobytes()
    wide = len(pos) and int(pos.max()) >= 1 << 32
    places = pos.astype(np.int64 if wide else np.uint32).tobytes()
    return np.array([len(h), low, near, wide], np.int64).tobytes() + h.tobytes() + keys + places + kind.tobytes()


def _unpack(x: bytes) -> tuple[np.ndarray, ...]:
    n, low, near, wide = np.frombuffer(x, np.int64, 4).tolist()
    at = 32
    out = []
    for kind in (np.uint64, np.uint32 if near else np.int64, np.int64 if wide else np.uint32, np.uint8):
        out.append(np.frombuffer(x, kind, n, at))
        at += n * out[-1].itemsize
    return out[0], out[1].astype(np.int64) + (low if near else 0), out[2].astype(np.int64), out[3]


def _repeated(table: pa.Table) -> pa.Table:
    """Anchors of one slice that occur more than once: (key, pos, anchor)."""
    h, key, pos, kind = (np.concatenate(x) for x in zip(*[_unpack(x) for x in table.column("anchors").to_pylist()], strict=True))
    known = kind == 2
    o = np.flatnonzero(~known)
    o = o[np.argsort(h[o])]
    new = np.ones(len(o), bool)
    new[1:] = h[o][1:] != h[o][:-1]
    n = np.diff(np.append(np.flatnonzero(new), len(o)))
    o = o[np.repeat(n > 1, n) & (kind[o] == 0)]
    o = np.concatenate([o, np.flatnonzero(known)])
    return pa.table({"key": key[o], "pos": pos[o], "anchor": h[o].view(np.int64)})


def _in_order(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of ``values`` (of so many bits, not negative), and the values in it.

    Where there is room, a value and its place are sorted as one number, which is much faster.
    """
    place = len(values).bit_length()
    if bits + place > 63:
        order = np.argsort(values, kind="stable")
        return order, values[order]
    both = np.sort(values << place | np.arange(len(values)))
    return both & ((1 << place) - 1), both >> place


def suffix_array(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes or more.

    ``end[i]`` is where the segment of place i ends; there a suffix stops.  Ranks are
    refined by doubling (Larsson and Sadakane): only groups that are still tied are sorted
    again, by the ranks of what follows.  Suffixes that are equal so far stand in order of place.
    """
    n = len(text)
    here = np.arange(n)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)  # 0: past the end
    code = code[text]
    width = len(used).bit_length()
    first = min(7, (63 - n.bit_length()) // width)
    key = np.zeros(n, np.int64)
    for j in range(first):
        key <<= width
        if j >= n:
            continue
        key[: n - j] |= np.where(here[j:] < end[: n - j], code[j:], 0)
    sa, key = _in_order(key, width * first)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)
    group = np.maximum.accumulate(np.where(new, here, 0))
    rank[sa] = group + 1
    tied = np.ones(n, bool)
    tied[:-1] = ~new[1:]
    tied[-1] = False
    tied[1:] |= ~new[1:]
    tied &= ~(new & np.append(new[1:], True))
    slot = np.flatnonzero(tied)
    h = first
    bits = n.bit_length()
    while h < depth and len(slot):
        p = sa[slot]
        after = p + h
        second = np.where(after < end[p], rank[np.minimum(after, n)], 0)
        own = rank[p]
        lead = np.cumsum(np.append(False, own[1:] != own[:-1]))  # tied groups stand in order
        order, both = _in_order(lead << bits | second, int(lead[-1]).bit_length() + bits)
        p = p[order]
        sa[slot] = p
        fresh = np.ones(len(p), bool)
        fresh[1:] = both[1:] != both[:-1]
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))
        rank[p] = slot[lead] + 1
        alone = fresh & np.append(fresh[1:], True)
        slot = slot[~alone]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, begin: np.ndarray, end: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place, bytes (up to ``most``) that its suffix shares with the one before it in ``sa``, which may hold some of the suffixes only.

    All neighbours are compared at once, eight bytes in each step, and only those go on that were
    equal so far: ``most`` bounds the steps, so that nothing need be carried from place to place.
    Where segments begin doesn't matter.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,)).copy()  # the eight bytes from each place
    a, b = sa[1:], sa[:-1]
    limit = np.minimum(np.minimum(end[a] - a, end[b] - b), most)
    live = np.arange(len(a))
    h = 0
    while len(live):
        other = words[a[live] + h] ^ words[b[live] + h]
        equal = other == 0
        stop = live[~equal]
        x = other[~equal]
        lowest = x & (~x + np.uint64(1))  # a power of two, in the first byte that differs
        out[a[stop]] = np.minimum(h + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3), limit[stop])
        live = live[equal]
        h += 8
        done = limit[live] <= h
        out[a[live[done]]] = limit[live[done]]
        live = live[~done]
    return out


def _strings(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """Strings of a shard in order: place in the bytes, key, start, number of the string."""
    raw, byte = _bytes(table.column("bytes").combine_chunks())
    sizes = np.diff(byte)
    seg = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = byte[:-1][seg], byte[1:][seg]
    # Strings are in order as soon as their suffixes are in the order of so many bytes.
    sa = suffix_array(raw, end, min(length, int(sizes.max(initial=0))))
    sa = sa[end[sa] - sa >= length]
    shared = common_prefixes(raw, begin, end, sa, length)
    same = np.zeros(len(sa), bool)
    if len(sa) > 1:
        same[1:] = shared[sa[1:]] >= length
    number = np.cumsum(~same)
    key = np.asarray(table.column("key"))[seg[sa]]
    start = np.asarray(table.column("start"))[seg[sa]] + sa - begin[sa]
    return raw, sa, key, start, number


def _earlier(key: np.ndarray, start: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by string, in which they stand; and which of them aren't at the string's earliest place."""
    order = np.arange(len(number))
    if not len(number):
        return order, np.zeros(0, bool)
    at = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    n = np.diff(np.append(at, len(number)))
    later = key != np.repeat(np.minimum.reduceat(key, at), n)
    least = np.minimum.reduceat(np.where(later, np.iinfo(np.int64).max, start), at)
    return order, later | (start != np.repeat(least, n))


def _spans(key: np.ndarray, start: np.ndarray, length: int) -> pa.Table:
    """Starts of repeated strings as joined stretches (key, start, stop)."""
    bits = int(start.max(initial=0)).bit_length()
    low = int(key.min(initial=0))
    if int(key.max(initial=0)) - low < 1 << (63 - bits):
        both = np.sort((key - low) << bits | start)
        key, start = (both >> bits) + low, both & ((1 << bits) - 1)
    else:
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + length)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key))[: len(at)] - 1
    return pa.table({"key": key[at], "start": start[at], "stop": start[last] + length})


def removed(docs: DataFrame, length: int, spread: int = SPREAD) -> DataFrame:
    """``(key, start, stop)``, a table: stretches of ``docs(key, t)`` to be removed, not yet joined.

    ``key`` is a long and tells documents apart and orders them.
    """
    size = docs.agg(F.sum(F.octet_length("t").cast("long")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // BATCH_BYTES))
    slices = 1 << max(2, (n // 2).bit_length())
    found = gathered = to_table(_gather(docs, slices, length).groupBy("slice").applyInArrow(lambda t: _repeated(t), "key long, pos long, anchor long"), "suffix-anchors")
    ids = to_table(found.select(F.col("key").alias("id_")).distinct(), "suffix-keys")
    texts = to_table(rows_by_ids(docs.select("key", "t"), ids, "key", "left_semi").withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(n))), "suffix-texts")
    hot = to_table(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > spread), "suffix-hot")
    n_hot = hot.count()
    if n_hot:
        few = n_hot <= 100_000
        found = found.join(F.broadcast(hot) if few else hot, "anchor", "left")
    else:
        found = found.withColumn("n", F.lit(None).cast("long"))
    total = found.count()
    shards = max(1, -(-total * (2 * length - GRAM) // SHARD_BYTES))
    part = F.when(F.col("n").isNull(), F.pmod(F.col("anchor"), F.lit(shards))).otherwise(
        -1 - F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / spread))), F.lit(1 << 40))
    )
    found = found.select("key", "pos", "anchor", part.cast("long").alias("shard"), F.pmod(F.xxhash64("key"), F.lit(n)).alias("batch"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, byte = _bytes(left.column("t").combine_chunks())
        keys = np.asarray(left.column("key"))
        order = np.argsort(keys)
        key, pos, shard, anchor = (np.asarray(right.column(c)) for c in ("key", "pos", "shard", "anchor"))
        doc = order[np.searchsorted(keys[order], key)]
        start = np.maximum(0, pos + GRAM - length)
        stop = np.minimum(byte[doc + 1] - byte[doc], pos + length)
        # Equal segments: the first is cut out, the others are repeated as they stand.
        seen: dict[tuple[int, bytes], int] = {}
        data = raw.tobytes()
        at = np.lexsort((start, key))
        first, again = [], []
        for i, a, b, g in zip(at.tolist(), (byte[doc] + start)[at].tolist(), (byte[doc] + stop)[at].tolist(), anchor[at].tolist(), strict=True):
            if b - a < length:
                continue
            mine = (g, data[a:b])
            if mine in seen:
                if key[i] != key[seen[mine]] or start[i] != start[seen[mine]]:
                    again.append(i)
            else:
                seen[mine] = i
                first.append(i)
        row = np.array(first + again, np.int64)
        pieces = [m[1] for m in seen] + [None] * len(again)
        # The others are only passed on, so they needn't meet the rest of their anchor.
        to = np.concatenate([shard[row[: len(first)]], key[row[len(first) :]] % shards])
        return pa.table({"shard": to, "key": key[row], "start": start[row], "stop": stop[row], "anchor": anchor[row], "bytes": pa.array(pieces, pa.binary())})

    parts = max(1, n // PER_PART)
    pieces = texts.repartition(parts, "batch").groupBy("batch").cogroup(found.repartition(parts, "batch").groupBy("batch")).applyInArrow(cut, "shard long, key long, start long, stop long, anchor long, bytes binary")
    if n_hot:
        pieces = to_table(pieces, "suffix-segments")

    def sort(table: pa.Table) -> pa.Table:
        again = table.filter(pa.compute.is_null(table.column("bytes"))).select(["key", "start", "stop"])
        own = table.filter(pa.compute.is_valid(table.column("bytes")))
        if not own.num_rows:
            return again
        # Equal segments of other batches are one as well; an anchor with a single segment left has
        # no other context to be sorted against.
        order = np.lexsort((np.asarray(own.column("start")), np.asarray(own.column("key"))))
        anchor, data = own.column("anchor").to_pylist(), own.column("bytes").to_pylist()
        seen: set[tuple[int, bytes]] = set()
        contexts: dict[int, int] = {}
        first, equal = [], []
        for i in order.tolist():
            mine = (anchor[i], data[i])
            if mine in seen:
                equal.append(i)
            else:
                seen.add(mine)
                first.append(i)
                contexts[anchor[i]] = contexts.get(anchor[i], 0) + 1
        again = pa.concat_tables([again, own.take(pa.array(equal, pa.int64())).select(["key", "start", "stop"])])
        own = own.take(pa.array([i for i in first if contexts[anchor[i]] > 1], pa.int64()))
        if not own.num_rows:
            return again
        _, _, key, start, number = _strings(own, length)
        order, late = _earlier(key, start, number)
        o = order[late]
        return pa.concat_tables([again, _spans(key[o], start[o], length)])

    spans = pieces.repartition(max(1, shards // PER_PART), "shard").groupBy("shard").applyInArrow(sort, "key long, start long, stop long")
    if not n_hot:
        out = to_table(spans, "suffix-spans")
        drop_tables(gathered, ids, texts, hot)
        return out

    def lists(table: pa.Table) -> pa.Table:
        """Earliest place of each distinct string of a sub-shard, by slices of the string's hash."""
        own = table.filter(pa.compute.is_valid(table.column("bytes")))
        if not own.num_rows:
            return pa.table({"slice": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "strings": pa.array([], pa.binary())})
        raw, sa, key, start, number = _strings(own, length)
        order, late = _earlier(key, start, number)
        o = order[~late]
        to = (_window_hash(raw, length, _P1, 31)[sa[o]] >> np.uint64(65 - slices.bit_length())).astype(np.int64)
        o2 = np.argsort(to, kind="stable")  # the order of strings stays within a slice
        at = np.searchsorted(to[o2], np.arange(slices + 1))
        packed = []
        for i in range(slices):
            x = o[o2[at[i] : at[i + 1]]]
            strings = raw[sa[x][:, None] + np.arange(length)]
            packed.append(np.stack([key[x], start[x]]).tobytes() + zlib.compress(strings.tobytes(), 1))
        return pa.table({"slice": np.arange(slices), "n": np.diff(at), "strings": pa.array(packed, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        """Strings of sub-shards looked up among the earliest ones of all."""
        lists_ = []
        for n_, x in zip(table.column("n").to_pylist(), table.column("strings").to_pylist(), strict=True):
            lists_.append((np.frombuffer(zlib.decompress(x[16 * n_ :]), f"S{length}", n_), *np.frombuffer(x, np.int64, 2 * n_).reshape(2, -1)))
        string, key, start = (np.concatenate(x) for x in zip(*lists_, strict=True))
        order = np.lexsort((start, key, string))
        string, key, start = string[order], key[order], start[order]
        lead = np.ones(len(string), bool)
        lead[1:] = string[1:] != string[:-1]
        string, key, start = string[lead], key[lead], start[lead]  # the earliest of each
        out_key, out_start = [], []
        for x, own_key, own_start in lists_:
            at = np.searchsorted(string, x)
            late = (key[at] != own_key) | (start[at] != own_start)
            out_key.append(own_key[late])
            out_start.append(own_start[late])
        return _spans(np.concatenate(out_key), np.concatenate(out_start), length)

    hot_lists = pieces.where("shard < 0").groupBy("shard").applyInArrow(lists, "slice long, n long, strings binary")
    out = to_table(spans.unionByName(hot_lists.groupBy("slice").applyInArrow(merge, "key long, start long, stop long")), "suffix-spans")
    drop_tables(gathered, ids, texts, hot, pieces)
    return out


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, ``kept`` (bytes).

    Texts are UTF-8 bytes, null counts as empty; texts under ``length`` bytes lose nothing.
    Documents come in the order of their ids, null after all others.  Rows equal in id and text
    are one document (equal results); rows with the same id and other texts are documents of
    their own, in the order of the texts' digests.  Other columns are not looked at; an empty
    table gives an empty one.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("md5", F.md5(F.col("t").cast("binary")))
    names = to_table(d.select("doc_id", "md5", F.octet_length("t").cast("long").alias("n")), "suffix-names")
    plain = d.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    plain = plain and names.where("doc_id is null").limit(1).count() == 0 and names.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() == 0
    if plain:
        keyed = names.select(F.col("doc_id").cast("long").alias("key"), "md5", "n")
        d = d.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "t")
    else:
        order = names.select("doc_id", "md5", "n").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "md5")
        table = to_table(order.withColumn("key", F.monotonically_increasing_id()), "suffix-order")
        keyed = table.select("key", "md5", "n")
        t = table.select(F.col("doc_id").alias("i_"), F.col("md5").alias("m_"), "key")
        d = d.join(t, d["doc_id"].eqNullSafe(t["i_"]) & (d["md5"] == t["m_"])).select("key", "doc_id", "t")
    # Later copies of a whole text go as a whole; the first one speaks for them.
    lead = keyed.groupBy("md5").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1")
    later = to_table(keyed.join(lead, "md5").where("key > lead").select(F.col("key").alias("id_")), "suffix-copies")
    own = rows_by_ids(d, later, "key", "left_anti")
    spans = removed(own, length, spread)
    touched = to_table(spans.select(F.col("key").alias("id_")).distinct(), "suffix-touched")
    size = keyed.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-size // BATCH_BYTES))

    id_type = d.schema["doc_id"].dataType.simpleString()

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        key, start, stop = (np.asarray(right.column(c)) for c in ("key", "start", "stop"))
        order = np.lexsort((start, key))
        key, start, stop = key[order], start[order], stop[order]
        rows = []
        for k, t in zip(left.column("key").to_pylist(), left.column("t").to_pylist(), strict=True):
            data = t.encode()
            a, b = np.searchsorted(key, [k, k + 1])
            kept, at, gone, n_spans = [], 0, 0, 0
            low = high = -1
            for x, y in zip(start[a:b].tolist(), stop[a:b].tolist(), strict=True):
                if x > high:
                    if high > 0:
                        kept.append(data[at:low])
                        at, gone, n_spans = high, gone + high - low, n_spans + 1
                    low, high = x, y
                else:
                    high = max(high, y)
            if high > 0:
                kept.append(data[at:low])
                at, gone, n_spans = high, gone + high - low, n_spans + 1
            rest = b"".join([*kept, data[at:]])
            rows.append((len(data), gone, n_spans, hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*rows, strict=True))
        return pa.table({
            "doc_id": left.column("doc_id"), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
            "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3]), "kept": pa.array(cols[4], pa.binary()),
        })

    batch = F.pmod(F.xxhash64("key"), F.lit(n))
    work = rows_by_ids(own, touched, "key", "left_semi").select("key", "doc_id", "t", batch.alias("batch"))
    ddl = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    parts = max(1, n // PER_PART)
    done = work.repartition(parts, "batch").groupBy("batch").cogroup(spans.select("*", batch.alias("batch")).repartition(parts, "batch").groupBy("batch")).applyInArrow(strip, ddl)

    def whole(df: DataFrame, copies: bool) -> DataFrame:
        n_bytes = F.octet_length("t").cast("long")
        goes = (n_bytes >= length) & F.lit(copies)
        kept = F.when(goes, F.lit("")).otherwise(F.col("t")).cast("binary")
        return df.select("doc_id", n_bytes.alias("n_bytes"), F.when(goes, n_bytes).otherwise(0).alias("n_removed"), F.when(goes, 1).otherwise(0).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept"))

    clean = whole(rows_by_ids(own, touched, "key", "left_anti"), False)
    copies = whole(rows_by_ids(d, later, "key", "left_semi"), True)
    return done.unionByName(clean).unionByName(copies)
