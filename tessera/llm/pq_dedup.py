"""Embedding near-dedup by product quantisation.

Vectors are dealt into inverted lists by the nearest coarse centroid; what is left over is coded
by one codeword per subspace.  A vector probes every list that can hold a partner: if x lies
in list c and y is nearest to c', then |y - c|^2 - |y - c'|^2 <= 2 r |c - c'|, where r is the
Euclidean length of the threshold, so no pair is missed.  Within a list, distances come from
lookup tables of the query's subspace distances to the codewords (asymmetric, the query itself
is not coded); each code carries the length of its error, so pruning by it is safe, and
the survivors get their exact cosine in double precision.

Centroids and codewords are fitted on a bounded sample; every vector is indexed.  Lists grow in
number with the vectors as far as the sample can tell centroids apart; beyond that they grow in
length, and lists are cut into blocks and a query visits all blocks of a list, so no task holds a
whole large list.  Vectors travel in their own element type and are brought to length one in double
precision where they are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_tables
from .shared import connected_components, to_table

#: Vectors that centroids and codewords are fitted on (the least by hash).
SAMPLE = 16_384
#: Vectors of one label in a list, on average; vectors of the sample for each centroid at least; vectors of a block.
LIST, PER_CENTROID, BLOCK = 512, 4, 1024
#: Distances to centroids that are worked out at once.
AT_ONCE = 2_000_000
SUBSPACES, WORDS, SWEEPS = 8, 64, 8


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centres; the start is spread over the sample as it stands."""
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64)].copy()
    for _ in range(SWEEPS):
        near = _nearest(x, centre)
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(centre, axis=0)


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    step = max(1, AT_ONCE // len(centre))
    for a in range(0, len(x), step):
        out[a : a + step] = _squares(x[a : a + step], centre).argmin(1)
    return out


@dataclass
class Index:
    """Coarse centroids and, for each subspace, its columns and codewords."""

    centre: np.ndarray
    columns: list[slice]
    words: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Index:
        centre = _kmeans(x, lists)
        rest = x - centre[_nearest(x, centre)]
        cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        columns = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return Index(centre, columns, [_kmeans(rest[:, c], WORDS) for c in columns])

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors in their lists, and the length of what the code leaves over."""
        rest = x - self.centre[home]
        code = np.stack([_nearest(rest[:, c], w) for c, w in zip(self.columns, self.words, strict=True)], 1)
        for j, (c, w) in enumerate(zip(self.columns, self.words, strict=True)):
            rest[:, c] -= w[code[:, j]]
        return code.astype(np.uint8), np.sqrt((rest * rest).sum(1))

    def probes(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs: all lists that can hold a vector within ``r``, the own one included."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, AT_ONCE // len(self.centre))
        for a in range(0, len(x), step):
            d = _squares(x[a : a + step], self.centre)
            own = d.argmin(1)
            apart = np.sqrt(_squares(self.centre[own], self.centre))
            q, c = np.nonzero(d - d[np.arange(len(d)), own][:, None] <= 2 * r * apart + 1e-9)
            found.append((q + a, c))
        q, c = zip(*found, strict=True)
        return np.concatenate(q), np.concatenate(c)

    def near(self, q: np.ndarray, list_: int, code: np.ndarray, error: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, coded) pairs that may be within ``r``, by table lookups."""
        rest = q - self.centre[list_]
        d = np.zeros((len(q), len(code)))
        for j, (c, w) in enumerate(zip(self.columns, self.words, strict=True)):
            d += _squares(rest[:, c], w)[:, code[:, j]]
        return np.nonzero(np.sqrt(d) <= r + error[None, :] + 1e-6)


def _unit(batch: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(batch.flatten()).astype(np.float64).reshape(-1, dim)
    return _length_one(x)


def _length_one(x: np.ndarray) -> np.ndarray:
    """Rows at length one; the largest part is brought to one first, so no square leaves the range of numbers."""
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def classes(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Linked are vectors of equal label (not null) and dimension whose cosine is at least ``least``, however
    long or short they are.  Null, empty and zero vectors, and those with null or non-finite parts,
    link with nothing.  Repeated
    rows are vectors of their own; a null id counts as greater than others, as a component's least
    id is of those that aren't null.  Other columns are not looked at; an empty table gives an
    empty one.
    """
    r = math.sqrt(2 - 2 * least)
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("x"))
    good = F.expr("label is not null and x is not null and size(x) > 0 and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('inf')) and exists(x, e -> e <> 0)")
    digits = F.array_join(F.transform("x", lambda e: (e + F.lit(0.0)).cast("string")), ",")  # no negative zeros
    v = v.withColumn("node", F.when(F.coalesce(good, F.lit(False)), F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), digits).cast("binary")))))
    v = to_table(v, "pq-vectors")
    # Equal vectors are one node with a weight.
    nodes = v.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count(F.lit(1)).alias("n"))
    nodes = to_table(nodes.withColumn("dim", F.size("x")), "pq-nodes")
    links, edges, parts = None, None, []
    for dim in sorted(r_["dim"] for r_ in nodes.select("dim").distinct().collect()):  # vector lengths in the table
        part = nodes.where(F.col("dim") == dim)
        found = _cells(part, dim, r, least)
        parts.append(found)
        n = found.where("kind = 0").groupBy("node").agg(F.sum("n").alias("n_links"))
        e = found.where("kind = 1").select(F.col("node").alias("src"), F.col("other").alias("dst"))
        links = n if links is None else links.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    if links is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = connected_components(edges, "pq")
    named = nodes.select("node", "n").join(links, "node", "left").join(roots, "node", "left")
    named = named.select("node", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    rows = to_table(v.select("vec_id", "node").join(named, "node", "left"), "pq-rows")
    drop_tables(v, nodes, roots, *parts)
    first = rows.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = rows.join(first, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _cells(nodes: DataFrame, dim: int, r: float, least: float) -> DataFrame:
    """Links of ``nodes(node, label, x, n)``: kind 0 (node, n: its links), kind 1 (node, other: an edge)."""
    count = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).first()
    lists = min(SAMPLE // PER_CENTROID, max(1, round(count["n"] / max(1, count["labels"]) / LIST)))
    sample = nodes.orderBy("node").limit(SAMPLE).select("x").collect()  # nodes are digests
    x = np.array([s["x"] for s in sample]).reshape(-1, dim)
    index = Index.fit(_length_one(x), lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            u = _unit(batch.column(2), dim)
            home = _nearest(u, index.centre)
            code, error = index.encode(u, home)
            q, to = index.probes(u, r)
            row = np.concatenate([np.arange(len(u)), q])
            coded = pa.array([c.tobytes() for c in code] + [None] * len(q), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), batch.column(3).take(pa.array(row)),
                 pa.array(np.concatenate([home, to])), coded, pa.array(np.concatenate([error, np.zeros(len(q))]))],
                names=["node", "label", "x", "n", "list", "code", "error"],
            )

    label_type = nodes.schema["label"].dataType.simpleString()
    placed = nodes.select("node", "label", "x", "n").mapInArrow(place, f"node binary, label {label_type}, x {nodes.schema['x'].dataType.simpleString()}, n long, list long, code binary, error double")
    placed = to_table(placed, "pq-placed")
    sizes = placed.groupBy("label", "list").agg(F.count("code").alias("coded"), F.count(F.lit(1)).alias("rows")).where("coded > 0")
    sizes = sizes.select("label", "list", F.ceil(F.col("coded") / BLOCK).alias("bs"), F.ceil((F.col("rows") - F.col("coded")) / BLOCK).alias("qs"))
    joined = placed.join(sizes, ["label", "list"])
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    coded = joined.where("code is not null").select("*", mine("bs").alias("i"), F.explode(F.expr("sequence(0L, qs - 1)")).alias("j"))
    asked = joined.where("code is null").select("*", F.explode(F.expr("sequence(0L, bs - 1)")).alias("i"), mine("qs").alias("j"))
    cells = coded.unionByName(asked).select("label", "list", "i", "j", "node", "x", "n", "code", "error")

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_query = np.asarray(table.column("code").is_null())
        b, q = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        names = np.frombuffer(b"".join(table.column("node").to_pylist()), "V16")
        n = np.asarray(table.column("n"))
        if not len(b) or not len(q):
            return pa.table({"kind": pa.array([], pa.int32()), "node": pa.array([], pa.binary()), "other": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        u = _unit(table.column("x").combine_chunks(), dim)
        code = np.frombuffer(b"".join(table.column("code").take(pa.array(b)).to_pylist()), np.uint8).reshape(len(b), -1)
        i, j = index.near(u[q], int(table.column("list")[0].as_py()), code, np.asarray(table.column("error"))[b], r)
        all_, back = np.unique(names, return_inverse=True)
        keep = back[q[i]] != back[b[j]]
        i, j = i[keep], j[keep]
        cos = np.einsum("ij,ij->i", u[q[i]], u[b[j]]) if len(i) else np.zeros(0)
        i, j = i[cos >= least], j[cos >= least]
        total = np.bincount(i, n[b[j]], len(q)).astype(np.int64) if len(i) else np.zeros(len(q), np.int64)
        has = np.flatnonzero(total)
        # The graph of a cell is passed on as one edge for each vector, to the least of its group.
        group = _groups(back[q[i]], back[b[j]], len(all_))
        far = np.flatnonzero(group != np.arange(len(all_)))
        return pa.table({
            "kind": pa.array([0] * len(has) + [1] * len(far), pa.int32()), "node": pa.array([x.tobytes() for x in [*names[q[has]], *all_[far]]], pa.binary()),
            "other": pa.array([None] * len(has) + [x.tobytes() for x in all_[group[far]]], pa.binary()), "n": pa.array([*total[has].tolist(), *[0] * len(far)], pa.int64()),
        })

    out = to_table(cells.groupBy("label", "list", "i", "j").applyInArrow(link, "kind int, node binary, other binary, n long"), "pq-links")
    drop_tables(placed)
    return out


def recall(found: set[tuple[int, int]], all_: set[tuple[int, int]]) -> float:
    """Share of ``all_`` links that were found; 1 if there are none."""
    return len(found & all_) / len(all_) if all_ else 1.0
