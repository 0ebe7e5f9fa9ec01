"""Nearest neighbours: in the plane by cells of like population, among embeddings by blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..tables import drop_tables, to_table
from .ranking import global_rank

#: Points of a cell in the plane; rows of an embedding block, and how many of them are compared at once.
PER_CELL, BLOCK, AT_ONCE = 256, 4096, 512
#: Blocks of a scope before they grow, and how far they do.
MOST, LARGEST = 10, 32


def _distances(q: pa.Table, d: pa.Table) -> np.ndarray:
    """Distance of each row of ``q`` to each of ``d``; infinite to itself."""
    x, y = (np.asarray(q.column(c))[:, None] - np.asarray(d.column(c))[None, :] for c in ("x", "y"))
    out = np.sqrt(x * x + y * y)
    mine, other = (t.column("id").to_pandas().to_numpy() for t in (q, d))
    out[mine[:, None] == other[None, :]] = np.inf
    return out


def _cells(points: DataFrame, n: int, per_cell: int) -> DataFrame:
    """``points`` with ``strip`` and ``cell``: strips of like population by x, in them cells by y."""
    strips = max(1, math.isqrt(n // per_cell))
    d = global_rank(points, "x", "id", "rx_", more=("y",)).withColumn("strip", F.expr(f"cast(rx_ * {strips} div {n} as int)"))
    # A strip has about the root of n * per_cell points.
    size = F.count(F.lit(1)).over(Window.partitionBy("strip"))
    turn = F.row_number().over(Window.partitionBy("strip").orderBy("y", "x", "id")) - 1
    d = d.withColumn("n_", size).withColumn("ry_", turn).withColumn("m_", F.greatest(F.expr(f"n_ div {per_cell}"), F.lit(1)))
    return to_table(d.select("id", "x", "y", "strip", F.expr("cast(ry_ * m_ div n_ as int)").alias("cell")), "knn-cells")


def spatial_knn(points: DataFrame, k: int, id_col: str = "region_id", per_cell: int = PER_CELL) -> DataFrame:
    """``(region_id, neighbor_id, rank, dist)``: the k nearest others (Euclid), ties to the lesser id.

    The distance of a point's k-th neighbour in its own cell bounds the search; it then visits just
    the cells that this circle meets, and each cell returns its k best.  At one place only the
    k + 1 least ids can be anyone's neighbours, so the others take their answer from these and
    crowds at one place cost nothing.  Rows with coordinates that aren't finite have no
    neighbours and are none; ids tell rows apart.
    """
    p = points.select(F.col(id_col).alias("id"), F.col("x").cast("double"), F.col("y").cast("double")).where(finite("x") & finite("y"))
    kind = p.schema["id"].dataType.simpleString()
    turn = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    few = to_table(p.withColumn("turn", turn).where(F.col("turn") <= k + 1), "knn-points")
    n = few.count()
    if n < 2 or k < 1:
        return p.sparkSession.createDataFrame([], f"region_id {kind}, neighbor_id {kind}, rank int, dist double")
    per_cell = max(per_cell, 2 * (k + 1))
    data = _cells(few.select("id", "x", "y"), n, per_cell)
    box = [f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in ((0, F.min), (1, F.max))]
    strips = data.groupBy("strip").agg(*box[:2]).orderBy("strip").collect()  # the root of n / per_cell rows
    low, high = (np.array([s[c] for s in strips]) for c in ("x0", "x1"))

    def reach(table: pa.Table) -> pa.Table:
        """Each point of a cell with the strips that its circle meets."""
        r = np.empty(table.num_rows)
        for a in range(0, len(r), AT_ONCE):
            d = _distances(table.slice(a, AT_ONCE), table)
            r[a : a + AT_ONCE] = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        r = r * (1 + 1e-9) + 1e-300
        x = np.asarray(table.column("x"))
        first, last = np.searchsorted(high, x - r), np.searchsorted(low, x + r, side="right")
        count = np.maximum(last - first, 0)
        row = np.repeat(np.arange(len(r)), count)
        strip = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        out = table.select(["id", "x", "y"]).take(pa.array(row))
        return out.append_column("r", pa.array(r[row])).append_column("strip", pa.array(strip.astype(np.int32)))

    asked = data.groupBy("strip", "cell").applyInArrow(reach, f"id {kind}, x double, y double, r double, strip int")

    def visit(q: pa.Table, cells: pa.Table) -> pa.Table:
        """Each point with the cells of one strip that its circle meets."""
        y0, y1, x0, x1, cell = (np.asarray(cells.column(c)) for c in ("y0", "y1", "x0", "x1", "cell"))
        order = np.argsort(cell)
        y0, y1, x0, x1, cell = y0[order], y1[order], x0[order], x1[order], cell[order]
        x, y, r = (np.asarray(q.column(c)) for c in ("x", "y", "r"))
        first, last = np.searchsorted(y1, y - r), np.searchsorted(y0, y + r, side="right")
        count = np.maximum(last - first, 0)
        row = np.repeat(np.arange(len(y)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        dx, dy = (np.maximum(0, np.maximum(lo[at] - v[row], v[row] - hi[at])) for lo, hi, v in ((x0, x1, x), (y0, y1, y)))
        near = dx * dx + dy * dy <= (r * r)[row] * (1 + 1e-9)
        row, at = row[near], at[near]
        out = q.select(["id", "x", "y", "strip"]).take(pa.array(row))
        return out.append_column("cell", pa.array(cell[at]))

    boxes = data.groupBy("strip", "cell").agg(*box)
    visits = asked.groupBy("strip").cogroup(boxes.groupBy("strip")).applyInArrow(visit, f"id {kind}, x double, y double, strip int, cell int")

    def best(q: pa.Table, d: pa.Table) -> pa.Table:
        """The k nearest points of one cell for each that visits it."""
        parts = []
        d = d.sort_by("id")
        for a in range(0, q.num_rows, AT_ONCE):
            some = q.slice(a, AT_ONCE)
            dist = _distances(some, d)
            top = np.argsort(dist, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(dist, top, 1).ravel()
            ok = np.isfinite(value)
            row = np.repeat(np.arange(some.num_rows), top.shape[1])[ok]
            parts.append(pa.table({"region_id": some.column("id").take(pa.array(row)), "neighbor_id": d.column("id").take(pa.array(top.ravel()[ok])), "dist": pa.array(value[ok])}))
        return pa.concat_tables(parts) if parts else pa.table({"region_id": q.column("id"), "neighbor_id": q.column("id"), "dist": pa.array([], pa.float64())})

    found = visits.groupBy("strip", "cell").cogroup(data.groupBy("strip", "cell")).applyInArrow(best, f"region_id {kind}, neighbor_id {kind}, dist double")
    rank = Window.partitionBy("region_id").orderBy("dist", "neighbor_id")
    found = to_table(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("region_id", "neighbor_id", "rank", "dist"), "knn-found")
    # Whoever is not among the k + 1 least ids of a crowded place has the first k of them at distance 0.
    crowds = few.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list("id")).alias("ids")).where(F.col("c") == k + 1)
    rest = p.join(crowds, ["x", "y"]).where(~F.array_contains("ids", F.col("id")))
    rest = rest.select(F.col("id").alias("region_id"), F.posexplode(F.slice("ids", 1, k)).alias("pos", "neighbor_id")).select("region_id", "neighbor_id", (F.col("pos") + 1).alias("rank"), F.lit(0.0).alias("dist"))
    drop_tables(data)
    return found.unionByName(rest)


class Block:
    """Rows of one block: columns as in a frame, vectors as matrices."""

    def __init__(self, table: pa.Table) -> None:
        vectors = [f.name for f in table.schema if pa.types.is_list(f.type) or pa.types.is_large_list(f.type)]
        self._matrix = {}
        for c in vectors:
            flat = table.column(c).combine_chunks().flatten()
            self._matrix[c] = np.asarray(flat).astype(np.float64).reshape(table.num_rows, -1 if table.num_rows else 0)
        self.frame = table.drop_columns(vectors).to_pandas()

    def __getitem__(self, name: str) -> pd.Series:
        return self.frame[name]

    def __len__(self) -> int:
        return len(self.frame)

    def matrix(self, name: str) -> np.ndarray:
        return self._matrix[name]


def tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """Stretches of ``n`` rows against stretches of ``m`` others that are compared at a time."""
    for a in range(0, n, AT_ONCE):
        for b in range(0, m, BLOCK):
            yield slice(a, min(n, a + AT_ONCE)), slice(b, min(m, b + BLOCK))


def block_count(n: Column, block: int) -> Column:
    """Blocks of ``n`` rows: of ``block`` rows until there are ``MOST``, then larger ones up to ``LARGEST`` times that."""
    return F.greatest(F.least(F.ceil(n / block), F.lit(MOST)), F.ceil(n / (LARGEST * block)))


def block_pairs(
    rows: DataFrame, scope: str, fn: Callable[[Block, Block, bool], pd.DataFrame], schema: str, block: int = BLOCK, left: list[str] | None = None,
    right: list[str] | None = None, half: bool = False,
) -> DataFrame:
    """``fn(queries, data, same)`` over all pairs of blocks of each scope of ``rows``; ``same`` if both are one block.

    The number of pairs is quadratic, as the metrics are, but what is sent is not: there are
    ``MOST`` blocks of a scope, larger ones for more rows, so a row is sent that many times to each side, until
    blocks have ``LARGEST`` times ``block`` rows, which bounds a task.  Only what ``fn`` returns leaves it; it should go
    through its blocks in ``tiles``.  The sides get the columns ``left`` and ``right``, or all.  With ``half``, of two different
    blocks only one is the queries and the other the data.
    """
    n = rows.groupBy(scope).agg(block_count(F.count(F.lit(1)), block).alias("nb_"))
    d = rows.join(n, scope).withColumn("mine_", F.pmod(F.xxhash64("id"), F.col("nb_")))
    others = lambda first, last: F.explode(F.expr(f"sequence({first}, {last})"))
    q = d.select(*(left or rows.columns), F.col("mine_").alias("i_"), others("mine_" if half else "0L", "nb_ - 1").alias("j_"))
    other = d.select(*(right or rows.columns), others("0L", "mine_" if half else "nb_ - 1").alias("i_"), F.col("mine_").alias("j_"))
    other = other.toDF(*other.columns)  # columns of its own, as both sides come from the same rows
    kinds = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(q: pa.Table, data: pa.Table) -> pa.Table:
        if not q.num_rows or not data.num_rows:
            return kinds.empty_table()
        return pa.Table.from_pandas(fn(Block(q), Block(data), q.column("i_")[0] == q.column("j_")[0])[kinds.names], schema=kinds, preserve_index=False)

    return q.groupBy(scope, "i_", "j_").cogroup(other.groupBy(scope, "i_", "j_")).applyInArrow(run, schema)


def embedding_knn(rows: DataFrame, k: int, scope: str = "scope", block: int = BLOCK) -> DataFrame:
    """``(scope, id, neighbor_id, rank, score)``: the k others of greatest dot product in each scope.

    ``rows`` has scope, id and ``vec``; ties go to the lesser id; null vectors take no part.
    """
    rows = rows.select(scope, "id", "vec").where("vec is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def top(left: Block, right: Block, same: bool) -> pd.DataFrame:
        order = np.argsort(right["id"].to_numpy(), kind="stable")
        ids, y = right["id"].to_numpy()[order], right.matrix("vec")[order]
        mine, x, out = left["id"].to_numpy(), left.matrix("vec"), []
        for here, there in tiles(len(x), len(y)):
            if there.start == 0:
                value, near = np.empty((here.stop - here.start, 0)), np.empty((here.stop - here.start, 0), ids.dtype)
            score = x[here] @ y[there].T
            score[mine[here][:, None] == ids[there][None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            value = np.concatenate([value, np.take_along_axis(score, best, 1)], 1)
            near = np.concatenate([near, ids[there][best]], 1)
            best = np.argsort(-value, axis=1, kind="stable")[:, :k]  # lesser ids stand first
            value, near = np.take_along_axis(value, best, 1), np.take_along_axis(near, best, 1)
            if there.stop == len(y):
                out.append(pd.DataFrame({scope: np.repeat(left[scope].to_numpy()[here], near.shape[1]), "id": np.repeat(mine[here], near.shape[1]), "neighbor_id": near.ravel(), "score": value.ravel()}))
        out = pd.concat(out)
        return out[np.isfinite(out["score"])]

    found = block_pairs(rows, scope, top, f"{scope} string, id {kind}, neighbor_id {kind}, score double", block)
    order = Window.partitionBy(scope, "id").orderBy(F.desc("score"), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(scope, "id", "neighbor_id", "rank", "score")
