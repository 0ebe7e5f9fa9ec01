"""Helpers that several operators use: shared tables, connected components."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..tables import drop_tables

#: Rows that travel to and from Python together while a table is written: texts are long.
BATCH_ROWS, _ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once an application, should they not have it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        base = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera"
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", top.parent, top.name))
        _shipped.add(app)


def to_table(df: DataFrame, name: str) -> DataFrame:
    """``tables.to_table`` with small Arrow batches; the session's own size is put back."""
    conf = df.sparkSession.conf
    rows = conf.get(_ROWS, "10000")
    try:
        if not 0 < int(rows) <= BATCH_ROWS:
            conf.set(_ROWS, str(BATCH_ROWS))
        return tables.to_table(df, name)
    finally:
        conf.set(_ROWS, rows)


#: Bytes of rows that are broadcast at most (they are measured first); more are joined by shuffle.
BROADCAST_BYTES = 32_000_000
#: What a row takes in a broadcast table besides its texts and binaries.
ROW_BYTES = 48


def is_small(table: DataFrame) -> bool:
    """Whether ``table`` may be broadcast, by the bytes of all its rows; read once to measure it."""
    sized = [F.octet_length(c) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) for c, t in table.dtypes if t not in ("long", "bigint", "int", "double", "boolean")]
    each = sum((F.coalesce(s, F.lit(0)).cast("long") for s in sized), F.lit(ROW_BYTES).cast("long"))
    return (table.agg(F.sum(each).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES


def rows_by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or is not (``left_anti``) in ``ids(id_)``, nulls included."""
    return docs.join(F.broadcast(ids) if is_small(ids) else ids, docs[id_col].eqNullSafe(ids["id_"]), how)


def connected_components(edges: DataFrame, name: str, rounds: int = 50) -> DataFrame:
    """``(node, root)``: for each node of ``edges(src, dst)`` one node of its component, the same for all.

    Every node goes to its neighbour of least hash, or stays if its own is less; edges are then drawn
    between the nodes gone to, once each, and those within one node go.  As hashes are random, each
    round has a fraction of the edges, long paths included.  When none is left, the rounds' maps are put together from the last to the first.
    Edges and maps stay distributed; nodes with many edges are only ever aggregated partially or
    dealt out by a splittable join.  Nulls in an edge drop the edge; an empty input gives an empty
    result; if ``rounds`` don't suffice, RuntimeError.
    """
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null and a <> b")
    e = to_table(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while e.limit(1).count():
        if len(maps) == rounds:
            raise RuntimeError(f"{name}: components did not settle in {rounds} rounds")
        ends = e.select(F.col("a").alias("node"), "b").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("b")))
        least = ends.groupBy("node").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("m"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("b"))
        to = to_table(least.select("node", F.least("m", own)["b"].alias("root")), f"{name}-labels")
        maps.append(to)
        last, drawn = e, e.join(to.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        e = to_table(drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
        drop_tables(last)
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for to in reversed(maps[:-1]):
        out = to.join(out.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = to_table(out, f"{name}-roots")
    drop_tables(e, *maps)
    return out
