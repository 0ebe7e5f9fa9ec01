"""Shards that each match the mixture of sources, by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; the rank as a fraction of the source's
size puts all sources on one scale, on which each is spread evenly.  Sorted by that fraction, any
stretch of rows has the sources in proportion, so the order is cut into shards of equal length.
Both orders are over sorted runs (``ordering.placed``), so no source meets in one task; only ids,
sizes and hashes are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import drop_placed, placed

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def shuffle_key(seed: int, *what: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(w.cast("string"), F.lit("")) for w in what]).cast("binary"))


def shards(
    docs: DataFrame, n: int = SHARDS, by: str = "rows", seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of each row, and the columns ``keep`` as ``keep_<name>``.

    ``by="rows"`` cuts shards whose counts differ by one at most, ``by="bytes"`` where the sizes of
    the rows before pass a shard's share of all bytes.  ``slot`` is the place in the shard, from 0.
    A null source is a source; a null text has no bytes; rows equal in id and text are
    interchangeable; a null id counts as an empty one in the hash.  An empty table gives an empty one.
    """
    if by not in ("rows", "bytes"):
        raise ValueError(f"no such law: {by!r}")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), crc.alias("text_crc32"),
        shuffle_key(seed, F.col(id_col), crc).alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    kept = ["id", "source", "size", "text_crc32", "key", *[f"keep_{c}" for c in keep]]
    ranked = placed(rows, ["source"], ["key"], "shards-source")
    mixed = ranked.select(*kept, ((2 * F.col("place") + 1) / (2 * F.col("total"))).alias("fraction"))
    out = placed(mixed, [], ["fraction", "source", "key"], "shards-all", "size" if by == "bytes" else None)
    drop_placed(ranked)
    if by == "rows":
        shard = F.expr(f"place * {n} div total")
        slot = F.col("place") - F.expr(f"(shard * total + {n - 1}) div {n}")
        out = out.withColumn("shard", shard).withColumn("slot", slot)
    else:
        out = out.withColumn("shard", F.expr(f"before * {n} div weight_total"))
        firsts = out.groupBy("shard").agg(F.min("place").alias("first_"))
        out = out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("first_"))
    return out.select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", *[f"keep_{c}" for c in keep])


def write_shards(docs: DataFrame, path: str, n: int = SHARDS, by: str = "rows", seed: int = 0, **columns: str) -> None:
    """Write all columns of ``docs`` as Parquet folders ``shard=<k>`` under ``path``, each in the order of its slots.

    A column of ``docs`` named ``shard`` or ``slot`` gets the suffix ``_in``.
    """
    placed_rows = shards(docs, n, by, seed, keep=tuple(docs.columns), **columns)
    rows = placed_rows.select("shard", "slot", *[F.col(f"keep_{c}").alias(f"{c}_in" if c in ("shard", "slot") else c) for c in docs.columns])
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
