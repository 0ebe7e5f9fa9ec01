"""Global ranks and running totals without gathering a table in one task."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import to_table

#: Rows of a range, on average; the driver gets one number for each range.
PER_RANGE = 1_000_000
#: ``monotonically_increasing_id`` has the partition above these bits and the row below them.
ROW_BITS = 33


def _ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ranges of the order, as a table, with the range ``part_`` and the place ``at_`` in it.

    It is written, as the bounds of ranges come from a sample and may differ from run to run.
    """
    parts = max(1, math.ceil(df.count() / PER_RANGE))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    part, at = F.shiftright("place_", ROW_BITS).cast("int"), F.col("place_").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return to_table(dealt.select(*df.columns, part.alias("part_"), at.alias("at_")), "ranges")


def _below(table: DataFrame, value: Column) -> DataFrame:
    """``(part_, below_)``: the total of all lower ranges."""
    sums = sorted((r["part_"], r["s"]) for r in table.groupBy("part_").agg(F.sum(value).alias("s")).collect())
    rows, total = [], 0
    for part, s in sums:
        rows.append((part, total))
        total += s or 0
    kind = table.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    ranges = pa.table({"part_": [p for p, _ in rows], "below_": [b for _, b in rows]}) if rows else pa.table({"part_": pa.array([], "int32"), "below_": pa.array([], "int64")})
    below = table.sparkSession.createDataFrame(ranges)  # by Arrow, which needs no Python worker
    return F.broadcast(below.select(F.col("part_").cast("int").alias("part_"), F.col("below_").cast(kind).alias("below_")))


def global_rank(df: DataFrame, value: str, tie: str, name: str = "rank0", more: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the rank (from 0) by value (nulls first), the columns ``more``, then tie.

    Rows are dealt to ranges of the whole order, so equal values don't meet in one task; each
    is sorted in its range and moved up by the sizes of the ranges below.
    """
    table = _ordered(df, [F.col(value).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in more], F.col(tie).asc_nulls_first()])
    ranked = table.join(_below(table, F.lit(1).cast("long")), "part_")
    return ranked.select(*df.columns, (F.col("at_") + F.col("below_")).alias(name))


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, by ``order``, which tells rows apart; 0 for the first."""
    table = _ordered(df, [F.col(c).asc_nulls_first() for c in order])
    before = F.sum(value).over(Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1))
    summed = table.withColumn("before_", F.coalesce(before, F.lit(0))).join(_below(table, F.col(value)), "part_")
    return summed.select(*df.columns, (F.col("before_") + F.col("below_")).alias(name))
