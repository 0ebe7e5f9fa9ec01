"""Places of rows in the order of their group, whatever share of the rows a group has."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import drop_tables
from .shared import is_small, to_table

#: Rows of a run on average, should the session's shuffle partitions not make them smaller.
RUN_ROWS = 500_000
#: ``monotonically_increasing_id`` has the partition above these bits and the row below them.
ROW_BITS = 33


def placed(table: DataFrame, group: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """``table`` with ``place`` (from 0, by ``order`` within ``group``) and ``total`` (rows of the group).

    With ``weight``, also ``before`` and ``weight_total``: the sums of that column over the group's
    earlier rows and over all of it.  Nulls come first and are a value like others; rows that are
    equal in ``group`` and ``order`` are told apart by where they were read.

    Rows are dealt to sorted runs over the order of (group, order, where read), so that a group is
    spread over as many runs as its size asks for.  Runs are written: their bounds come from a sample
    and may differ when drawn again.  What is gathered is one row for each run and group in it.
    """
    spark = table.sparkSession
    read = to_table(table.withColumn("read_", F.monotonically_increasing_id()), f"{name}-rows")
    n_runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(read.count() / RUN_ROWS))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order, "read_"]]
    at = F.monotonically_increasing_id()
    dealt = read.repartitionByRange(n_runs, *keys).sortWithinPartitions(*keys).select(*table.columns, at.alias("at_"))
    runs = to_table(dealt.withColumn("run_", F.shiftright("at_", ROW_BITS)), f"{name}-runs")
    drop_tables(read)
    named = [F.col(c).alias(f"g{i}_") for i, c in enumerate(group)]
    by = [f"g{i}_" for i in range(len(group))]
    sums = [F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_")]
    if weight:
        sums.append(F.sum(weight).alias("w_"))
    each = runs.select(*runs.columns, *named).groupBy(F.col("run_").alias("r_"), *by).agg(*sums)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = whole.orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    more = [before("w_").alias("w_below_"), F.sum("w_").over(whole).alias("weight_total")] if weight else []
    starts = to_table(each.select("r_", *by, (before("n_") - F.col("first_")).alias("shift_"), F.sum("n_").over(whole).alias("total"), *more), f"{name}-starts")
    on = [F.col("run_") == F.col("r_"), *[F.col(c).eqNullSafe(F.col(g)) for c, g in zip(group, by, strict=True)]]
    both = runs
    if weight:
        earlier = Window.partitionBy("run_", *group).orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
        both = runs.withColumn("w_before_", F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    both = both.join(F.broadcast(starts) if is_small(starts) else starts, _all(on))
    sums = [(F.col("w_below_") + F.col("w_before_")).alias("before"), F.col("weight_total")] if weight else []
    out = both.select(*table.columns, (F.col("at_") + F.col("shift_")).alias("place"), "total", *sums)
    out._read_from = [runs, starts]
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def drop_placed(placed_rows: DataFrame) -> None:
    """Delete the runs behind what ``placed`` returned, once nothing reads it any more."""
    drop_tables(*placed_rows.__dict__.pop("_read_from", []))
