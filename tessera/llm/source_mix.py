"""Mixing sources to target weights by Poisson replication.

A source with weight w among rows of total size T gets a mean repetition rate of
w * T / (its own size), so that its expected share of the output is w.  Each document's number
of copies is a Poisson draw of that mean, by inversion of the distribution at a uniform number
hashed from seed, id and text.  Copies are exploded and put in a global order that is hashed
too, so a run can be repeated row by row, on any number of executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop_tables
from .shared import to_table

#: Up to so many sources their rates are broadcast; beyond, they are joined by source.
BROADCAST_SOURCES = 10_000
#: Rates are split into parts of at most this mean, whose draws are added up.
PART = 8.0
#: Terms of the distribution function that are looked at; beyond them is less than 1e-16.
TERMS = 48


def uniform(seed: int, *what: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(w.cast("string"), F.lit("")) for w in what]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def sizes(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, n)``: characters of each source's texts, one at least for each row."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long")).alias("n"))


def rates(by_source: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``(source, rate)``: the mean number of copies.

    ``weights`` names sources and their shares (any scale); others get none.  Without it, the
    shares are proportional to size to the power ``alpha``, which lifts small sources.  The
    output has about ``epochs`` times the size of the input.
    """
    if weights is not None:
        for k, v in weights.items():
            if not (v >= 0 and math.isfinite(v)):
                raise ValueError(f"weight of {k!r}: {v}")
        table = by_source.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        share = by_source.join(F.broadcast(table), "source", "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    else:
        share = by_source.select("source", "n", F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("w"))
    total = share.agg(F.sum("n").alias("t"), F.sum("w").alias("s")).first()
    if not total["s"]:
        return share.select("source", F.lit(0.0).alias("rate"))
    return share.select("source", (F.col("w") / F.lit(total["s"]) * F.lit(float(total["t"]) * epochs) / F.col("n")).alias("rate"))


def poisson(u: Column, mean: Column) -> Column:
    """The least k whose distribution function exceeds ``u``, for means up to ``PART``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.when(u >= a["c"], a["k"] + 1).otherwise(a["k"]).alias("k"))

    return F.reduce(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["k"])


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs``, all columns, each row as often as drawn, in a random global order.

    Appended: ``copy_no`` (long, from 0) and ``mix_key`` (string, by which rows are ordered); a
    column of such a name in ``docs`` gets the suffix ``_in``.  A null source is a source of
    its own; null texts count as one character; rows equal in id and text are drawn alike.
    An empty table gives an empty one.
    """
    names = [f"{c}_in" if c in ("copy_no", "mix_key") else c for c in docs.columns]
    by_source = to_table(sizes(docs, source_col, text_col), "mix-sizes")
    table = to_table(rates(by_source, weights, alpha, epochs).where("rate > 0"), "mix-rates")
    drop_tables(by_source)
    few = table.count() <= BROADCAST_SOURCES
    table = table.select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"))
    d = docs.toDF(*names)
    text_md5 = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    joined = d.join(F.broadcast(table) if few else table, F.col(source_col).eqNullSafe(F.col("mix_source")))
    joined = joined.select(*names, "mix_rate", F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_md5).alias("mix_id"))
    n_parts = F.greatest(F.ceil(F.col("mix_rate") / PART), F.lit(1)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), n_parts), lambda i: uniform(seed, F.lit("n"), i, F.col("mix_id")))
    joined = joined.select(*names, "mix_id", (F.col("mix_rate") / n_parts).alias("mix_mean"), draws.alias("mix_u"))
    n = F.reduce(F.transform("mix_u", lambda u: poisson(u, F.col("mix_mean"))), F.lit(0), lambda a, k: a + k)
    copies = joined.select(*names, "mix_id", n.alias("mix_n")).where("mix_n > 0")
    copies = copies.select(*names, "mix_id", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)).alias("copy_no"))
    copies = copies.withColumn("copy_no", F.col("copy_no").cast("long"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("o"), F.col("copy_no").cast("string"), F.col("mix_id")).cast("binary"))
    return copies.select(*names, "copy_no", key.alias("mix_key")).orderBy("mix_key")
