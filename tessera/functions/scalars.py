"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value.
NULL_TEXTS = ("", "nan", "None")
NULL_LABELS = (*NULL_TEXTS, "unknown")


def clean_text(c: Column | str) -> Column:
    """Text of a value, null where it is missing or one of ``NULL_TEXTS``."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(~text.isin(*NULL_TEXTS), text)


def valid_label(c: Column | str) -> Column:
    """True where a label says something."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(~text.isin(*NULL_LABELS), F.lit(False))


def or_missing(c: Column | str, by: str = "missing") -> Column:
    return F.coalesce(clean_text(c), F.lit(by))


def normal_id(c: Column | str) -> Column:
    """Ids that are whole numbers as plain integers (``7.0`` as ``7``), others as they are."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    number = text.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9e15) & (number == F.floor(number))
    return F.when(whole, number.cast("long").cast("string")).otherwise(text)


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def first_true(*cols: Column) -> Column:
    """The first of ``cols`` that is neither null, zero nor empty text."""
    return F.coalesce(*[F.when((c.cast("string") != "") & ~F.coalesce(c.cast("string").try_cast("double") == 0, F.lit(False)), c) for c in cols])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector at length one; as it is if its length is zero."""
    scaled = lambda n: F.transform(a, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))
    return F.get(F.transform(F.array(F.sqrt(dot(a, a))), scaled), F.lit(0))  # the length is taken once, not for each component


def hash_order(*cols: Column) -> Column:
    """A sort key that looks random, equal on every engine and partitioning."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
