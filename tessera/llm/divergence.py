"""Divergence of the sources of each language, by the terms that they use.

Every pair of sources starts at a baseline, V times the value of a term that neither has.  An
inverted index of the terms then says where that is wrong: what a source's own terms change against
sources without them follows from how often it has each count, and postings of sources that share a
term emit the rest, which is not zero only there.  So the work follows the postings, not sources times
vocabulary.  A source's terms against its whole language are ranked in windows.

Terms are counted in Arrow batches, gathered over many texts before they leave a task, and dealt by
language and term, so that no source meets in one task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import is_small, to_table
from .words import chunks

#: Documents of its language that a term must be in.
LEAST_DOCS = 10
#: Terms of each source that are reported.
TOP = 10
#: Shares are counted in these.
UNIT = 1_000_000_000
#: Entries that a task holds before it hands them on.
HELD = 300_000
#: Bytes of a text that are taken apart together.
PIECE = 1 << 20
_LETTERS = frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B))
#: A-Z lower-cased, bytes of other code points kept, all else a space.
_TABLE = bytes(b + 0x20 if 0x41 <= b < 0x5B else b if b in _LETTERS or b >= 0x80 else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n long, n_docs long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of about ``PIECE`` bytes."""
    raw, at = text.translate(_TABLE), 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, and documents with them, of each term of (lang, source); several rows may stand for one term."""
    occurs: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
    within: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in occurs.items():
            n = len(found)
            have = within[lang, source]
            columns = [
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()),
                pa.array(list(found.values()), pa.int64()), pa.array([have[t] for t in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])
        occurs.clear()
        within.clear()

    entries = 0
    for batch in batches:
        for part in chunks(batch, 2):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                found, distinct = occurs[lang, source], set()
                entries -= len(found)
                for some in terms(text):
                    found.update(some)
                    distinct.update(some)
                entries += len(found)
                within[lang, source].update(distinct)
                if entries >= HELD:
                    yield from hand_on()
                    entries = 0
    yield from hand_on()


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * v)), whatever the size of the counts."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.call_function("div", whole, (total + 2 * v).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(F.broadcast(right) if is_small(right) else right, on)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source is from others, and which terms set it apart.

    Part ``pair`` has a row for each ordered pair of sources of a language, part ``term`` the ``top``
    terms that a source uses more than its language.  Null text, language and source are ''; empty
    texts have no terms, but their source is one; repeated rows count as often as they stand there;
    ties of value go by item.  An empty table gives an empty one; other columns are not read.
    """
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    # all rows of a (lang, term) go to one place, where documents are added up over the sources
    counted = d.mapInArrow(_count, COUNTS).repartition("lang", "term")
    each = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    of_term = Window.partitionBy("lang", "term")
    one = F.row_number().over(of_term.orderBy("source")) == 1  # one posting of each term says what the language has
    index = each.select("lang", "source", "term", "n", F.sum("n_docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("in_lang"), one.alias("one"))
    index = to_table(index.where(F.col("in_docs") >= least_docs).drop("in_docs"), "audit-index")

    langs = index.where("one").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total"))
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.coalesce("total", F.lit(0))
    groups = groups.select("lang", "source", zero.alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    nothing = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.when(F.col("v") > 0, F.col("v"))))
    groups = to_table(groups.withColumn("z", nothing), "audit-groups")

    shared = _joined(index, groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    pairs = _pairs(shared, groups)
    q = share(F.col("in_lang"), F.col("lang_total"), F.col("v"))
    above = shared.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q")
    own = above.select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(own)


def _pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value)`` of all ordered pairs of sources of a language."""
    a = groups.where("v > 0").select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.col("total").alias("nb"))
    both = a.join(b, "lang").where("a <> b")
    base = both.where("a < b").select("lang", "a", "b", (F.col("v") * gap(F.col("za"), F.col("zb"))).alias("value"))

    # a term that only ``a`` has: the change depends on its count in ``a`` and on b's share of nothing
    often = shared.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("k"))
    change = F.col("k") * (gap(F.col("p"), F.col("zb")) - gap(F.col("za"), F.col("zb")))
    alone = _joined(often, to_table(both, "audit-both"), ["lang", "a"]).where("p <> za")
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), change.alias("value")).where("value <> 0")

    # a term of both: the two changes above are taken back for what it really is
    post = shared.select("lang", "term", "source", "p", "z")
    x = post.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    y = post.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    rest = gap(pa_, pb) - gap(pa_, zb) - gap(za, pb) + gap(za, zb)
    met = x.join(y, ["lang", "term"]).where("a < b").select("lang", "a", "b", rest.alias("value")).where("value <> 0")

    summed = base.unionByName(alone).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    none = groups.where("v = 0").select("lang", F.col("source").alias("a"))
    none = none.join(none.select("lang", F.col("a").alias("b")), "lang").where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    half = to_table(summed.unionByName(none), "audit-pairs")
    part = F.lit("pair").alias("part")
    return half.select("lang", F.col("a").alias("source"), part, F.col("b").alias("item"), "value").unionByName(
        half.select("lang", F.col("b").alias("source"), part, F.col("a").alias("item"), "value"))
