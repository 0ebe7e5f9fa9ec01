"""Merkle manifest of a data set, with a proof for every row.

Rows are leaves.  Each group's leaves, in order, are hashed 16 at a time, level by level, to the
group's subroot, and the subroots, in the order of the groups, to the root.  Trees live in an
external node store: sorted runs of leaves stream into Parquet that is partitioned by level, whose
rows are the families of up to 16 sisters with the hash that they make.  A level is made from the
one below it alone, at a 16th of its size.  Proofs are merged down by coordinate: a family is joined
with the steps from its hash to the root, which all its members share, so what is shuffled for a
proof is a 16th of what it says.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field as made

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import new_folder
from .ordering import placed
from .shared import to_table

FAN = 16
#: The columns of a document that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A step of a proof: the sisters' digests before and after the node.
STEPS = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields put together."""
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def fold(node: Column, steps: Column) -> Column:
    """The root that a node's hash and the steps of its proof make."""
    return F.aggregate(steps, node, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


@dataclass
class Store:
    """A node store: levels of families ``(tree, block, n, members, hash)``, ``n`` being the tree's nodes on the level above."""

    path: str
    #: the groups' trees, from the leaves up, and the tree of their subroots
    lower: list[DataFrame] = made(default_factory=list)
    upper: list[DataFrame] = made(default_factory=list)
    #: leaves that are their group's only one
    lone: DataFrame | None = None
    #: ``(tree, level, subroot, steps)`` of each group, the steps being those from the subroot to the root
    subroots: DataFrame | None = None
    #: null for an empty table
    root: str | None = None


def _grow(nodes: DataFrame, path: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes(tree, place, n, hash, ...)``, and the last nodes ``(tree, level, hash)``."""
    spark = nodes.sparkSession
    width = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    levels: list[DataFrame] = []
    done = nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "hash")
    while width > 1:
        at = f"{path}/level={len(levels)}"
        member = F.struct("place", "hash", *[c for c in nodes.columns if c not in ("tree", "place", "n", "hash")])
        families = nodes.where("n > 1").groupBy("tree", F.floor(F.col("place") / FAN).alias("block"))
        families = families.agg(F.ceil(F.first("n") / FAN).alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
        families = families.withColumn("hash", F.sha2(F.array_join("members.hash", ""), 256))
        families.write.parquet(at)
        levels.append(spark.read.schema(families.schema).parquet(at))
        nodes = levels[-1].select("tree", F.col("block").alias("place"), "n", "hash")
        done = done.unionByName(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "hash"))
        width = math.ceil(width / FAN)
    return levels, done


def _down(level: DataFrame, ways: DataFrame, carry: list[str]) -> DataFrame:
    """Members of a level's families, each with its ``steps`` to the root: its sisters, then those of its parent."""
    w = ways.select(F.col("tree").alias("t_"), F.col("place").alias("b_"), F.col("steps").alias("rest_"), *carry)
    joined = level.join(w, F.col("tree").eqNullSafe(F.col("t_")) & (F.col("block") == F.col("b_")))

    def step(m: Column, i: Column) -> Column:
        before, after = F.slice("members.hash", F.lit(1), i), F.slice("members.hash", i + 2, F.lit(FAN))
        return F.struct(m.alias("m"), F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    each = joined.select("tree", "rest_", *carry, F.explode(F.transform("members", step)).alias("s_"))
    steps = F.concat(F.array(F.struct("s_.before", "s_.after")), "rest_")
    return each.select("tree", "s_.m.*", steps.alias("steps"), *carry)


def build(rows: DataFrame, group: str, order: str, leaf_hash: str, path: str | None = None) -> Store:
    """The node store of ``rows``, whose column ``leaf_hash`` is the leaf; other columns stay with the leaves.

    Each value of ``group`` (null is one) has a tree, whose leaves ascend by ``order`` (null first),
    equal ones by hash.  ``path`` is a folder for the store, by default one in the shared folder that
    lasts as long as the application.  An empty table gives a store without levels and root.
    """
    spark = rows.sparkSession
    store = Store(path or new_folder(spark, "merkle"))
    rest = [c for c in rows.columns if c not in (group, leaf_hash)]
    named = rows.select(F.col(group).alias("tree"), F.col(leaf_hash).alias("hash"), *[F.col(c).alias(f"in_{c}") for c in rest])
    leaves = placed(named, ["tree"], [f"in_{order}", "hash"], "merkle-leaves").withColumnRenamed("total", "n")
    store.lower, done = _grow(leaves, f"{store.path}/groups")
    store.lone = leaves.where("n = 1").select("tree", "place", "hash", *[f"in_{c}" for c in rest])
    done = to_table(done, "merkle-subroots")
    trees = placed(done.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["tree"], ["name"], "merkle-trees")
    trees = trees.withColumnRenamed("total", "n")
    store.upper, top = _grow(trees, f"{store.path}/top")
    root = top.first()
    store.root = root and root["hash"]
    none = F.array().cast(STEPS)
    if store.upper:
        ways = spark.range(1).select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("place"), none.alias("steps"))
        for level in reversed(store.upper):
            ways = _down(level, ways, [])
    else:  # at most one tree, whose subroot is the root
        ways = trees.select("name", none.alias("steps"))
    ways = ways.select(F.col("name").alias("name_"), "steps")
    with_ways = done.join(ways, F.col("tree").eqNullSafe(F.col("name_"))).select("tree", "level", F.col("hash").alias("subroot"), "steps")
    store.subroots = to_table(with_ways, "merkle-ways")
    return store


def proofs(store: Store) -> DataFrame:
    """Every leaf with its proof: the rows' columns under ``in_`` names, ``tree``, ``hash``, ``subroot`` and ``steps``."""
    ways: DataFrame | None = None
    columns = ["tree", "place", "steps", "subroot"]
    for k in range(len(store.lower), 0, -1):
        own = store.subroots.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("place"), "steps", "subroot")
        ways = _down(store.lower[k - 1], own if ways is None else ways.select(columns).unionByName(own), ["subroot"])
    single = store.subroots.where("level = 0").select(F.col("tree").alias("t_"), "steps", "subroot")
    lone = store.lone.join(single, F.col("tree").eqNullSafe(F.col("t_"))).drop("t_")
    return lone if ways is None else ways.unionByName(lone)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``order``, leaf, subroot, root, the proof's digest, and a test of it against tampering.

    Where 5 divides the CRC-32 of the id in decimal, the text is tampered with: A-Z become a-z.
    ``folded_root`` is made from the leaf that this gives and the true proof, ``verified`` says
    whether it is the root.  Nulls in any column are part of the leaf, a null id is not tampered with
    and comes first, a null group is a group; repeated rows are leaves of their own beside each other;
    an empty text is no null.  An empty table gives an empty one; other columns are not read.
    """
    true = [F.col(c) for c in fields]
    false = [F.translate(c, UPPER, LOWER) if c == text_col else F.col(c) for c in fields]
    forged = F.when(F.crc32(F.col(order).cast("string")) % 5 == 0, leaf(false))
    rows = docs.select(F.col(group).alias("group"), F.col(order).alias("id"), leaf(true).alias("leaf"), forged.alias("forged"))
    store = build(rows, "group", "id", "leaf")
    root = F.lit(store.root).cast("string")
    out = proofs(store).select(
        F.col("in_id").alias(order), F.col("hash").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"),
        fold(F.coalesce("in_forged", "hash"), F.col("steps")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
