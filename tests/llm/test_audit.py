"""The manifest, the audit of sources and the sharding against brute force, on odd tables too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, merkle, stratified_shards
from tessera.llm.ordering import placed

RNG = random.Random(11)
WORDS = ["The", "of", "and", "Straße", "ÉTÉ", "x"] + ["".join(RNG.choice("abcdeü") for _ in range(RNG.randint(1, 4))) for _ in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)) + RNG.choice(["", ".", "\n", " 42", "\x00\x7f"])


def many(n, sources):
    return [(i * 3 - 50, prose(RNG.randint(0, 30)), RNG.choice(["en", "de", None]), RNG.choice(sources), i) for i in range(n)]


ODD = [
    (None, None, None, None, None), (1, "", "en", "b", 0), (1, "Equal Text", "en", "a", 10), (1, "Equal Text", "en", "a", 10), (2, "Equal Text", "en", "a", None),
    (None, "Equal Text", "", "é", 3), (-5, "Z" * 30_000, "de", "z", 1), (7, "lower", "de", "", 5),
]
TABLES = {"many": many(700, ["a"] * 9 + ["b", "c", None, "é", ""]), "one": many(1, ["a"]), "one source": many(40, ["a"]), "sources": many(60, [f"s{i}" for i in range(50)]), "odd": ODD}
CLASHING = ("tree", "place", "hash", "total", "term", "n", "shard", "slot", "key", "in_id", "total_", "value")


@pytest.fixture(scope="module", params=TABLES)
def rows(request):
    return TABLES[request.param]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("odd") for c in CLASHING}).repartition(3)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def grow(nodes):
    """Levels of a tree, from its leaves to its last node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def null_first(x):
    return (x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0)


def proof_of(levels, at):
    out = []
    for level in levels[:-1]:
        block = at // 16 * 16
        out.append((level[block:at], level[at + 1 : block + 16]))
        at //= 16
    return out


def brute_manifest(table):
    by_source = defaultdict(list)
    for row in table:
        by_source[row[3]].append(row)
    names = sorted(by_source, key=null_first)
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (null_first(r[0]), leaf_of(r)))
        trees[s] = grow([leaf_of(r) for r in by_source[s]])
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(by_source[s]):
            proof = proof_of(trees[s], i) + proof_of(top, k)
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            h = leaf_of((row[0], text, *row[2:]))
            for before, after in proof:
                h = sha(*before, h, *after)
            digest = sha(*[x for before, after in proof for x in (*before, *after)])
            out.append((row[0], leaf_of(row), trees[s][-1][0], top[-1][0], digest, h, h == top[-1][0]))
    return out


def test_manifest_equals_brute_force(docs, rows):
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_manifest(rows), key=str)


def test_store_has_a_row_for_each_family(spark, tmp_path):
    table = spark.createDataFrame(TABLES["many"], SCHEMA).select("source", "doc_id", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    path = f"file://{tmp_path}/store"
    store = merkle.build(table, "source", "doc_id", "leaf", path)
    assert [spark.read.parquet(f"{path}/groups/level={k}").count() for k in range(len(store.lower))] == [x.count() for x in store.lower]
    first = store.lower[0].select("tree", "block", F.size("members").alias("n"), "hash", F.col("members.hash").alias("m")).collect()
    assert all(r.n <= 16 and r.hash == sha(*r.m) for r in first)
    every = merkle.proofs(store)
    assert every.where(merkle.fold(F.col("hash"), F.col("steps")) != store.root).count() == 0
    assert every.where(merkle.fold(F.reverse("hash"), F.col("steps")) == store.root).count() == 0


def brute_audit(table, least, top):
    rows = [(l or "", s or "", [w.translate(str.maketrans(merkle.UPPER, merkle.LOWER)) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, l, s, _ in table]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        within = Counter(t for r in own for t in set(r[2]))
        kept = [t for t, n in within.items() if n >= least]
        v = len(kept)
        count = {s: Counter(t for r in own if r[1] == s for t in r[2] if within[t] >= least) for s in {r[1] for r in own}}
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * v)  # noqa: E731, B023
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum(count.values(), Counter())
        p = {s: {t: share(c[t], c.total()) for t in kept} for s, c in count.items()}
        q = {t: share(whole[t], whole.total()) for t in kept}
        for s in count:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return out


def test_audit_equals_brute_force(docs, rows):
    least = 10 if len(rows) > 100 else 1
    got = [tuple(r) for r in divergence.audit(docs, least_docs=least).collect()]
    assert sorted(got) == sorted(brute_audit(rows, least, divergence.TOP))


def test_terms_of_a_long_text_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Aé-b cc\x00dd" * 50 + "long" * 30
    assert [t.decode() for some in divergence.terms(text.encode()) for t in some] == [w.replace("A", "a") for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


def test_shares_of_large_counts_are_exact(spark):
    n, total, v = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 1_000_000
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def brute_shards(table, n):
    by_source = defaultdict(list)
    for row in table:
        crc = zlib.crc32((row[1] or "").encode())
        key = hashlib.md5(f"0|{'' if row[0] is None else row[0]}|{crc}".encode()).hexdigest()
        by_source[row[3]].append((key, row[0], len((row[1] or "").encode()) + 16, crc))
    mixed = []
    for s, own in by_source.items():
        mixed += [((2 * i + 1) / (2 * len(own)), null_first(s), *x) for i, x in enumerate(sorted(own, key=lambda x: x[0]))]
    mixed.sort(key=lambda x: x[:3])
    out, slots = [], Counter()
    for place, (_, _, _, doc_id, size, crc) in enumerate(mixed):
        shard = place * n // len(mixed)
        out.append((doc_id, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return out


def test_shards_equal_brute_force(docs, rows):
    n = 40 if len(rows) > 100 else 7
    got = [tuple(r) for r in stratified_shards.shards(docs, n).collect()]
    assert sorted(got, key=str) == sorted(brute_shards(rows, n), key=str)


def test_shards_match_the_mixture(spark):
    table = spark.createDataFrame(TABLES["many"], SCHEMA)
    shards = stratified_shards.shards(table, 10, keep=("source",)).collect()
    sizes, whole = Counter(r.shard for r in shards), Counter(r.keep_source for r in shards)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(10))
    for (_, s), n in Counter((r.shard, r.keep_source) for r in shards).items():
        assert abs(n - whole[s] / 10) <= 2
    by_bytes = stratified_shards.shards(table, 10, by="bytes").collect()
    total, each = sum(r["size"] for r in by_bytes), Counter()
    for r in by_bytes:
        each[r.shard] += r["size"]
    assert all(abs(x - total / 10) <= 2 * max(r["size"] for r in by_bytes) for x in each.values())
    assert all(sorted(r.slot for r in by_bytes if r.shard == k) == list(range(sum(r.shard == k for r in by_bytes))) for k in each)
    with pytest.raises(ValueError):
        stratified_shards.shards(table, by="words")


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    table = spark.createDataFrame(TABLES["many"], SCHEMA).withColumn("shard", F.lit("own"))
    stratified_shards.write_shards(table, f"file://{tmp_path}/s", 5)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 700 and back.where("shard_in = 'own'").count() == 700
    want = {r.keep_doc_id: (r.shard, r.slot) for r in stratified_shards.shards(table, 5, keep=("doc_id",)).collect()}
    assert all((r.shard, r.slot) == want[r.doc_id] for r in back.collect())


@pytest.mark.parametrize("run", [merkle.manifest, divergence.audit, stratified_shards.shards])
def test_empty_tables_give_empty_results(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_places_are_gapless_and_in_order(spark):
    table = spark.createDataFrame([("g" if i % 3 else None, (i * 7919) % 101, i % 5) for i in range(400)], "g string, x int, w long")
    out = placed(table, ["g"], ["x"], "test", "w").collect()
    for g in ("g", None):
        own = sorted((r for r in out if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and all(r.total == len(own) for r in own)
        assert [r.x for r in own] == sorted(r.x for r in own)
        assert [r.before for r in own] == [sum(x.w for x in own[:i]) for i in range(len(own))]
        assert all(r.weight_total == sum(x.w for x in own) for r in own)
