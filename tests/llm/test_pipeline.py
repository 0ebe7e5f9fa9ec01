"""The pipeline against a run of its five stages by brute force, and operators on awkward tables."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_operators as T
from tessera.llm import byte_bpe, dart_minhash, license_scan, pairwise_quality, pq_dedup, quality_rules, secret_scan, source_mix

RNG = random.Random(11)
WORD = r"[^\x20\x09-\x0D]+"


def lines(n):
    return "\n".join(T.prose(12) for _ in range(n)) + "."


def corpus():
    rows = [lines(RNG.randint(7, 14)) for _ in range(30)]
    rows += [rows[3], rows[3] + " end", rows[4].replace(" the ", " that ", 1), "short text", "", None, "# " * 300, "Buy now! " * 90]
    rows += [lines(8) + f"\npassword = hunter2hunter{i} and AKIA{'Z' * 16}" for i in range(3)]
    rows += [lines(8) + "\nhttps://user:" + "p" * 80 + "@host " + "ab12" * 10, lines(60)]
    return [(i, t, "en", ["a", "b", None][i % 3] if i % 5 else "rare", len(t or "")) for i, t in enumerate(rows)]


def good_by_force(rows):
    seen = {}
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(WORD, t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        again = len({j + k for j in range(len(w) - 2) if tri[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)})
        full = [x for x in t.split("\n") if re.search(WORD, x)]
        chars, n = sum(map(len, w)), len(w)
        symbols, dup, capitals, shouts = sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(re.findall("[A-Z]", t)), t.count("!")
        votes = [
            -1 if n < 50 else n >= 80, -1 if chars < 2 * n or chars > 12 * n else 3 * n <= chars <= 10 * n, -1 if 10 * symbols > n else 100 * symbols <= n,
            -1 if 10 * dup > 3 * len(full) else dup == 0 and len(full) > 1, -1 if 10 * again > 4 * n else 10 * again <= n,
            -1 if 10 * capitals > 3 * chars else 10 * capitals <= chars, -1 if 10 * shouts > n else 100 * shouts <= n,
        ]
        seen[i] = (tuple(int(v) for v in votes), n < 50 or 100 * again > 50 * n)
    model = quality_rules.fit(sorted((v, float(k)) for v, k in Counter(v for v, _ in seen.values()).items()))
    return [r for r in rows if not seen[r[0]][1] and model.posterior(seen[r[0]][0]) >= 0.5]


def one_of_each_by_force(rows):
    sets, root = {}, {}
    for i, t, *_ in rows:
        w = re.findall(WORD, t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        same = [j for j in sets if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        root[i] = i
        for j in same:
            a, b = sorted((root[i], root[j]))
            root = {k: a if v == b else v for k, v in root.items()}
    return [r for r in rows if root[r[0]] == r[0]]


def mask_by_force(t):
    spans = []
    for rule in secret_scan.RULES:
        spans += [m.span() for m in re.finditer(rule.expression, t) if len(m[rule.group]) >= rule.least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += t[at:a] + "[secret]"
        at = max(at, b)
    return out + t[at:]


def mix_by_force(rows, alpha=0.5):
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += max(len(t), 1)
    share = {s: n**alpha for s, n in size.items()}
    out = []
    for r in rows:
        rate = share[r[3]] / sum(share.values()) * sum(size.values()) / size[r[3]]
        parts = max(1, math.ceil(rate / source_mix.PART))
        for i in range(1, parts + 1):
            u = int(hashlib.md5(f"0|n|{i}|{r[0]}|{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
            k, p = 0, math.exp(-rate / parts)
            c = p
            while u >= c and k < source_mix.TERMS:
                k += 1
                p *= rate / parts / k
                c += p
            out += [r] * k
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = one_of_each_by_force(good_by_force(rows))
    assert 20 < len(kept) < len(rows) - 6
    masked = [(i, mask_by_force(t), lang, s, n) for i, t, lang, s, n in kept]
    assert sum(a[1] != b[1] for a, b in zip(kept, masked, strict=True)) == 4
    mixed = mix_by_force(masked)
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
        ranks = byte_bpe.Vocabulary(f.read()).rank
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in mixed:
        ids = coder.encode_ordinary(t)
        want[i, len(ids), tuple(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in got) == want
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "secret scans", "mixing sources", "byte-level BPE"]


def test_encoding_takes_small_batches(spark, tmp_path, monkeypatch):
    """Texts reach Python a thousand rows at a time, whatever the session's own batch is."""
    def sizes(docs, *_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([[]], pa.list_(pa.int32())), pa.array([b""])], names=["doc_id", "ids", "decoded"])

        return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")

    monkeypatch.setattr(byte_bpe, "encode", sizes)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")
    try:
        got = corpus_pipeline.encode(spark, spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), str(tmp_path)).collect()
        assert sorted(r.doc_id for r in got) == [1000] * 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2500"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_remembered_pieces_are_bounded(monkeypatch):
    """Ids stay right when pieces are forgotten; no more than the bounds are kept after a call, and a piece takes little."""
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
        codec = byte_bpe.Codec(f.read(), public_tokenizers.PATTERN)
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.rank, special_tokens={})
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäß漢"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(3, 12))) for _ in range(400)) for _ in range(50)] + ["", "x" * 5000]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    codec.encode(texts)
    taken = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert len(codec.known) > 15_000 and taken < 200 * len(codec.known)
    for bound, most in (("REMEMBERED", 900), ("REMEMBERED_CHARS", 3000)):
        monkeypatch.setattr(byte_bpe, bound, most)
        for at in range(0, len(texts), 3):
            part = texts[at : at + 3]
            ids, first = codec.encode(part)
            data, place = codec.decode(ids, first)
            assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [coder.encode_ordinary(t) for t in part]
            assert [data[a:b].decode() for a, b in zip(place, place[1:], strict=False)] == part
            assert len(codec.known) <= byte_bpe.REMEMBERED and sum(map(len, codec.known)) <= byte_bpe.REMEMBERED_CHARS


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(T.RUNS))
def test_clashing_columns_change_nothing(name, spark):
    """Extra columns with the operators' own names on a table with rows, very long texts among them."""
    texts = [T.TEXTS[i] for i in (0, 1, 3, 5, 7, 8, 9, 10, 11, 13, 53)] + ["MIT License, token = abcdefgh12 ://u:" + "w" * 90 + "@h", lines(9), lines(9)]
    plain = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    clash = plain.withColumns({c: F.lit("odd") for c in (*T.CLASHING, "b", "c", "h", "x", "i", "n", "root", "bucket", "rules", "copy_no", "mix_key", "gate", "lines", "p")}).repartition(2)
    a, b = T.RUNS[name](plain), T.RUNS[name](clash)
    both = [c for c in a.columns if c in b.columns] if name != "source_mix" else ["doc_id", "text", "source", "copy_no"]
    assert rows_of(a.select(*both)) == rows_of(b.select(*both))


@pytest.mark.parametrize("name", ["license_scan", "secret_scan", "byte_bpe"])
def test_null_and_repeated_ids(name, spark):
    """A row's result depends on its text alone."""
    texts = ["mit license", "mit license", "token: abcdefgh12345", None, "", "token: abcdefgh12345", "word " * 30_000]
    odd = spark.createDataFrame(list(zip([None, 1, 1, None, 2, 2, 3], texts, strict=True)), "doc_id long, text string")
    even = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = T.RUNS[name](odd), T.RUNS[name](even)
    rest = [c for c in a.columns if c != "doc_id"]
    assert rows_of(a.select(*rest)) == rows_of(b.select(*rest)) and a.where("doc_id is null").count() == 2


def features_by_force(t):
    w = re.findall(WORD, t)
    if not w:
        return [0.0] * len(pairwise_quality.NAMES)
    n, letters, raw = len(w), sum(len(x.encode()) for x in w), t.encode()
    many = lambda k: [tuple(w[i : i + k]) for i in range(max(1, n - k + 1))]
    full = [tuple(re.findall(WORD, x)) for x in t.split("\n") if re.search(WORD, x)]
    n_lines = t.count("\n") + 1
    of = lambda chars: sum(c in chars for c in t)
    return [
        math.log1p(n), letters / n / 10, of("#*$%&|<>{}[]^~=_\\@") / letters, len(re.findall("[A-Z]", t)) / letters, len(re.findall("[0-9]", t)) / letters,
        of(".,;:?") / n, t.count("!") / n, sum(b >= 128 for b in raw) / letters, len(set(w)) / n, max(Counter(w).values()) / n,
        1 - len(set(many(2))) / len(many(2)), sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, 1 - len(set(many(3))) / len(many(3)),
        t.count("\n") / len(raw), sum(len(x.encode()) <= 2 for x in w) / n, sum(len(x.encode()) >= 14 for x in w) / n,
        1 - len(set(full)) / len(full), math.log1p(n / n_lines),
    ]


def test_pairwise_scores_against_brute_force(spark):
    texts = [lines(RNG.randint(1, 6)) if i % 3 else T.prose(20) + " ### $$$ !!! " * RNG.randint(1, 5) + "\nsame line\nsame line" for i in range(60)] + [None, "", "été ünï 漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("odd")).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(4, None), (None, 1), (999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in pairwise_quality.classify(docs, labels).collect()}
    x = {i: features_by_force(t or "") for i, t in enumerate(texts)}
    taught = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2)
    good, bad = (np.array([x[i] for _, i in taught if (i % 3 > 0) == kind]) for kind in (True, False))
    model = pairwise_quality.fit(good, bad)
    raw = [pairwise_quality._expand(v, model.mean, model.scale) @ model.weight for v in (good, bad)]
    model.threshold = pairwise_quality._threshold(*raw, len(good) / (len(good) + len(bad)))
    for i in x:
        want = float(model.scores(np.array([x[i]]))[0])
        assert math.isclose(got[i].score, want, abs_tol=1e-9) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(want >= 0.7)


def test_pairwise_learns_from_every_labelled_row():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.3, 1, (6000, len(pairwise_quality.NAMES))), rng.normal(0, 1, (3000, len(pairwise_quality.NAMES)))
    model = pairwise_quality.fit(good, bad)
    p, q = (pairwise_quality._expand(v, model.mean, model.scale) for v in (good, bad))
    lose = 1 / (1 + np.exp((p @ model.weight)[:, None] - (q @ model.weight)[None, :]))
    slope = (q.T @ lose.sum(0) - p.T @ lose.sum(1)) / lose.size + 1e-3 * model.weight
    assert np.abs(slope).max() < 1e-3  # that of all 18 million pairs is zero at the minimum


def test_pairwise_model_of_parts(spark):
    """Many rows of each class, dealt out: every one of them changes the model and the threshold as it does in one place."""
    rng = np.random.default_rng(6)
    x, good = rng.normal(size=(7000, len(pairwise_quality.NAMES))), rng.random(7000) < 0.7
    x[good] += 0.4
    taught = spark.createDataFrame([(v.tolist(), bool(g)) for v, g in zip(x, good, strict=True)], "x array<double>, good boolean").repartition(5)
    one, many = pairwise_quality.fit(x[good], x[~good]), pairwise_quality._learn_table(taught)
    assert np.abs(one.weight - many.weight).max() < 1e-7
    raw = [pairwise_quality._expand(v, one.mean, one.scale) @ one.weight for v in (x[good], x[~good])]
    assert math.isclose(pairwise_quality._threshold(*raw, good.mean()), pairwise_quality._cut(taught, many, good.mean(), len(x)), abs_tol=1e-6)


def test_vectors_of_any_length_and_odd_ids(spark):
    big, small = [1e300, 1e-10, 0.0], [1e-310, 0.0, 0.0]
    rows = [(1, big, 0), (2, [2e200, 0.0, 0.0], 0), (None, small, 0), (3, [0.0, 1e-160, 0.0], 0), (3, [0.0, 5.0, 0.0], 0), (None, [0.0, 0.0, 0.0], 0), (7, [1.0, 0.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit(1)).repartition(2)
    got = sorted(map(tuple, pq_dedup.classes(d).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (3, 1, 3, True), (3, 1, 3, True), (None, 0, None, True), (7, 0, 7, True)], key=str)


def test_recall_of_bands(spark):
    """Pairs at the threshold: 25 bands of 5 rows miss one in 20,000."""
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles; 11 changed at each end leave 178 of 222
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([f"x{j}" + w[j] for j in range(11)] + w[11:-11] + [f"y{j}" + w[j] for j in range(11)]))]
        pairs.append((2 * i, 2 * i + 1))
    a = {tuple(rows[0][1].split()[j : j + 5]) for j in range(200)}
    b = {tuple(rows[1][1].split()[j : j + 5]) for j in range(200)}
    assert 0.8 <= len(a & b) / len(a | b) < 0.81
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) == len(pairs)


def test_rest_of_wide_buckets(spark, monkeypatch):
    """Buckets whose members fall into many groups: pivots of the rest, then blocks, link as all pairs do."""
    monkeypatch.setattr(dart_minhash, "REST_BLOCK", 4)
    monkeypatch.setattr(dart_minhash, "BLOCK", 8)
    rng = random.Random(8)
    base = [f"b{j}" for j in range(120)]
    rows = []
    for i in range(90):
        w = base[:]
        for j in rng.sample(range(0, 120), rng.choice((1, 3, 5))):
            w[j] = f"c{i}_{j}"
        rows.append((i, " ".join(w), "", "", 0))
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t, *_ in rows}
    root = {i: i for i in sets}
    for _ in range(20):
        for i in sets:
            for j in sets:
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert len(set(root.values())) < 90 and got == root
