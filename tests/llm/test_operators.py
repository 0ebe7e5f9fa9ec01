"""The ten operators against brute force on small tables, and on the odd ones: nulls, empty and
long texts, ties, repeated rows, empty tables, columns with clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, class_lm, dart_minhash, license_scan, pairwise_quality, pq_dedup, quality_rules, secret_scan, source_mix, suffix_dedup
from tessera.llm import words as W
from tessera.llm.shared import connected_components

RNG = random.Random(5)
WORDS = ["the", "of", "and", "to"] + ["".join(RNG.choice("abcdefghié") for _ in range(RNG.randint(2, 8))) for _ in range(200)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGES = [prose(45) for _ in range(3)]
TEXTS = [None, "", " \t\n ", "a", "word", prose(300), prose(300), "same words here", "same words here", "é ü 漢字 😀 \x01\x02", "x" * 20_000, prose(4000)]
for _i in range(40):
    _t = prose(RNG.randint(3, 90))
    TEXTS.append(_t + " " + PASSAGES[_i % 3] if _i % 2 else _t)
TEXTS += [TEXTS[20], TEXTS[20], TEXTS[21].replace("the", "teh", 1), TEXTS[11] + " end"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)]
#: Names that the operators use inside, and those of their results.
CLASHING = ("t", "w", "s", "key", "node", "score", "n_words", "copy_no", "batch", "id_", "row_", "found")


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(i, t, f"src{i % 3}" if i % 7 else None) for i, t in ROWS], "doc_id long, text string, source string")
    return d.withColumns({c: F.lit("odd") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    rows = [(None, prose(60), "a"), (None, None, None), (1, "x y z", "a"), (1, "x y z", "a"), (1, prose(60), "b"), (2, "x y z", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


RANKS = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
RUNS = {
    "source_mix": lambda d: source_mix.mix(d),
    "quality_rules": lambda d: quality_rules.judge(d),
    "quality_filter": lambda d: quality_rules.good_rows(d),
    "license_scan": lambda d: license_scan.scan(d),
    "dart_minhash": lambda d: dart_minhash.classes(d),
    "one_of_each": lambda d: dart_minhash.one_of_each(d),
    "secret_scan": lambda d: secret_scan.report(d),
    "mask": lambda d: secret_scan.mask(d),
    "byte_bpe": lambda d: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "suffix_dedup": lambda d: suffix_dedup.dedup(d),
    "class_lm": lambda d: class_lm.score(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_and_empty_tables(name, odd, empty):
    n = RUNS[name](odd).count()
    assert n == 6 or name in ("source_mix", "quality_filter", "one_of_each")
    assert RUNS[name](empty).count() == 0


def test_mix_draws_poisson(docs, spark):
    out = source_mix.mix(docs, epochs=3.0).select("doc_id", "copy_no", "mix_key").collect()
    again = source_mix.mix(docs.repartition(5), epochs=3.0).select("doc_id", "copy_no", "mix_key").collect()
    assert [tuple(r) for r in out] == [tuple(r) for r in again] and len(out) > len(ROWS)
    assert [r.mix_key for r in out] == sorted(r.mix_key for r in out)
    draws = spark.range(20_000).select(source_mix.poisson(source_mix.uniform(1, F.col("id")), F.lit(2.5)).alias("k")).groupBy("k").count().collect()
    got = {r.k: r["count"] / 20_000 for r in draws}
    assert all(abs(got.get(k, 0) - math.exp(-2.5) * 2.5**k / math.factorial(k)) < 0.015 for k in range(8))
    weights = {r.source: r["count"] for r in source_mix.mix(docs, {"src0": 1.0}).groupBy("source").count().collect()}
    assert set(weights) == {"src0"}
    with pytest.raises(ValueError):
        source_mix.mix(docs, {"src0": -1.0})


def test_quality_counts_and_verdict(docs):
    got = by_id(quality_rules.judge(docs))
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j in range(len(w) - 2) if tri[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(got[i])[1:7] == want
        assert not (failed and got[i].kept)
    assert got[5].kept and sum(r.kept for r in got.values()) == quality_rules.good_rows(docs).count()


def test_em_finds_the_careless_rule():
    rng, n = random.Random(1), len(quality_rules.RULES)
    seen = Counter()
    for _ in range(4000):
        y = rng.random() < 0.7
        seen[tuple((1 if y else -1) * (1 if rng.random() < (0.55 if j == 0 else 0.9) else -1) for j in range(n))] += 1
    model = quality_rules.fit(sorted((k, float(v)) for k, v in seen.items()))
    assert abs(model.good - 0.7) < 0.05 and abs(model.votes[0][0][2] - 0.55) < 0.06 and abs(model.votes[1][0][2] - 0.9) < 0.04
    assert quality_rules.fit([]) == quality_rules.LabelModel.start()


def test_license_phrases(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "the MIT-License and gnu General Public License v3", "mit", None, "cc by nc licence 4.0", "GNU Lesser General Public License", "MIT LİCENSE", "apache\nlicense apache license"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(license_scan.scan(d))
    assert (got[0].n_base, got[0].first_word, got[0].base_labels, got[0].labels) == (1, 3, "apache", "apache")
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 5, "gpl,mit")
    assert (got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert got[3].n_words == 0 and got[4].labels == "cc-by-nc" and got[6].n_base == 0 and got[7].n_base == 2
    # The longer name holds the shorter one inside; the base label stays all the same.
    assert got[5].labels == "gpl,lgpl" and [x.label for x in got[5].detections] == ["lgpl"]


def license_text(items, take):
    """A match of a parsed expression; ``take(n)`` chooses one of n ways at each choice."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += chr([c for k, v in arg for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])][take(2)])
        elif name == "SUBPATTERN":
            out += license_text(arg[-1], take)
        elif name == "BRANCH":
            out += license_text(arg[1][take(len(arg[1]))], take)
        elif name == "MAX_REPEAT":
            out += "".join(license_text(arg[2], take) for _ in range(arg[0] if arg[0] == 1 or arg[0] == arg[1] else take(2)))
        elif name == "ANY":
            out += "q"
        else:
            assert name == "AT"
    return out


def license_cases():
    """For each rule: its least match, two random ones, and the expression."""
    rng = random.Random(3)
    for text in sorted({r[4] for r in license_scan.rules()}):
        parsed = re._parser.parse(text)
        for take in (lambda n: 0, rng.randrange, rng.randrange):
            yield license_text(parsed, take).strip(), text


def test_license_gate_passes_each_rule(spark):
    texts = sorted({t for t, _ in license_cases()} | {"public domain", "all rights reserved"})
    texts = [t.title().replace(" ", by) for t in texts for by in (" ", "\n", "-")]
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    # The same text after a word that opens every gate.
    opened = by_id(license_scan.scan(spark.createDataFrame([(i, "unlicensable; " + t) for i, t in enumerate(texts)], "doc_id long, text string")))
    for i, t in enumerate(texts):
        assert got[i].labels == opened[i].labels and got[i].score == opened[i].score, t
    want = {"Public\nDomain": "public-domain", "Public-Domain": "public-domain", "All\nRights\nReserved": "proprietary"}
    assert {t: got[texts.index(t)].labels for t in want} == want
    # The least text of each hand-written signature has its label, or one of greater priority that holds it.
    assert len(license_scan.PASSAGES) > 140
    for label, p, text in license_scan.PASSAGES:
        r = got[texts.index(license_text(re._parser.parse(text), lambda n: 0).strip().title())]
        assert label in r.labels.split(",") or r.score > p / 100, text


def test_license_rules_under_each_opening(spark):
    rules = [(n, label, p, re.compile(text)) for n, label, p, text in sorted({(r[0], *r[2:]) for r in license_scan.rules()})]
    texts = sorted({t for t, _ in license_cases()} | {
        "BSD 3-Clause License", "BSD 2-clause licence", "3 Clause BSD License 1.0", "SIL Open Font License", "Open Font Licence", "GPLv3 License", "gplv2 licence",
        "Apache Software License 2.0", "Licence: BSD", "licence is the MIT", "LICENSE: Apache",
    })
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):  # every rule at every word
        w = re.findall("[a-z0-9]+", t.lower())
        hits = []
        for a in range(len(w)):
            for n, label, p, text in rules:
                if m := text.match(" ".join(w[a:]) + " "):
                    hits.append((a, a + len(m[1].split(" ")), p, n, label))
        kept = [x for x in hits if not any(y[0] <= x[0] and y[1] >= x[1] and (y[2], y[1] - y[0], -y[3]) > (x[2], x[1] - x[0], -x[3]) for y in hits)]
        assert hits and [(x.start, x.end, x.priority, x.label) for x in got[i].detections] == [(a, b, p, label) for a, b, p, _, label in sorted(kept)], t
    want = {"BSD 3-Clause License": "bsd-3-clause", "SIL Open Font License": "ofl", "GPLv3 License": "gpl", "Apache Software License 2.0": "apache", "Licence: BSD": "bsd"}
    assert {t: got[texts.index(t)].labels for t in want} == want
    with pytest.raises(ValueError):
        license_scan._openings("[0-9]+ clause")


#: Notices as they stand in files, with the label that tells which licence it is.
NOTICES = {
    "ncsa": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "bsd-3-clause": """Neither the name of the Regents of the University of Somewhere With a Rather Long Name, its School of Applied and
Theoretical Computer Science, nor the names of its contributors may be used to endorse or promote products derived from this software""",
    "gpl": "you may copy it under the GPL, version 2",
}


def test_license_notices_of_any_length(spark):
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(NOTICES.values())), "doc_id long, text string")))
    assert [set(got[i].labels.split(",")) & {label} for i, label in enumerate(NOTICES)] == [{label} for label in NOTICES]
    assert "mit" not in got[0].labels.split(",")  # the longer rule of the same words holds it
    assert license_scan.reach("a(?: .{1,40} )?b c{0,2}(?:d e f|g)") == 1 + (1 + 20 + 1) + 1 + 2
    with pytest.raises(ValueError):
        license_scan.reach("a .* b")


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for weighted in (False, True):
        errors = []
        for _ in range(60):
            u = rng.integers(0, 2**63, 260).astype(np.uint64)
            a, b = rng.integers(1, 6, 200).astype(float), rng.integers(1, 6, 200).astype(float)
            if not weighted:
                a, b = np.ones(200), np.ones(200)
            b[60:] = a[:140]
            sig = dart_minhash.signatures(np.concatenate([u[60:260], u[:200]]) if weighted else np.concatenate([u[:200], u[60:260]]), np.concatenate([a, b]) if weighted else None, np.array([0, 200, 400]), 128)
            x = dict(zip((u[60:260] if weighted else u[:200]).tolist(), a, strict=True))
            y = dict(zip((u[:200] if weighted else u[60:260]).tolist(), b, strict=True))
            low = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y)
            errors.append((sig[0] == sig[1]).mean() - low / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y))
        assert abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize("weights", ["set", "count"])
def test_near_copies(spark, weights):
    base = [prose(80) for _ in range(6)] + ["again " * 30 + prose(20)]
    rows = []
    for b in base:
        for k in range(9):
            w = b.split()
            for _ in range(k // 3 + RNG.randint(0, 2)):
                w[RNG.randrange(len(w))] = RNG.choice(WORDS)
            rows.append(" ".join(w))
    rows += [None, "", " ", "one two", "one  two", "one two three"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)

    def bag(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags = [bag(t) if weights == "count" else Counter(dict.fromkeys(bag(t), 1)) for t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = (bags[i] | bags[j]).total()
            if union and 5 * (bags[i] & bags[j]).total() >= 4 * union:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = by_id(dart_minhash.classes(d, dart_minhash.Settings(weights=weights)))
    assert [got[i].class_id for i in range(len(rows))] == [find(i) for i in range(len(rows))]
    assert dart_minhash.one_of_each(d, dart_minhash.Settings(weights=weights)).count() == sum(find(i) == i for i in range(len(rows)))


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 40)] + [(3000 - i, 3000) for i in range(1, 40)]
    pairs += [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(7, 7), (None, 5), (5, None)]
    rng.shuffle(pairs)
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    d = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node: r.root for r in connected_components(d, "some").collect()}
    assert got.keys() == root.keys() and all(root[r] == root[x] for x, r in got.items())
    assert len(set(got.values())) == len(set(root.values()))
    assert connected_components(d.limit(0), "none").count() == 0


def test_pairwise_ranking(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(RNG.choice(WORDS) + ("###" if bad else "") for _ in range(60))))
        labels += [(i, 0 if bad else 1)] if i % 2 else []
    rows += [(600, None), (601, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = by_id(pairwise_quality.classify(d, lab))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(600) if got[i].held_out] == held
    assert np.mean([got[i].predicted == (i % 5 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert len({r.score for r in pairwise_quality.classify(d, lab.limit(0)).collect()}) == 1
    assert pairwise_quality.classify(d.limit(0), lab).count() == 0


def test_secrets(spark):
    texts = [
        "password = 'hunter2hunter2' x", "token=a.token:abcdefgh", "API_KEY: abcdefgh;apikey:short", "AKIA" + "A" * 12 + " AKIAB", "0123456789abcdef" * 2 + "g" + "f" * 31,
        None, "é\x01\x02 secret:\x0112345678 secret: 12345678", "ghp_" + "a1B2" * 9, "paſſword=abcdefgh", "PassWord\":\"abcdefghij",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(secret_scan.report(d))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert "github:0:40" in got[7].spans and got[8].n_assign == 0
    masked = {r.doc_id: r.text for r in secret_scan.mask(d).collect()}
    assert masked[0] == "[secret]' x" and masked[5] is None and masked[1] == texts[1]


def test_long_logins(spark):
    logins = [f"://{'u' * a}:{'p' * b}@" for a, b in ((1, 1), (64, 64), (65, 1), (1, 65), (300, 9000))] + ["://me:github_pat_" + "a1B_" * 20 + "@"]
    texts = [f"see https{x}host/x" for x in logins] + ["://" + "u" * 50_000, "://u:" + "p" * 50_000 + " @", "://u:@"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, masked = by_id(secret_scan.report(d)), by_id(secret_scan.mask(d))
    for i, t in enumerate(texts):
        assert got[i].spans == (f"login:9:{9 + len(logins[i])}" if i < len(logins) else "")
        assert masked[i].text == ("see https[secret]host/x" if i < len(logins) else t)


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{32,}") == [] and secret_scan.trigram_query("ab[xy]?") == []
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert len(secret_scan.trigram_query("(?:abc|xyz)\\d+tail")) == 2
    for rule in secret_scan.RULES:
        for clause in secret_scan.trigram_query(rule.expression):
            assert clause and all(clause)


def test_byte_bpe_is_tiktoken(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN))
    for i, t in ROWS:
        assert got[i].ids == enc.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    v = byte_bpe.Vocabulary(RANKS)
    pieces = ["".join(RNG.choice("abé \n") for _ in range(RNG.randint(2, 60))).encode() for _ in range(200)]
    assert v.merge_stack([p for p in pieces if len(p) <= byte_bpe.STACKED]) == [v.merge_one(p) for p in pieces if len(p) <= byte_bpe.STACKED]


def _brute_removed(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], (i, p))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("spread", [suffix_dedup.SPREAD, 3])
def test_suffix_dedup(docs, spread):
    want = _brute_removed(ROWS, 100)
    assert sum(x[1] for x in want.values()) > 1000
    got = by_id(suffix_dedup.dedup(docs, spread=spread))
    assert {i: tuple(got[i])[1:5] for i in want} == want


def test_suffix_array_and_prefixes():
    text = np.frombuffer(b"banana$bandana" * 3 + b"aaaaaaa", np.uint8)
    ends = np.array([14, 28, 42, 49])
    end = ends[np.searchsorted(ends, np.arange(len(text)), side="right")]
    begin = np.concatenate([[0], ends[:-1]])[np.searchsorted(ends, np.arange(len(text)), side="right")]
    sa = suffix_dedup.suffix_array(text, end, 14)
    suffix = lambda i: bytes(text[i : end[i]])
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: (suffix(i), i))
    lcp = suffix_dedup.common_prefixes(text, begin, end, sa, 10)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        x, y = suffix(a), suffix(b)
        assert lcp[b] == min(10, next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x = rng.normal(size=16)
        for k in range(1 + i % 3):
            rows.append((len(rows), (x + 0.03 * k * rng.normal(size=16)).tolist(), i % 4))
    rows += [(len(rows) + k, v, lab) for k, (v, lab) in enumerate([(None, 0), ([0.0] * 16, 0), ([1.0] * 15 + [None], 0), ([1.0] * 15 + [float("nan")], 1), (rows[0][1], None), (rows[0][1], 0), ([float("inf")] * 16, 2), ([], 1)])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("x", "n", "node", "code")}).repartition(3)
    good = {}
    for r in d.select("vec_id", "embedding", "label").collect():
        if r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding):
            v = np.array(r.embedding, np.float64)
            good[r.vec_id] = (v / np.linalg.norm(v), r.label)
    links = {(a, b) for a in good for b in good if a != b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.98}
    root = {i: i for i, _, _ in rows}
    for _ in range(10):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.vec_id: r for r in pq_dedup.classes(d).collect()}
    n = Counter(a for a, _ in links)
    assert len(links) > 100 and all((got[i].n_links, got[i].component_id, got[i].kept) == (n[i], root[i], root[i] == i) for i in root)
    assert pq_dedup.classes(d.limit(0)).count() == 0


def test_probes_reach_every_partner():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(500, 8)), 3, axis=0) + 0.05 * rng.normal(size=(1500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    r = math.sqrt(2 - 2 * 0.98)
    index = pq_dedup.Index.fit(x[:500], 12)
    home = pq_dedup._nearest(x, index.centre)
    code, error = index.encode(x, home)
    asked = set(zip(*(a.tolist() for a in index.probes(x, r)), strict=True))
    all_ = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.98), strict=True) if i != j}
    found = set()
    for c in range(len(index.centre)):
        own = np.flatnonzero(home == c)
        ask = np.array([i for i in range(len(x)) if (i, c) in asked])
        i, j = index.near(x[ask], c, code[own], error[own], r)
        found |= set(zip(ask[i].tolist(), own[j].tolist(), strict=True))
    assert pq_dedup.recall(found, all_) == 1.0 and len(all_) > 20


def test_bands_that_nobody_shares_are_not_written(spark, monkeypatch):
    """Only rows of shared buckets are kept; the others are as many as documents times bands."""
    texts = [prose(80) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0] + " end", texts[1], texts[1]])]
    sizes = {}

    def kept(df, name, to_table=dart_minhash.to_table):
        out = to_table(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(dart_minhash, "to_table", kept)
    got = by_id(dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [r.class_id for _, r in sorted(got.items())] == [*range(30), 0, 1, 1]
    assert sizes["minhash-signed"] == 33 and max(sizes.values()) <= 2 * dart_minhash.Settings().bands


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_hardly_look_at_a_region_twice(weighted, monkeypatch):
    rng, k, seen = np.random.default_rng(3), 125, []
    sizes = rng.integers(1, 60, 200)
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 1 << 63, first[-1]).astype(np.uint64)
    weight = rng.integers(1, 9, first[-1]).astype(float) if weighted else None
    monkeypatch.setattr(dart_minhash.W, "mix", lambda x, salt=0, mix=W.mix: (seen.append(x if salt == 4242 else x[:0]), mix(x, salt))[1])
    sig = dart_minhash.signatures(h, weight, first, k, 4242)  # regions are hashed with the seed
    regions = np.concatenate(seen).ravel()
    # again only those that reach across the rank where a set with open coordinates went on: one an element and level of weight
    assert len(regions) - len(np.unique(regions)) <= first[-1]
    for i in range(200):  # the same for a set by itself
        own = slice(first[i], first[i + 1])
        assert (sig[i] == dart_minhash.signatures(h[own], None if weight is None else weight[own], np.array([0, sizes[i]]), k, 4242)[0]).all()


def test_bpe_decodes_from_the_bytes_of_all_tokens():
    """Whole arrays of ids are decoded together, without an object for each token."""
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = [t or "" for t in TEXTS]
    ids, first = codec.encode(texts)
    codec.vocabulary.token = []
    data, at = codec.decode(ids, first)
    assert [data[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)] == texts
    data, at = codec.decode(ids[:0], first[:1])
    assert data == b"" and at.tolist() == [0]


def test_class_lm(docs):
    got = by_id(class_lm.score(docs))
    low = {c: c + 32 for c in range(65, 91)}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for i, t in ROWS}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = c.total(), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_class_lm_contexts_do_not_grow_with_batches(docs, spark):
    model = class_lm.Model(1, 1, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones((1 + class_lm.FORMS + 1,) * 2))
    d = docs.select(F.coalesce("text", F.lit("")).alias("t"), F.lit(False).alias("held_out"))
    d = d.withColumn("batch", F.pmod(F.xxhash64("t"), F.lit(1_000_000))).coalesce(1)
    assert d.select("batch").distinct().count() > 20
    found = class_lm._contexts(d, model, 4).cache()
    assert found.count() == found.select("slice").distinct().count() == 4  # one task gathers them all


def test_class_lm_scores_are_those_of_any_batches(docs, monkeypatch):
    few = sorted((r.doc_id or -1, r.score, r.base_score) for r in class_lm.score(docs).collect())
    monkeypatch.setattr(class_lm, "BATCH_BYTES", 300)
    many = sorted((r.doc_id or -1, r.score, r.base_score) for r in class_lm.score(docs).collect())
    assert len(few) == len(many) and np.allclose(np.array(few, float), np.array(many, float), rtol=1e-9)


def test_class_lm_against_brute_force(docs, spark, monkeypatch):
    monkeypatch.setattr(class_lm, "SHARE", 20)
    monkeypatch.setattr(class_lm, "SEEDS", 30, raising=False)
    k, forms, low = 6, class_lm.FORMS, {c: c + 32 for c in range(65, 91)}
    got = by_id(class_lm.score(docs, classes=k))
    tokens, form, hash_ = {}, {}, {}
    for i, t in ROWS:
        tokens[i] = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
        h, f, _ = class_lm._tokens(pa.array([t or ""]))
        form |= dict(zip(tokens[i], f.tolist(), strict=True))
        hash_ |= dict(zip(tokens[i], h.tolist(), strict=True))
    train = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    words = sorted((w for w in c if w), key=lambda w: (-c[w], hash_[w]))
    seeds, rest = words[:30], words[30:]
    assert len(rest) > 100
    bigrams = Counter((a, b) for ws in train for a, b in zip([None, *ws], ws, strict=False))
    unit = {w: i for i, w in enumerate(seeds)} | {None: 30} | {w: 31 + form[w] for w in rest}
    pairs = np.zeros((31 + forms, 31 + forms))
    for (a, b), n in bigrams.items():
        pairs[unit[a], unit[b]] += n
    of = dict(zip(seeds, class_lm.exchange(pairs, 30, k).tolist(), strict=True)) | {None: k} | {w: k + 1 + form[w] for w in rest}

    def likelihood(of):
        t = np.zeros((k + 1 + forms, k + 1 + forms))
        for (a, b), n in bigrams.items():
            t[of[a], of[b]] += n
        x = lambda v: float((v * np.log(np.maximum(v, 1))).sum())
        return x(t) - x(t.sum(0)) - x(t.sum(1))

    best = {w: int(np.argmax([round(likelihood(of | {w: g}), 6) for g in range(k)])) for w in rest}
    of |= best
    size = k + 1 + forms
    table = np.zeros((size, size))
    for ws in train:
        for a, b, d in zip([None, *ws], ws, [*ws[1:], None], strict=False):
            table[of[a], of[b]] += 1
            if c[b] == 1 and b:
                table[of[a], k + 1 + form[b]] += 1
                table[k + 1 + form[b], of[d]] += 1
    seen, rows = table.sum(0), table.sum(1)
    uni = (seen + 1) / (seen.sum() + size)
    for i, ws in tokens.items():
        cls = [of[w] if c[w] else k + 1 + form[w] for w in ws]
        p = [(table[a, b] + class_lm.ALPHA * uni[b]) / (rows[a] + class_lm.ALPHA) for a, b in zip([k, *cls], cls, strict=False)]
        e = [c[w] / seen[g] if c[w] else class_lm.DELTA / (seen[g] + class_lm.DELTA * (seen[g] + 1)) for w, g in zip(ws, cls, strict=True)]
        assert math.isclose(got[i].score, sum(map(math.log10, p + e)), rel_tol=1e-6), (i, got[i].score)


def test_exchange_finds_the_classes():
    rng, kinds, seq = random.Random(2), 3, []
    for _ in range(6000):
        seq.append(4 * (len(seq) % kinds) + rng.randrange(4))
    pairs = np.zeros((12, 12))
    np.add.at(pairs, (seq[:-1], seq[1:]), 1)
    of = class_lm.exchange(pairs, 12, 3, sweeps=6)
    assert len({tuple(of[4 * k : 4 * k + 4]) for k in range(3)}) == 3 and all(len(set(of[4 * k : 4 * k + 4])) == 1 for k in range(3))


def test_word_hashes():
    t = pa.array(["a b  C d e f", "", None, "hello", " x\ty\n", "A B c D e f"])
    w = W.split(t, lower=True)
    assert w.count.tolist() == [6, 0, 0, 1, 2, 6] and (w.hash[:6] == w.hash[9:]).all()
    s, first = W.shingles(w, 5)
    assert np.diff(first).tolist() == [2, 0, 0, 1, 1, 2] and (s[:2] == s[-2:]).all()
    cut = list(W.chunks(pa.RecordBatch.from_arrays([t], names=["t"]), 0, most=8))
    assert sum(len(x) for x in cut) == 6 and len(cut) > 1


def test_prefixes_of_some_of_the_suffixes():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 2, k).astype(np.uint8) * 255 for k in (40, 25, 40, 3)]
    parts.append(parts[0])
    text, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
    end = np.repeat(np.cumsum(sizes), sizes)
    begin = end - np.repeat(sizes, sizes)
    suffix = lambda i: bytes(text[i : end[i]])
    for length in (1, 8, 13, 20):
        sa = suffix_dedup.suffix_array(text, end, length)
        sa = sa[end[sa] - sa >= length]
        assert [suffix(i)[:length] for i in sa] == sorted(suffix(i)[:length] for i in sa)
        got = suffix_dedup.common_prefixes(text, begin, end, sa, 30)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            pairs = zip(suffix(a), suffix(b))
            assert got[b] == min(30, next((k for k, (x, y) in enumerate(pairs) if x != y), min(end[a] - a, end[b] - b)))


def test_suffixes_are_sorted_with_their_places():
    rng = np.random.default_rng(5)
    for bits in (10, 62):  # with room for the place, and without
        v = rng.integers(0, 1 << 4, 500)
        order, ordered = suffix_dedup._in_order(v, bits)
        assert (order == np.argsort(v, kind="stable")).all() and (ordered == np.sort(v)).all()
    for used in (1, 3, 256):
        sizes = rng.integers(1, 30, 40)
        text = rng.integers(0, used, sizes.sum()).astype(np.uint8)
        end = np.repeat(np.cumsum(sizes), sizes)
        want = sorted(range(len(text)), key=lambda i: (text[i : end[i]].tobytes(), i))  # noqa: B023
        assert suffix_dedup.suffix_array(text, end, 30).tolist() == want
    key, start, number = np.array([5, 2, 2, 9]), np.array([0, 7, 3, 1]), np.array([1, 1, 1, 2])
    order, late = suffix_dedup._earlier(key, start, number)
    assert order[late].tolist() == [0, 1]
    for low in (0, -(1 << 62)):  # keys too far apart to be sorted as one number with the start
        t = suffix_dedup._spans(np.array([4, 1 << 62, low, low]), np.array([3, 9, 250, 7]), 100)
        assert t.column("start").to_pylist()[:2] == [7, 250] and t.column("stop").to_pylist() == [107, 350, 103, 109]
