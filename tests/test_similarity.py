"""Pruned nearest neighbours against all pairs."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import metrics, neighbors, similarity

RNG = np.random.default_rng(2)


def frame(spark, rows):
    return spark.createDataFrame([(s, i, None if v is None else [float(x) for x in v]) for s, i, v in rows], "scope string, id long, vec array<double>").repartition(3)


def clustered(n, groups=12, size=6, noise=0.05):
    centre = RNG.normal(size=(groups, size))
    v = centre[RNG.integers(0, groups, n)] + RNG.normal(0, noise, (n, size))
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def brute(rows, k):
    out = {}
    for s in {r[0] for r in rows}:
        own = [(i, np.array(v)) for t, i, v in rows if t == s and v is not None and np.isfinite(v).all()]
        for i, v in own:
            best = sorted(((-round(float(v @ w), 9), j) for j, w in own if j != i))[:k]
            out[s, i] = [j for _, j in best]
    return out


CASES = {
    "clusters": [("a", i, v) for i, v in enumerate(clustered(300))] + [("b", i, v) for i, v in enumerate(clustered(40))],
    "lengths": [("a", i, v * RNG.uniform(0, 5)) for i, v in enumerate(clustered(150))],
    "copies": [("a", i, [1.0, 0.0]) for i in range(60)] + [("a", 60 + i, [0.0, 1.0 + i]) for i in range(5)] + [("a", 99, [0.0, 0.0])],
    "few": [("a", 1, [1.0, 2.0]), ("b", 1, [1.0, 2.0]), ("b", 2, [2.0, 1.0])],
    "odd": [("a", i, v) for i, v in enumerate(clustered(30))] + [("a", 100, None), ("a", 101, [np.nan] * 6), ("a", 102, [np.inf] + [0.0] * 5)],
}


@pytest.mark.parametrize("name", CASES)
def test_neighbours_equal_all_pairs(spark, name, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rows, stats = CASES[name], {}
    got = {}
    for r in sorted(similarity.nearest(frame(spark, rows), 4, per_list=10, stats=stats).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.scope, r.id), []).append((r["rank"], r.neighbor_id))
    want = {key: near for key, near in brute(rows, 4).items() if near}
    assert {key: [j for _, j in near] for key, near in got.items()} == want
    assert all([rank for rank, _ in near] == list(range(1, len(near) + 1)) for near in got.values())
    if name == "clusters":
        assert stats["compared"] < 0.5 * stats["pairs"]


def test_same_as_blocks_and_empty(spark):
    rows = frame(spark, [("a", i, v) for i, v in enumerate(clustered(120, 5))])
    order = lambda df: [tuple(r)[:4] for r in df.select("scope", "id", "neighbor_id", "rank").orderBy("id", "rank").collect()]
    assert order(similarity.nearest(rows, 3, per_list=20)) == order(neighbors.embedding_knn(rows, 3))
    assert similarity.nearest(rows.limit(0), 3).count() == 0


@pytest.mark.parametrize("half", [False, True])
def test_blocks_grow_and_their_number_does_not(spark, half):
    """All pairs of rows meet, and a row of a large scope is sent no more often than one of a smaller."""
    rows = frame(spark, [("a", i, v) for i, v in enumerate(clustered(400))])

    def pairs(left, right, same):
        return pd.DataFrame({"pairs": [len(left) * len(right) * (1 if same or not half else 2)]})

    got = [r.pairs for r in neighbors.block_pairs(rows, "scope", pairs, "pairs long", block=8, half=half).collect()]
    assert sum(got) == 400**2 and len(got) <= neighbors.MOST**2


def test_metrics_of_many_blocks(spark, monkeypatch):
    """Rounded products decide only where they are apart: equal to all pairs in full precision, ties and copies included."""
    a, b = clustered(300, 9, 4), clustered(300, 9, 4)
    b[:150] = a[:150]
    rows = spark.createDataFrame([("s", i, x.tolist(), y.tolist(), f"l{i % 3}") for i, (x, y) in enumerate(zip(a, b, strict=True))], "scope string, id long, a array<double>, b array<double>, l string")
    original = neighbors.block_pairs
    monkeypatch.setattr(metrics, "block_pairs", lambda *args, **named: original(*args, **named, block=16))
    score = a @ b.T
    own = np.diag(score)
    loss = np.mean([np.log(np.exp((s - own[:, None]) / 0.07).sum(1)) for s in (score, score.T)])
    assert abs(metrics.contrastive_loss(rows).first().loss - loss) < 1e-9
    ids = np.arange(300)
    before = [((ids[None, :] != ids[:, None]) & ((s > own[:, None] + 1e-12) | ((np.abs(s - own[:, None]) <= 1e-12) & (ids[None, :] < ids[:, None])))).sum(1) for s in (score, score.T)]
    got = {r.k: r for r in metrics.retrieval(rows).collect()}
    assert all(abs(got[k].a_to_b_topk - np.mean(before[0] < k)) < 1e-12 and abs(got[k].b_to_a_topk - np.mean(before[1] < k)) < 1e-12 for k in (1, 5))
    dist = np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * score_of(a) + (a * a).sum(1)[None, :], 0))
    np.fill_diagonal(dist, 0)
    means = np.array([dist[:, ids % 3 == c].sum(1) / ((ids % 3 == c).sum() - (ids % 3 == c)) for c in range(3)])
    inner = means[ids % 3, ids]
    outer = np.where(np.arange(3)[:, None] == ids % 3, np.inf, means).min(0)
    assert abs(metrics.silhouette(rows.withColumnRenamed("a", "vec"), "l").first().silhouette - np.mean((outer - inner) / np.maximum(inner, outer))) < 1e-9


def score_of(a):
    return a @ a.T
