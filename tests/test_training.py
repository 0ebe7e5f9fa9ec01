"""Epochs and training on small tables: orders, gradients, steps, states."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encoder, epochs, features, training
from tessera.operators import network as N

GENES = [f"g{i}" for i in range(10)]
SHAPE = N.Shape(size=8, heads=2, layers=1, inner=8, bins=6, image_size=6, channels=1, structures=2)


def tables(spark, n=22, seed=0):
    rng = np.random.default_rng(seed)
    where = [(f"r{i:02d}", float(rng.normal()), float(rng.normal()), "ab"[i % 2], f"img{i % 5}", 1) for i in range(n)]
    regions = spark.createDataFrame(where, "region_id string, x double, y double, structure_label string, image_path string, n_cells int")
    rows = [(r[0], g, float((3.0 if (j % 2) == (i % 2) else 0.5) + rng.uniform(0, 0.3))) for i, r in enumerate(where) for j, g in enumerate(GENES) if i != 7 and (i + j) % 4]
    values = spark.createDataFrame(rows, "region_id string, gene string, value double")
    members = spark.createDataFrame([(r[0], f"{r[0]}-{k}") for r in where for k in range(3)], "region_id string, cell_id string")
    expr = spark.createDataFrame([(f"{r}-{k}", g, v) for r, g, v in rows for k in range(3) if k], "cell_id string, gene string, value double")
    images = spark.createDataFrame([(f"img{i}", bytearray(rng.integers(0, 256, 108).astype(np.uint8).tobytes())) for i in range(4)], "image_path string, pixels binary")
    return regions, values, members, expr, images


def dataset(spark, size=6, where="true", parts=None, **more):
    regions, values, members, expr, images = tables(spark)
    items = features.region_items(regions).where(where)
    if parts:
        items, values = items.repartition(parts), values.repartition(parts)
    genes = spark.createDataFrame([(g,) for g in GENES], "gene string")
    near = values.withColumn("value", F.col("value") / 2)
    return epochs.RegionDataset(values, genes, items, size, 5, 6, 0.3, 4, members, expr, 2, near, images, **more)


def test_each_region_stands_once_in_each_epoch(spark):
    data, other = dataset(spark), dataset(spark, parts=7)
    assert data.n_batches == 4 and len(data) == 22
    orders = []
    for epoch in (0, 5):
        rows = data.epoch(epoch).orderBy("batch", "place").collect()
        again = other.epoch(epoch).orderBy("batch", "place").collect()
        assert [r.asDict(True) for r in rows] == [r.asDict(True) for r in again]
        assert [(r.batch, r.place) for r in rows] == [(k // 6, k % 6) for k in range(22)]
        orders.append([r.region_id for r in rows])
        assert sorted(orders[-1]) == [f"r{i:02d}" for i in range(22)]
    assert len({tuple(o) for o in orders}) == 2
    assert [r.region_id for r in data.epoch(None).orderBy("batch", "place").collect()] == sorted(orders[0])
    # a later step is there without those before it, and reads one batch
    fresh = dataset(spark)
    step = fresh.batch(4 * 5 + 2)
    assert sorted(r.region_id for r in step.collect()) == sorted(orders[1][12:18]) and list(fresh._tables) == [5]
    bare = next(r for r in data.epoch(5).collect() if r.region_id == "r07")
    assert bare.tokens == []
    fresh.close()
    assert not fresh._tables


def brute_loss(spark, rows, network, weights):
    t = training._arrays(training.terms(rows, network).toArrow().sort_by("region_id"))
    return training._losses(t, weights)[0]["loss"]


@pytest.fixture(scope="module")
def network():
    net = encoder.new_network(SHAPE, GENES, 3)
    rng = np.random.default_rng(1)
    return encoder.Network(SHAPE, net.genes, {k: v if k in ("gene", "context") or k.endswith(N.FIXED) else v + rng.normal(0, 0.2, v.shape) for k, v in net.weights.items()})


def test_gradients_of_a_step_equal_differences(spark, network):
    rows = dataset(spark).batch(0).coalesce(1).cache()
    weights = {"image_gene_loss": 0.5, "neighbor_loss": 0.25, "structure_loss": 0.7}
    found = training.terms(rows, network).toArrow().sort_by("region_id")
    t, ids = training._arrays(found), found.column("region_id").to_pylist()
    losses, d_region, d_image = training._losses(t, weights)
    assert math.isclose(losses["loss"], losses["gene_loss"] + 0.5 * losses["image_gene_loss"] + 0.25 * losses["neighbor_loss"] + 0.7 * losses["structure_loss"])
    up = {r: (0.5 * x, 0.5 * y) for r, x, y in zip(ids, d_region, d_image, strict=True)}
    scale = {"genes": 1 / t["n_mask"].sum(), "neighbors": 0.25 / t["n_near"].sum(), "structure": 0.7 / len(ids)}
    grads = training.gradients(rows, network, up, scale, 2)
    many = training.gradients(rows, network, up, scale, 19)
    assert set(grads) == set(many) and all(np.allclose(grads[k], many[k], atol=1e-12) for k in grads)
    for k, place in (("patch0.w", (3, 0, 2, 2)), ("layer0.qkv.w", (5, 2)), ("structure.w", (1, 3))):
        ends = []
        for step in (1e-4, -1e-4):
            moved = {**network.weights, k: network.weights[k].copy()}
            moved[k][place] += step
            ends.append(brute_loss(spark, rows, encoder.Network(SHAPE, network.genes, moved), weights))
        assert abs((ends[0] - ends[1]) / 2e-4 - grads[k][place]) < 5e-3 * max(0.1, abs(grads[k][place])), k


def test_contrast_and_its_gradient():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 3)), rng.normal(size=(5, 3))
    loss, dx, dy = training._contrast(x, y)
    rows = lambda a, b: np.mean([-math.log(math.exp(a[i] @ b[i] / 0.07 - m) / sum(math.exp(a[i] @ b[j] / 0.07 - m) for j in range(5))) for i in range(5) for m in [max(a[i] @ v / 0.07 for v in b)]])
    assert math.isclose(loss, (rows(x, y) + rows(y, x)) / 2, rel_tol=1e-9)
    for which, grad in ((x, dx), (y, dy)):
        which[1, 2] += 1e-5
        up = training._contrast(x, y)[0]
        which[1, 2] -= 2e-5
        down = training._contrast(x, y)[0]
        which[1, 2] += 1e-5
        assert abs((up - down) / 2e-5 - grad[1, 2]) < 1e-4
    assert training._contrast(x[:1], y[:1])[0] == 0


def test_update_is_adam_with_decay_and_clipping(network):
    state, plan = training.State(network), training.Plan(3, rate=0.1, decay=0.2, clip=1.0)
    w, m, v = network.weights["start"].copy(), 0.0, 0.0
    for step in (1, 2, 3):
        g = np.arange(8.0) * step
        state.step = step
        training.update(state, {"start": g, "last.norm.b": np.ones(8)}, 0.1, plan)
        g = g / (math.sqrt((g**2).sum() + 8) + 1e-6)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w * (1 - 0.1 * 0.2) - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(state.network.weights["start"], w) and state.network.weights["gene"] is network.weights["gene"]


def test_schedules_and_warm_ups(spark):
    plan = training.Plan(10, rate=2.0, schedule="cosine", warmup=4, image_gene=0.5, image_gene_warmup=10, save_every=3)
    got = training.rates(spark, plan)
    assert len(got) == 11 and math.isclose(got[0], 0.5) and math.isclose(got[3], 2.0) and got[10] < 1e-6
    assert training.rates(spark, training.Plan(2, rate=3.0)) == [3.0] * 3
    assert plan.loss_weights(5)["image_gene_loss"] == 0.25 and plan.loss_weights(50)["image_gene_loss"] == 0.5 and plan.loss_weights(1)["neighbor_loss"] == 0.25
    assert [s for s in range(1, 11) if plan.validates(s)] == [1, 3, 6, 9, 10]
    with pytest.raises(ValueError):
        training.rates(spark, training.Plan(2, schedule="steps"))


def test_training_resumes_with_the_same_weights(spark, network, tmp_path):
    train, val = "region_id < 'r18'", "region_id >= 'r18'"
    plan = training.Plan(4, rate=0.02, save_every=2, tasks=2)
    run = lambda steps, place, tasks=2: training.train(dataset(spark, where=train), network, training.Plan(**plan.__dict__ | {"steps": steps, "tasks": tasks}), f"file://{tmp_path}/{place}", dataset(spark, where=val))
    whole = run(4, "whole")
    assert run(2, "parts").step == 2
    resumed = run(4, "parts")
    assert all(np.array_equal(resumed.network.weights[k], v) for k, v in whole.network.weights.items()) and resumed.history == whole.history
    spread = run(2, "spread", 7)
    half = training.load_state(spark, f"file://{tmp_path}/whole/step_000002")
    assert half.step == 2 and all(np.allclose(spread.network.weights[k], v, atol=1e-9) for k, v in half.network.weights.items())
    assert whole.history[-1]["val_loss"] < whole.history[0]["val_loss"]
    checked = {r["step"]: r["val_loss"] for r in whole.history if "val_loss" in r}
    assert list(checked) == [1, 2, 4] and math.isclose(whole.best, min(checked.values()))
    best, last = (training.load_state(spark, f"file://{tmp_path}/whole/{k}") for k in ("best", "last"))
    assert checked[best.step] == whole.best and last.step == 4 and np.array_equal(last.network.weights["start"], whole.network.weights["start"])
    assert not np.array_equal(last.network.weights["gene"][1:], network.weights["gene"][1:]) and not last.network.weights["gene"][0].any()


def test_training_without_validation_or_regions(spark, network, tmp_path):
    with pytest.raises(ValueError, match="no regions"):
        training.train(dataset(spark, where="false"), network, training.Plan(1), f"file://{tmp_path}/a")
    state = training.train(dataset(spark, 30), network, training.Plan(1, image_gene=0.0, tasks=2), f"file://{tmp_path}/b")
    assert state.step == 1 and state.best == state.history[0]["loss"]
    assert training.load_state(spark, f"file://{tmp_path}/b/best").step == 1 and training.last_state(spark, f"file://{tmp_path}/b") is None
