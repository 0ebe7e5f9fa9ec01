"""The network against loops over single numbers, and its rows against regions taken one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encoder, features, regions
from tessera.operators import network as N

RNG = np.random.default_rng(8)
GENES = [f"g{i}" for i in range(12)]
SHAPE = N.Shape(size=8, heads=2, layers=2, inner=12, bins=5, image_size=9, channels=3, scales=(1, 2), structures=3)


def slow_norm(x, w, b):
    m = sum(x) / len(x)
    s = math.sqrt(sum((v - m) ** 2 for v in x) / len(x) + 1e-5)
    return [(v - m) / s * wi + bi for v, wi, bi in zip(x, w, b, strict=True)]


def slow_line(x, w, b):
    return [sum(wi * v for wi, v in zip(row, x, strict=True)) + bi for row, bi in zip(w, b, strict=True)]


def slow_gelu(x):
    return [v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x]


def slow_convolve(x, w, b, stride, pad):
    n_out, n_in, k, _ = w.shape
    height, width = ((s + 2 * pad - k) // stride + 1 for s in x.shape[1:])
    out = np.zeros((n_out, height, width))
    for o in range(n_out):
        for i in range(height):
            for j in range(width):
                total = b[o]
                for c in range(n_in):
                    for u in range(k):
                        for v in range(k):
                            y, z = i * stride + u - pad, j * stride + v - pad
                            if 0 <= y < x.shape[1] and 0 <= z < x.shape[2]:
                                total += w[o, c, u, v] * x[c, y, z]
                out[o, i, j] = total
    return out


def slow_patch(w, shape, image):
    out = []
    for scale in sorted(set(shape.scales)):
        size = -(-image.shape[1] // scale)
        x = np.array([[[image[c, i * scale : (i + 1) * scale, j * scale : (j + 1) * scale].mean() for j in range(size)] for i in range(size)] for c in range(image.shape[0])])
        for i, (n_out, _, stride, pad) in enumerate(N.LAYERS):
            x = slow_convolve(x, w[f"patch{i}.w"], w[f"patch{i}.b"], stride, pad)
            x = np.array(slow_gelu(x.ravel().tolist())).reshape(x.shape)
            if i < 2:
                for c in range(n_out):
                    x[c] = (x[c] - w[f"patch{i}.norm.mean"][c]) / math.sqrt(w[f"patch{i}.norm.var"][c] + 1e-5) * w[f"patch{i}.norm.w"][c] + w[f"patch{i}.norm.b"][c]
        out += slow_norm(slow_line([c.mean() for c in x], w["patch.out.w"], w["patch.out.b"]), w["patch.out.norm.w"], w["patch.out.norm.b"])
    return out if len(set(shape.scales)) == 1 else slow_norm(slow_gelu(slow_line(out, w["fusion.w"], w["fusion.b"])), w["fusion.norm.w"], w["fusion.norm.b"])


def slow_region(w, shape, tokens, cells, image, spatial, context):
    """Outputs of one region: tokens are (id, input, bin), all without padding."""
    mlp = lambda x, name: slow_norm(slow_gelu(slow_line(x, w[f"{name}.w"], w[f"{name}.b"])), w[f"{name}.norm.w"], w[f"{name}.norm.b"])
    add = lambda *v: [sum(x) for x in zip(*v, strict=True)]
    zero = [0.0] * shape.size
    gene = [w["gene"][i].tolist() for i, _, _ in tokens]
    seq = [w["start"].tolist(), slow_patch(w, shape, image) if shape.use_image else zero, mlp(spatial, "spatial") if shape.use_spatial else zero, w["context"][context].tolist() if shape.use_structure else zero]
    if shape.use_cells:
        for cell in cells:
            mean = [sum(x) / max(1, len(gene)) for x in zip(*[add(g, mlp([v], "value")) for g, v in zip(gene, cell, strict=True)], strict=True)]
            seq.append(slow_norm(mean, w["cell.norm.w"], w["cell.norm.b"]))
    start = len(seq)
    seq += [add(g, mlp([v], "value"), w["bin"][b].tolist()) if shape.use_expression else g for g, (_, v, b) in zip(gene, tokens, strict=True)]
    wide = shape.size // shape.heads
    for i in range(shape.layers):
        own = lambda name, i=i: (w[f"layer{i}.{name}.w"], w[f"layer{i}.{name}.b"])
        qkv = [slow_line(slow_norm(x, *own("norm1")), *own("qkv")) for x in seq]
        mixed = [[] for _ in seq]
        for h in range(shape.heads):
            cut = lambda v, j, h=h: v[j * shape.size + h * wide : j * shape.size + (h + 1) * wide]
            for a, x in enumerate(qkv):
                s = [sum(u * v for u, v in zip(cut(x, 0), cut(y, 1), strict=True)) / math.sqrt(wide) for y in qkv]
                e = [math.exp(v - max(s)) for v in s]
                mixed[a] += [sum(p * cut(y, 2)[c] for p, y in zip(e, qkv, strict=True)) / sum(e) for c in range(wide)]
        seq = [add(x, slow_line(m, *own("mix"))) for x, m in zip(seq, mixed, strict=True)]
        seq = [add(x, slow_line(slow_gelu(slow_line(slow_norm(x, *own("norm2")), *own("up"))), *own("down"))) for x in seq]
    seq = [slow_norm(x, w["last.norm.w"], w["last.norm.b"]) for x in seq]
    head = lambda name: [slow_line(slow_gelu(slow_line(x, w[f"{name}.in.w"], w[f"{name}.in.b"])), w[f"{name}.out.w"], w[f"{name}.out.b"])[0] for x in seq[start:]]
    length = math.sqrt(sum(v * v for v in seq[0]))
    return [v / length for v in seq[0]], head("genes"), head("neighbors")


def weights(shape, seed=1):
    rng = np.random.default_rng(seed)
    w = N.initial(shape, len(GENES), seed)
    return {k: v if k in ("gene", "context") else np.abs(v + rng.normal(0, 0.1, v.shape)) if k.endswith(".var") else v + rng.normal(0, 0.1, v.shape) for k, v in w.items()}


def made_rows(n):
    rows = []
    for i in range(n):
        chosen = sorted(RNG.choice(12, RNG.integers(0 if i == 3 else 1, 8), replace=False).tolist())
        tokens = [(GENES[g], float(v := RNG.uniform(0, 3)), 0.0 if RNG.random() < 0.3 else v, int(RNG.integers(0, 5)), bool(RNG.random() < 0.3), float(RNG.uniform(0, 2))) for g in chosen]
        cells = [[float(x) for x in RNG.uniform(0, 2, len(tokens))] for _ in range(RNG.integers(0, 4))]
        pixels = None if i % 4 == 0 else RNG.integers(0, 256, 9 * 9 * 3).astype(np.uint8).tobytes()
        rows.append((f"r{i}", tokens, cells, float(RNG.normal()), float(RNG.normal()), int(RNG.integers(0, 4)), int(RNG.integers(0, 3)), pixels))
    return rows


DDL = "region_id string, tokens array<struct<gene: string, value: double, input: double, bin: int, mask: boolean, neighbor: double>>, cells array<array<double>>, x_z double, y_z double, context_id long, code long, pixels binary"
VIEWS = {"all": {}, "one scale": {"scales": (1,)}, "genes": {"use_image": False, "use_spatial": False, "use_structure": False, "use_cells": False}, "blind": {"use_expression": False, "use_cells": False}, "one structure": {"structures": 1}}


@pytest.mark.parametrize("view", VIEWS)
def test_rows_equal_a_loop(spark, view, monkeypatch):
    shape = N.Shape(**SHAPE.__dict__ | VIEWS[view])
    w = weights(shape)
    net = encoder.Network(shape, tuple(GENES), w)
    rows = made_rows(20)
    if shape.structures == 1:
        rows = [(*r[:5], min(r[5], 1), 0, r[7]) for r in rows]
    table = spark.createDataFrame(rows, DDL).repartition(3)
    net = encoder.from_rows(encoder.to_rows(spark, net))
    got = {r.region_id: r for r in encoder.embed(table, net).collect()}
    tokens = {(r.region_id, r.gene): r for r in encoder.predict(table, net).collect()}
    assert set(got) == {r[0] for r in rows} and len(tokens) == sum(len(r[1]) for r in rows)
    for name, toks, cells, x, y, context, _, pixels in rows:
        image = np.zeros((3, 9, 9)) if pixels is None else np.moveaxis(np.frombuffer(pixels, np.uint8).reshape(9, 9, 3) / 255, 2, 0)
        vec, genes, near = slow_region(w, shape, [(GENES.index(t[0]) + 1, t[2], t[3]) for t in toks], cells if toks else [[] for _ in cells][:0], image, [x, y], context)
        if toks or not cells:
            assert np.allclose(got[name].vec, vec, atol=2e-5), name
        assert np.allclose([tokens[name, t[0]].pred for t in toks], genes, atol=2e-5) and np.allclose([tokens[name, t[0]].neighbor_pred for t in toks], near, atol=2e-5)
        assert all(tokens[name, t[0]].target == t[1] and tokens[name, t[0]].mask == t[4] and tokens[name, t[0]].neighbor_target == t[5] for t in toks)
        assert abs(np.linalg.norm(got[name].image_vec) - float(shape.use_image)) < 1e-5


def test_micro_batches_change_nothing(spark, monkeypatch):
    net = encoder.Network(SHAPE, tuple(GENES), weights(SHAPE))
    table = spark.createDataFrame(made_rows(12), DDL).coalesce(1)
    whole = {r.region_id: r.vec for r in encoder.embed(table, net).collect()}
    pieces = list(N.micro_batches([5, 900, 900, 3], [0, 64, 0, 0], SHAPE))
    assert [a for a, _ in pieces] == [0, *[b for _, b in pieces[:-1]]] and pieces[-1][1] == 4 and len(pieces) > 1
    one = {k: v for r in made_rows(0) for k, v in r}
    for row in table.collect():
        one |= {r.region_id: r.vec for r in encoder.embed(spark.createDataFrame([row], table.schema), net).collect()}
    assert all(np.allclose(one[k], whole[k], atol=1e-6) for k in whole)


def test_vocabulary_and_weights_are_checked(spark):
    net = encoder.new_network(SHAPE, GENES[:5])
    table = spark.createDataFrame([("r", [("g9", 1.0, 1.0, 0, False, 0.0)], [], 0.0, 0.0, 0, 0, None)], DDL)
    with pytest.raises(Exception, match="g9"):
        encoder.embed(table, net).collect()
    rows = encoder.to_rows(spark, net)
    with pytest.raises(ValueError, match="last.norm.w"):
        encoder.from_rows(rows.where("name <> 'last.norm.w'"))
    with pytest.raises(ValueError, match="heads"):
        N.Shape(size=9, heads=2)
    assert encoder.embed(table.limit(0), net).count() == 0


def test_inputs_of_a_case(spark):
    values = spark.createDataFrame([("a", "g1", 2.0), ("a", "g2", 1.0), ("b", "g1", 3.0), ("c", "g3", 1.0)], "region_id string, gene string, value double")
    genes = spark.createDataFrame([(g,) for g in GENES], "gene string")
    near = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "region_id string, neighbor_id string")
    items = features.region_items(spark.createDataFrame([("a", 0.0, 1.0, "s", "one.png"), ("b", 2.0, 1.0, "t", None), ("c", 4.0, 1.0, None, "gone")], "region_id string, x double, y double, structure_label string, image_path string"))
    images = spark.createDataFrame([("one.png", bytearray(9 * 9 * 3))], "image_path string, pixels binary")
    got = {r.region_id: r for r in encoder.inputs(features.region_batches(values, 5, 4, 0.2, 1, genes), items, images, regions.neighbor_mean(values, near)).collect()}
    assert all(len(r.tokens) == 5 and [t.gene for t in r.tokens] == sorted(t.gene for t in r.tokens) for r in got.values())
    by_gene = {k: {t.gene: t for t in r.tokens} for k, r in got.items()}
    assert math.isclose(by_gene["a"]["g1"].neighbor, math.log1p(3)) and math.isclose(by_gene["b"]["g1"].neighbor, math.log1p(1.0)) and by_gene["a"]["g2"].neighbor == 0
    assert (got["a"].pixels is not None, got["b"].pixels, got["c"].pixels) == (True, None, None)
    net = encoder.new_network(N.Shape(**SHAPE.__dict__ | {"bins": 4}), GENES)
    out = encoder.embed(encoder.inputs(features.region_batches(values, 5, 4, 0.2, 1, genes), items), net)
    assert out.where(F.abs(F.aggregate(F.transform("vec", lambda v: v.cast("double") * v), F.lit(0.0), lambda a, v: a + v) - 1) > 1e-5).count() == 0 and out.count() == 3


def test_gradients_equal_differences():
    shape = N.Shape(size=4, heads=2, layers=1, inner=5, bins=3, image_size=5, channels=1, scales=(1, 2), structures=2)
    rng = np.random.default_rng(0)
    w = {k: v + rng.normal(0, 0.3, v.shape) * (k not in ("gene", "context")) for k, v in N.initial(shape, 6, 2).items()}
    w = {k: np.abs(v) + 0.5 if k.endswith(".var") else v for k, v in w.items()}
    w["gene"][1:], w["context"][1:] = rng.normal(size=(6, 4)), rng.normal(size=(2, 4))
    batch = {
        "ids": np.array([[1, 2, 3], [4, 6, 0]]), "bins": np.array([[0, 1, 2], [2, 2, 0]]), "input": rng.uniform(0, 2, (2, 3)), "cells": rng.uniform(0, 2, (2, 2, 3)),
        "no_cell": np.array([[False, False], [False, True]]), "image": rng.uniform(0, 1, (2, 1, 5, 5)), "spatial": rng.normal(size=(2, 2)), "context": np.array([1, 0]),
    }
    ways = {}

    def value(arrays):
        out = N.forward({k: N.Var(v) for k, v in arrays.items()}, shape, batch)
        return sum(float((v.data * ways.setdefault(k, rng.normal(size=v.data.shape))).sum()) for k, v in sorted(out.items()))

    value(w)
    p = {k: N.Var(v) for k, v in w.items()}
    N.backward([(v, ways[k]) for k, v in N.forward(p, shape, batch).items()])
    for k, v in w.items():
        if k.endswith(N.FIXED):
            continue
        for at in rng.choice(v.size, min(4, v.size), replace=False):
            place = np.unravel_index(at, v.shape)
            if k in ("gene", "context") and place[0] == 0:
                continue
            ends = []
            for step in (1e-4, -1e-4):
                moved = {**w, k: v.copy()}
                moved[k][place] += step
                ends.append(value(moved))
            slope = (ends[0] - ends[1]) / 2e-4
            got = 0.0 if p[k].grad is None else p[k].grad[place]
            assert abs(got - slope) < 5e-3 * max(1.0, abs(slope)), (k, place, got, slope)
