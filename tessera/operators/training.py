"""Training of the network by data-parallel steps.

A step takes two passes over its batch: the first gives each region's embeddings and loss terms, from
which the driver works out what each embedding should change (regions of a batch are contrasted
with each other); the second gives gradients, which are added up in a tree of tasks.  What reaches the
driver is bounded by the batch and by the network, never by the data.  The state after a step is a
table, and a run that is started again goes on from the last one with the same results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import Config
from ..tables import folders
from . import encoder, metrics
from . import network as N
from .encoder import Network
from .epochs import RegionDataset

#: Partial sums that a task adds up.
FAN = 8
TEMPERATURE = 0.07
TERMS = ("loss", "gene_loss", "neighbor_loss", "image_gene_loss", "structure_loss")


@dataclass(frozen=True)
class Plan:
    """How to train: AdamW with decay, gradients clipped to a norm, weights of the losses with their warm-ups."""

    steps: int
    rate: float = 1e-4
    decay: float = 0.01
    schedule: str = "none"
    warmup: int = 0
    image_gene: float = 0.1
    neighbor: float = 0.25
    structure: float = 0.1
    image_gene_warmup: int = 0
    neighbor_warmup: int = 0
    structure_warmup: int = 0
    save_every: int | None = None
    clip: float = 1.0
    betas: tuple[float, float] = (0.9, 0.999)
    #: tasks that share a batch; None: as many as Spark's default parallelism
    tasks: int | None = None

    def loss_weights(self, step: int) -> dict[str, float]:
        up = lambda target, warm: target if warm <= 0 else target * min(1.0, step / warm)
        return {"image_gene_loss": up(self.image_gene, self.image_gene_warmup), "neighbor_loss": up(self.neighbor, self.neighbor_warmup), "structure_loss": up(self.structure, self.structure_warmup)}

    def validates(self, step: int) -> bool:
        return step == 1 or step >= self.steps or bool(self.save_every) and step % self.save_every == 0


@dataclass
class State:
    """Everything that the next step depends on."""

    network: Network
    step: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)
    best: float = math.inf
    history: list[dict[str, float]] = field(default_factory=list)


def save_state(spark: SparkSession, state: State, path: str, about: dict | None = None) -> None:
    """Write a state as a table: weights, both moments, and a row that says the rest."""
    rows = [(kind, k, list(v.shape), v.ravel().tolist(), None) for kind, arrays in (("first", state.first), ("second", state.second)) for k, v in arrays.items()]
    rest = {"step": state.step, "best": state.best, "history": state.history} | (about or {})
    rows.append(("about", "about", None, None, json.dumps(rest)))
    table = spark.createDataFrame(rows, "kind string, name string, shape array<int>, values array<double>, text string")
    encoder.to_rows(spark, state.network).withColumn("kind", F.lit("weight")).select(*table.columns).unionByName(table).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> State:
    table = spark.read.parquet(path)
    network = encoder.from_rows(table.where("kind = 'weight'").drop("kind"))
    rows = table.where("kind <> 'weight'").collect()  # bounded by the network
    about = json.loads(next(r["text"] for r in rows if r["kind"] == "about"))
    arrays = lambda kind: {r["name"]: np.array(r["values"], np.float64).reshape(r["shape"]) for r in rows if r["kind"] == kind}
    return State(network, about["step"], arrays("first"), arrays("second"), about["best"], about["history"])


def last_state(spark: SparkSession, path: str) -> State | None:
    """The state of the last step that was wholly written below ``path``."""
    steps = [f for f in folders(spark, path) if f.startswith("step_")]
    return load_state(spark, f"{path}/{steps[-1]}") if steps else None


def terms(rows: DataFrame, network: Network) -> DataFrame:
    """Of each region its embeddings and what it adds to the losses: squared errors and numbers of values, cross entropy of its structure."""
    names = ("sse", "n_mask", "near_sse", "n_near", "entropy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reader, a, b, out in encoder._outputs(batch, network):
                x = reader.arrays(a, b)
                real = x["ids"] > 0
                mask = x["mask"] & real
                logits = out.get("structure", np.zeros((b - a, 1)))
                top = logits.max(1)
                entropy = top + np.log(np.exp(logits - top[:, None]).sum(1)) - logits[np.arange(b - a), np.minimum(x["code"], logits.shape[1] - 1)]
                sums = ((out["genes"] - x["target"]) ** 2 * mask).sum(1), mask.sum(1), ((out["neighbors"] - x["neighbor"]) ** 2 * real).sum(1), real.sum(1), entropy
                vectors = [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in (out["region"], out["image"])]
                yield pa.RecordBatch.from_arrays(
                    [reader.region[a:b], batch.column("batch")[a:b], *[pa.array(s.astype(np.float64)) for s in sums], *vectors],
                    names=["region_id", "batch", *names, "vec", "image_vec"],
                )

    columns = [*encoder.COLUMNS, "batch"]
    return rows.select(*columns).mapInArrow(run, "region_id string, batch long, " + ", ".join(f"{n} double" for n in names) + ", vec array<double>, image_vec array<double>")


def _contrast(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of matching each of ``x`` with its own of ``y`` and the other way round, and its gradients; 0 below two rows."""
    n = len(x)
    if n < 2:
        return 0.0, np.zeros_like(x), np.zeros_like(y)
    logits = x @ y.T / TEMPERATURE
    loss, back = 0.0, np.zeros((n, n))
    for z, turn in ((logits, False), (logits.T, True)):
        e = np.exp(z - z.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        loss -= 0.5 * float(np.log(np.maximum(p[np.arange(n), np.arange(n)], 1e-300)).mean())
        g = 0.5 * (p - np.eye(n)) / n
        back += g.T if turn else g
    back /= TEMPERATURE
    return loss, back @ y, back.T @ x


def _losses(t: dict[str, np.ndarray], weights: dict[str, float]) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """The losses of a batch, and the gradients of the contrast by its vectors."""
    mean = lambda s, n: float(t[s].sum() / t[n].sum()) if t[n].sum() else 0.0
    contrast, d_region, d_image = _contrast(t["vec"], t["image_vec"])
    out = {"gene_loss": mean("sse", "n_mask"), "neighbor_loss": mean("near_sse", "n_near"), "image_gene_loss": contrast, "structure_loss": float(t["entropy"].mean())}
    return {"loss": out["gene_loss"] + sum(w * out[k] for k, w in weights.items())} | out, d_region, d_image


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    out = {c: np.asarray(table.column(c)) for c in ("sse", "n_mask", "near_sse", "n_near", "entropy")}
    return out | {c: np.array(table.column(c).to_pylist(), np.float64).reshape(table.num_rows, -1) for c in ("vec", "image_vec")}


def validate(rows: DataFrame, network: Network, weights: dict[str, float]) -> dict[str, float]:
    """``val_<loss>``: the mean over the batches of ``rows(.., batch)``; a batch is a task, of bounded size."""

    def one(table: pa.Table) -> pa.Table:
        losses, _, _ = _losses(_arrays(table.sort_by("region_id")), weights)
        return pa.table({k: [v] for k, v in losses.items()})

    each = terms(rows, network).groupBy("batch").applyInArrow(one, ", ".join(f"{k} double" for k in TERMS))
    got = metrics.validation_mean(each).first().asDict()
    return {} if got["val_loss"] is None else got


def gradients(rows: DataFrame, network: Network, upstream: dict[str, tuple[np.ndarray, np.ndarray]], scale: dict[str, float], tasks: int) -> dict[str, np.ndarray]:
    """The gradient of each weight over a batch: sums in ``tasks`` tasks, then in a tree.

    ``upstream`` has each region's gradients by its vectors, ``scale`` what a squared error of genes, of neighbours and an
    entropy weigh.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            reader = encoder.Reader(batch, network)
            for a, b in reader.pieces():
                x = reader.arrays(a, b)
                p = {k: N.Var(v) for k, v in network.weights.items()}
                out = N.forward(p, network.shape, x)
                real = x["ids"] > 0
                ways = [upstream[r] for r in reader.region[a:b].to_pylist()]
                back = [
                    (out["genes"], 2 * scale["genes"] * (out["genes"].data - x["target"]) * (x["mask"] & real)), (out["neighbors"], 2 * scale["neighbors"] * (out["neighbors"].data - x["neighbor"]) * real),
                    (out["region"], np.stack([w[0] for w in ways])), (out["image"], np.stack([w[1] for w in ways])),
                ]
                if "structure" in out:
                    e = np.exp(out["structure"].data - out["structure"].data.max(1, keepdims=True))
                    g = e / e.sum(1, keepdims=True)
                    g[np.arange(b - a), x["code"]] -= 1
                    back.append((out["structure"], scale["structure"] * g))
                N.backward(back)
                for k, v in p.items():
                    if v.grad is not None and not k.endswith(N.FIXED):
                        total[k] = total[k] + v.grad if k in total else v.grad
        names = list(total)
        part = pa.array([TaskContext.get().partitionId()] * len(names), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), part, pa.array([np.ascontiguousarray(total[k]).tobytes() for k in names], pa.binary())], names=["name", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        arrays = [np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist()]
        return pa.table({"name": table.column("name")[:1], "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), "sums": pa.array([sum(arrays[1:], arrays[0]).tobytes()], pa.binary())})

    ddl = "name string, part long, sums binary"
    sums = rows.select(*encoder.COLUMNS).repartition(tasks, "region_id").mapInArrow(run, ddl)
    width = tasks
    while width > 1:
        sums = sums.groupBy("name", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(add, ddl)
        width = math.ceil(width / FAN)
    return {r["name"]: np.frombuffer(r["sums"], np.float64).reshape(network.weights[r["name"]].shape) for r in sums.collect()}


def update(state: State, grads: dict[str, np.ndarray], rate: float, plan: Plan) -> None:
    """One step of AdamW with clipped gradients; weights without a gradient stay."""
    norm = math.sqrt(sum(float((g**2).sum()) for _, g in sorted(grads.items())))
    shrink = min(1.0, plan.clip / (norm + 1e-6))
    a, b = plan.betas
    weights = dict(state.network.weights)
    for k, g in grads.items():
        g = g * shrink
        m = state.first[k] = a * state.first.get(k, 0.0) + (1 - a) * g
        v = state.second[k] = b * state.second.get(k, 0.0) + (1 - b) * g * g
        w = weights[k] * (1 - rate * plan.decay)
        weights[k] = w - rate / (1 - a**state.step) * m / (np.sqrt(v / (1 - b**state.step)) + 1e-8)
    state.network = Network(state.network.shape, state.network.genes, weights)


def rates(spark: SparkSession, plan: Plan) -> list[float]:
    """The learning rate before each step, and after the last one."""
    if plan.schedule == "none":
        return [plan.rate] * (plan.steps + 1)
    if plan.schedule not in ("cosine", "onecycle"):
        raise ValueError(f"unknown schedule {plan.schedule!r}")
    steps = spark.range(plan.steps + 1).select(F.col("id").alias("step"))
    table = (metrics.cosine_schedule if plan.schedule == "cosine" else metrics.one_cycle_schedule)(steps, plan.steps, plan.warmup)
    return [plan.rate * r["factor"] for r in table.orderBy("step").collect()]  # a number for each step


def train(data: RegionDataset, network: Network, plan: Plan, path: str, validation: RegionDataset | None = None, about: dict | None = None) -> State:
    """Train ``network`` on ``data``; states go below ``path`` as ``step_<n>``, ``best`` and ``last``.

    If ``path`` has states of an earlier run, it goes on from the last.  Losses are validated after the first step,
    the last, and each that is saved; ``best`` is the state of least ``val_loss``, or the last one without
    validation.  ValueError without regions.
    """
    if not len(data):
        raise ValueError("no regions to train on")
    spark = data.items.sparkSession
    state = last_state(spark, path) or State(network)
    each = rates(spark, plan)
    tasks = plan.tasks or spark.sparkContext.defaultParallelism
    checks = validation is not None and len(validation) > 0
    while state.step < plan.steps:
        rows = data.batch(state.step)
        weights = plan.loss_weights(state.step + 1)
        found = terms(rows, state.network).toArrow().sort_by("region_id")  # a batch
        t, ids = _arrays(found), found.column("region_id").to_pylist()
        losses, d_region, d_image = _losses(t, weights)
        w = weights["image_gene_loss"]
        upstream = {r: (w * x, w * y) for r, x, y in zip(ids, d_region, d_image, strict=True)}
        scale = {"genes": 1 / max(1, t["n_mask"].sum()), "neighbors": weights["neighbor_loss"] / max(1, t["n_near"].sum()), "structure": weights["structure_loss"] / len(ids)}
        grads = gradients(rows, state.network, upstream, scale, tasks)
        state.step += 1
        update(state, grads, each[state.step - 1], plan)
        row = losses | {"step": state.step, "lr": each[state.step]} | {f"{k}_weight": v for k, v in weights.items()}
        better = False
        if checks and plan.validates(state.step):
            row |= validate(validation.epoch(None), state.network, weights)
            better = row["val_loss"] < state.best
            state.best = min(state.best, row["val_loss"])
        state.history.append(row)
        if better:
            save_state(spark, state, f"{path}/best", about)
        if plan.save_every and state.step % plan.save_every == 0:
            save_state(spark, state, f"{path}/step_{state.step:06d}", about)
    if math.isinf(state.best):
        state.best = state.history[-1]["loss"] if state.history else math.nan
        save_state(spark, state, f"{path}/best", about)
    save_state(spark, state, f"{path}/last", about)
    return state


def plan_of(cfg: Config) -> Plan:
    """The plan that a configuration asks for."""
    t = cfg.training
    return Plan(
        steps=t.max_steps, rate=t.rate, decay=t.decay, schedule=t.schedule, warmup=t.warmup_steps, image_gene=t.image_gene_weight, neighbor=t.neighborhood_weight, structure=t.structure_weight,
        image_gene_warmup=t.image_gene_warmup, neighbor_warmup=t.neighborhood_warmup, structure_warmup=t.structure_warmup, save_every=t.save_every,
    )

