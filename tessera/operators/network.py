"""The network of regions in numpy: patch encoder, context tokens, attention, decoders, and their gradients.

It works on a few regions at a time, inside a task; ``encoder`` and ``training`` deal the regions out.
Weights are arrays by name, all double, so that sums over batches hardly depend on how rows are dealt.
Batch norm uses its running figures always, as at inference; there is no dropout.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np

EPS = 1e-5
#: Channels of the patch encoder's three layers, with kernel, stride and padding.
LAYERS = ((32, 5, 2, 2), (64, 3, 2, 1), (96, 3, 2, 1))
#: Numbers in the largest array of a micro-batch, should one region not need more.
MOST = 4_000_000


@dataclass(frozen=True)
class Shape:
    """What a network sees and how large it is."""

    size: int = 128
    heads: int = 4
    layers: int = 2
    inner: int | None = None
    bins: int = 51
    image_size: int = 224
    channels: int = 3
    scales: tuple[int, ...] = (1,)
    structures: int = 1
    use_expression: bool = True
    use_image: bool = True
    use_spatial: bool = True
    use_structure: bool = True
    use_cells: bool = True

    def __post_init__(self) -> None:
        if self.size % self.heads:
            raise ValueError(f"size {self.size} is no multiple of {self.heads} heads")
        if not self.scales or min(self.scales) < 1:
            raise ValueError(f"scales: {self.scales}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Shape:
        got = json.loads(text)
        return Shape(**got | {"scales": tuple(got["scales"])})


class Var:
    """An array, and how a gradient of it goes on to those it was made from."""

    __slots__ = ("data", "grad", "parents")
    recording = True

    def __init__(self, data: np.ndarray, parents: tuple[tuple[Var, Callable[[np.ndarray], np.ndarray]], ...] = ()) -> None:
        self.data, self.grad = data, None
        self.parents = parents if Var.recording else ()

    def __add__(self, other: Var) -> Var:
        return Var(self.data + other.data, ((self, lambda g: _fit(g, self)), (other, lambda g: _fit(g, other))))

    def times(self, c: np.ndarray | float) -> Var:
        return Var(self.data * c, ((self, lambda g: _fit(g * c, self)),))

    def reshape(self, *shape: int) -> Var:
        return Var(self.data.reshape(*shape), ((self, lambda g: g.reshape(self.data.shape)),))

    def turn(self, *axes: int) -> Var:
        return Var(self.data.transpose(axes), ((self, lambda g: g.transpose(np.argsort(axes))),))

    def part(self, at: tuple) -> Var:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.data)
            out[at] = g
            return out

        return Var(self.data[at], ((self, back),))

    def total(self, axes: tuple[int, ...]) -> Var:
        return Var(self.data.sum(axes), ((self, lambda g: np.broadcast_to(np.expand_dims(g, axes), self.data.shape)),))


def _fit(g: np.ndarray, to: Var) -> np.ndarray:
    """A gradient summed over the axes along which ``to`` was spread."""
    shape = to.data.shape
    g = g.sum(tuple(range(g.ndim - len(shape))))
    return g.sum(tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] > 1), keepdims=True)


def backward(outputs: list[tuple[Var, np.ndarray]]) -> None:
    """Gradients of all that ``outputs`` were made from, added up in ``grad``."""
    order, seen, stack = [], set(), [(v, False) for v, _ in outputs]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack += [(p, False) for p, _ in v.parents]
    for v, g in outputs:
        v.grad = g if v.grad is None else v.grad + g
    for v in reversed(order):
        if v.grad is not None:
            for p, way in v.parents:
                g = way(v.grad)
                p.grad = g if p.grad is None else p.grad + g


def matmul(a: Var, b: Var) -> Var:
    return Var(a.data @ b.data, ((a, lambda g: _fit(g @ b.data.swapaxes(-1, -2), a)), (b, lambda g: _fit(a.data.swapaxes(-1, -2) @ g, b))))


def linear(x: Var, w: Var, b: Var) -> Var:
    n_out, n_in = w.data.shape
    flat = lambda g: g.reshape(-1, n_out)
    return Var(x.data @ w.data.T + b.data, ((x, lambda g: g @ w.data), (w, lambda g: flat(g).T @ x.data.reshape(-1, n_in)), (b, lambda g: flat(g).sum(0))))


def take(table: Var, at: np.ndarray) -> Var:
    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(table.data)
        np.add.at(out, at, g)
        out[0 if table_pads(table) else slice(0, 0)] = 0.0
        return out

    return Var(table.data[at], ((table, back),))


def table_pads(table: Var) -> bool:
    """Whether row 0 stands for nothing: it is zero and stays so."""
    return not table.data[0].any()


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: Var) -> Var:
    phi = 0.5 * (1 + _erf(x.data / math.sqrt(2)))
    return Var(x.data * phi, ((x, lambda g: g * (phi + x.data * np.exp(-x.data**2 / 2) / math.sqrt(2 * math.pi))),))


def layer_norm(x: Var, w: Var, b: Var) -> Var:
    mean = x.data.mean(-1, keepdims=True)
    scale = 1 / np.sqrt(((x.data - mean) ** 2).mean(-1, keepdims=True) + EPS)
    y = (x.data - mean) * scale

    def back(g: np.ndarray) -> np.ndarray:
        g = g * w.data
        return scale * (g - g.mean(-1, keepdims=True) - y * (g * y).mean(-1, keepdims=True))

    return Var(y * w.data + b.data, ((x, back), (w, lambda g: _fit(g * y, w)), (b, lambda g: _fit(g, b))))


def softmax(x: Var) -> Var:
    e = np.exp(x.data - x.data.max(-1, keepdims=True))
    p = e / e.sum(-1, keepdims=True)
    return Var(p, ((x, lambda g: p * (g - (g * p).sum(-1, keepdims=True))),))


def unit(x: Var) -> Var:
    """Rows at length one."""
    length = np.maximum(np.sqrt((x.data**2).sum(-1, keepdims=True)), 1e-12)
    y = x.data / length
    return Var(y, ((x, lambda g: (g - y * (g * y).sum(-1, keepdims=True)) / length),))


def concat(parts: list[Var], axis: int) -> Var:
    ends = np.cumsum([0, *[p.data.shape[axis] for p in parts]])
    cut = lambda i: (lambda g: np.take(g, np.arange(ends[i], ends[i + 1]), axis))
    return Var(np.concatenate([p.data for p in parts], axis), tuple((p, cut(i)) for i, p in enumerate(parts)))


def convolve(x: Var, w: Var, b: Var, stride: int, pad: int) -> Var:
    """Convolution of (n, channels, height, width) by unfolded windows."""
    n_out, _, k, _ = w.data.shape
    padded = np.pad(x.data, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(2, 3))[:, :, ::stride, ::stride]
    n, c, height, width = windows.shape[:4]
    flat = windows.transpose(0, 2, 3, 1, 4, 5).reshape(n * height * width, c * k * k)
    out = (flat @ w.data.reshape(n_out, -1).T + b.data).reshape(n, height, width, n_out).transpose(0, 3, 1, 2)
    rows = lambda g: g.transpose(0, 2, 3, 1).reshape(-1, n_out)

    def back(g: np.ndarray) -> np.ndarray:
        each = (rows(g) @ w.data.reshape(n_out, -1)).reshape(n, height, width, c, k, k)
        total = np.zeros_like(padded)
        for i in range(k):
            for j in range(k):
                total[:, :, i : i + stride * height : stride, j : j + stride * width : stride] += each[:, :, :, :, i, j].transpose(0, 3, 1, 2)
        return total[:, :, pad : pad + x.data.shape[2], pad : pad + x.data.shape[3]]

    return Var(out, ((x, back), (w, lambda g: (rows(g).T @ flat).reshape(w.data.shape)), (b, lambda g: rows(g).sum(0))))


def pooled(image: np.ndarray, scale: int) -> np.ndarray:
    """Means of squares of ``scale`` by ``scale``; those at the far edges are of what is there."""
    out = image
    for axis in (2, 3):
        at = np.arange(0, out.shape[axis], scale)
        count = np.diff(np.append(at, out.shape[axis])).reshape(-1, *[1] * (3 - axis))
        out = np.add.reduceat(out, at, axis) / count
    return out


def names(shape: Shape, genes: int) -> dict[str, tuple[int, ...]]:
    """The weights of a network, with their shapes."""
    d, inner = shape.size, shape.inner or 4 * shape.size
    out: dict[str, tuple[int, ...]] = {"gene": (genes + 1, d), "bin": (shape.bins, d), "context": (shape.structures + 1, d), "start": (d,)}

    def line(name: str, n_in: int, n_out: int) -> None:
        out.update({f"{name}.w": (n_out, n_in), f"{name}.b": (n_out,)})

    def norm(name: str) -> None:
        out.update({f"{name}.w": (d,), f"{name}.b": (d,)})

    for name, n_in in (("value", 1), ("spatial", 2), ("patch.out", LAYERS[-1][0]), *([("fusion", d * len(set(shape.scales)))] if len(set(shape.scales)) > 1 else [])):
        line(name, n_in, d)
        norm(f"{name}.norm")
    c = shape.channels
    for i, (n_out, k, _, _) in enumerate(LAYERS):
        out.update({f"patch{i}.w": (n_out, c, k, k), f"patch{i}.b": (n_out,)})
        if i < len(LAYERS) - 1:
            out.update({f"patch{i}.norm.{x}": (n_out,) for x in ("w", "b", "mean", "var")})
        c = n_out
    norm("cell.norm")
    for i in range(shape.layers):
        norm(f"layer{i}.norm1")
        line(f"layer{i}.qkv", d, 3 * d)
        line(f"layer{i}.mix", d, d)
        norm(f"layer{i}.norm2")
        line(f"layer{i}.up", d, inner)
        line(f"layer{i}.down", inner, d)
    norm("last.norm")
    for name in ("genes", "neighbors"):
        line(f"{name}.in", d, d)
        line(f"{name}.out", d, 1)
    if shape.structures > 1:
        line("structure", d, shape.structures)
    return out


#: Weights that are kept as they are.
FIXED = (".norm.mean", ".norm.var")


def initial(shape: Shape, genes: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights: norms at one and zero, biases at zero, others normal by the number of inputs; row 0 of genes and contexts is zero."""
    rng, out = np.random.default_rng(seed), {}
    for name, s in names(shape, genes).items():
        if ".norm" in name:
            out[name] = np.ones(s) if name.endswith((".w", ".var")) else np.zeros(s)
        elif name.endswith(".b"):
            out[name] = np.zeros(s)
        else:
            out[name] = rng.normal(0, 0.02 if name in ("gene", "bin", "context", "start") else 1 / math.sqrt(math.prod(s[1:])), s)
    out["gene"][0] = out["context"][0] = 0.0
    return out


def micro_batches(rows: list[int], cells: list[int], shape: Shape) -> Iterator[tuple[int, int]]:
    """Stretches of regions, given their numbers of tokens and cells, whose arrays keep to ``MOST`` numbers."""
    at = 0
    while at < len(rows):
        to, n, c = at, 0, 0
        while to < len(rows):
            n, c = max(n, rows[to]), max(c, cells[to])
            length = 4 + c + n
            need = max(shape.heads * length**2, c * n * shape.size, length * (shape.inner or 4 * shape.size), 60 * shape.image_size**2 if shape.use_image else 0)
            if to > at and (to + 1 - at) * need > MOST:
                break
            to += 1
        yield at, to
        at = to


def forward(p: dict[str, Var], shape: Shape, batch: dict[str, np.ndarray]) -> dict[str, Var]:
    """Predictions and embeddings of a micro-batch.

    ``ids``, ``input``, ``bins`` are (n, genes), id 0 where there is none; ``cells`` (n, cells, genes) with ``no_cell``
    (n, cells); ``image`` (n, channels, size, size); ``spatial`` (n, 2); ``context`` (n,).
    """
    ids = batch["ids"]
    n, length = ids.shape
    d = shape.size
    mlp = lambda x, name: layer_norm(gelu(linear(x, p[f"{name}.w"], p[f"{name}.b"])), p[f"{name}.norm.w"], p[f"{name}.norm.b"])
    nothing = lambda *s: Var(np.zeros(s))
    gene = take(p["gene"], ids)
    tokens = gene
    if shape.use_expression:
        tokens = gene + mlp(Var(batch["input"][..., None]), "value") + take(p["bin"], np.maximum(batch["bins"], 0))
    image = encode_patch(p, shape, batch["image"]) if shape.use_image else nothing(n, d)
    spatial = mlp(Var(batch["spatial"]), "spatial") if shape.use_spatial else nothing(n, d)
    context = take(p["context"], np.clip(batch["context"], 0, shape.structures)) if shape.use_structure else nothing(n, d)
    hidden = [np.zeros((n, 4), bool), ids == 0]
    parts = [p["start"].reshape(1, 1, d) + nothing(n, 1, d), *[x.reshape(n, 1, d) for x in (image, spatial, context)], tokens]
    n_cells = 0
    if shape.use_cells and batch["cells"].shape[1]:
        n_cells = batch["cells"].shape[1]
        real = np.abs(gene.data).sum(-1) > 0
        each = gene.reshape(n, 1, length, d) + mlp(Var(batch["cells"][..., None]), "value")
        mean = each.times((real / np.maximum(real.sum(1, keepdims=True), 1))[:, None, :, None]).total((2,))
        cell = layer_norm(mean, p["cell.norm.w"], p["cell.norm.b"]).times(~batch["no_cell"][..., None])
        parts.insert(4, cell)
        hidden.insert(1, batch["no_cell"])
    x = concat(parts, 1)
    mask = np.where(np.concatenate(hidden, 1), -1e30, 0.0)[:, None, None, :]
    whole, wide = x.data.shape[1], d // shape.heads
    for i in range(shape.layers):
        own = lambda name, i=i: (p[f"layer{i}.{name}.w"], p[f"layer{i}.{name}.b"])
        qkv = linear(layer_norm(x, *own("norm1")), *own("qkv")).reshape(n, whole, 3, shape.heads, wide).turn(2, 0, 3, 1, 4)
        q, k, v = (qkv.part((j,)) for j in range(3))
        weight = softmax(matmul(q, k.turn(0, 1, 3, 2)).times(1 / math.sqrt(wide)) + Var(mask))
        x = x + linear(matmul(weight, v).turn(0, 2, 1, 3).reshape(n, whole, d), *own("mix"))
        x = x + linear(gelu(linear(layer_norm(x, *own("norm2")), *own("up"))), *own("down"))
    x = layer_norm(x, p["last.norm.w"], p["last.norm.b"])
    region, out = x.part((slice(None), 0)), x.part((slice(None), slice(4 + n_cells, None)))
    head = lambda name: linear(gelu(linear(out, p[f"{name}.in.w"], p[f"{name}.in.b"])), p[f"{name}.out.w"], p[f"{name}.out.b"]).reshape(n, length)
    result = {"genes": head("genes"), "neighbors": head("neighbors"), "region": unit(region), "image": unit(image)}
    if shape.structures > 1:
        result["structure"] = linear(region, p["structure.w"], p["structure.b"])
    return result


def encode_patch(p: dict[str, Var], shape: Shape, image: np.ndarray) -> Var:
    """Vectors of images (n, channels, size, size): convolutions at each scale, then what the scales say together."""
    scales = sorted(set(shape.scales))
    out = []
    for scale in scales:
        x = Var(pooled(image, scale) if scale > 1 else image)
        for i, (n_out, _, stride, pad) in enumerate(LAYERS):
            x = gelu(convolve(x, p[f"patch{i}.w"], p[f"patch{i}.b"], stride, pad))
            if i < len(LAYERS) - 1:
                norm = {k: p[f"patch{i}.norm.{k}"] for k in ("w", "b", "mean", "var")}
                still = (x + Var(-norm["mean"].data.reshape(1, n_out, 1, 1))).times(1 / np.sqrt(norm["var"].data.reshape(1, n_out, 1, 1) + EPS))
                x = scaled(still, norm["w"].reshape(1, n_out, 1, 1)) + norm["b"].reshape(1, n_out, 1, 1)
        mean = x.total((2, 3)).times(1 / (x.data.shape[2] * x.data.shape[3]))
        out.append(layer_norm(linear(mean, p["patch.out.w"], p["patch.out.b"]), p["patch.out.norm.w"], p["patch.out.norm.b"]))
    if len(scales) == 1:
        return out[0]
    return layer_norm(gelu(linear(concat(out, 1), p["fusion.w"], p["fusion.b"])), p["fusion.norm.w"], p["fusion.norm.b"])


def scaled(a: Var, b: Var) -> Var:
    return Var(a.data * b.data, ((a, lambda g: _fit(g * b.data, a)), (b, lambda g: _fit(g * a.data, b))))
