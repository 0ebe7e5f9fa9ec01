"""Strict configuration: unknown keys are errors; presets and ablations change known ones."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class DataConfig:
    #: "synthetic", "tables" (canonical tables in ``root``), "xenium" (an instrument's folder) or "corpus" (either in each of ``roots``)
    mode: str = "synthetic"
    root: str | None = None
    roots: tuple[str, ...] = ()
    patches: str | None = None
    images: str | None = None
    structures: str | None = None
    contour_map: str | None = None
    panel: str | None = None
    panel_genes: tuple[str, ...] = ()
    region_key: str = "contour_id"
    structure_key: str = "structure_id"
    cluster_key: str = "cluster"
    gene_name: str = "feature_name"
    slide_id: str | None = None
    patient_id: str | None = None
    organ: str | None = None
    batch_id: str | None = None
    stain: str | None = None
    scanner: str | None = None
    structure_context: bool = False
    seed: int = 0
    n_cells: int = 24
    n_genes: int = 48
    n_structures: int = 4
    min_cells: int = 1


@dataclass(frozen=True)
class ModelConfig:
    size: int = 128
    heads: int = 4
    layers: int = 2
    inner: int | None = None
    bins: int = 51
    max_genes: int = 1200
    max_cells: int = 64
    image_size: int = 224
    channels: int = 3
    scales: tuple[int, ...] = (1,)
    use_expression: bool = True
    use_image: bool = True
    use_spatial: bool = True
    use_structure: bool = True
    use_cells: bool = True


@dataclass(frozen=True)
class TrainingConfig:
    seed: int = 0
    mask: float = 0.15
    neighborhood_k: int = 8
    image_gene_weight: float = 0.1
    neighborhood_weight: float = 0.25
    structure_weight: float = 0.1
    image_gene_warmup: int = 0
    neighborhood_warmup: int = 0
    structure_warmup: int = 0
    #: "none", "cosine" or "onecycle"
    schedule: str = "none"
    max_steps: int = 1000
    warmup_steps: int = 0
    batch: int = 16
    rate: float = 1e-4
    decay: float = 0.01
    #: steps between states that are kept; None keeps the last and the best one
    save_every: int | None = None
    device: str = "auto"
    workers: int = 0
    ablation: str | None = None


@dataclass(frozen=True)
class SplitConfig:
    strategy: str = "spatial_block"
    group: str | None = None
    train: float = 0.7
    val: float = 0.15
    test: float = 0.15
    seed: int | None = None

    def __post_init__(self) -> None:
        if abs(self.train + self.val + self.test - 1) > 1e-6 or self.train <= 0 or min(self.val, self.test) < 0:
            raise ValueError("shares of the splits must add up to 1, with some to train on")


@dataclass(frozen=True)
class Config:
    case_name: str = "case"
    data: DataConfig = field(default_factory=DataConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    split: SplitConfig = field(default_factory=SplitConfig)


def expand(value: Any) -> Any:
    """Environment variables in texts, at any depth; a text with one that is not set becomes None."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if isinstance(value, str):
        out = os.path.expandvars(os.path.expanduser(value))
        return None if re.search(r"\$\w|\$\{|%\w+%", out) else out
    return value


def from_mapping(values: dict[str, Any], preset: str | None = None) -> Config:
    out = Config()
    for section, given in expand(values).items():
        if section == "case_name":
            out = replace(out, case_name=str(given))
            continue
        if section not in {f.name for f in fields(Config)}:
            raise ValueError(f"unknown section {section!r}")
        kind = getattr(out, section)
        unknown = set(given) - {f.name for f in fields(kind)}
        if unknown:
            raise ValueError(f"unknown keys in {section}: {sorted(unknown)}")
        out = replace(out, **{section: replace(kind, **given)})
    return with_preset(out, preset) if preset else out


def from_file(path: str, preset: str | None = None) -> Config:
    with open(path) as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML files need PyYAML; JSON needs nothing") from e
        return from_mapping(yaml.safe_load(text) or {}, preset)
    return from_mapping(json.loads(text), preset)


def with_preset(cfg: Config, name: str) -> Config:
    """``smoke`` makes a run small and local, ``pdc`` asks for a GPU and two workers at least."""
    model, training = cfg.model, cfg.training
    if name == "smoke":
        model = replace(model, size=min(model.size, 64), layers=min(model.layers, 2))
        training = replace(training, device="cpu", workers=0, max_steps=min(training.max_steps, 2))
    elif name == "pdc":
        training = replace(training, device="cuda", workers=max(training.workers, 2))
    else:
        raise ValueError(f"unknown preset {name!r}")
    return replace(cfg, model=model, training=training)


# What a model sees in each ablation.
ABLATIONS: dict[str, tuple[str, ...]] = {
    "full": ("expression", "image", "spatial", "structure", "cells"),
    "gene_only": ("expression",),
    "image_only": ("image",),
    "spatial_only": ("spatial",),
    "image_gene": ("expression", "image"),
    "image_gene_spatial": ("expression", "image", "spatial"),
}


def with_ablation(cfg: Config, mode: str | None) -> Config:
    """The parts that a mode leaves out are switched off, and with them the losses that need them.

    Images are matched with genes where both are there; neighbours need places too; structures count
    only where they are seen.
    """
    if mode is None:
        return cfg
    name = mode.strip().lower()
    if name not in ABLATIONS:
        raise ValueError(f"unknown ablation {mode!r}")
    seen = set(ABLATIONS[name])
    model = replace(cfg.model, **{f"use_{part}": part in seen for part in ABLATIONS["full"]})
    needs = {"image_gene_weight": {"expression", "image"}, "neighborhood_weight": {"expression", "image", "spatial"}, "structure_weight": {"structure"}}
    off = {weight: 0.0 for weight, parts in needs.items() if not parts <= seen}
    return replace(cfg, model=model, training=replace(cfg.training, ablation=name, **off))
