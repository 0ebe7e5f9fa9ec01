"""A case with its network: data set, training, embeddings, predictions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoder, epochs, features, neighbors, quality, regions, training
from ..operators import network as N
from ..sources import images as I
from ..sources.cases import Case, splits_of
from ..sources.config import Config
from ..tables import to_table
from .evaluation import evaluate


def genes_of(case: Case, cfg: Config) -> list[str]:
    """Names of the case's genes in order; ValueError should two be equal once they are made unique."""
    named = features.vocabulary(case.genes, cfg.data.gene_name)
    clash = features.colliding_names(named).limit(5).collect()
    if clash:
        raise ValueError(f"gene names that collide: {sorted(r['vocab_name'] for r in clash)}")
    return [r["vocab_name"] for r in named.orderBy("vocab_id").collect()]  # as many as the network has rows


def shape_of(case: Case, cfg: Config) -> N.Shape:
    """The shape of the network that a configuration asks for, with as many structures as the regions have labels."""
    m = cfg.model
    return N.Shape(
        size=m.size, heads=m.heads, layers=m.layers, inner=m.inner, bins=m.bins, image_size=m.image_size, channels=m.channels, scales=tuple(m.scales),
        structures=max(1, case.regions.select(F.coalesce("structure_label", F.lit("unknown"))).distinct().count()), use_expression=m.use_expression,
        use_image=m.use_image, use_spatial=m.use_spatial, use_structure=m.use_structure and cfg.data.structure_context, use_cells=m.use_cells,
    )


def dataset(spark: SparkSession, case: Case, cfg: Config, only: DataFrame | None = None) -> epochs.RegionDataset:
    """The data set of a case with regions, or of those in ``only(region_id)``.

    Places are z-scored, labels numbered and neighbourhoods taken over all regions of the case, whatever ``only`` says; a
    region that is the only one is its own neighbourhood.
    """
    items = features.region_items(case.regions, structure_context=cfg.data.structure_context)
    k = min(cfg.training.neighborhood_k, case.regions.count() - 1)
    near = case.region_expr if k < 1 else regions.neighbor_mean(case.region_expr, neighbors.spatial_knn(case.regions.select("region_id", "x", "y"), k))
    pixels = I.read_images(spark, cfg.data.images, cfg.model.image_size) if cfg.data.images and cfg.model.use_image else None
    if only is not None:
        items = items.join(only.select("region_id"), "region_id", "left_semi")
    return epochs.RegionDataset(
        case.region_expr, case.genes.select("gene"), items, cfg.training.batch, cfg.model.max_genes, cfg.model.bins, cfg.training.mask, cfg.training.seed,
        case.members, case.expr, cfg.model.max_cells if cfg.model.use_cells else 0, near, pixels,
    )


def train_case(spark: SparkSession, case: Case, cfg: Config, path: str) -> training.State:
    """Train on the case's training split (on all regions if it has none), validate on its ``val`` split; states go below ``path``."""
    splits = to_table(splits_of(case, cfg), "case-splits")
    part = lambda name: splits.where(F.col("split") == name)
    train = dataset(spark, case, cfg, part("train") if part("train").limit(1).count() else None)
    network = encoder.new_network(shape_of(case, cfg), genes_of(case, cfg), cfg.training.seed)
    counts = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    return training.train(train, network, training.plan_of(cfg), path, dataset(spark, case, cfg, part("val")), {"splits": counts, "case": cfg.case_name})


def check_genes(case: Case, cfg: Config, network: encoder.Network) -> None:
    """ValueError unless the case has the network's genes, in its order."""
    have = genes_of(case, cfg)
    if tuple(have) != network.genes:
        at = next((i for i, (a, b) in enumerate(zip(have, network.genes, strict=False)) if a != b), min(len(have), len(network.genes)))
        raise ValueError(f"the case's genes differ from the network's from number {at}: {have[at : at + 1]}, {list(network.genes[at : at + 1])}")


def embed_case(spark: SparkSession, case: Case, cfg: Config, network: encoder.Network) -> DataFrame:
    """The region table with ``vec`` and ``image_vec``, the vocabulary being checked first."""
    check_genes(case, cfg, network)
    data = dataset(spark, case, cfg)
    return case.regions.join(encoder.embed(data.rows(cfg.training.seed), network), "region_id")


def evaluate_case(spark: SparkSession, case: Case, cfg: Config, network: encoder.Network) -> dict[str, DataFrame]:
    """The six tables of an evaluation of the case by its network."""
    check_genes(case, cfg, network)
    splits = to_table(splits_of(case, cfg), "case-splits").select("region_id", "split")
    rows = to_table(dataset(spark, case, cfg).rows(cfg.training.seed), "case-inputs")
    vectors = encoder.embed(rows, network).select("region_id", F.col("vec").cast("array<double>").alias("vec"), F.col("image_vec").cast("array<double>").alias("a"))
    about = regions.with_splits(case.regions, splits)
    embedded = to_table(about.join(vectors, "region_id").withColumn("b", F.col("vec")).withColumn("id", F.col("region_id")), "case-vectors")
    predictions = encoder.predict(rows, network).join(splits, "region_id")
    failures = quality.failure_analysis(about, case.patches, case.images, cfg.split.strategy, None, case.genes.select("gene"))
    return evaluate(embedded, predictions, failures)
