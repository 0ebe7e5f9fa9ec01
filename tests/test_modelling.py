"""A case through data set, training, embedding and evaluation."""

import struct
import zlib

import pytest

from tessera.operators import encoder
from tessera.plans import modelling
from tessera.sources import cases, config


def grey(size, value):
    """Bytes of a PNG of one colour."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + bytes([value]) * size) * size)) + chunk(b"IEND", b"")


def test_case_is_trained_embedded_and_evaluated(spark, tmp_path):
    patches = []
    (tmp_path / "img").mkdir()
    for i in range(6):
        (tmp_path / "img" / f"{i}.png").write_bytes(grey(8, 40 * i))
        patches.append(f"contour_{i},{tmp_path}/img/{i}.png,{i},{i}")
    (tmp_path / "patches.csv").write_text("contour_id,image_path,patch_x,patch_y\n" + "\n".join(patches) + "\n")
    cfg = config.from_mapping({
        "case_name": "c", "data": {"mode": "synthetic", "n_cells": 24, "n_genes": 10, "n_structures": 3, "seed": 7, "patches": f"{tmp_path}/patches.csv", "images": f"{tmp_path}/img"},
        "model": {"size": 8, "heads": 2, "layers": 1, "bins": 6, "max_genes": 6, "max_cells": 2, "image_size": 6, "scales": [1, 2]}, "training": {"max_steps": 1, "batch": 5, "rate": 0.01, "neighborhood_k": 3, "seed": 1}, "split": {"seed": 13},
    })
    case = cases.settle(cases.build_regions(cases.load_case(spark, cfg.data), cfg.data))
    state = modelling.train_case(spark, case, cfg, f"file://{tmp_path}/run")
    assert state.step == 1 and state.network.genes == tuple(f"gene_{i}" for i in range(10)) and state.network.shape.structures == 3
    rows = modelling.embed_case(spark, case, cfg, state.network)
    assert rows.count() == 12 and {len(r.vec) for r in rows.collect()} == {8}
    tables = modelling.evaluate_case(spark, case, cfg, state.network)
    overall = tables["prediction_summary"].where("split = 'overall'").first()
    assert overall.n_masked_values >= 12 and overall.mse > 0
    assert tables["retrieval_metrics"].where("scope = 'overall'").first().n_regions == 12
    assert tables["failure_analysis"].where("metric = 'patch_rows'").first().value == 6
    other = encoder.new_network(state.network.shape, ["gene_0", "x"])
    with pytest.raises(ValueError, match="number 1"):
        modelling.embed_case(spark, case, cfg, other)


def test_colliding_names_are_told(spark):
    cfg = config.Config()
    genes = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a.1")], "gene_pos int, feature_name string").withColumnRenamed("feature_name", "gene")
    table = cases.Case(None, genes.withColumn("feature_name", genes.gene), None, None, None)
    with pytest.raises(ValueError, match=r"a\.1"):
        modelling.genes_of(table, cfg)
