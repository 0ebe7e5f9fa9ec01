"""Instrument folders against a plain read of the same files."""

import gzip
import random

import pytest

from tessera.operators import regions
from tessera.sources import cases, config, matrix_market

RNG = random.Random(3)
FEATURES = [(f"ENS{i}", f"g{i % 9}", "Gene Expression" if i % 4 else "Negative Control Probe") for i in range(14)]
BARCODES = [f"cell-{(i * 37) % 101}" for i in range(40)]
ENTRIES = sorted({(RNG.randint(1, 14), RNG.randint(1, 40)) for _ in range(200)})
VALUES = [RNG.choice([0, 1, 2, 5, 17]) for _ in ENTRIES]


def matrix_text(size=None, kind="integer general", entries=None):
    rows = entries if entries is not None else [f"{i} {j} {v}" for (i, j), v in zip(ENTRIES, VALUES, strict=True)]
    return "\n".join([f"%%MatrixMarket matrix coordinate {kind}", "% made for a test", size or f"14 40 {len(rows)}", *rows]) + "\n"


def put(path, text, packed=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    (gzip.open if packed else open)(path, "wt").write(text)


def folder(root, packed=True, text=None, barcodes=BARCODES, inner="cell_feature_matrix"):
    end = ".gz" if packed else ""
    put(root / inner / f"matrix.mtx{end}", text or matrix_text(), packed)
    put(root / inner / f"features.tsv{end}", "".join("\t".join(f) + "\n" for f in FEATURES), packed)
    put(root / inner / f"barcodes.tsv{end}", "".join(b + "\n" for b in barcodes), packed)
    put(root / f"cells.csv{end}", "cell_id,x_centroid,y_centroid,contour_id\n" + "".join(f"{b},{i}.5,{-i},c{i % 5}\n" for i, b in enumerate(BARCODES[3:] + ["other"])), packed)
    return str(root)


def brute():
    names, seen = {}, {}
    for k, (_, name, kind) in enumerate(FEATURES):
        if kind == "Gene Expression":
            n = seen.get(name, 0)
            seen[name] = n + 1
            names[k + 1] = f"{name}.{n}" if n else name
    return names, {(BARCODES[j - 1], names[i], float(v)) for (i, j), v in zip(ENTRIES, VALUES, strict=True) if v and i in names}


@pytest.fixture(params=["packed", "plain", "small blocks", "parts", "at the root"])
def root(request, tmp_path, spark):
    if request.param == "small blocks":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    if request.param != "parts":
        yield folder(tmp_path, request.param == "packed", inner="" if request.param == "at the root" else "cell_feature_matrix")
    else:
        folder(tmp_path)
        for name, text in (("matrix.mtx", matrix_text()), ("barcodes.tsv", "".join(b + "\n" for b in BARCODES))):
            (tmp_path / "cell_feature_matrix" / f"{name}.gz").unlink()
            lines = text.splitlines(keepends=True)
            for k in range(0, len(lines), 11):
                put(tmp_path / "cell_feature_matrix" / name / f"part-{k:05d}.gz", "".join(lines[k : k + 11]))
        yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_folder_equals_a_plain_read(spark, root):
    case = matrix_market.read_case(spark, root)
    names, expr = brute()
    assert {tuple(r) for r in case["expr"].select("cell_id", "gene", "value").collect()} == expr
    genes = case["genes"].orderBy("gene_pos").collect()
    assert [g.gene for g in genes] == list(names.values()) and [g.gene_pos for g in genes] == list(range(len(names)))
    assert [(g.feature_id, g.feature_name) for g in genes] == [f[:2] for f in FEATURES if f[2] == "Gene Expression"]
    rows = case["cells"].orderBy("row_pos").collect()
    assert [r.cell_id for r in rows] == BARCODES and [r.x_centroid for r in rows[:4]] == [None, None, None, "0.5"]


def test_case_of_a_folder_and_of_both_kinds(spark, tmp_path):
    root = folder(tmp_path / "outs")
    spark.createDataFrame([(BARCODES[0], "mapped", "s")], "cell_id string, contour_id string, structure_id string").write.parquet(f"{tmp_path}/cell_to_contour.parquet")
    cfg = config.from_mapping({"data": {"mode": "xenium", "root": root}}).data
    case = cases.build_regions(cases.load_case(spark, cfg), cfg)
    _, expr = brute()
    contour = {b: f"c{i % 5}" for i, b in enumerate(BARCODES[3:])} | {BARCODES[0]: "mapped"}
    members = {c: [b for b in contour if contour[b] == c] for c in set(contour.values())}
    got = {(r.region_id, r.gene): r.value for r in case.region_expr.collect()}
    want = {}
    for cell, gene, value in expr:
        if cell in contour:
            want[contour[cell], gene] = want.get((contour[cell], gene), 0.0) + value / len(members[contour[cell]])
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    table = spark.createDataFrame([("x1", 1.0, 2.0, "k")], "cell_id string, x double, y double, contour_id string")
    for name, df in (("cells", table), ("genes", spark.createDataFrame([(0, "own")], "gene_pos int, gene string")), ("expr", spark.createDataFrame([("x1", "own", 2.0)], "cell_id string, gene string, value double"))):
        df.write.parquet(f"{tmp_path}/two/{name}.parquet")
    both = cases.load_case(spark, config.from_mapping({"data": {"mode": "corpus", "roots": [root, f"{tmp_path}/two"]}}).data)
    assert both.cells.groupBy("source").count().count() == 2 and both.expr.count() == len(expr) + 1
    with pytest.raises(FileNotFoundError):
        cases.load_case(spark, config.from_mapping({"data": {"mode": "xenium", "root": f"{tmp_path}/two"}}).data)


@pytest.mark.parametrize("text", [
    matrix_text("14 40 1"), matrix_text("14 39 200"), matrix_text("3 40 200"), matrix_text(kind="integer symmetric"), matrix_text(kind="complex general"),
    "%%MatrixMarket matrix array real general\n1 1\n3\n", "%%MatrixMarket matrix coordinate real general\n", matrix_text(entries=["1 1"]), matrix_text(entries=["1 1 a"]), "1 1 1\n1 1 1\n",
])
def test_matrix_must_agree_with_its_head(spark, tmp_path, text):
    with pytest.raises(ValueError, match="matrix"):
        matrix_market.read_case(spark, folder(tmp_path, text=text))


def test_files_must_agree_with_the_matrix(spark, tmp_path):
    with pytest.raises(ValueError, match="39 lines"):
        matrix_market.read_case(spark, folder(tmp_path, barcodes=BARCODES[1:]))


def test_patterns_and_empty_matrices(spark, tmp_path):
    pattern = folder(tmp_path / "a", text=matrix_text(kind="pattern general", entries=["2 1", "2 2"]))
    assert {tuple(r) for r in matrix_market.read_case(spark, pattern)["expr"].collect()} == {(BARCODES[0], "g1", 1.0), (BARCODES[1], "g1", 1.0)}
    empty = matrix_market.read_case(spark, folder(tmp_path / "b", text=matrix_text(entries=[])))
    assert empty["expr"].count() == 0 and empty["cells"].count() == 40 and empty["genes"].count() == 10


def test_written_case_reads_back(spark, tmp_path):
    case = matrix_market.read_case(spark, folder(tmp_path / "in"))
    matrix_market.write_case(case["cells"], case["genes"], case["expr"], f"file://{tmp_path}/out")
    back = matrix_market.read_case(spark, f"file://{tmp_path}/out")
    assert {tuple(r) for r in back["expr"].collect()} == {tuple(r) for r in case["expr"].collect()}
    order = lambda c, by, name: [r[name] for r in c.orderBy(by).collect()]
    assert order(back["cells"], "row_pos", "cell_id") == BARCODES and order(back["genes"], "gene_pos", "gene") == order(case["genes"], "gene_pos", "gene")
    assert back["cells"].where("contour_id = 'c1'").count() == case["cells"].where("contour_id = 'c1'").count()


def test_entries_by_place_and_any_white_space(spark, tmp_path):
    lines = [(f"{i} {j} {v}", f" {i}\t{j}  {v}\t", f"{i}\t{j}\t{v}")[k % 3] for k, ((i, j), v) in enumerate(zip(ENTRIES, VALUES, strict=True))]
    case = matrix_market.read_case(spark, folder(tmp_path, text=matrix_text(entries=lines)))
    names, expr = brute()
    place = {b: k for k, b in enumerate(BARCODES)}
    assert {tuple(r) for r in case["entries"].select("row_pos", "gene", "value").collect()} == {(place[c], g, v) for c, g, v in expr}
    by_name = regions.mean_expression(case["expr"], case["cells"], "contour_id").collect()
    by_place = regions.mean_expression(case["entries"], case["cells"], "contour_id", key="row_pos").collect()
    assert by_name and sorted(map(tuple, by_name)) == sorted(map(tuple, by_place))


@pytest.mark.parametrize("bad", ["15 1 2", "1 41 2", "0 1 2", "1 0 2", "1 1 2 3", "1 1"])
def test_one_entry_outside_or_malformed(spark, tmp_path, bad):
    entries = ["1 1 2", bad, "14 40 3"]
    with pytest.raises(ValueError, match="3 entries of 14 by 40 are announced, 3 are there, 1 of them"):
        matrix_market.read_case(spark, folder(tmp_path, text=matrix_text(entries=entries)))
