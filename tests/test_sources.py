"""Readers, writers and commands on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane import cli
from cytoplane.operators import clustering, linalg, receptors
from cytoplane.sources import readers, writers


def test_other_features_become_columns(spark):
    x = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (2, 3, 0.0), (2, 1, 1.0)], "cell_id long, gene_id long, value double")
    f = spark.createDataFrame([(1, "g", "Gene Expression"), (2, "tag", "Antibody"), (3, "mute", "Antibody")], "gene_id long, gene string, type string")
    assert {tuple(r) for r in readers.other_features_as_columns(x, f).collect()} == {(1, 3.0)}
    m = readers.feature_matrix(x, f, exclude_types=["none"], as_cell_columns=["tag"], label=("lab", "a"))
    assert {(r.cell_id, r.tag, r.lab) for r in m.cells.collect()} == {(1, 3.0, "a"), (2, 0.0, "a")} and m.genes.count() == 2


def test_gene_positions_guard_and_contigs(spark):
    g = spark.createDataFrame([("a",), ("b",), ("c",)], "gene string")
    p = spark.createDataFrame([("a", "1", 5, 9), ("a", "1", 2, 3), ("b", "X", 1, 2), ("c", "MT", 1, 2)], "gene string, contig string, start long, end long")
    got = {r.gene: (r.contig, r.start) for r in readers.gene_positions(g, p).collect()}
    assert got == {"a": ("1", 2), "b": ("X", 1), "c": (None, None)}
    assert {r.gene: r.contig for r in readers.gene_positions(g, p, with_x=False).collect()}["b"] is None
    with pytest.raises(ValueError):
        readers.gene_positions(g, p.where("gene = 'a'"))


def test_writers_of_text(spark, tmp_path):
    t = spark.createDataFrame([("k", 1), ("l", 2)], "cluster string, v int")
    writers.by_cluster(t, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("cluster = 'l'").first().v == "2"
    writers.text(t, str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 2


def test_score_vectors_fill_gaps(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.25), (2, 2, 1.0)], "cell_id long, pc int, score double")
    assert {r.cell_id: r.vec for r in linalg.score_vectors(s, 2).collect()} == {1: [0.5, 0.0], 2: [0.0, 1.0]}


def test_weighted_linkage():
    d = np.array([[0, 2, 6, 10], [2, 0, 5, 9], [6, 5, 0, 4], [10, 9, 4, 0]], float)
    assert clustering.kendall_clusters(d, 2).tolist() == [0, 0, 1, 1]
    assert [round(h, 3) for _, _, h in clustering.linkage(d, weighted=True)] == [2, 4, 7.5]


def test_summary_on_cells(spark):
    c = spark.createDataFrame([(1, "s", "a|b"), (2, "s", "a|b"), (3, "s", None)], "cell_id long, sample string, tcr string")
    got = {r.cell_id: r.counts_multichain_summary for r in receptors.summary_on_cells(c, "sample", "tcr").collect()}
    assert got == {1: 2, 2: 2, 3: None}


def test_commands(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 3\n2 2 4\n")
    (tmp_path / "f.tsv").write_text("id1\tg1\tGene Expression\nid2\tg2\tAntibody\n")
    cli.main(["convert-triplets", str(tmp_path / "m.mtx"), str(tmp_path / "f.tsv"), str(tmp_path / "m"), "--exclude", "Antibody"])
    m = readers.matrix(spark, str(tmp_path / "m"))
    assert [(r.gene_id, r.cell_id, r.value) for r in m.x.collect()] == [(0, 0, 3.0)]
    cli.main(["combine", str(tmp_path / "both"), str(tmp_path / "m")])
    assert readers.matrix(spark, str(tmp_path / "both")).cells.count() == 2
    (tmp_path / "g.gtf").write_text('1\ts\texon\t1\t9\t.\t+\t.\tgene_id "G"; gene_name "N"; exon_number "2";\n')
    cli.main(["split-exons", str(tmp_path / "g.gtf"), str(tmp_path / "out"), "--gene", "N"])
    assert "exon2" in spark.read.text(str(tmp_path / "out")).agg(F.max("value")).first()[0]
    (tmp_path / "v.csv").write_text("barcode,chain,cdr3\nx,TRA,CAA\nx,TRB,CBB\n")
    writers.matrix(type(m)(m.layers, m.cells.withColumn("barcode", F.when(F.col("cell_id") == 0, "x").otherwise("y")), m.genes), str(tmp_path / "b"))
    cli.main(["add-receptors", str(tmp_path / "b"), str(tmp_path / "v.csv"), str(tmp_path / "r")])
    assert {r.barcode: r.TRA_cdr3 for r in readers.matrix(spark, str(tmp_path / "r")).cells.collect()} == {"x": "CAA", "y": None}
