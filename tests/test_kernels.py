"""Golden values and invariants of kernels and operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.functions import pvalues, scalars
from cytoplane.model import from_tables
from cytoplane.operators import clustering, differential, genome, graph, groups, joins, layers, linalg, masks, mixtures, receptors, signatures, spatial, windows
from cytoplane.plans import catalogue, more
from cytoplane.sources import readers, writers


def test_t_distribution():
    assert pvalues.t_two_sided(0, 5) == pytest.approx(1)
    assert pvalues.t_two_sided(2.570581835636314, 5) == pytest.approx(0.05, abs=1e-9)
    assert pvalues.t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)


def test_exact_u_by_enumeration():
    n1, n2 = 3, 4
    us = [sum(r) - n1 * (n1 + 1) / 2 for r in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        assert pvalues.exact_u(u, n1, n2) == pytest.approx(min(1, 2 * sum(v >= top for v in us) / len(us)))


def test_fisher():
    assert pvalues.fisher(8, 2, 1, 5) == pytest.approx(0.03496503496503495)
    assert pvalues.fisher(3, 1, 1, 3) == pytest.approx(0.4857142857142857)


def test_wilcoxon_by_enumeration():
    d = np.array([1.5, -0.5, 2.5, 3.5, -1.0])
    ranks = pvalues.ranks(np.abs(d))
    seen = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    all_ = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=5)]
    assert pvalues.wilcoxon(d, np.zeros(5)) == pytest.approx(min(1, 2 * np.mean([v <= seen for v in all_])))


def test_kendall():
    x, y = np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4])
    assert pvalues.kendall(x, y)[0] == pytest.approx(4 / 6)
    assert math.isnan(pvalues.kendall(np.ones(4), y)[0])


def test_kendall_with_ties_against_all_pairs():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 17, 64, 130):
        for kinds in (2, 5, 10**6):
            x, y = rng.integers(0, kinds, n).astype(float), rng.integers(0, kinds, n).astype(float)
            assert pvalues.inversions(y) == sum(y[i] > y[j] for i in range(n) for j in range(i + 1, n))
            a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
            down = np.sqrt((a != 0).sum() * (b != 0).sum())
            tau = pvalues.kendall(x, y)[0]
            assert math.isnan(tau) if down == 0 else tau == pytest.approx((a * b).sum() / down)


def test_median_slope_holds_no_pairs():
    rng = np.random.default_rng(3)
    for n, ties in ((2, False), (41, True), (300, False), (301, True)):
        x, y = rng.integers(0, 9 if ties else 10**6, n).astype(float), (rng.integers(0, 4, n) if ties else rng.normal(size=n)).astype(float)
        want = np.median([(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(n) if x[i] < x[j]])
        for held in (1 << 20, 200):
            assert pvalues.median_slope(x, y, 64, held) == pytest.approx(want)
    assert math.isnan(pvalues.median_slope(np.ones(4), y[:4]))


def test_theil_sen_joins_no_pairs(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 4.0, 4.0), ("a", None, 9.0), ("b", 1.0, 2.0), (None, 1.0, 1.0), (None, 2.0, 2.0)], "k string, x double, y double")
    got = differential.theil_sen(df, "k", "x", "y")
    assert "Join" not in got._jdf.queryExecution().toString() and [tuple(r) for r in got.collect()] == [("a", 1.0)]


def test_doublet_p_is_a_tail():
    def g(x1, x2, x12, n, c):
        return c**x12 * math.comb(x1 + x12, x12) * math.comb(n - x2 - x12, x1)

    x1, x2, x12, n, c = 5, 4, 2, 40, (0.05 / 0.95) ** 2
    terms = {x: g(x1 + x12 - x, x2 + x12 - x, x, n, c) for x in range(1, min(x1, x2) + x12 + 1)}
    want = sum(v for x, v in terms.items() if x >= x12) / sum(terms.values())
    assert pvalues.doublet_p(x1, x2, x12, n) == pytest.approx(want)


def test_dip_tells_two_modes_from_one():
    rng = np.random.default_rng(0)
    assert pvalues.dip(np.concatenate([rng.normal(0, 1, 200), rng.normal(12, 1, 200)])) > 3 * pvalues.dip(rng.normal(0, 1, 400))


def small(spark):
    x = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, 4.0), (3, 3, 5.0), (3, 3, 1.0)], "cell_id long, gene_id long, value double")
    cells = spark.createDataFrame([(1, "0-0"), (2, "0-1"), (3, "1-0"), (4, "1-1")], "cell_id long, path string")
    return from_tables(x, cells, spark.createDataFrame([(1, "RPa"), (2, "mt-b"), (3, "c")], "gene_id long, gene string"))


def test_matrix_adds_duplicates_and_guards_names(spark):
    m = small(spark)
    m.check()
    assert {(r.cell_id, r.gene_id): r.value for r in m.x.collect()}[3, 3] == 6.0
    with pytest.raises(ValueError):
        m.with_cells(m.cells)


def test_moments_count_zeros(spark):
    got = {r.cell_id: r for r in layers.moments(small(spark), "cell").collect()}
    assert got[4].total == 0 and got[4].var == 0 and got[1].mean == pytest.approx(1) and got[1].var == pytest.approx(np.var([2, 1, 0]))


def test_quality_of_gene_sets(spark):
    got = {r.cell_id: r for r in layers.quality_metrics(small(spark)).cells.collect()}
    assert got[1].RibosomalCountFraction == pytest.approx(2 / 3) and got[1].MitochondrialCountFraction == pytest.approx(1 / 3)
    assert got[4].RibosomalCountFraction is None and got[4].nGene == 0


def test_rank_sum_matches_dense_kernel(spark):
    rng = np.random.default_rng(1)
    d = rng.poisson(0.7, size=(24, 5))
    rows = [(i, j, float(v)) for i, r in enumerate(d.tolist()) for j, v in enumerate(r) if v]
    cells = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(24)], "cell_id long, k string")
    m = from_tables(spark.createDataFrame(rows, "cell_id long, gene_id long, value double"), cells, spark.createDataFrame([(j,) for j in range(5)], "gene_id long"))
    for r in differential.differential_expression(m, differential.sides_of(m.cells, "k", ["a"])).collect():
        u, p = pvalues.mann_whitney(d[:10, r.gene_id].astype(float), d[10:, r.gene_id].astype(float))
        assert r.u == pytest.approx(u) and r.p == pytest.approx(p)


def test_category_tests_match_kernels(spark):
    rng = np.random.default_rng(11)
    rows = [(c, float(round(v, 1)), h) for c, v, h in zip(rng.choice(list("abc"), 90), rng.normal(size=90), rng.integers(0, 2, 90).tolist())] + [("a", float("nan"), 0), ("a", None, 1)]
    df, ok = spark.createDataFrame([(str(c), v, h) for c, v, h in rows], "c string, v double, h int"), [r for r in rows if r[1] is not None and r[1] == r[1]]
    for hue in (None, "h"):
        for test, kernel in (("mannwhitney", lambda a, b: pvalues.mann_whitney(a, b)[1]), ("ttest", pvalues.t_test)):
            for r in differential.category_tests(df, "c", "v", hue, test).collect():
                a = np.array([v for c, v, h in ok if c == r.c and (hue is None or h == 0)])
                b = np.array([v for c, v, h in ok if (c == r.c and h == 1 if hue else c != r.c)])
                assert (r.n1, r.n2) == (len(a), len(b)) and r.p == pytest.approx(kernel(a, b), abs=1e-9)


def test_bh_keeps_nulls_and_order(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    got = {r.i: r.q for r in windows.bh_adjust(p, "p").collect()}
    assert got[4] is None and got[1] == pytest.approx(0.03) and got[3] == pytest.approx(0.04) and got[2] == pytest.approx(0.04)


def test_asof_takes_last_and_stays_on_contig(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, "a", 1)], "i int, contig string, start int")
    right = spark.createDataFrame([("a", 2, 0.1), ("a", 10, 0.2), ("b", 3, 0.3)], "contig string, start int, v double")
    assert {r.i: r.v for r in joins.asof(left, right, ["contig"], "start", ["v"]).collect()} == {1: 0.1, 2: 0.2, 3: None, 4: None}


def test_guarded_join_raises(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    with pytest.raises(ValueError):
        joins.guarded(a, spark.createDataFrame([("p", 1), ("x", 2), ("q", 3)], "k string, v int"), "k")


def test_predicates_read_two_letter_operators(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    assert [r.n for r in df.where(scalars.predicate(df, ["n <= 2", "n >= 2"])).collect()] == [2]


def test_stars_and_gravy(spark):
    df = spark.createDataFrame([(0.0, "A-R"), (0.02, ""), (0.001, "B"), (0.5, None)], "p double, s string")
    got = df.select(scalars.stars(F.col("p")).alias("t"), scalars.gravy(F.col("s")).alias("g")).collect()
    assert [r.t for r in got] == ["****", "*", "***", "n.s."]
    assert got[0].g == pytest.approx((1.8 - 4.5) / 2) and [r.g for r in got[1:]] == [None, None, None]


def test_linkage_cut_and_silhouette():
    x = np.array([[1, 0.01], [1, 0.02], [0.01, 1], [0.02, 1], [1, 0.0], [0.0, 1.0]] * 3)
    labels = clustering.subcluster(x, 0.1, 6)
    assert len(set(labels)) == 2 and all(labels[i] == labels[i % 6] for i in range(18))
    assert clustering.subcluster(x[:5], 0.1, 5).tolist() == [0] * 5


def test_clumpiness_of_two_groups():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], float)
    labels, t = clustering.clumpiness(d)
    assert labels[0] == labels[1] != labels[2] == labels[3] and sorted(t["mean_distance"]) == [1, 2]


def test_clumps_of_rows_are_those_of_the_matrix():
    rng = np.random.default_rng(5)
    u = clustering.unit_rows(np.repeat(rng.normal(size=(7, 12)), 30, axis=0) + 0.4 * rng.normal(size=(210, 12)))
    (a, t), (b, r) = clustering.clumpiness(np.clip(1 - u @ u.T, 0, None)), clustering.unit_clumpiness(u, block=64)
    assert (a == b).all() and t["n"].tolist() == r["n"].tolist() and t["mean_distance"].tolist() == pytest.approx(r["mean_distance"].tolist())


def test_vector_queries_read_every_vector(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(230)]
    monkeypatch.setattr(more, "vectors", lambda s, d: s.createDataFrame(rows, "id long, vec array<double>"))
    assert sum(r.n for r in more.clump_sizes(spark, "").collect()) == 230
    seen = []
    monkeypatch.setattr(clustering, "best_neighbours", lambda points, *rest: seen.append((points.count(), rest)) or (2, 0.0))
    more.neighbour_search(spark, "").collect()
    assert seen == [(230, ())]


def test_components_and_communities(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 8)], "u long, v long")
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    w = [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a, b in itertools.combinations(g, 2)] + [(3, 4, 0.1)]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame(w, "src long, dst long, weight double")).collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[0] != got[7]


def test_mixture_parts_two_humps(spark):
    rng = np.random.default_rng(3)
    v = [(i, "t", float(x)) for i, x in enumerate(np.concatenate([rng.normal(0, 1, 80), rng.normal(10, 1, 40)]))] + [(999, "t", None)]
    got = {r.i: r.prediction for r in mixtures.two_components(spark.createDataFrame(v, "i long, t string, v double"), ["t"], "v").collect()}
    assert sum(got[i] for i in range(80)) == 0 and sum(got[i] for i in range(80, 120)) == 40 and got[999] is None


def test_pca_finds_the_axis(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(60, 1)) * 5 @ np.array([[0.6, 0.8, 0.0]]) + rng.normal(size=(60, 3)) * 0.1 + 10
    rows = [(i, j, float(v)) for i, r in enumerate(a) for j, v in enumerate(r)]
    m = from_tables(spark.createDataFrame(rows, "cell_id long, gene_id long, value double"), spark.range(60).withColumnRenamed("id", "cell_id"), spark.range(3).withColumnRenamed("id", "gene_id"))
    load, ratio = linalg.pca(m, 1)
    assert ratio[0] > 0.99 and {r.gene_id: round(r.loading, 1) for r in load.collect()} == {0: 0.6, 1: 0.8, 2: 0.0}


def test_gsea_needs_and_scores_hits(spark):
    s = spark.createDataFrame([(i, float(-i)) for i in range(50)], "gene_id long, score double")
    r = signatures.gsea(s, s.where("gene_id < 5").select("gene_id"), 100).first()
    assert r.es == pytest.approx(1) and r.p <= 0.02


def test_doublets_prefer_the_likelier_pair(spark):
    rows = [("s", "a|b")] * 30 + [("s", "c|d")] * 20 + [("s", "a---c|b---d")] * 2 + [("s", "a|b---d")] + [(None, None)]
    t = {r.tcr: r for r in receptors.summary(spark.createDataFrame(rows, "sample string, tcr string")).collect()}
    assert t["a---c|b---d"].pair == "a|b (n=30) + c|d (n=20)" and t["a---c|b---d"].p > 0
    assert t["a|b---d"].p is not None and t["a|b"].p is None


def test_peptide_clusters(spark):
    df = spark.createDataFrame([(p,) for p in ("CAS", "CAT", "CATS", "QQQQ", "", None)], "p string")
    got = {r.p: r.cluster for r in receptors.cluster_peptides(df, "p").collect()}
    assert got == {"CAS": "CAS", "CAT": "CAS", "CATS": "CAS", "QQQQ": "QQQQ", "": ""}


def test_soft_clipped_starts(spark):
    cols = "chrom string, pos long, end long, strand string, cigar string, seq string, barcode string, umi string"
    df = spark.createDataFrame([("1", 10, 20, "+", "1S9M", "GAAAAAAAAA", "x", "u"), ("1", 10, 20, "+", "1S9M", "GAAAAAAAAA", "x", "u"), ("1", 10, 20, "+", "1S9M", "TAAAAAAAAA", "x", "v"), ("1", 5, 9, "-", "4M2S", "AAAACT", "x", "u")], cols)
    assert {(r.start, r.strand, r.n) for r in genome.soft_clipped_starts(df).collect()} == {(10, "+", 1), (9, "-", 1)}


def test_alpha_outline_of_a_square(spark):
    p = spark.createDataFrame([("k", float(x), float(y)) for x in range(4) for y in range(4) if (x + y) % 5 != 4], "k string, x double, y double")
    assert spatial.alpha_outlines(p, "k", 0.1).count() >= 3
    one = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)],)], "points array<struct<x:double,y:double>>")
    assert one.select(spatial.polygon_area().alias("a")).first().a == 2


def test_alpha_outlines_of_every_vector(spark, monkeypatch):
    p = np.random.default_rng(8).uniform(size=(140, 2))
    monkeypatch.setattr(catalogue, "vectors", lambda s, d: s.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, vec array<double>"))
    sides: dict = {}
    for t in itertools.combinations(range(140), 3):
        a, b, c = p[list(t)]
        two = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        u, v = ((b - a) ** 2).sum(), ((c - a) ** 2).sum()
        o = a + np.array([(c[1] - a[1]) * u - (b[1] - a[1]) * v, (b[0] - a[0]) * v - (c[0] - a[0]) * u]) / two
        r = ((a - o) ** 2).sum()
        if r < 0.04 and (((p - o) ** 2).sum(1) < r * (1 - 1e-9)).sum() == 0:
            for e in itertools.combinations(t, 2):
                sides[e] = sides.get(e, 0) + 1
    want = {frozenset((tuple(p[i]), tuple(p[j]))) for (i, j), n in sides.items() if n == 1}
    got = {frozenset(((r.x1, r.y1), (r.x2, r.y2))) for r in catalogue.alpha_outlines(spark, "").collect()}
    assert got == want


def test_round_trip_and_readers(spark, tmp_path):
    m = layers.normalize_counts(small(spark))
    writers.matrix(m, str(tmp_path / "m"))
    back = readers.matrix(spark, str(tmp_path / "m"))
    assert set(back.layers) == {"", "log"} and back.x.count() == m.x.count()
    (tmp_path / "d.tsv").write_text("gene\tc1\tc2\na\t0\t-1.5\nb\t2\t0\n")
    assert {(r.gene, r.cell, r.value) for r in readers.dense_text(spark, str(tmp_path / "d.tsv")).collect()} == {("a", "c2", -1.5), ("b", "c1", 2.0)}
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 3\n2 2 4\n")
    assert {(r.gene_id, r.cell_id, r.value) for r in readers.triplets(spark, str(tmp_path / "m.mtx")).collect()} == {(0, 0, 3.0), (1, 1, 4.0)}
    (tmp_path / "g.gtf").write_text('#c\n1\ts\texon\t1\t9\t.\t+\t.\tgene_id "G"; exon_number "2";\n1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "G";\n')
    assert [r.attribute for r in scalars.split_exons(readers.gtf(spark, str(tmp_path / "g.gtf"))).collect()] == ['gene_id "G-exon2"; exon_number "2";']
    (tmp_path / "s.seg").write_text("Chromosome\tStart.bp\tEnd.bp\ttau\n1\t1\t50\t0.5\nX\t7\t9\t1.5\n")
    assert {(r.contig, r.start, r.tau) for r in readers.segments(spark, str(tmp_path / "s.seg")).collect()} == {(1, 1, 0.5), (23, 7, 1.5)}
    np.savez(tmp_path / "x.npz", row=np.array([0, 1]), col=np.array([1, 0]), data=np.array([2.0, 3.0]))
    spark.dataSource.register(readers.ArraySource)
    assert spark.read.format("cytoplane_npz").option("path", str(tmp_path / "x.npz")).load().count() == 2


def test_names_match_by_last_suffix(spark):
    l, r = spark.createDataFrame([("a",), ("b",), ("c",)], "n string"), spark.createDataFrame([("a",), ("b_Lym",), ("b_45pos",)], "m string")
    assert {x.n: x.m for x in masks.match_names(l, r, "n", "m").collect()} == {"a": "a", "b": "b_45pos", "c": None}


def test_stream_windows(spark, tmp_path):
    from cytoplane.streaming import events

    spark.createDataFrame([(i, 1, "a", float(i)) for i in range(10)], "event_id long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(event_id * 1800) ts", "user_id", "event_type", "value", "'{}' props").write.parquet(str(tmp_path / "in" / "events.parquet"))
    s = events.read(spark, str(tmp_path / "in" / "events.parquet"), "*.parquet")
    q = events.windowed(s).writeStream.outputMode("complete").format("memory").queryName("w_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) n FROM w_test").first().n == 10
    assert events.sessions(spark.read.parquet(str(tmp_path / "in" / "events.parquet"))).count() >= 1


def test_group_helpers(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "g string, k string")
    assert [tuple(r) for r in groups.value_counts(df, "g").collect()] == [("a", 2), ("b", 1)]
    t = {(r.g, r.k): (r.t11, r.t12, r.t21, r.t22) for r in groups.complement_tables(df, "g", "k").collect()}
    assert t["b", "y"] == (0, 1, 1, 1) and sum(v[0] for v in t.values()) == 3


def test_positives_with_two_modes_are_split_again(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 0.3, 120), rng.normal(9, 0.3, 40), rng.normal(12, 0.3, 40)])
    df = spark.createDataFrame([(i, "t", float(x)) for i, x in enumerate(v)], "i long, t string, v double")
    called = mixtures.two_components(df, ["t"], "v")
    got = {r.i: r.prediction for r in mixtures.unimodal_positives(df, called, ["t"], "v", "i").collect()}
    assert sum(got[i] for i in range(120)) == 0 and sum(got[i] for i in range(160, 200)) == 40 and sum(got[i] for i in range(120, 160)) < 5


def test_downsampling_keeps_the_number_and_follows_chances(spark):
    df = spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 0), ("d", 1000)], "k string, n long")
    got = {r.k: r.n for r in masks.downsample_counts(df, "k", "n", 0.5, 3).collect()}
    assert sum(got.values()) == 5000 and got["c"] == 0 and abs(got["a"] - 3000) < 250 and abs(got["d"] - 500) < 120
    assert {r.k: r.n for r in masks.downsample_counts(df.where("n = 0"), "k", "n", 0.5).collect()} == {"c": 0}


def test_neighbour_distances(spark):
    p = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)] + [(99, 50.0, 50.0), (100, None, 1.0)], "id long, x double, y double")
    got = {r.id: r for r in masks.sparse_neighbourhoods(p, 2, 0.9).collect()}
    assert got[12].distance == 1 and got[12].keep and not got[99].keep and got[100].distance is None


def test_a_few_points_meet_in_one_step():
    rng = np.random.default_rng(5)
    for n in (2, 7, 40, 300):
        for x in (rng.permutation(n * 3)[:n].astype(float), rng.integers(0, 5, n).astype(float)):
            y = rng.integers(0, 9, n).astype(float)
            i, j = np.nonzero(x[None, :] > x[:, None])
            slopes = (y[j] - y[i]) / (x[j] - x[i])
            got = pvalues.median_slope(x, y)
            assert np.isnan(got) if not len(slopes) else got == pytest.approx(np.median(slopes), abs=1e-12)
    assert pvalues.LATER[: 3, : 3].tolist() == [[False, True, True], [False, False, True], [False, False, False]]


def test_permutations_are_sorted_once(spark, capsys):
    from cytoplane.operators import signatures

    s = spark.range(90).select(F.col("id").alias("gene_id"), F.pmod(F.hash("id"), F.lit(50)).cast("double").alias("score"))
    own = s.where("gene_id % 7 = 0").select("gene_id")
    out = signatures.gsea(s, own, 40)
    ranked = [(r.gene_id, r.hit) for r in signatures.ranked_hits(s, own).orderBy("rank").collect()]

    def top(flags):
        k, h, o, best = sum(flags), 0, 0, 0.0
        for f in flags:
            h, o = h + f, o + (not f)
            best = max(best, h / k - o / (len(flags) - k), best, key=abs)
        return best

    import hashlib

    null = [top([f for _, f in sorted((hashlib.md5(f"0:{p}:{g}".encode()).hexdigest(), f) for g, f in ranked)]) for p in range(40)]
    es = top([f for _, f in ranked])
    r = out.first()
    assert abs(r.es - es) < 1e-12 and abs(r.p - np.mean([abs(es) < abs(x) for x in null])) < 1e-12
    out.explain()
    assert capsys.readouterr().out.count("Sort [perm") == 1
