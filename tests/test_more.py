"""Text ids, ties, associations, registered functions, workbooks, stateful streams, and invariants of queries without SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane import cli
from cytoplane.functions import pvalues, registered
from cytoplane.model import from_tables
from cytoplane.operators import associations, clumps, clustering, differential, genome, graph, layers, linalg, masks, mixtures, receptors, windows
from cytoplane.plans import catalogue
from cytoplane.sources import readers, writers
from cytoplane.streaming import events


def blobs(spark, per=40, named=True):
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:3] * 6
    rows = [(f"cell-{k}-{i}" if named else 100 * k + i, (c + rng.normal(size=6) * 0.4).tolist(), k) for k, c in enumerate(centres) for i in range(per)]
    return spark.createDataFrame(rows, f"id {'string' if named else 'long'}, vec array<double>, label int")


def test_text_ids_from_counts_to_clusters(spark):
    """The usual chain on barcodes: normalise, variable genes, components, neighbours, communities, layout, outliers."""
    rng = np.random.default_rng(5)
    kinds = {f"AAC{i:03d}-1": i % 2 for i in range(80)}
    x = [(c, f"g{j}", float(rng.poisson(9 if j % 2 == k else 1))) for c, k in kinds.items() for j in range(30)]
    m = from_tables(spark.createDataFrame([r for r in x if r[2]], "cell_id string, gene_id string, value double"), spark.createDataFrame([(c, str(k)) for c, k in kinds.items()], "cell_id string, kind string"), spark.createDataFrame([(f"g{j}", f"G{j}") for j in range(30)], "gene_id string, gene string"))
    m = layers.gene_variances(layers.normalize_counts(m), "log")
    load, _ = linalg.pca(m, 3, "log", layers.variable_genes(m, 29))
    vec = linalg.score_vectors(linalg.scores(m, load, "log"), 3).withColumnRenamed("cell_id", "id")
    assert dict(vec.dtypes)["id"] == "string"
    near = graph.nearest(vec, 5)
    assert dict(near.dtypes)["src"] == "string" and near.count() == 400
    kind = {r.id: kinds[r.id] for r in vec.collect()}
    assert all(kind[r.src] == kind[r.dst] for r in near.collect())
    com = {r.node: r.community for r in graph.communities(near.select("src", "dst", F.lit(1.0).alias("weight"))).collect()}
    assert len(com) == 80 and all(kind[v] == kind[k] for k, v in com.items())
    xy = linalg.layout(near.select("src", "dst", F.lit(1.0).alias("weight")), 20)
    assert dict(xy.dtypes)["id"] == "string" and xy.count() == 80
    assert dict(linalg.diffusion(vec, 0.5, 2).dtypes)["id"] == "string"
    paths = clustering.iterate(vec, 2, smallest=50)
    assert dict(paths.dtypes)["id"] == "string" and len({(kind[r.id], r.level0) for r in paths.collect()}) == 2
    flagged = masks.minor_clusters(m.cells, ["kind"])
    assert flagged.where("outlier").count() == 0 and flagged.count() == 80


def test_layout_takes_every_edge_and_raises_over_its_limit(spark):
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 300)], "src long, dst long, weight double")
    assert linalg.layout(star, 5, limit=300).count() == 300
    with pytest.raises(ValueError):
        linalg.layout(star, 5, limit=299)


def test_clusters_of_the_exact_path_and_of_micro_clusters(spark):
    p = blobs(spark, named=False)
    label = {r.id: r.label for r in p.collect()}
    for exact in (4000, 60):
        got = {r.id: r.level0 for r in clustering.iterate(p, 1, exact=exact).collect()}
        assert len(got) == 120 and all(len({got[i] for i in got if label[i] == k}) == 1 for k in range(3)) and len(set(got.values())) == 3


def test_diffusion_orders_and_normalises(spark):
    p = blobs(spark, 20, named=False)
    rows = linalg.diffusion(p, 0.5, 3).collect()
    v = {c: np.array([r.value for r in sorted(rows, key=lambda r: r.id) if r.component == c]) for c in (1, 2, 3)}
    norms = [np.linalg.norm(v[c]) for c in (1, 2, 3)]
    assert norms == sorted(norms, reverse=True) and all(abs(x.max()) >= abs(x.min()) for x in v.values())


def test_many_tied_cells_do_not_overflow(spark):
    n = 3_000_000
    cells = spark.range(n).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"))
    m = from_tables(cells.select("cell_id", F.lit(1).cast("long").alias("gene_id"), F.lit(1.0).alias("value")), cells, spark.createDataFrame([(1,)], "gene_id long"))
    rows = differential.rank_sum(m, differential.sides_of(cells, "k", ["a"])).collect() + differential.sibling_rank_sum(m, "k").where("comparison = 'a'").collect()
    assert [(r.n1, r.n2, r.p, r.CommonLanguageEffectSize) for r in rows] == [(1_000_000, 2_000_000, 1.0, None)] * 2


def test_siblings_are_tested_like_any_two_sides(spark):
    rng = np.random.default_rng(13)
    names = ["0-0", "0-1", "0-2", "1-0", "1-1", "2-0"]
    cells = spark.createDataFrame([(i, names[i % 6]) for i in range(60)], "cell_id long, path string")
    x = [(i, j, float(v)) for i in range(60) for j in range(8) if (v := rng.poisson(0.6 + (j == i % 6))) and j != 7] + [(i, 7, 2.0) for i in range(0, 60, 6)]
    m = from_tables(spark.createDataFrame(x, "cell_id long, gene_id long, value double"), cells, spark.createDataFrame([(j,) for j in range(8)], "gene_id long"))
    key = lambda r: (r.comparison, r.gene_id)
    a = sorted(differential.rank_sum(m, differential.one_vs_siblings(cells, "path")).collect(), key=key)
    b = sorted(differential.sibling_rank_sum(m, "path").collect(), key=key)
    assert len(a) == len(b) > 30
    for p, q in zip(a, b):
        for c in a[0].__fields__:
            u, v = p[c], q[c]
            assert u == v or u == pytest.approx(v, abs=1e-9), (c, p, q)


def test_bh_of_one_family_equals_that_of_a_group(spark):
    rng = np.random.default_rng(17)
    p = [float(round(v, 2)) for v in rng.random(300) ** 2]
    df = spark.createDataFrame([(i, v if i % 10 else None, "k") for i, v in enumerate(p)], "i int, p double, k string")
    one = {r.i: r.q for r in windows.bh_adjust(df.repartition(7), "p").collect()}
    two = {r.i: r.q for r in windows.bh_adjust(df, "p", "q", ["k"]).collect()}
    some = sorted((v, i) for i, v in enumerate(p) if i % 10)
    best, want = 1.0, {}
    for rank in range(len(some), 0, -1):
        best = min(best, some[rank - 1][0] * len(some) / rank)
        want[some[rank - 1][1]] = best
    assert len(one) == len(two) == 300 and one[0] is None and two[10] is None
    assert all(one[i] == pytest.approx(w) and two[i] == pytest.approx(w) for i, w in want.items())


def test_components_that_do_not_settle_raise(spark):
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long"), rounds=1)


def test_covariance_of_sparse_rows(spark):
    rng = np.random.default_rng(19)
    d = rng.poisson(0.5, size=(700, 6)).astype(float)
    x = spark.createDataFrame([(i, f"c{j}", float(v)) for i, r in enumerate(d) for j, v in enumerate(r) if v], "row long, col string, value double")
    cols, c = linalg.covariance(x, "row", "col", "value", 700)
    assert cols == [f"c{j}" for j in range(6)] and np.allclose(c, np.cov(d.T))


def test_mixture_of_bins_judges_like_one_of_values(spark):
    rng = np.random.default_rng(23)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 1, 1000)])
    df = spark.createDataFrame([(i, "t", float(x)) for i, x in enumerate(v)] + [(9000, "t", None), (9001, "one", 2.0), (9002, "one", 2.0)], "i long, t string, v double")
    fine = {r.i: r.prediction for r in mixtures.two_components(df, ["t"], "v").collect()}
    rough = {r.i: r.prediction for r in mixtures.two_components(df, ["t"], "v", bins=200).collect()}
    assert fine[9000] is None and fine[9001] == fine[9002] == 0 and len(fine) == 4003
    assert np.mean([fine[i] == (i >= 3000) for i in range(4000)]) > 0.99 and np.mean([fine[i] == rough[i] for i in range(4000)]) > 0.999
    counts = spark.createDataFrame([(i, "g", int(c)) for i, c in enumerate([2] * 50 + [400] * 20)], "cell_id long, guide string, count long")
    calls = {r.cell_id: r.n_guides for r in mixtures.guide_calls(counts).collect()}
    assert calls == {i: int(i >= 50) for i in range(70)}


def test_background_is_regressed_out(spark):
    rng = np.random.default_rng(29)
    noise = rng.normal(size=60)
    rows = [(c, f"t{t}", float(max(0, 100 + 30 * noise[c] + rng.normal() + (400 if t == c % 3 else 0)))) for c in range(60) for t in range(8)]
    df = spark.createDataFrame(rows, "cell_id long, antibody string, count double")
    empty = df.where("cell_id < 10")
    raw = {(r.cell_id, r.antibody): r.value for r in mixtures.background_corrected(df, empty, denoise=False).collect()}
    done = {(r.cell_id, r.antibody): r.value for r in mixtures.background_corrected(df, empty).collect()}
    z = mixtures.antibody_scores(df, empty, 10.0).select("cell_id", "antibody", F.col("z").alias("value"))
    low = {r.cell_id: r.m for r in mixtures.two_components(z, ["cell_id"], "value").where("prediction = 0").groupBy("cell_id").agg(F.avg("value").alias("m")).collect()}
    flat = lambda d, t, by: abs(np.corrcoef([d[c, t] for c in range(60)], by)[0, 1])
    technical = [low.get(c, 0.0) for c in range(60)]
    assert len(done) == 480 and flat(raw, "t7", noise) > 0.9 and flat(done, "t7", noise) < 0.7 * flat(raw, "t7", noise)
    assert all(flat(done, f"t{t}", technical) < 1e-6 < flat(raw, f"t{t}", technical) for t in range(8))


def test_factors_rebuild_the_matrix(spark):
    rng = np.random.default_rng(31)
    w, h = rng.random((12, 2)), rng.random((2, 50)) * 5
    d = w @ h
    m = from_tables(spark.createDataFrame([(c, g, float(d[g, c])) for c in range(50) for g in range(12)], "cell_id long, gene_id long, value double"), spark.range(50).withColumnRenamed("id", "cell_id"), spark.range(12).withColumnRenamed("id", "gene_id"))
    load, place = linalg.nmf(m, 2, rounds=100)
    lw, lh = np.zeros((12, 2)), np.zeros((2, 50))
    for r in load.collect():
        lw[r.gene_id, r.component - 1] = r.loading
    for r in place.collect():
        lh[r.component - 1, r.cell_id] = r.score
    assert (lw >= 0).all() and np.allclose(lw.sum(0), 1) and np.linalg.norm(d - lw @ lh) < 0.1 * np.linalg.norm(d)


def test_malignant_cells_lie_higher(spark):
    rng = np.random.default_rng(37)
    rows, cells = [], []
    for c in range(40):
        bad = c % 2 == 0
        cells.append((c, "p", "bad" if bad else "good"))
        rows += [(c, g, float(rng.poisson(9 if bad and g < 30 else 3))) for g in range(60)]
    genes = spark.createDataFrame([(g, "1", g) for g in range(60)], "gene_id long, contig string, start long")
    m = from_tables(spark.createDataFrame([r for r in rows if r[2]], "cell_id long, gene_id long, value double"), spark.createDataFrame(cells, "cell_id long, patient string, kind string"), genes)
    got = {r.cell_id: r for r in genome.malignancy(m, "patient", "kind", "bad", 10, 5, 2).collect()}
    assert len(got) == 40 and all((got[c].malignancy == 0) == (c % 2 == 1) for c in got) and np.mean([got[c].malignancy for c in range(0, 40, 2)]) > 0.9


def test_replicate_means_against_kernels(spark):
    rng = np.random.default_rng(41)
    v = {(g, r): float(rng.normal()) for g in range(4) for r in range(10) if (g, r) != (3, 9)}
    df = spark.createDataFrame([(g, r, x) for (g, r), x in v.items()], "gene_id long, rep int, value double")
    for r in differential.replicate_tests(df, "rep", [0, 1, 2, 3, 4], [5, 6, 7, 8, 9]).collect():
        a, b = (np.array([v.get((r.gene_id, k), 0.0) for k in side]) for side in (range(5), range(5, 10)))
        assert r.ttest_ind_p == pytest.approx(pvalues.t_test(a, b)) and r.mannwhitney_p == pytest.approx(pvalues.mann_whitney(a, b)[1])
        assert r.ttest_ind_q >= r.ttest_ind_p


def test_large_peptide_components_need_no_pairs(spark):
    import itertools

    rng = np.random.default_rng(43)
    words = {"AAAAAAAAAA"} | {"".join("AAAAAAAAAA"[i] if rng.random() > 0.2 else "C" for i in range(10)) for _ in range(60)} | {"QQ", "QR", "WWWWWWWWWWWW"}
    got = {r.p: r.cluster for r in receptors.cluster_peptides(spark.createDataFrame([(w,) for w in words], "p string"), "p").collect()}
    lev = lambda a, b: sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else 99
    top = {w: w for w in words}
    for _ in words:
        for a, b in itertools.combinations(sorted(words), 2):
            if lev(a, b) <= 1:
                top[a] = top[b] = min(top[a], top[b])
    groups = {}
    for w in words:
        groups.setdefault(top[w], []).append(w)
    far = {k for k, g in groups.items() if any(lev(a, b) > 6 for a, b in itertools.combinations(g, 2))}
    assert got == {w: "-1" if top[w] in far else top[w] for w in words}


def test_association_kernels_and_empty_tables(spark):
    assert pvalues.gamma_upper(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert pvalues.gamma_upper(2, 9.487729036781154 / 2) == pytest.approx(0.05, abs=1e-9)
    assert pvalues.kolmogorov(1.3580986) == pytest.approx(0.05, abs=1e-6)
    df = spark.createDataFrame([("a", "x", 1.0)] * 8 + [("a", "y", 2.0)] * 2 + [("b", "x", 3.0)] * 1 + [("b", "y", 5.0)] * 5 + [(None, "x", 1.0)], "g string, k string, v double")
    r = associations.chi_square(df, "g", "k").first()
    assert (r.n, r.df) == (16, 1) and r.statistic == pytest.approx(6.1122, abs=1e-3) and r.p == pytest.approx(math.erfc(math.sqrt(r.statistic / 2)), abs=1e-9)
    a, b = np.array([1.0] * 8 + [2.0] * 2), np.array([3.0] + [5.0] * 5)
    f = associations.anova(df, "g", "v").first()
    assert f.p == pytest.approx(pvalues.t_test(a, b), rel=1e-6) and (f.df1, f.df2) == (1, 14)
    k = associations.two_sample_ks(df.where("g IS NOT NULL"), "v", F.col("g") == "a").first()
    assert (k.n1, k.n2, k.statistic) == (10, 6, 1.0)
    assert [tuple(r) for r in associations.jaccard(df, "g", "k").collect()] == [("a", "b", 2, 1.0)]
    none = df.limit(0)
    assert associations.chi_square(none, "g", "k").first().p is None and associations.anova(none, "g", "v").count() == 0 and associations.jaccard(none, "g", "k").count() == 0


def test_registered_functions_in_sql(spark):
    registered.register(spark)
    spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", None)], "g string, k string").createOrReplaceTempView("t_reg")
    assert {r.g: r.s for r in spark.sql("SELECT g, simpson_index(k) AS s FROM t_reg GROUP BY g").collect()} == {"a": pytest.approx(1 / 3), "b": None}
    assert [tuple(r) for r in spark.sql("SELECT * FROM window_starts(25, 10, 5)").collect()] == [(0, 0, 9), (1, 5, 14), (2, 10, 19), (3, 15, 24)]
    assert [r.v for r in spark.sql("SELECT gravy_index(p) AS v FROM VALUES ('I'), ('IR'), (''), (NULL) AS t(p)").collect()] == [4.5, 0.0, None, None]


def test_workbook_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("b & <c>", "g1", 1.5, None), ("a", "é ", 2.0, 7), ("a", "g2", None, 8)], "cluster string, gene string, p double, n int")
    writers.workbook(t, str(tmp_path / "w.xlsx"), "cluster")
    got = readers.workbook(spark, str(tmp_path / "w.xlsx"))
    assert list(got) == ["a", "b & <c>"]
    assert [tuple(r) for r in got["a"].collect()] == [("é ", "2.0", "7"), ("g2", None, "8")] and [tuple(r) for r in got["b & <c>"].collect()] == [("g1", "1.5", None)]
    with pytest.raises(ValueError):
        writers.workbook(t, str(tmp_path / "x.xlsx"), "cluster", most=2)


def test_stateful_totals_close_idle_users(spark, tmp_path):
    rows = lambda a: [(i, 1 if i % 2 else 2, "a", 1.0, a + 60 * i) for i in range(6)]
    folder = str(tmp_path / "in")
    write = lambda r: spark.createDataFrame(r, "event_id long, user_id long, event_type string, value double, s long").selectExpr("event_id", "timestamp_seconds(s) ts", "user_id", "event_type", "value", "'{}' props").coalesce(1).write.mode("append").parquet(folder)
    write(rows(1000))
    seen = []
    s = events.user_totals(events.read(spark, folder, "*.parquet"), late="1 minute")
    q = s.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).start()
    q.processAllAvailable()
    write([(9, 3, "a", 5.0, 100_000)])
    q.processAllAvailable()
    write([(10, 3, "a", 5.0, 100_060)])
    q.processAllAvailable()
    q.stop()
    assert {(1, 3, 3.0, False), (2, 3, 3.0, False), (1, 3, 3.0, True), (2, 3, 3.0, True), (3, 2, 10.0, False)} <= set(seen)


def test_streams_append_to_a_table(spark, tmp_path):
    spark.range(5).selectExpr("id event_id", "timestamp_seconds(id) ts", "id user_id", "'a' event_type", "1.0D value", "'{}' props").write.parquet(str(tmp_path / "in"))
    events.latest(events.read(spark, str(tmp_path / "in"), "*.parquet"), spark, str(tmp_path / "ck"), "stream_rows")
    assert spark.table("stream_rows").count() == 5
    spark.sql("DROP TABLE stream_rows")


def test_matrix_commands(spark, tmp_path):
    rng = np.random.default_rng(47)
    rows = [(c, g, float(rng.poisson(8 if (g < 15) == (c % 2 == 0) else 1))) for c in range(40) for g in range(30)]
    cells = spark.createDataFrame([(c, "even" if c % 2 == 0 else "odd") for c in range(40)], "cell_id long, kind string")
    genes = spark.createDataFrame([(g, f"g{g}", "1", g) for g in range(30)], "gene_id long, gene string, contig string, start long")
    writers.matrix(from_tables(spark.createDataFrame([r for r in rows if r[2]], "cell_id long, gene_id long, value double"), cells, genes), str(tmp_path / "m"))
    at = lambda n: str(tmp_path / n)
    cli.main(["subset", at("m"), at("even"), "--query", "kind == even"])
    assert readers.matrix(spark, at("even")).cells.count() == 20
    cli.main(["normalize", at("m"), at("n"), "--target", "100"])
    assert set(readers.matrix(spark, at("n")).layers) >= {"", "log"}
    cli.main(["markers", at("n"), "kind", at("marks.xlsx"), "--layer", "log", "--top", "5"])
    got = readers.workbook(spark, at("marks.xlsx"))
    assert {int(r.gene_id) < 15 for r in got["even"].collect()} == {True} and {int(r.gene_id) < 15 for r in got["odd"].collect()} == {False}
    cli.main(["window-clusters", at("m"), at("w"), "--size", "5", "--step", "5", "--cut", "0"])
    label = {int(r.id): r.level0 for r in spark.read.option("header", True).option("sep", "\t").csv(at("w")).collect()}
    assert len(label) == 40 and len(set(label.values())) == 2 and all(label[c] == label[c % 2] for c in label)


def test_standard_scores_with_and_without_a_broadcast_axis(spark):
    rng = np.random.default_rng(53)
    d = rng.poisson(0.6, size=(9, 7)).astype(float)
    d[:, 3], d[4] = 0, 0
    x = spark.createDataFrame([(f"c{i}", f"g{j}", float(v)) for i, r in enumerate(d) for j, v in enumerate(r) if v], "cell_id string, gene_id string, value double")
    m = from_tables(x, spark.createDataFrame([(f"c{i}",) for i in range(9)], "cell_id string"), spark.createDataFrame([(f"g{j}",) for j in range(7)], "gene_id string"))
    for axis, k in (("gene", 0), ("cell", 1)):
        sd = d.std(axis=k, keepdims=True)
        want = (d - d.mean(axis=k, keepdims=True)) / np.where(sd > 0, sd, 1)
        for most in (100, 3):
            got = {(r.cell_id, r.gene_id): r.value for r in layers.standardize(m, axis, out="s", most=most).layers["s"].collect()}
            assert len(got) == 63 and all(got[f"c{i}", f"g{j}"] == pytest.approx(want[i, j]) for i in range(9) for j in range(7))


def test_standard_scores_make_no_pairs_by_joins_and_are_rounded_as_spark_rounds(spark, monkeypatch):
    import pandas as pd
    from cytoplane.model import AnnotatedMatrix

    monkeypatch.setattr(AnnotatedMatrix, "dense", lambda *a: pytest.fail("pairs of cells and genes are joined"))
    x = spark.createDataFrame([(i, j, float(i * j % 5)) for i in range(6) for j in range(40) if i * j % 5], "cell_id long, gene_id long, value double")
    m = from_tables(x, spark.range(6).withColumnRenamed("id", "cell_id"), spark.range(40).withColumnRenamed("id", "gene_id"))
    for axis in ("gene", "cell"):
        whole, parts = ({(r.cell_id, r.gene_id): r.value for r in layers.standardize(m, axis, out="s", most=most, digits=6).layers["s"].collect()} for most in (100, 25))
        exact = layers.standardize(m, axis, out="s").layers["s"].select("cell_id", "gene_id", (F.round("value", 6) + 0.0).alias("value"))
        assert len(whole) == 240 and whole == parts == {(r.cell_id, r.gene_id): r.value for r in exact.collect()}
    v = np.concatenate([np.random.default_rng(5).normal(size=5000), (np.arange(-500, 500) + 0.5) * 1e-6, [0.0, -0.0, -1e-9, 1e300, 5e9 + 0.1234565, np.inf]])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(v)), "v": v})).select("i", (F.round("v", 6) + 0.0).alias("r")).orderBy("i")
    assert layers.half_up(v, 6).tolist() == [r.r for r in df.collect()]


def test_clumps_linked_in_rounds_are_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(5, 8)), 24, axis=0) + 0.4 * rng.normal(size=(120, 8))
    x = np.vstack([x, x[:9], np.zeros((1, 8))])
    ids = rng.permutation(len(x)) * 3 + 1
    want = clustering.unit_clumpiness(clustering.unit_rows(x[np.argsort(ids)]), most=60)[1]
    p = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)] + [(-5, None)], "id long, vec array<double>")
    # No task may get all rows.
    most, linkage = [], clumps._in_one
    monkeypatch.setattr(clumps, "_in_one", lambda c: most.append(c.count()) or linkage(c))
    got = sorted(tuple(r) for r in clumps.clumps(p, most=60, held=70).collect())
    assert most[0] <= 70 and [g[:2] for g in got] == list(zip(want["cluster"], want["n"]))
    assert [g[2] for g in got] == pytest.approx(want["mean_distance"].tolist())


def test_refined_communities_are_connected_and_merge_further(spark):
    import itertools

    cliques = [[f"n{k}-{i}" for i in range(6)] for k in range(6)]
    e = [(a, b, 1.0) for c in cliques for a, b in itertools.combinations(c, 2)] + [(cliques[k][0], cliques[k + 1][1], 1.0) for k in range(5)] + [("z1", "z2", 1.0)]
    df = spark.createDataFrame(e, "src string, dst string, weight double")
    got = {r.node: r.community for r in graph.refined_communities(df).collect()}
    assert len(got) == 38 and got["z1"] == got["z2"] == "z1" and all(len({got[n] for n in c}) == 1 for c in cliques)
    parts = {}
    for n, c in got.items():
        parts.setdefault(c, set()).add(n)
    for c, nodes in parts.items():
        seen, open_ = set(), [c]
        while open_:
            n = open_.pop()
            seen.add(n)
            open_ += [b if a == n else a for a, b, _ in e if n in (a, b) and ({a, b} <= nodes) and not {a, b} <= seen]
        assert seen == nodes and c == min(nodes)

    def modularity(label):
        total, inside, mass = len(e), 0, {}
        for a, b, _ in e:
            inside += label[a] == label[b]
            for n in (a, b):
                mass[label[n]] = mass.get(label[n], 0) + 1
        return inside / total - sum((v / 2 / total) ** 2 for v in mass.values())

    plain = {r.node: r.community for r in graph.communities(df).collect()}
    assert modularity(got) >= modularity(plain) - 1e-9 and modularity(got) > 0.7


def test_landmarks_stand_for_the_rest(spark):
    p = blobs(spark, 40)
    exact = {(r.id, r.component): r.value for r in linalg.diffusion(p, 0.5, 2).collect()}
    whole = {(r.id, r.component): r.value for r in linalg.diffusion(p, 0.5, 2, landmarks=200).collect()}
    some = {(r.id, r.component): r.value for r in linalg.diffusion(p, 0.5, 2, landmarks=60).collect()}
    assert exact.keys() == whole.keys() == some.keys() and all(whole[k] == pytest.approx(v, abs=1e-9) for k, v in exact.items())
    ids = sorted({i for i, _ in exact})
    for name in ("cell-0", "cell-1", "cell-2"):
        own = [some[i, 1] for i in ids if i.startswith(name)]
        assert np.std(own) < 0.2 * np.std([some[i, 1] for i in ids])
    near = graph.nearest(p, 8).select("src", "dst", F.lit(1.0).alias("weight"))
    xy = linalg.layout(near, 50, landmarks=60)
    assert xy.count() == 120 and xy.where("x IS NULL").count() == 0 and dict(xy.dtypes)["id"] == "string"


def test_outliers_by_rounded_distances_as_in_the_sql(spark, tmp_path):
    """The distances on both sides of the quantile differ, but not in the digits that are shown."""
    import duckdb

    far = [0.1] * 8 + [0.25, 0.2500002]
    rows = [(11 * c + i, [10.0 * c, d if i == 10 else 0.0, 1.0], 0) for c, d in enumerate(far) for i in range(11)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in catalogue.outlier_nth_neighbor(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == set(c.execute(catalogue.oracle_sql()["outlier_nth_neighbor"]).fetchall()) and all(r[2] for r in got)


def test_replicate_tests_take_many_genes_at_a_time(spark):
    """Genes are tested a batch at a time, each like alone, and none is a group of its own."""
    rng = np.random.default_rng(43)
    v = [(g, r, float(rng.integers(0, 9))) for g in range(300) for r in range(6) if (g + r) % 7]
    df = spark.createDataFrame(v, "gene_id long, rep int, value double")
    out = differential.replicate_tests(df, "rep", [0, 1, 2], [3, 4, 5])
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got, by = {r.gene_id: r for r in out.collect()}, {(g, r): x for g, r, x in v}
    assert len(got) == 300
    for g, r in got.items():
        a, b = (np.array([by.get((g, i), 0.0) for i in side]) for side in ((0, 1, 2), (3, 4, 5)))
        u, p = pvalues.mann_whitney(a, b)
        assert (r.mannwhitney_p, r.CommonLanguageEffectSize) == (pytest.approx(p), pytest.approx(u / 9)) and r.ttest_ind_p == pytest.approx(pvalues.t_test(a, b))


def test_diffusion_of_blocks_is_the_dense_one(spark):
    p = blobs(spark, named=False)
    dense, got = ({(r.id, r.component): r.value for r in linalg.diffusion(p, 0.5, 3, **how).collect()} for how in ({}, {"limit": 100, "blocks": True}))
    assert got.keys() == dense.keys() and len(got) == 360
    for at, v in dense.items():
        assert got[at] == pytest.approx(v, abs=1e-7)


def test_nearest_in_few_blocks_keeps_ties_by_id(spark):
    """Every point is sent to as few blocks as hold it; rows of equal distance come in the order of ids."""
    assert [graph.blocks_of(n, 2048, 12) for n in (1, 2049, 51_282, 600_000)] == [1, 2, 7, 37]
    rng = np.random.default_rng(61)
    x = rng.integers(0, 3, size=(400, 3)).astype(float)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = graph.nearest(p, 7, block=4, metric="euclidean")
    rows = {(r.src, r["rank"]): r.dst for r in got.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :7]
    assert rows == {(i, r + 1): int(order[i, r]) for i in range(400) for r in range(7)}


def test_layout_of_tables_holds_neighbours_together(spark):
    """More nodes than the limit, none left out, as near to their neighbours as by the layout of one task."""
    rings = [(20 * g + i, 20 * g + (i + s) % 20, 1.0) for g in range(6) for i in range(20) for s in (1, 2, 3)]
    e = spark.createDataFrame(rings, "src long, dst long, weight double")
    with pytest.raises(ValueError):
        linalg.layout(e, 40, limit=100)
    share = []
    for more in ({}, {"limit": 100, "tables": True}):
        got = {r.id: (r.x, r.y) for r in linalg.layout(e, 10, **more).collect()}
        assert sorted(got) == list(range(120)) and all(math.isfinite(v) for p in got.values() for v in p)
        mean = lambda pairs: sum(math.dist(got[a], got[b]) for a, b in pairs) / len(pairs)  # noqa: E731, B023
        share.append(mean([(a, b) for a, b, _ in rings]) / mean([(a, b) for a in range(120) for b in range(a)]))
    assert abs(share[1] - share[0]) < 0.2 * share[0], share


def test_nmf_packs_cells_once(spark, monkeypatch):
    """All rounds read one table that is written once."""
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([(int(c), int(g), float(v)) for c, g, v in zip(rng.integers(0, 40, 300), rng.integers(0, 12, 300), rng.integers(1, 9, 300))], "cell_id long, gene_id long, value double")
    m = from_tables(x, x.select("cell_id").distinct(), x.select("gene_id").distinct())
    seen, inner = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: seen.append(df.columns) or inner(df))
    load, score = linalg.nmf(m, 2, rounds=20)
    assert seen == [["cell_id", "x"]] and load.count() == 24 and score.count() == 80
    assert all(abs(r.s - 1) < 1e-9 for r in load.groupBy("component").agg(F.sum("loading").alias("s")).collect())


def test_communities_without_a_score_have_no_silhouettes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))], "id long, vec array<double>")
    want = {tuple(r) for r in clustering.neighbour_communities(p, 4)[0].collect()}
    monkeypatch.setattr(graph, "silhouettes", None)
    got, s = clustering.neighbour_communities(p, 4, scored=False)
    assert s is None and {tuple(r) for r in got.collect()} == want
