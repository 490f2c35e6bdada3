"""Operators that replace all-pairs, squares and permutations, against those or against brute force."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.functions import pvalues
from cytoplane.model import from_tables
from cytoplane.operators import clustering, components, genome, graph, layers, linalg, masks, mixtures, moves, neighbours, receptors, signatures, spectra, windows


# ---- neighbours


def cloud(spark, n, d=8, groups=20, seed=1, repeats=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, d))
    x = c[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.6
    rows = [(f"p{i:05d}", v.tolist()) for i, v in enumerate(x)] + [(f"r{i:05d}", x[0].tolist()) for i in range(repeats)]
    return spark.createDataFrame(rows, "id string, vec array<double>")


def test_neighbour_descent_finds_nearly_all(spark):
    p = cloud(spark, 1500, repeats=60)
    exact = collections.defaultdict(list)
    for r in graph.nearest(p, 8).collect():
        exact[r.src].append(r.distance)
    got = collections.defaultdict(list)
    for r in neighbours.neighbour_descent(p, 8).collect():
        assert r.src != r.dst
        got[r.src].append((r.rank, r.distance, r.dst))
    assert got.keys() == exact.keys()
    hits = 0
    for i, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 9)) and len({d for _, _, d in rows}) == 8
        assert [d for _, d, _ in rows] == sorted(d for _, d, _ in rows)
        hits += sum(d <= max(exact[i]) + 1e-8 for _, d, _ in rows)
    assert hits >= 0.95 * 8 * len(exact)


def test_neighbour_descent_on_odd_tables(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert neighbours.neighbour_descent(none, 3).count() == 0
    assert neighbours.neighbour_descent(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>"), 3).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, None)], "id long, vec array<double>")
    got = {(r.src, r.dst): r.distance for r in neighbours.neighbour_descent(few, 3).collect()}
    assert len(got) == 12 and got[1, 2] == 0 and got[1, 3] == got[4, 1] == 1
    own = neighbours.neighbour_descent(few, 2, include_self=True).where("rank = 1").collect()
    assert {(r.src, r.dst) for r in own} == {(i, i) for i in (1, 2, 3, 4)}


def test_hubs_give_lists_of_bounded_length(spark):
    """Every point is nearest to one of the centre: the lists that meet in a task stay short."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0] + [0.0] * 15)] + [(i, [1.0, *(rng.normal(size=15) * 0.5).tolist()]) for i in range(1, 1200)]
    p = spark.createDataFrame(rows, "id long, vec array<double>")
    seen = []
    inner = neighbours._local_joins

    def watched(k):
        run = inner(k)

        def count(batches):
            for pdf in batches:
                assert max(map(len, pdf["vs"])) <= 120
                yield from run([pdf])

        seen.append(k)
        return count

    neighbours._local_joins = watched
    try:
        assert neighbours.neighbour_descent(p, 10, rounds=2).count() == 12000
    finally:
        neighbours._local_joins = inner
    assert seen


def test_one_table_of_neighbours_serves_every_number(spark):
    p = cloud(spark, 120, groups=3)
    table = clustering.neighbour_table(p, 40)
    for k in (3, 12):
        want = {(r.src, r.dst) for r in graph.nearest(p, k, include_self=True).collect()}
        assert {(r.src, r.dst) for r in table.where(F.col("rank") <= k).collect()} == want
    assert -1 <= clustering.neighbour_communities(p, 12, near=table)[1] <= 1


@pytest.mark.parametrize("held", [2, 1024])
def test_silhouettes_equal_all_distances(spark, held):
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(60, 5)), [int(v) for v in rng.integers(0, 7, 60)]
    label[3] = 99  # alone
    x[5] = 0
    rows = [(f"i{i}", v.tolist(), label[i]) for i, v in enumerate(x)] + [("n", None, 1), ("m", [1.0] * 5, None)]
    got = {r.id: r.silhouette for r in graph.silhouettes(spark.createDataFrame(rows, "id string, vec array<double>, label int"), held=held).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in range(60):
        d = {g: [1 - u[i] @ u[j] for j in range(60) if j != i and label[j] == g] for g in set(label)}
        own, other = d[label[i]], min(np.mean(v) for g, v in d.items() if g != label[i])
        want = (other - np.mean(own)) / max(other, np.mean(own)) if own else 0.0
        if i == 5:  # a vector of zeros is not at distance 0 from itself, which the sums take for granted
            continue
        if label[i] != label[5] or not own:
            assert got[f"i{i}"] == pytest.approx(want)
    assert len(got) == 60


# ---- communities


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


def modularity(edges, label):
    total, inside, mass = sum(w for *_, w in edges), 0.0, collections.Counter()
    for a, b, w in edges:
        inside += w * (label[a] == label[b])
        mass[label[a]] += w
        mass[label[b]] += w
    return inside / total - sum((v / 2 / total) ** 2 for v in mass.values())


def connected(nodes, edges):
    seen, open_ = set(), [min(nodes)]
    while open_:
        n = open_.pop()
        if n not in seen:
            seen.add(n)
            open_ += [b if a == n else a for a, b, _ in edges if n in (a, b) and a in nodes and b in nodes]
    return seen == set(nodes)


@pytest.mark.parametrize("seed", [0, 1])
def test_leiden_is_near_the_best_partition_of_small_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = [f"n{i}" for i in range(8)]
    edges = [(a, b, float(rng.integers(1, 4))) for a, b in itertools.combinations(nodes, 2) if rng.random() < (0.75 if int(a[1]) // 4 == int(b[1]) // 4 else 0.2)]
    used = sorted({n for a, b, _ in edges for n in (a, b)})
    best = max(modularity(edges, {n: i for i, g in enumerate(p) for n in g}) for p in partitions(used))
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    out = graph.leiden(df)
    got = {r.node: r.community for r in out.collect()}
    assert sorted(got) == used
    assert graph.modularity(df, out) == pytest.approx(modularity(edges, got))
    assert modularity(edges, got) >= best - 0.03
    for c in set(got.values()):
        own = {n for n, v in got.items() if v == c}
        assert connected(own, edges) and c == min(own)


def test_a_badly_connected_community_is_taken_apart(spark):
    """A community of two cliques that only a third, outer, one ties together, as label moves can leave it."""
    cliques = [[f"{c}{i}" for i in range(5)] for c in "abz"]
    edges = [(x, y, 1.0) for c in cliques for x, y in itertools.combinations(c, 2)] + [("a0", "z0", 1.0), ("b0", "z1", 1.0)]
    df = spark.createDataFrame(edges, "u string, v string, w double")
    both = graph.written(df.union(df.select("v", "u", "w")))
    degree = both.groupBy("u").agg(F.sum("w").alias("k"))
    bad = spark.createDataFrame([(n, "z0" if n[0] == "z" else "a0") for c in cliques for n in c], "node string, community string")
    part = {r.node: r.part for r in graph.well_connected_parts(both, degree, bad).collect()}
    assert len(part) == 15 and not {part[n] for n in cliques[0]} & {part[n] for n in cliques[1]}
    for p in set(part.values()):
        assert connected({n for n, v in part.items() if v == p}, edges) and p in part
    got = {r.node: r.community for r in graph.leiden(df.toDF("src", "dst", "weight")).collect()}
    assert [{got[n] for n in c} for c in cliques] == [{"a0"}, {"b0"}, {"z0"}]


def test_leiden_is_no_worse_than_label_moves(spark):
    rng = np.random.default_rng(8)
    block = [i // 20 for i in range(80)]
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(80), 2) if rng.random() < (0.25 if block[a] == block[b] else 0.02)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    new, old = (graph.modularity(df, f(df)) for f in (graph.leiden, graph.refined_communities))
    truth = modularity(edges, dict(enumerate(block)))
    assert new >= old - 1e-3 and new >= truth - 0.02
    assert graph.leiden(df.limit(0)).count() == 0


# ---- components


def long_table(spark, d):
    return spark.createDataFrame([(f"c{i}", f"g{j:03d}", float(v)) for i, r in enumerate(d) for j, v in enumerate(r) if v], "cell_id string, gene_id string, value double")


def spiked(rng, n, k, rank):
    return np.round(np.abs((rng.normal(size=(n, rank)) * np.linspace(8, 2, rank)) @ rng.normal(size=(rank, k)) + rng.normal(size=(n, k)) * 0.3) * (rng.random((n, k)) < 0.5), 3)


def angle(a, b):
    """The sine of the largest angle between two spaces."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


def test_components_equal_the_exact_ones(spark):
    d = spiked(np.random.default_rng(1), 160, 70, 6)
    d[:, 5], d[9] = 0, 0
    rows = components.Rows(long_table(spark, d), "cell_id", "gene_id", "value", 160, tasks=3)
    assert len(rows.columns) == 69
    x = np.delete(d, 5, axis=1)
    c = np.cov(x.T)
    v = np.random.default_rng(2).normal(size=(69, 4))
    assert np.allclose(rows.times(v, held=7), c @ v)
    got = components.fit(rows, 4)
    w, e = np.linalg.eigh(c)
    assert angle(got.vectors[:, :4], e[:, ::-1][:, :4]) < 1e-6
    assert np.allclose(got.variances[:4], w[::-1][:4], rtol=1e-9) and got.total == pytest.approx(w.sum())
    assert got.vectors.shape == (69, 14) and np.allclose(got.vectors.T @ got.vectors, np.eye(14))


def test_pca_is_the_same_with_and_without_the_square(spark):
    d = spiked(np.random.default_rng(3), 90, 40, 4)
    m = from_tables(long_table(spark, d), spark.createDataFrame([(f"c{i}",) for i in range(90)], "cell_id string"), spark.createDataFrame([(f"g{j:03d}",) for j in range(40)], "gene_id string"))
    (a, ra), (b, rb) = linalg.pca(m, 3), linalg.pca(m, 3, square=10)
    assert a.schema.simpleString() == b.schema.simpleString()
    a, b = ({(r.gene_id, r.pc): r.loading for r in t.collect()} for t in (a, b))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-7) for k in a) and np.allclose(ra, rb)


def test_components_of_few_rows_columns_and_none(spark):
    d = spiked(np.random.default_rng(4), 5, 30, 3)
    got = components.fit(components.Rows(long_table(spark, d), "cell_id", "gene_id", "value", 5), 3)
    w = np.linalg.eigvalsh(np.cov(d[:, d.any(axis=0)].T))[::-1]
    assert np.allclose(got.variances[:3], w[:3])
    empty = components.fit(components.Rows(long_table(spark, d).limit(0), "cell_id", "gene_id", "value", 5), 3)
    assert empty.loadings(spark, 3, "gene_id", "string").count() == 0 and empty.ratios(3) == []
    flat = components.fit(components.Rows(spark.createDataFrame([("a", "g", 1.0), ("b", "g", 1.0)], "cell_id string, gene_id string, value double"), "cell_id", "gene_id", "value", 2), 1)
    assert flat.variances.tolist() == [0.0] and flat.ratios(1) == [0.0]


def test_a_new_batch_is_merged_into_stored_components(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 25)) * 6
    a, b = (np.round((rng.normal(size=(n, 3)) + shift) @ base + rng.normal(size=(n, 25)) * 0.01, 6) for n, shift in ((60, 0), (35, 2)))
    fit = lambda x, n: components.fit(components.Rows(long_table(spark, x), "cell_id", "gene_id", "value", n), 3)
    both = components.merged(fit(a, 60), fit(b, 35), 3)
    c = np.cov(np.vstack([a, b]).T)
    w, e = np.linalg.eigh(c)
    assert both.n == 95 and both.total == pytest.approx(w.sum()) and np.allclose(both.mean, np.vstack([a, b]).mean(axis=0))
    assert angle(both.vectors[:, :3], e[:, ::-1][:, :3]) < 1e-4 and np.allclose(both.variances[:3], w[::-1][:3], rtol=1e-6)


def test_array_sums(spark):
    rows = [(i % 3, "ab"[i % 2], [float(i), 1.0, -2.0 * i]) for i in range(20)]
    got = {(r.k, r.s): r.v for r in components.array_sums(spark.createDataFrame(rows, "k int, s string, v array<double>"), ["k", "s"], "v", 3).collect()}
    want = {key: np.sum([v for k, s, v in rows if (k, s) == key], axis=0).tolist() for key in {(k, s) for k, s, _ in rows}}
    assert got == want


# ---- slopes


def test_median_slope_equals_that_of_all_pairs():
    rng = np.random.default_rng(1)
    for t in range(160):
        n, kind = int(rng.integers(0, 50)), t % 4
        x = rng.normal(size=n) if kind == 0 else rng.integers(0, 6, n).astype(float)
        y = rng.normal(size=n) if kind < 2 else rng.integers(0, 4, n).astype(float)
        y = np.where(rng.random(n) < 0.7, 0, y) if kind == 3 else y
        dx, dy = x[None] - x[:, None], y[None] - y[:, None]
        want = float(np.median(dy[dx > 0] / dx[dx > 0])) if (dx > 0).any() else float("nan")
        for held in (1, 20, 1 << 18):
            got = pvalues.median_slope(x, y, held=held, drawn=int(rng.choice([4, 64])))
            assert got == pytest.approx(want, rel=1e-8, abs=1e-8, nan_ok=True)


def test_inversion_pairs_are_all_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 33):
        v = rng.integers(0, 9, n)
        i, j = pvalues.inversion_pairs(v)
        assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a, b in itertools.combinations(range(n), 2) if v[a] > v[b]] and len(i) == pvalues.inversions(v)
        some = np.arange(0, len(i), 3)
        a, b = pvalues.inversion_pairs(v, some)
        assert (a == i[some]).all() and (b == j[some]).all()


def test_median_slope_of_many_rows_is_quick():
    import time

    rng = np.random.default_rng(3)
    x = rng.random(100_000)
    y = 3 * x + rng.normal(size=100_000)
    began = time.time()
    assert pvalues.median_slope(x, y) == pytest.approx(3, abs=0.05)
    assert time.time() - began < 30


# ---- enrichment


def score_by_hand(hits, n, weights=None):
    w = [1.0] * n if weights is None else weights
    total, miss, at, best = sum(w[h] for h in hits), n - len(hits), 0.0, 0.0
    for i in range(n):
        at += w[i] / total if i in hits else -1 / miss
        best = at if abs(at) > abs(best) + 1e-12 else best
    return best


@pytest.mark.parametrize("weighted", [False, True])
def test_small_p_agrees_with_every_set_of_twelve_genes(weighted):
    n, size = 12, 4
    steps = np.linspace(3, 0.5, n) if weighted else None
    every = np.array(list(itertools.combinations(range(n), size)))
    scores = signatures.largest_deviation(every, n, steps)
    for hits, s in list(zip(every, scores))[::97]:
        high = max(0.0, s)
        walk = [0.0]
        for i in range(n):
            walk.append(walk[-1] + ((1.0 if steps is None else steps[i]) / (size if steps is None else steps[hits].sum()) if i in hits else -1 / (n - size)))
        assert s == pytest.approx(max(walk[1:])) or high == pytest.approx(max(walk))
    for target in np.unique(np.round(scores, 9))[-9::2] - 1e-8:
        exact = float((scores >= target).mean())
        got = np.mean([signatures.small_p(target, size, n, steps, sets=400, mixed=3, seed=s)[0] for s in range(8)])
        assert got == pytest.approx(exact, rel=0.2)


def test_small_p_goes_far_below_what_permutations_see():
    n, size = 2000, 20
    score = float(signatures.largest_deviation(np.arange(size)[None], n)[0])  # the first genes: one set of all
    p, error = signatures.small_p(score, size, n, seed=1)
    exact = -sum(math.log2((n - i) / (i + 1)) for i in range(size))
    assert p < 1e-20 and math.log2(p) == pytest.approx(exact, rel=0.15) and 0 < error < 5
    assert signatures.small_p(0.5, 0, 5) == (1.0, 0.0) == signatures.small_p(0.5, 5, 5)


def test_exact_p_agrees_with_every_set_and_with_far_ones():
    for n, size in ((12, 4), (9, 7), (14, 2), (5, 1)):
        scores = signatures.largest_deviation(np.array(list(itertools.combinations(range(n), size))), n)
        for target in np.unique(np.round(scores, 9)):
            assert signatures.exact_p(target - 1e-8, size, n) == pytest.approx(float((scores >= target - 2e-8).mean()), rel=1e-9)
    assert math.log2(signatures.exact_p(1.0, 20, 2000)) == pytest.approx(-sum(math.log2((n - i) / (i + 1)) for n in [2000] for i in range(20)), rel=1e-9)
    assert signatures.exact_p(0.5, 0, 5) == 1.0 == signatures.exact_p(0.5, 5, 5)
    # Half as far in a table of four times the genes and the set: about as likely.
    assert signatures.exact_p(0.1, 400, 8000) == pytest.approx(signatures.exact_p(0.05, 1600, 32_000), rel=0.1)


def test_scores_of_pathways_draw_no_random_sets(spark, monkeypatch):
    def never(*args, **kw):
        raise AssertionError("drawn")

    monkeypatch.setattr(signatures, "small_p", never)
    monkeypatch.setattr(signatures, "exact_p", never)
    from cytoplane.plans import more

    assert more.enrichment_scores(spark, "/root/testdata/sf0.001").count() > 0
    scores = spark.createDataFrame([(i, float(-i)) for i in range(60)], "gene_id long, score double")
    got = signatures.running_scores(scores, spark.createDataFrame([("first", i) for i in range(5)], "pathway string, gene_id long")).collect()
    assert [tuple(r) for r in got] == [("first", 5, 1.0)]


def test_enrichment_of_pathways(spark):
    rng = np.random.default_rng(6)
    n = 300
    s = rng.normal(size=n)
    order = sorted(range(n), key=lambda i: (-s[i], f"g{i:03d}"))
    rank = {g: r for r, g in enumerate(order)}
    ways = {"top": order[:12], "bottom": order[-15:], "any": rng.choice(n, 20, replace=False).tolist(), "all": range(n), "one": [order[40]]}
    rows = [(p, f"g{g:03d}") for p, gs in ways.items() for g in gs] + [("top", f"g{order[0]:03d}"), ("any", "unknown"), ("nowhere", "unknown")]
    scores = spark.createDataFrame([(f"g{i:03d}", float(v)) for i, v in enumerate(s)] + [("empty", None)], "gene_id string, score double")
    for weight in (0.0, 1.0):
        got = {r.pathway: r for r in signatures.enrichment(scores, spark.createDataFrame(rows, "pathway string, gene_id string"), weight=weight, chains=1, sets=100).collect()}
        assert got.keys() == ways.keys()
        for name, gs in ways.items():
            r = got[name]
            assert r.size == len(set(gs)) and 0 < r.p <= r.q <= 1
            if name != "all":
                assert r.es == pytest.approx(score_by_hand({rank[g] for g in gs}, n, [abs(s[g]) ** weight for g in order]))
        assert got["top"].p < 1e-9 and got["bottom"].p < 1e-9 and got["bottom"].es < 0 and got["any"].p > 0.01 and (got["all"].es, got["all"].p) == (0, 1)
    with pytest.raises(ValueError):
        signatures.enrichment(scores, spark.createDataFrame(rows, "pathway string, gene_id string"), weight=1.0, most=10)


# ---- molecules


def molecules_by_hand(counts):
    """{umi: molecule}: the most read UMIs first take all that they lead to."""
    order, out = sorted(counts, key=lambda u: (-counts[u], u)), {}
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    for u in order:
        open_ = [u] if u not in out else []
        while open_:
            a = open_.pop()
            if a in out:
                continue
            out[a] = u
            open_ += [b for b in counts if b not in out and near(a, b) and counts[a] >= 2 * counts[b] - 1]
    return out


def test_umis_that_meet_none_take_no_part_in_label_rounds(spark, monkeypatch):
    seen, written = [], genome.written
    monkeypatch.setattr(genome, "written", lambda df: seen.append(set(df.columns)) or seen.append(written(df)) or seen[-1])
    rows = [("a", u) for u, n in {"AAAA": 5, "AAAC": 2, "GGGG": 3, "TTCC": 1}.items() for _ in range(n)] + [("b", "AAAC")]
    got = {(r.cell, r.umi): (r.n, r.molecule) for r in genome.umi_networks(spark.createDataFrame(rows, "cell string, umi string"), ["cell"]).collect()}
    assert got == {("a", "AAAA"): (5, "AAAA"), ("a", "AAAC"): (2, "AAAA"), ("a", "GGGG"): (3, "GGGG"), ("a", "TTCC"): (1, "TTCC"), ("b", "AAAC"): (1, "AAAC")}
    labels = [t for c, t in zip(seen[::2], seen[1::2]) if "top" in c]
    assert labels and all(t.count() == 2 for t in labels)


def test_umi_networks_equal_those_by_hand(spark):
    rng = np.random.default_rng(7)
    reads, want = [], {}
    for place in (("chr1", "A"), ("chr1", "B"), (None, "A"), ("chr2", None)):
        seeds = ["".join(rng.choice(list("ACGT"), 8)) for _ in range(6)]
        umis = collections.Counter()
        for u in seeds:
            for _ in range(int(rng.integers(1, 40))):
                v = list(u)
                while rng.random() < 0.35:
                    v[rng.integers(0, 8)] = str(rng.choice(list("ACGT")))
                umis["".join(v)] += 1
        umis.update({"": 2, "N": 1, "AAAA": 5, "AAAC": 3, "AACC": 2, "AACG": 1, "ACCG": 1})
        reads += [(*place, u, 1) for u, n in umis.items() for _ in range(n)] + [(*place, None, 1)]
        want |= {(*place, u): (umis[u], m) for u, m in molecules_by_hand(umis).items()}
    df = spark.createDataFrame(reads, "chrom string, cell string, umi string, n int")
    out = genome.umi_networks(df, ["chrom", "cell"]).collect()
    assert len(out) == len(want) and {(r.chrom, r.cell, r.umi): (r.n, r.molecule) for r in out} == want
    assert genome.umi_networks(df.limit(0), ["chrom", "cell"]).count() == 0


def test_transcription_starts_count_molecules(spark):
    seq = "A" * 5 + "G" + "C" * 20
    umis = ["ACGTACGT"] * 6 + ["ACGTACGA"] * 2 + ["TTTTTTTT"] * 3 + ["TTTTTTTA"] * 3
    rows = [("chr1", 100, 120, "+", "6S20M", seq, "cell", u) for u in umis] + [("chr1", 100, 120, "+", "6S20M", "C" * 26, "cell", "GGGGGGGG"), ("KI27", 100, 120, "+", "6S20M", seq, "cell", "GGGGGGGG")]
    reads = spark.createDataFrame(rows, "chrom string, pos long, end long, strand string, cigar string, seq string, barcode string, umi string")
    assert {(r.chrom, r.n) for r in genome.soft_clipped_starts(reads).collect()} == {("chr1", 4), ("KI27", 1)}
    assert [(r.chrom, r.start, r.end, r.strand, r.barcode, r.n) for r in genome.soft_clipped_starts(reads, networks=True, contigs="chr").collect()] == [("chr1", 100, 101, "+", "cell", 3)]


# ---- receptors, quantiles, background, layouts


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_near_pairs_equal_those_of_all_pairs(spark, most):
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("ACDE"), 7)) for _ in range(6)]

    def chain():
        s = list(base[rng.integers(0, 6)])
        for _ in range(rng.integers(0, 3)):
            k = int(rng.integers(0, len(s)))
            s[k : k + 1] = rng.choice([["A"], ["C", "D"], []][rng.integers(0, 3)] or ["E"], 1).tolist() if rng.random() < 0.7 else []
        return "".join(s)

    clones = [(f"t{i}", "---".join(chain() for _ in range(rng.integers(1, 3))), "---".join(chain() for _ in range(rng.integers(0, 3)))) for i in range(70)]
    clones += [(f"h{i}", "ACDEACD", chain()) for i in range(30)] + [clones[0], ("none", "", ""), (None, "AC", "DE"), ("null", None, "AC")]
    df = spark.createDataFrame(clones, "tcr string, tra string, trb string")
    all_pairs = receptors.pair_distances(df.where("tcr IS NOT NULL AND tra IS NOT NULL"))
    want = {(r.a, r.b): r.d for r in all_pairs.collect() if r.d is not None and r.d <= most}
    found = receptors.near_pairs(df, most)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert {(r.a, r.b): r.d for r in rows} == want and len(rows) == len(want) and (most < 2 or len(want) > 30)


def test_near_strings(spark):
    words = ["", "a", "ab", "abc", "xyz", "abcd", "acbd", "é", "éa", "ab"]
    df = spark.createDataFrame([("k", w) for w in words] + [("other", "ab"), ("k", None)], "kind string, text string")
    got = {(r.kind, r.x, r.y): r.d for r in receptors.near_strings(df, 2).collect()}
    want = {("k", a, b): levenshtein(a, b) for a in set(words) for b in set(words) if levenshtein(a, b) <= 2} | {("other", "ab", "ab"): 0}
    assert got == want


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(12)
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 0.999, 1.0]
    for values in (rng.normal(size=997).tolist(), rng.integers(0, 4, 500).astype(float).tolist(), [3.0], [1.0, 2.0], [7.0] * 40):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        assert windows.exact_quantiles(df, "v", shares, accuracy) == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    assert windows.exact_quantiles(df.limit(0), "v", [0.5]) == [None] and windows.exact_quantiles(df, "v", []) == []


def test_quantile_bins_are_the_same_either_way(spark):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, None if i % 17 == 0 else float(v)) for i, v in enumerate(rng.integers(0, 30, 400))], "i int, v double")
    a, b = ({r.i: r.bin for r in windows.quantile_bins(df, "v", 7, few=few).collect()} for few in (False, True))
    assert a == b and a[0] is None and len(set(a.values())) > 5
    assert windows.quantile_bins(df.limit(0), "v", 7).count() == 0


def test_background_by_isotypes_and_clipping(spark):
    rng = np.random.default_rng(14)
    n, tags = 120, ["CD3", "CD19", "iso1", "iso2", "iso3"]
    noise = rng.normal(size=n)
    counts = {t: np.round(np.exp(4 + 0.4 * noise + rng.normal(size=n) * 0.05 + (1.5 * (rng.random(n) < 0.4) if t[0] == "C" else 0))) for t in tags}
    rows = [(f"c{i}", t, float(counts[t][i])) for t in tags for i in range(n)]
    empty = [(f"e{i}", t, float(rng.poisson(5))) for t in tags for i in range(60)]
    c, e = (spark.createDataFrame(x, "cell_id string, antibody string, count double") for x in (rows, empty))
    got = {(r.cell_id, r.antibody): r.value for r in mixtures.background_corrected(c, e, isotypes=tags[2:], negatives=False).collect()}
    z = {}
    for t in tags:
        base = np.log(np.array([v for _, u, v in empty if u == t]) + 10)
        z[t] = (np.log(counts[t] + 10) - base.mean()) / base.std()
    s = np.column_stack([(z[t] - z[t].mean()) / z[t].std(ddof=1) for t in tags[2:]])
    pc = s @ np.linalg.eigh(np.corrcoef(s.T))[1][:, -1]
    for t in tags:
        b = np.cov(z[t], pc)[0, 1] / pc.var(ddof=1)
        want = z[t] - b * (pc - pc.mean())
        assert all(got[f"c{i}", t] == pytest.approx(want[i]) for i in range(n))
    assert abs(np.corrcoef(noise, [got[f"c{i}", "iso1"] for i in range(n)])[0, 1]) < 0.5
    both = mixtures.background_corrected(c, e, isotypes=["iso1"])
    assert both.count() == len(rows)
    clipped = mixtures.background_corrected(c, e, isotypes=["iso1"], negatives=False, clip=(0.1, 0.9)).where("antibody = 'CD3'").collect()
    values = sorted(r.value for r in clipped)
    assert len({v for v in values if v == values[0]}) == 1 and values[11] == values[0] and values[-12] == values[-1] and values[20] > values[0]
    one = {(r.cell_id, r.antibody): r.value for r in mixtures.background_corrected(c, e, isotypes=["iso1"], negatives=False).collect()}
    assert all(abs(one[f"c{i}", "iso1"] - z["iso1"].mean()) < 1e-9 for i in range(n))


def test_downsampled_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, 10 * k) for k in range(12)] + [(99, None)], "k int, n long")
    seen = [sorted((r.k, r.n) for r in masks.downsample_counts(df.repartition(p), "k", "n", 0.37).collect()) for p in (1, 7)]
    assert seen[0] == seen[1] and sum(n for _, n in seen[0]) == round(660 * 0.37) and dict(seen[0])[0] == 0


def test_landmarks_lay_out_what_they_stand_for(spark):
    """Three clusters of a sparse graph, of which few landmarks are neighbours: places still tell clusters apart."""
    rng = np.random.default_rng(15)
    edges = [(600 * c + i, 600 * c + int(j), 1.0) for c in range(3) for i in range(200) for j in rng.integers(0, 200, 4) if i != j]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    xy = {r.id: (r.x, r.y) for r in linalg.layout(df, 120, landmarks=30, spread=8).collect()}
    assert len(xy) == len({n for a, b, _ in edges for n in (a, b)}) and all(x is not None for x, _ in xy.values())
    places = np.array([xy[i] for i in sorted(xy)])
    kinds = np.array([i // 600 for i in sorted(xy)])
    assert np.linalg.matrix_rank(places - places.mean(axis=0), tol=1e-3) == 2
    centre = np.array([places[kinds == k].mean(axis=0) for k in range(3)])
    nearest = ((places[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == kinds).mean() > 0.8
    lone = linalg.layout(spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0)], "src long, dst long, weight double"), 10, landmarks=1).collect()
    assert len(lone) == 5 and 0 < sum(r.x is not None for r in lone) < 5


def test_commands_for_starts_and_enrichment(spark, tmp_path):
    from cytoplane import cli

    at = lambda n: str(tmp_path / n)
    seq = "A" * 5 + "G" + "C" * 20
    rows = [("chr1", 100, 120, "+", "6S20M", seq, "cell", u) for u in ["ACGTACGT"] * 6 + ["ACGTACGA"] * 2]
    spark.createDataFrame(rows, "chrom string, pos long, end long, strand string, cigar string, seq string, barcode string, umi string").write.parquet(at("reads"))
    cli.main(["transcription-starts", at("reads"), at("starts")])
    assert [tuple(r) for r in spark.read.option("header", True).option("sep", "\t").csv(at("starts")).select("chrom", "start", "n").collect()] == [("chr1", "100", "1")]
    spark.createDataFrame([(f"g{i}", float(-i)) for i in range(60)], "gene_id string, score double").write.parquet(at("scores"))
    spark.createDataFrame([("first", f"g{i}") for i in range(5)], "pathway string, gene_id string").write.parquet(at("ways"))
    cli.main(["enrichment", at("scores"), at("ways"), at("out")])
    r = spark.read.option("header", True).option("sep", "\t").csv(at("out")).first()
    assert (r.pathway, float(r.es)) == ("first", 1.0) and 0 < float(r.p) < 1e-4


def test_rounds_leave_no_tables_behind(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: {p for p in os.listdir(folder) if not p.startswith(".")}
    before = held()
    e = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    assert {r.component for r in graph.components(e).collect()} == {0}
    assert len(held() - before) == 1


def test_segmented_cells(spark):
    from cytoplane.operators import spatial

    rows = [(7, [0.0, 0.0, 2.0, 2.0], [0.0, 3.0, 3.0, 0.0], "a"), (3, [0.0, 4.0, 0.0], [0.0, 0.0, 1.0], "b"), (5, None, [1.0], "c"), (9, [1.0, None, 2.0], [1.0, 2.0], "d")]
    df = spark.createDataFrame(rows, "id long, rows array<double>, cols array<double>, name string")
    got = {r.id: r for r in spatial.segmented_cells(df).collect()}
    assert {i: (r.name, r.area) for i, r in got.items()} == {3: ("ID_1", 2.0), 5: ("ID_2", 0.0), 7: ("ID_3", 6.0), 9: ("ID_4", 0.0)}
    assert [(p.x, p.y) for p in got[3].points] == [(0, 0), (0, 4), (1, 0)] and [(p.x, p.y) for p in got[9].points] == [(1, 1)]
    assert spatial.segmented_cells(df.limit(0)).count() == 0


# ---- densities


def test_densities_agree_with_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 900), rng.normal(6, 0.5, 300), [40.0]])
    y = np.concatenate([x[:900] * 0.8 + rng.normal(0, 0.4, 900), rng.normal(-3, 1, 300), [-30.0]])
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None), (float("nan"), 2.0)]
    got = linalg.kde_grid(spark.createDataFrame(rows, "x double, y double"), 25).collect()
    assert {(r.i, r.j) for r in got} == set(itertools.product(range(25), repeat=2))
    c = np.cov(x, y) * len(x) ** (-1 / 3)
    inv, peak = np.linalg.inv(c), 1 / (2 * np.pi * np.sqrt(np.linalg.det(c)))
    for r in got:
        d = np.stack([r.gx - x, r.gy - y])
        assert r.density == pytest.approx(np.exp(-0.5 * np.einsum("in,ij,jn->n", d, inv, d)).mean() * peak, abs=1e-8 * peak)


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], [(None, None)]])
def test_densities_without_spread_are_null(spark, rows):
    got = linalg.kde_grid(spark.createDataFrame(rows, "x double, y double"), 3).collect()
    assert len(got) == 9 and all(r.density is None for r in got)


def test_densities_meet_points_by_tiles_only(spark):
    p = spark.range(1000).select(F.sin("id").alias("x"), F.cos(F.col("id") * 2).alias("y"))
    plan = linalg.kde_grid(p, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin") <= 2  # the grid's own axes, twice read


# ---- micro-clusters


def test_micro_clusters_hold_all_points_and_near_ones(spark):
    a, b = cloud(spark, 900, groups=12, seed=4), cloud(spark, 400, groups=3, seed=5, repeats=50)
    p = a.withColumn("path", F.lit("0")).unionByName(b.withColumn("path", F.lit("1")))
    same = spark.createDataFrame([(f"s{i}", [0.0] * 7 + [1.0], "2") for i in range(40)] + [(f"z{i}", [0.0] * 8, "3") for i in range(5)], "id string, vec array<double>, path string")
    placed, centres = clustering.micro_clusters(p.unionByName(same), 48)
    vec = {(r.path, r.id): clustering.unit_rows(np.array([r.vec]))[0] for r in p.unionByName(same).collect()}
    groups = collections.defaultdict(list)
    for r in placed.collect():
        groups[r.path, r.node].append(vec.pop((r.path, r.id)))
    assert not vec
    got = {(r.path, r.node): (r.n, np.array(r.vec)) for r in centres.collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.mean(v, axis=0))
    per = collections.Counter(k[0] for k in got)
    assert per == {"0": 48, "1": 48, "2": 1, "3": 1}
    for path in "01":
        x = np.concatenate([v for k, v in groups.items() if k[0] == path])
        inner = sum(((np.array(v) - np.mean(v, axis=0)) ** 2).sum() for k, v in groups.items() if k[0] == path)
        assert inner < 0.4 * ((x - x.mean(0)) ** 2).sum()


def test_clusters_do_not_depend_on_the_size_switch_where_groups_are_apart(spark):
    rng = np.random.default_rng(8)
    c = np.linalg.qr(rng.normal(size=(12, 12)))[0] * 8
    rows = [(i, (c[i % 6] + (c[6 + i % 2] * 0.2) + rng.normal(size=12) * 0.3).tolist()) for i in range(600)]
    p = spark.createDataFrame(rows, "id long, vec array<double>")
    for exact in (4000, 200):
        got = {r.id: r.level0 for r in clustering.iterate(p, 1, exact=exact).collect()}
        assert len(got) == 600 and len(set(got.values())) == 6 and all(len({got[i] for i in range(600) if i % 6 == k}) == 1 for k in range(6))


# ---- mixtures


@pytest.mark.parametrize("kind", ["gaussian", "poisson", "gamma"])
def test_mixtures_fitted_in_spark_agree_with_those_fitted_in_a_task(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(g, float(x)) for g, far in (("a", 12), ("b", 30)) for x in np.concatenate([rng.poisson(3, 300), rng.poisson(far, 100)])]
    rows += [("one", 4.0)] * 5 + [("single", 1.0), ("mostly", 0.0)] + [("mostly", 2.0)] * 9 + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "t string, v double").where("v IS NULL OR isnan(v) OR v >= 0")
    got = {}
    for bins in (16_384, None):
        got[bins] = sorted(map(tuple, mixtures.two_components(df, ["t"], "v", kind, bins=bins).collect()), key=str)
    assert str(got[None]) == str(got[16_384]) and {r[-1] for r in got[None] if r[0] == "a" and r[1] is not None and r[1] == r[1]} == {0, 1}


def test_bins_change_few_calls(spark):
    """256 bins against all distinct values: calls differ only within a bin's width of the cut."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 4000), rng.normal(4, 1.2, 2000)])
    df = spark.createDataFrame([("g", float(v)) for v in x], "t string, v double")
    exact, rough = ({r.v: r.prediction for r in mixtures.two_components(df, ["t"], "v", bins=b).collect()} for b in (None, 256))
    off = [v for v in exact if exact[v] != rough[v]]
    assert len(off) < 6 and (not off or max(off) - min(off) <= (x.max() - x.min()) / 256)


# ---- spectra


def test_leading_vectors_agree_with_the_dense_ones(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((60, 60)) < 0.1, rng.normal(size=(60, 60)), 0)
    a = (a + a.T) / 2 + np.diag(rng.normal(size=60))
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(a[i, j])) for i in range(60) for j in range(60) if a[i, j] or i == j], "src string, dst string, weight double")
    got, w = spectra.leading(edges, 4, extra=20)
    want, v = np.linalg.eigh(a)
    order = np.argsort(-np.abs(want))[:4]
    assert w == pytest.approx(want[order], abs=1e-9)
    x = np.array([r.now for r in got.orderBy("id").collect()])
    assert np.abs((x * v[:, order]).sum(0)) == pytest.approx(np.ones(4), abs=1e-6)


def test_diffusion_on_all_neighbours_is_the_dense_one(spark):
    p = cloud(spark, 90, groups=5, seed=3)
    dense = {(r.id, r.component): r.value for r in linalg.diffusion(p, 0.5, 3).collect()}
    got = {(r.id, r.component): r.value for r in spectra.diffusion_on_neighbours(p, 0.5, 3, nearest=89).collect()}
    assert got.keys() == dense.keys() and all(got[k] == pytest.approx(dense[k], abs=1e-6) for k in dense)


def test_diffusion_of_few_points(spark):
    for n, parts in ((0, 0), (1, 0), (2, 1), (3, 2)):
        p = cloud(spark, 3, seed=3).orderBy("id").limit(n)
        assert spectra.diffusion_on_neighbours(p, 0.5, 5).count() == n * parts


def test_components_by_the_shorter_side(spark):
    """More genes than cells: the driver holds no vector of genes, and loadings are those of the covariance."""
    from cytoplane.model import from_tables
    from cytoplane.operators import components

    rng = np.random.default_rng(51)
    d = (rng.normal(size=(30, 3)) * [9, 6, 4]) @ rng.normal(size=(3, 200)) + rng.normal(size=(30, 200)) + 3
    d[29] = 0.0  # a cell without values
    x = spark.createDataFrame([(c, g, float(d[c, g])) for c in range(29) for g in range(200)], "cell_id long, gene_id long, value double")
    cells, genes = (spark.range(n).withColumnRenamed("id", f"{k}_id") for n, k in ((30, "cell"), (200, "gene")))
    m, made = from_tables(x, cells, genes), []

    class Watched(components.Rows):
        def __init__(self, *args, **kw):
            super().__init__(*args, **kw)
            made.append(len(self.columns))

    whole, held = components.Rows, linalg.components
    try:
        held.Rows = Watched
        load, ratios = linalg.pca(m, 3, square=50)
    finally:
        held.Rows = whole
    assert made == [29]
    w, v = np.linalg.eigh(np.cov(d.T))
    got = {(r.gene_id, r.pc): r.loading for r in load.collect()}
    assert len(got) == 600 and ratios == pytest.approx((w[::-1][:3] / w.sum()).tolist(), abs=1e-9)
    for pc, t in enumerate(linalg.flip(v[:, ::-1][:, :3]).T, 1):
        assert [got[g, pc] for g in range(200)] == pytest.approx(t.tolist(), abs=1e-6)


def test_first_components_of_groups_with_many_columns(spark):
    rng = np.random.default_rng(52)
    rows = [(g, f"{g}-{r}", c, float(v)) for g, n in (("a", 40), ("b", 25), ("c", 3)) for r in range(n) for c, v in enumerate(rng.normal(size=60) + 4 * (r % 3 == 0) * np.linspace(0, 1, 60)) if rng.random() < 0.7 or c == 0]
    x = spark.createDataFrame(rows, "g string, r string, c int, value double")
    want, got = ({(r.g, r.r): r.pc1 for r in linalg.first_component_by(x, "g", "r", "c", "value", square=n).collect()} for n in (100, 10))
    assert got.keys() == want.keys() and len(want) == 68
    for at, v in want.items():
        assert got[at] == pytest.approx(v, abs=1e-6)


def test_tasks_are_counted_by_the_rows_of_a_layer(spark, monkeypatch):
    from cytoplane import model
    from cytoplane.operators import differential, genome
    from cytoplane.sources import readers

    monkeypatch.setattr(model, "TASK_ROWS", 100)
    x = spark.range(6000).select((F.col("id") % 60).alias("cell_id"), F.floor(F.col("id") / 60).alias("gene_id"), (1 + F.pmod(F.hash("id"), F.lit(4))).cast("double").alias("value"))
    cells = spark.range(60).select(F.col("id").alias("cell_id"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("covariate"))
    genes = spark.range(100).select(F.col("id").alias("gene_id"), F.lit("g").alias("gene"), F.lit("t").alias("type"), F.lit("1").alias("contig"), F.col("id").alias("start"))
    plain, m = model.from_tables(x, cells, genes), model.from_tables(x, cells, genes, 6000)
    made = {
        "rank_sum": lambda a: differential.rank_sum(a, differential.sides_of(a.cells, "kind", ["1"]), with_p=False),
        "siblings": lambda a: differential.sibling_rank_sum(a, "kind", with_p=False),
        "spearman": lambda a: differential.spearman(a, a.cells, with_p=False),
        "windows": lambda a: genome.windowed_expression(a, 20, 10, 3),
        "features": lambda a: readers.feature_matrix(a.x, genes, exclude_types=["none"], rows=a.attrs.get("rows")).x,
    }
    for name, run in made.items():
        got, want = run(m), run(plain)
        places = got.select(F.spark_partition_id().alias("p")).distinct().count()
        assert places > 20 or name == "windows" and places > 5, name
        key = lambda r: str(r[:3])
        for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            assert all(u == v or abs(u - v) < 1e-9 for u, v in zip(a, b)), name


def test_neighbour_descent_shuffles_floats_as_floats(spark, monkeypatch):
    """With the same neighbours and distances as for doubles."""
    p = cloud(spark, 200).withColumn("vec", F.col("vec").cast("array<float>"))
    seen, inner = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df: seen.append(df.schema) or inner(df))
    got = {tuple(r) for r in neighbours.neighbour_descent(p, 5).collect()}
    assert seen[0]["vec"].dataType.simpleString() == "array<float>"
    assert got == {tuple(r) for r in neighbours.neighbour_descent(p.withColumn("vec", F.col("vec").cast("array<double>")), 5).collect()}


# ---- one packed graph for all neighbour numbers


def test_packed_communities_are_those_of_edges(spark, monkeypatch):
    rng = np.random.default_rng(23)
    x = np.repeat(rng.normal(size=(6, 8)), 50, axis=0) + 0.5 * rng.normal(size=(300, 8))
    x[7], x[9] = x[5], x[5]
    p = spark.createDataFrame([(1000 - 3 * i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    points = moves.numbered(p)
    packed = moves.packed_graph(points, 64, strip=100)
    near = graph.nearest(p, 64, include_self=True).cache()
    for k in (2, 9):
        edges = near.where(F.col("rank") <= k).select("src", "dst", F.lit(1.0).alias("weight"))
        want = {r.node: r.community for r in graph.communities(edges).collect()}
        ids = {r.i: r.id for r in points.collect()}
        got = moves.communities(packed, 300, k)
        assert {ids[i]: ids[int(c)] for i, c in enumerate(got) if c >= 0} == want
    monkeypatch.setattr(graph, "nearest", None)  # the search shuffles no row a tie
    k, s = clustering.best_neighbours(p, middle=8, most=16, rounds=1)
    assert 2 <= k <= 16 and -1 <= s <= 1 and clustering.neighbour_communities(p, k, near=near.select("src", "dst", "rank"))[1] == pytest.approx(s, abs=1e-9)


def test_diffusion_starts_from_the_vectors(spark, monkeypatch):
    x = np.random.default_rng(31).normal(size=(300, 16))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    made, times = [], linalg._Kernel.times
    monkeypatch.setattr(linalg._Kernel, "times", lambda self, v: made.append(v.shape[1]) or times(self, v))
    got = {(r.id, r.component): r.value for r in linalg.diffusion(p, 0.5, 2, limit=100, blocks=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    kernel = np.exp(-(1 - u @ u.T) / 0.5)
    d = kernel.sum(axis=0)
    w, v = np.linalg.eigh(kernel / np.sqrt(np.outer(d, d)))
    for c in (1, 2):
        want = np.sqrt(d) * v[:, -1 - c]
        want *= w[-1 - c] ** 2 / np.linalg.norm(want)
        own = np.array([got[i, c] for i in range(300)])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-7
    assert len(made) < 20


def test_standardized_zeros_take_no_disk(spark, tmp_path):
    cells = spark.createDataFrame([(1000 + i,) for i in range(300)], "cell_id long")
    genes = spark.createDataFrame([(5000 + 7 * i,) for i in range(2000)], "gene_id long")
    x = spark.createDataFrame([(1000 + i % 300, 5000 + 7 * (i * 37 % 2000), float(i % 11)) for i in range(3000)], "cell_id long, gene_id long, value double")
    m = from_tables(x, cells, genes)
    for axis in ("gene", "cell"):
        dense = layers.standardize(m, axis, out="s", digits=6).layers["s"]
        dense.write.parquet(str(tmp_path / axis))
        assert spark.read.parquet(str(tmp_path / axis)).agg(F.count_distinct("cell_id", "gene_id")).first()[0] == 600_000
        assert sum(f.stat().st_size for f in (tmp_path / axis).glob("*.parquet")) < 600_000  # under a byte a row
