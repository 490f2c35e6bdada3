"""Module scores, cell-cycle angles and gene-set enrichment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.functions.scalars import angle_degrees
from cytoplane.model import AnnotatedMatrix
from cytoplane.operators.graph import written
from cytoplane.operators.layers import global_zscore
from cytoplane.operators.windows import bh_adjust, enrichment_score, quantile_bins, running_total


def set_means(m: AnnotatedMatrix, sets: DataFrame, layer: str = "") -> DataFrame:
    """(cell_id, name, mean) of gene sets (name, gene_id) over all their genes, for every cell."""
    size = sets.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    s = m.layers[layer].join(sets, "gene_id").groupBy("cell_id", "name").agg(F.sum("value").alias("s"))
    return m.cells.select("cell_id").crossJoin(F.broadcast(size)).join(s, ["cell_id", "name"], "left").select("cell_id", "name", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))


def control_genes(m: AnnotatedMatrix, signature: DataFrame, layer: str = "", bins: int = 10, controls: int = 5, seed: int = 0, cells: DataFrame | None = None) -> DataFrame:
    """gene_id of controls: for each of the signature's genes ``controls`` others of its bin of mean expression, without
    replacement, in the order of a hash (md5 of seed and gene), so that reruns and other engines agree."""
    cells = m.cells if cells is None else cells
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    sums = m.layers[layer].join(cells.select("cell_id"), "cell_id", "left_semi").groupBy("gene_id").agg(F.sum("value").alias("s"))
    means = m.genes.select("gene_id").join(sums, "gene_id", "left").crossJoin(F.broadcast(n)).select("gene_id", F.try_divide(F.coalesce("s", F.lit(0.0)), "n").alias("mean"))
    binned = quantile_bins(means, "mean", bins, few=True).join(signature.select("gene_id", F.lit(True).alias("own")), "gene_id", "left")
    wanted = binned.where("own").groupBy("bin").agg((F.count(F.lit(1)) * controls).alias("k"))
    order = F.row_number().over(Window.partitionBy("bin").orderBy(F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col("gene_id").cast("string")))))
    return binned.where("own IS NULL").withColumn("rn", order).join(wanted, "bin").where("rn <= k").select("gene_id")


def module_score(m: AnnotatedMatrix, signature: DataFrame, layer: str = "", bins: int = 10, controls: int = 5, seed: int = 0, cells: DataFrame | None = None, omit_control: bool = False) -> DataFrame:
    """(cell_id, score): mean of the signature minus mean of its controls; null for cells not in ``cells``."""
    sets = signature.select(F.lit("s").alias("name"), "gene_id")
    if not omit_control:
        sets = sets.unionByName(control_genes(m, signature, layer, bins, controls, seed, cells).select(F.lit("c").alias("name"), "gene_id"))
    s = set_means(m, sets, layer).groupBy("cell_id").agg((F.max(F.when(F.col("name") == "s", F.col("mean"))) - F.coalesce(F.max(F.when(F.col("name") == "c", F.col("mean"))), F.lit(0.0))).alias("score"))
    return s if cells is None else m.cells.select("cell_id").join(s.join(cells.select("cell_id"), "cell_id", "left_semi"), "cell_id", "left")


def cell_cycle_angle(m: AnnotatedMatrix, g1s: DataFrame, g2m: DataFrame, layer: str = "", origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(cell_id, g1s, g2m, angle): standard scores of the two gene sets' means and their angle in degrees about origin."""
    sets = g1s.select(F.lit("g1s").alias("name"), "gene_id").unionByName(g2m.select(F.lit("g2m").alias("name"), "gene_id"))
    w = set_means(m, sets, layer).groupBy("cell_id").agg(*[F.max(F.when(F.col("name") == k, F.col("mean"))).alias(k) for k in ("g1s", "g2m")])
    w = global_zscore(global_zscore(w, "g1s", "g1s_z"), "g2m", "g2m_z")
    w = w.select("cell_id", F.col("g1s_z").alias("g1s"), F.col("g2m_z").alias("g2m"))
    return w.withColumn("angle", angle_degrees(F.col("g2m") - origin[1], F.col("g1s") - origin[0]))


def ranked_hits(scores: DataFrame, geneset: DataFrame, score: str = "score") -> DataFrame:
    """(gene_id, rank, hit): genes by descending score (ties by gene) and whether the set has them. Raises if none is."""
    down = scores.select("gene_id", (-F.col(score)).alias("__down"), F.lit(1).alias("__one"))
    r = running_total(down, ["__down", "gene_id"], "__one", "rank").select("gene_id", F.col("rank").cast("int").alias("rank"))
    return r.join(geneset.select("gene_id", F.lit(True).alias("hit")).distinct(), "gene_id", "left").select("gene_id", "rank", F.coalesce("hit", F.lit(False)).alias("hit"))


def gsea(scores: DataFrame, geneset: DataFrame, permutations: int = 1000, seed: int = 0, score: str = "score") -> DataFrame:
    """One row (es, p): the enrichment score and the fraction of permutations with a larger one in size.

    A permutation is an order of the genes by md5 of seed, permutation and gene; each is one group, so permutations run in parallel and repeatably.
    """
    r = written(ranked_hits(scores, geneset, score))
    es = enrichment_score(r, "rank", "hit")
    size = r.agg(F.count_if("hit").alias("k"), F.count_if(~F.col("hit")).alias("others"))
    perms = scores.sparkSession.range(permutations).withColumnRenamed("id", "perm")
    # The running score is farthest from 0 at a gene of the set or just before it: one sort an order tells the ranks of these.
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("gene_id").cast("string")))
    shuffled = perms.crossJoin(r.select("gene_id", "hit")).select("perm", "hit", key.alias("key"))
    upto = Window.partitionBy("perm").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = shuffled.withColumn("h", F.count_if("hit").over(upto)).withColumn("o", F.count_if(~F.col("hit")).over(upto)).where("hit").crossJoin(F.broadcast(size))
    other = F.coalesce(F.try_divide("o", "others"), F.lit(0.0))
    null = met.groupBy("perm").agg(F.max(F.greatest(F.abs(F.col("h") / F.col("k") - other), F.abs((F.col("h") - 1) / F.col("k") - other))).alias("top"))
    return es.crossJoin(null).groupBy("es").agg(F.avg((F.abs("es") < F.col("top")).cast("double")).alias("p"))


def largest_deviation(hits: np.ndarray, n: int, steps: np.ndarray | None = None) -> np.ndarray:
    """The greatest value of the running score of each row of ``hits`` (sorted ranks from 0 of a set's genes among n): the
    share of the set's weight met so far less the share of the other genes. The extremes lie at hits. steps: weights by
    rank, equal by default."""
    size = hits.shape[1]
    weight = np.ones(hits.shape) if steps is None else steps[hits]
    upto = np.cumsum(weight, axis=1)
    return (upto / np.maximum(upto[:, -1:], 1e-300) - (hits - np.arange(size)) / max(1, n - size)).max(axis=1)


def small_p(score: float, size: int, n: int, steps: np.ndarray | None = None, sets: int = 200, mixed: float = 1.0, least: float = 1e-50, seed: int = 0) -> tuple[float, float]:
    """(p, error): the chance that a random set of ``size`` of n ranked genes reaches ``score`` or more, by adaptive
    multilevel splitting; error is the standard deviation of log2 p.

    A level's threshold is the median score of ``sets`` random sets. Those under it are replaced by copies of those that
    reach it, and each copy is drawn anew on that condition: some of its genes are swapped for others, and a swap stays if the
    set still reaches the threshold, until each gene has been swapped ``mixed`` times on average. Each level halves the chance; the share that reaches ``score`` itself ends it.
    """
    rng = np.random.default_rng(seed)
    if not 0 < size < n:
        return 1.0, 0.0
    now = np.argsort(rng.random((sets, n)), axis=1)[:, :size] if n * sets <= 1 << 24 else np.stack([rng.choice(n, size, replace=False) for _ in range(sets)])
    now = np.sort(now, axis=1)
    value = largest_deviation(now, n, steps)
    logp, spread = 0.0, 0.0
    while True:
        done = (value >= score - 1e-12).sum()
        if 2 * done >= sets:
            share = done / sets
            return float(np.exp(logp) * share), float(np.sqrt(spread + (1 - share) / done) / np.log(2))
        bar = np.sort(value)[sets // 2]
        more = value[value > value.min() + 1e-12]
        if not len(more):
            return float(np.exp(logp) * done / sets), float("inf")  # all sets score alike, and under it
        bar = max(bar, more.min())  # where over half of them share the least score, those above it go on
        keep = value >= bar - 1e-12
        share = keep.mean()
        logp, spread = logp + np.log(share), spread + (1 - share) / keep.sum()
        if logp < np.log(least):
            return float(least), float("inf")
        alive = np.flatnonzero(keep)
        now[~keep] = now[rng.choice(alive, sets - len(alive))]
        value = largest_deviation(now, n, steps)
        swaps, moved, tried = max(1, size // 4), 0.0, 0
        while moved < mixed * size and tried < 40 * mixed * size:  # so many genes of a set are others, on average
            new, rows, changed = now.copy(), np.arange(sets), np.zeros(sets)
            for _ in range(swaps):
                out, into = rng.integers(0, size, sets), rng.integers(0, n, sets)
                free = ~(new == into[:, None]).any(axis=1)
                new[rows, out] = np.where(free, into, new[rows, out])
                changed += free
            new.sort(axis=1)
            reached = largest_deviation(new, n, steps)
            ok = reached >= bar - 1e-12
            now[ok], value[ok] = new[ok], reached[ok]
            moved, tried = moved + float((ok * changed).mean()), tried + 1
            swaps = max(1, swaps // 2) if ok.mean() < 0.3 else min(size, swaps + 1) if ok.mean() > 0.7 else swaps


def exact_p(score: float, size: int, n: int) -> float:
    """The chance that a random set of ``size`` of n ranked genes, all of one weight, reaches ``score`` or more: exact to some
    nine digits, also where it is far below 1e-100.

    Genes are drawn rank by rank; a place holds the chance of so many hits without having reached the score. Places from where
    the score is reached with under 1e-14 of the whole chance are left out, so work is n times the square root of size.
    """
    if not 0 < size < n:
        return 1.0
    miss, drawn = n - size, np.arange(n + 1)
    reached = lambda i: i / size - (drawn - i) / miss >= score - 1e-12
    bar = np.ceil((score - 1e-12 + drawn / miss) * (size * miss / n)).astype(np.int64)  # the fewest hits that reach it
    bar = np.where(reached(bar - 1), bar - 1, np.where(reached(bar), bar, bar + 1))
    deep = 4.2 * np.sqrt(size * miss / n) + 2
    lows = np.clip(np.floor(drawn * (size / n) - deep), 0, size).astype(np.int64).tolist()
    bar = np.clip(bar, 1, size + 1).tolist()
    g, left, p, high = np.zeros(size + 2), (size - np.arange(size + 2)).clip(0).astype(float), 0.0, 1
    g[0] = 1.0
    for t in range(n):
        low = lows[t]
        hit = left[low:high] * (1 / (n - t))
        hit *= g[low:high]
        g[low:high] -= hit
        g[low + 1 : high + 1] += hit
        if high < bar[t + 1]:
            high += 1
        else:
            p, g[high] = p + g[high], 0.0
    return float(min(1.0, p))


def _ranked(scores: DataFrame, pathways: DataFrame, score: str, weight: float, most: int) -> tuple[DataFrame, int, np.ndarray | None]:
    """((pathway, size, es), number of genes, weights by rank or None for all alike)."""
    s = scores.where(F.col(score).isNotNull()).groupBy("gene_id").agg(F.max(score).alias("s"))
    down = s.withColumn("__down", -F.col("s")).withColumn("__one", F.lit(1))
    r = running_total(down, ["__down", "gene_id"], "__one", "rank").select("gene_id", "s", (F.col("rank") - 1).cast("long").alias("rank"))
    r = written(r)
    n = r.count()
    up = steps = None
    if weight:
        if n > most:
            raise ValueError(f"over {most} genes")
        steps = np.array([x["w"] for x in r.orderBy("rank").select((F.abs("s") ** weight).alias("w")).collect()])
        up = steps[::-1].copy()
    own = pathways.select("pathway", "gene_id").distinct().join(r, "gene_id").groupBy("pathway").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))

    def extremes(pdf: pd.Series) -> pd.DataFrame:
        rows = []
        for x in pdf:
            hits = np.asarray(x)[None]
            high, low = float(largest_deviation(hits, n, steps)[0]), float(largest_deviation(n - 1 - hits[:, ::-1], n, up)[0])
            rows.append((len(x), 0.0 if len(x) == n else high if high >= low else -low))
        return pd.DataFrame(rows, columns=["size", "es"])

    return own.withColumn("x", F.pandas_udf(extremes, "size long, es double")("ranks")).select("pathway", "x.size", "x.es"), n, steps


def running_scores(scores: DataFrame, pathways: DataFrame, score: str = "score", weight: float = 0.0, most: int = 1 << 20) -> DataFrame:
    """(pathway, size, es) of ``enrichment``, without the random sets that its p needs."""
    return _ranked(scores, pathways, score, weight, most)[0]


def enrichment(scores: DataFrame, pathways: DataFrame, score: str = "score", weight: float = 0.0, chains: int = 4, sets: int = 200, most: int = 1 << 20, seed: int = 0, held: int = 1 << 20) -> DataFrame:
    """(pathway, size, es, p, log2err, q) for each pathway (pathway, gene_id) with a scored gene: the running score farthest
    from 0, and the chance that a random set of as many genes, among those whose score goes the same way, goes as far; q
    by Benjamini and Hochberg. Small p are real ones, not the 0 that permutations give.

    weight: the power of the absolute score by which a gene counts, 0 for all alike. Ranks are global ones, dealt by
    ranges; a pathway's score follows from the ranks of its own genes, so no pathway meets the whole list. The chance to
    go as far is exact for genes all alike (``exact_p``, log2err 0) and by ``chains`` runs of ``small_p`` with weights; the
    share that goes the same way is that of 512 random sets a chain, ``held`` ranks at a time. A task needs only the size and
    the score (with weights also the list of them, which is why it may hold no more than ``most`` genes; more raise).
    Null scores are left out, ties go by gene, and a pathway of all genes has es 0 and p 1.
    """
    scored, n, steps = _ranked(scores, pathways, score, weight, most)
    scored, up = written(scored), None if steps is None else steps[::-1].copy()

    def same_way(size: int, es: float, one: int) -> float:
        """The share of sets whose score goes this way: the other extreme of each is the same one from below."""
        few, found = max(1, held // max(1, size)), 0
        if n * 512 <= 1 << 24:
            drawn = iter([np.sort(np.argsort(np.random.default_rng(one + 1).random((512, n)), axis=1)[:, :size], axis=1)])
        else:
            drawn = (np.sort(np.stack([np.random.default_rng(one * 512 + i).choice(n, size, replace=False) for i in range(s, min(s + few, 512))]), axis=1) for s in range(0, 512, few))
        for ways in drawn:
            a, b = largest_deviation(ways, n, steps), largest_deviation(n - 1 - ways[:, ::-1], n, up)
            found += int((a >= b).sum() if es >= 0 else (b > a).sum())
        return found / 512

    def chain(batches):
        for pdf in batches:
            rows = []
            for name, size, es, c in zip(pdf["pathway"], pdf["size"], pdf["es"], pdf["chain"]):
                one = seed * 1009 + int(c)
                p, error = (None if es and c >= 0 else 1.0), 0.0
                if es and steps is not None:
                    p, error = small_p(abs(es), int(size), n, steps if es >= 0 else up, sets, seed=one)
                elif es and c < 0:
                    p = exact_p(abs(es), int(size), n)
                same = None if c < 0 else max(same_way(int(size), es, one), 1 / 512) if es else 1.0
                rows.append((name, p, same, error))
            yield pd.DataFrame(rows, columns=["pathway", "p", "same", "error"]).astype({"p": float, "same": float})

    kind = pathways.schema["pathway"].dataType.simpleString()
    # Where p is exact, one task of a pathway more (-1) has it, and chains only draw sets.
    dealt = scored.withColumn("chain", F.explode(F.sequence(F.lit(0 if weight else -1), F.lit(chains - 1))))
    dealt = dealt.repartition(scored.count() * (chains + 1) or 1, "pathway", "chain")
    tried = dealt.mapInPandas(chain, f"pathway {kind}, p double, same double, error double")
    known = lambda c: F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c)
    tried = tried.groupBy("pathway").agg(known("p"), known("same"), (F.sqrt(F.avg(F.col("error") ** 2) / chains)).alias("log2err"))
    out = scored.join(tried, "pathway").withColumn("p", F.least(F.lit(1.0), F.col("p") / F.col("same")))
    return bh_adjust(out, "p", "q").select("pathway", "size", "es", "p", "log2err", "q")
