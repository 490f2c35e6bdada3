"""Differential expression: rank-sum tests with implicit zeros, correlations, replicate-level tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.functions import pvalues
from cytoplane.model import AnnotatedMatrix
from cytoplane.operators.graph import written
from cytoplane.operators.windows import bh_adjust, global_ranks, top_k


def sides_of(cells: DataFrame, level: str, ident1: list[str], ident2: list[str] | None = None, comparison: str = "") -> DataFrame:
    """(comparison, cell_id, side): ident1 is side 1; side 2 is ident2, or the siblings of ident1 (same parent path; all
    others for paths of one part). Identities without a common parent raise."""
    parents = {"-".join(i.split("-")[:-1]) for i in ident1}
    if len(parents) != 1:
        raise ValueError("the identities have different parents")
    c = F.col(level)
    parent = parents.pop()
    second = c.isin(*ident2) if ident2 else ~c.isin(*ident1) & (c.startswith(parent + "-") if parent else F.lit(True))
    side = F.when(c.isin(*ident1), 1).when(second, 2)
    return cells.withColumn("side", side).where("side IS NOT NULL").select(F.lit(comparison or "+".join(ident1)).alias("comparison"), "cell_id", "side")


def one_vs_siblings(cells: DataFrame, level: str) -> DataFrame:
    """(comparison, cell_id, side) for every cluster of a level against its siblings, as one table for one job."""
    c = cells.where(F.col(level).isNotNull()).select("cell_id", F.col(level).alias("own"))
    up = F.when(F.contains("own", F.lit("-")), F.regexp_replace("own", "-[^-]*$", "")).otherwise("")
    c = c.withColumn("up", up)
    names = c.select("up", F.col("own").alias("comparison")).distinct()
    return c.join(names, "up").select("comparison", "cell_id", F.when(F.col("own") == F.col("comparison"), 1).otherwise(2).alias("side"))


def _side_sums(k, w: int) -> list:
    """Sums of a side's counts k of distinct values: non-zeros, values, powers of two, positives."""
    v = F.col("value")
    return [F.sum(k).alias(f"nz{w}"), F.sum(k * v).alias(f"s{w}"), F.sum(k * F.pow(F.lit(2.0), v)).alias(f"e{w}"), F.sum(F.when(v > 0, k).otherwise(0)).alias(f"pos{w}")]


def _effects(g: DataFrame, with_p: bool) -> DataFrame:
    """Statistics of rank sums: g has comparison, gene_id, n1, n2, r (rank sum of side 1's non-zeros, ranks among non-zeros),
    t (sum of c^3 - c over distinct non-zero values), flat1 and flat2 (one value on that side), and the sums of both sides."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    zero = total - F.col("nz1") - F.col("nz2")
    r1 = F.col("r") + F.col("nz1") * zero + (n1 - F.col("nz1")) * (zero + 1) / 2
    g = g.withColumn("ties", F.col("t") + zero * zero * zero - zero).withColumn("u", r1 - n1 * (n1 + 1) / 2).withColumn("flat", F.col("flat1") & F.col("flat2"))
    sigma = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    z = F.try_divide(F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5, sigma)
    exp = lambda w, k: (F.col(f"e{w}") + k - F.col(f"nz{w}")) / k
    out = g.select(
        "comparison", "gene_id", "n1", "n2", "u", "ties", "flat", F.when(~F.col("flat"), z).alias("z"),
        F.when(~F.col("flat"), F.col("u") / (n1 * n2)).alias("CommonLanguageEffectSize"),
        (F.col("s1") / n1).alias("MeanExpr1"), (F.col("s2") / n2).alias("MeanExpr2"), exp(1, n1).alias("MeanExpExpr1"), exp(2, n2).alias("MeanExpExpr2"),
        (F.log2(exp(1, n1)) - F.log2(exp(2, n2))).alias("Log2FoldChange"), (F.col("pos1") / n1).alias("FracExpr1"), (F.col("pos2") / n2).alias("FracExpr2"),
    )
    if with_p:
        out = out.withColumn("p", F.when(F.col("flat"), 1.0).otherwise(pvalues.u_test_udf("u", "n1", "n2", "ties")))
    return out.drop("ties", "flat")


def rank_sum(m: AnnotatedMatrix, sides: DataFrame, layer: str = "", smallest: int = 1, with_p: bool = True) -> DataFrame:
    """Mann-Whitney per comparison and gene of a non-negative layer, zeros included as one tie block.

    comparison, gene_id, u, z, CommonLanguageEffectSize, MeanExpr1/2, MeanExpExpr1/2, Log2FoldChange, FracExpr1/2 and,
    with_p, p. Genes constant on both sides have p 1 and no effect size. Comparisons with a side under ``smallest`` cells
    are left out. Values are first counted per distinct value, so a shuffle carries one row per value and gene at most.
    """
    n = sides.groupBy("comparison").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2")).where(F.least("n1", "n2") >= smallest)
    x = m.dealt(m.layers[layer].where("value <> 0").join(sides, "cell_id"), "gene_id")
    count = lambda side: F.count_if(F.col("side") == side).cast("double")
    per = x.groupBy("comparison", "gene_id", "value").agg(count(1).alias("c1"), count(2).alias("c2")).withColumn("c", F.col("c1") + F.col("c2"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("comparison", "gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = per.withColumn("rank", before + (F.col("c") + 1) / 2)
    v, c1, c2, c = (F.col(k) for k in ("value", "c1", "c2", "c"))
    ends = [f(F.when(k > 0, v)).alias(f"{name}{w}") for w, k in ((1, c1), (2, c2)) for name, f in (("lo", F.min), ("hi", F.max))]
    g = ranked.groupBy("comparison", "gene_id").agg(F.sum(c1 * F.col("rank")).alias("r"), F.sum(c * c * c - c).alias("t"), *_side_sums(c1, 1), *_side_sums(c2, 2), *ends).join(n, "comparison")
    flat = lambda w: (F.col(f"nz{w}") == 0) | ((F.col(f"nz{w}") == F.col(f"n{w}")) & (F.col(f"lo{w}") == F.col(f"hi{w}")))
    return _effects(g.withColumn("flat1", flat(1)).withColumn("flat2", flat(2)), with_p)


def sibling_rank_sum(m: AnnotatedMatrix, level: str, layer: str = "", smallest: int = 1, with_p: bool = True) -> DataFrame:
    """rank_sum of every cluster of a level against its siblings together.

    Cells are counted once per gene, distinct value and cluster; ranks among all siblings are the same for each of them,
    and the other side's sums are the siblings' less the cluster's own, so rows don't grow with the number of siblings.
    """
    c = F.col(level)
    up = F.when(F.contains(c, F.lit("-")), F.regexp_replace(c, "-[^-]*$", "")).otherwise("")
    own = m.cells.where(c.isNotNull()).select("cell_id", c.alias("comparison"), up.alias("up"))
    names = own.groupBy("up", "comparison").agg(F.count(F.lit(1)).alias("n1"))
    names = names.withColumn("n2", F.sum("n1").over(Window.partitionBy("up")) - F.col("n1")).where(F.least("n1", "n2") >= smallest)
    x = m.dealt(m.layers[layer].where("value <> 0").join(own, "cell_id"), "gene_id")
    per = x.groupBy("up", "gene_id", "value", "comparison").agg(F.count(F.lit(1)).cast("double").alias("c1"))
    gene = Window.partitionBy("up", "gene_id")
    per = per.withColumn("c", F.sum("c1").over(Window.partitionBy("up", "gene_id", "value"))).withColumn("upto", F.sum("c1").over(gene.orderBy("value")))
    c1, k = F.col("c1"), F.col("c")
    ranked = per.withColumn("rank", F.col("upto") - k + (k + 1) / 2)
    mine = ranked.groupBy("up", "gene_id", "comparison").agg(F.sum(c1 * F.col("rank")).alias("r"), F.count(F.lit(1)).alias("kinds"), F.count_if(c1 == k).alias("alone"), *_side_sums(c1, 1))
    whole = ranked.groupBy("up", "gene_id").agg(F.sum(c1 * (k * k - 1)).alias("t"), F.round(F.sum(c1 / k)).alias("all_kinds"), *_side_sums(c1, 0))
    g = whole.join(names, "up").join(mine, ["up", "gene_id", "comparison"], "left").na.fill(0, ["r", "kinds", "alone", "nz1", "s1", "e1", "pos1"])
    g = g.withColumn("nz2", F.col("nz0") - F.col("nz1"))
    g = g.withColumns({f"{s}2": F.when(F.col("nz2") == 0, 0.0).otherwise(F.col(f"{s}0") - F.col(f"{s}1")) for s in ("s", "e", "pos")})
    flat = lambda w, kinds: (F.col(f"nz{w}") == 0) | ((F.col(f"nz{w}") == F.col(f"n{w}")) & (kinds == 1))
    return _effects(g.withColumn("flat1", flat(1, F.col("kinds"))).withColumn("flat2", flat(2, F.col("all_kinds") - F.col("alone"))), with_p)


def differential_expression(m: AnnotatedMatrix, sides: DataFrame, layer: str = "", smallest: int = 1) -> DataFrame:
    """rank_sum plus BenjaminiHochbergQ within each comparison."""
    return bh_adjust(rank_sum(m, sides, layer, smallest), "p", "BenjaminiHochbergQ", ["comparison"])


def markers(m: AnnotatedMatrix, level: str, layer: str = "", k: int = 500, smallest: int = 1) -> DataFrame:
    """For each cluster against its siblings, the first k genes higher in it, by effect size (ties by gene)."""
    d = bh_adjust(sibling_rank_sum(m, level, layer, smallest), "p", "BenjaminiHochbergQ", ["comparison"]).where("MeanExpr1 > MeanExpr2")
    return top_k(d, ["comparison"], [F.desc_nulls_last("CommonLanguageEffectSize"), F.col("gene_id")], k)


def spearman(m: AnnotatedMatrix, covariate: DataFrame, layer: str = "", col: str = "covariate", with_p: bool = True) -> DataFrame:
    """(gene_id, rho[, p]) of a non-negative layer with a cell covariate (cell_id, col); constant genes have rho 0 and p 1.

    Ranks of the covariate are one column of cells; zeros of a gene are one tie block, so nothing is made dense.
    """
    y = covariate.where(F.col(col).isNotNull()).select("cell_id", F.col(col).alias("y"))
    y = y.join(global_ranks(y, "y", "ry").drop("count"), "y").select("cell_id", "ry")
    stats = y.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("ry").alias("sy"), F.sum(F.col("ry") ** 2).alias("syy"))
    x = m.dealt(m.layers[layer].where("value <> 0").join(y, "cell_id"), "gene_id")
    per = x.groupBy("gene_id", "value").agg(F.count(F.lit(1)).alias("c"), F.sum("ry").alias("ry"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = per.withColumn("r", before + (F.col("c") + 1) / 2).groupBy("gene_id").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("r")).alias("a"), F.sum(F.col("c") * F.col("r") ** 2).alias("b"), F.sum(F.col("r") * F.col("ry")).alias("d"), F.sum("ry").alias("e")).crossJoin(F.broadcast(stats))
    z, k, n = F.col("n") - F.col("k"), F.col("k"), F.col("n")
    mid = (z + 1) / 2
    sx = F.col("a") + k * z + z * mid
    sxx = F.col("b") + 2 * z * F.col("a") + k * z * z + z * mid * mid
    sxy = F.col("d") + z * F.col("e") + mid * (F.col("sy") - F.col("e"))
    num, vx, vy = n * sxy - sx * F.col("sy"), n * sxx - sx**2, n * F.col("syy") - F.col("sy") ** 2
    out = g.select("gene_id", "n", F.coalesce(F.try_divide(num, F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy))), F.lit(0.0)).alias("rho"), (vx > 0).alias("varies"))
    if with_p:
        t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, F.greatest(1 - F.col("rho") ** 2, F.lit(1e-300))))
        out = out.withColumn("p", F.when(F.col("varies"), pvalues.t_two_sided_udf(t, F.col("n") - 2)).otherwise(1.0))
    return out.drop("n", "varies")


def kendall_by(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, tau, p): tau-b of two columns within each group, groups being of the size of a cell or a gene."""
    import pandas as pd

    def one(key, pdf):
        tau, p = pvalues.kendall(pdf[x].to_numpy(float), pdf[y].to_numpy(float))
        return pd.DataFrame({by: [key[0]], "tau": [tau], "p": [p]})

    kind = df.schema[by].dataType.simpleString()
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, x, y).groupBy(by).applyInPandas(one, f"{by} {kind}, tau double, p double")
    return out.select(by, F.nanvl("tau", F.lit(None).cast("double")).alias("tau"), F.nanvl("p", F.lit(None).cast("double")).alias("p"))


def theil_sen(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, slope): the median slope over pairs of a group's rows with different x; a task holds a group's rows, not its pairs."""
    import pandas as pd

    def one(key, pdf):
        slope = pvalues.median_slope(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({by: [key[0]], "slope": [slope]}).dropna(subset="slope")

    rows = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    return rows.groupBy(by).applyInPandas(one, f"{by} {df.schema[by].dataType.simpleString()}, slope double")


def replicate_tests(values: DataFrame, replicate: str, first: list, second: list, matched: bool = False) -> DataFrame:
    """Per gene tests of replicate means (gene_id, replicate, value): signed-rank and paired t in the order of the lists if
    matched, else rank-sum and t; q for each, Cohen's d and effect size. Replicates without a value of a gene count as 0."""
    import numpy as np
    import pandas as pd

    names = ("wilcoxon_p", "ttest_rel_p") if matched else ("mannwhitney_p", "ttest_ind_p")

    def tests(batches):
        for pdf in batches:
            rows = []
            for gene, own, value in zip(pdf["gene_id"], pdf["reps"], pdf["values"]):
                got = dict(zip(own, value))
                a, b = (np.array([got.get(r, 0.0) for r in side], float) for side in (first, second))
                u, p = pvalues.mann_whitney(a, b)
                ps = (pvalues.wilcoxon(a, b), pvalues.t_test(a, b, True)) if matched else (p, pvalues.t_test(a, b))
                pooled = np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / max(1, len(a) + len(b) - 2)) if min(len(a), len(b)) > 1 else 0
                rows.append((gene, *ps, (a.mean() - b.mean()) / pooled if pooled else None, u / (len(a) * len(b))))
            yield pd.DataFrame(rows, columns=["gene_id", *names, "CohensD", "CommonLanguageEffectSize"])

    # A gene's few values are packed in Spark and genes are tested a batch at a time.
    kind = values.schema["gene_id"].dataType.simpleString()
    packed = values.where(F.col(replicate).isin(*first, *second)).groupBy("gene_id").agg(F.collect_list(F.struct(F.col(replicate).alias("r"), F.col("value").alias("v"))).alias("x"))
    packed = packed.select("gene_id", F.col("x.r").alias("reps"), F.col("x.v").alias("values"))
    out = written(packed.mapInPandas(tests, f"gene_id {kind}, {names[0]} double, {names[1]} double, CohensD double, CommonLanguageEffectSize double"))
    for p in names:
        out = bh_adjust(out.withColumn(p, F.nanvl(p, F.lit(None).cast("double"))), p, p.replace("_p", "_q"))
    return out


def category_tests(df: DataFrame, category: str, value: str, hue: str | None = None, test: str = "mannwhitney") -> DataFrame:
    """Per category: the two values of hue against each other, or without hue the category against all other rows.

    (category, n1, n2, p, cohens_d, cles); null, NaN and infinite values are left out; null without rows on both sides.
    Ranks come from counts of distinct values; against all others they are the same for every category and taken once.
    """
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col(category).isNotNull())
    if hue:
        levels = d.where(F.col(hue).isNotNull()).agg(F.min(hue).alias("__a"), F.max(hue).alias("__b"))
        d = d.crossJoin(F.broadcast(levels)).where((F.col(hue) == F.col("__a")) | (F.col(hue) == F.col("__b")))
        d = d.select(F.col(category).alias("c"), (F.col(hue) == F.col("__a")).alias("one"), v.alias("v"))
        w = Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        per = d.groupBy("c", "v").agg(F.count(F.lit(1)).cast("double").alias("k"), F.count_if("one").alias("k1")).withColumn("rank", F.coalesce(F.sum("k").over(w), F.lit(0.0)) + (F.col("k") + 1) / 2)
        ranked = per.groupBy("c").agg(F.sum(F.col("k1") * F.col("rank")).alias("r1"), F.sum(F.col("k") ** 3 - F.col("k")).alias("ties"))
        side = lambda one: F.when(F.col("one") if one else ~F.col("one"), F.col("v"))
        both = d.groupBy("c").agg(*[f(side(one)).alias(f"{n}{i}") for i, one in ((1, True), (2, False)) for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_pop))])
        t = ranked.join(both, "c").withColumn("ss", F.col("n1") * F.coalesce("s1", F.lit(0.0)) + F.col("n2") * F.coalesce("s2", F.lit(0.0)))
    else:
        d = d.select(F.col(category).alias("c"), v.alias("v"))
        ranks = global_ranks(d, "v")
        k = F.col("count").cast("double")
        ties = ranks.agg(F.sum(k**3 - k).alias("ties"))
        own = d.groupBy("c", "v").agg(F.count(F.lit(1)).alias("k1")).join(ranks, "v").groupBy("c").agg(F.sum(F.col("k1") * F.col("rank")).alias("r1"))
        each = d.groupBy("c").agg(F.count("v").alias("n1"), F.avg("v").alias("m1"), F.var_pop("v").alias("s1"))
        whole = d.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
        t = own.join(each, "c").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(ties)).withColumn("n2", F.col("n") - F.col("n1"))
        t = t.withColumn("m2", F.try_divide(F.col("n") * F.col("m") - F.col("n1") * F.col("m1"), F.col("n2")))
        t = t.withColumn("ss", F.greatest(F.lit(0.0), F.col("n") * F.col("s") - F.try_divide(F.col("n1") * F.col("n2"), F.col("n")) * (F.col("m1") - F.col("m2")) ** 2))
    some = (F.col("n1") > 0) & (F.col("n2") > 0)
    u, gap = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("m1") - F.col("m2")
    var = F.try_divide("ss", F.col("n1") + F.col("n2") - 2)
    if test == "ttest":
        stat = F.try_divide(gap, F.sqrt(F.try_divide(var, F.col("n1")) + F.try_divide(var, F.col("n2"))))
        p = F.when(var > 0, pvalues.t_two_sided_udf(F.coalesce(stat, F.lit(0.0)), (F.col("n1") + F.col("n2") - 2).cast("double"))).when(gap == 0, 1.0).otherwise(0.0)
    else:
        p = pvalues.u_test_udf(F.coalesce(u, F.lit(0.0)), "n1", "n2", "ties")
    return t.select(F.col("c").alias(category), "n1", "n2", F.when(some, p).alias("p"), F.when(some, F.try_divide(gap, F.sqrt(var))).alias("cohens_d"), F.when(some, F.try_divide(u, F.col("n1") * F.col("n2"))).alias("cles"))


def volcano(df: DataFrame, effect: str, p: str, floor: float = 1e-300, important: float = 5.0) -> DataFrame:
    """df plus minus_log10_p (p no smaller than floor) and important: over the bar."""
    return df.withColumn("minus_log10_p", -F.log10(F.greatest(F.col(p), F.lit(floor)))).withColumn("important", F.col("minus_log10_p") > important).select("*", F.col(effect).alias("effect"))
