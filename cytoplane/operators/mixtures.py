"""Two-component mixtures for antibody, hashtag and guide calls, fitted on counts of distinct values or bins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.operators import graph


EPS = 1e-6


def log_density(kind: str, x, m, s, ln, top):
    """The log of a component's density at x, up to a term without parameters; m is its mean and s its variance. Columns or
    arrays, by the ln and two-argument maximum given."""
    if kind == "gaussian":
        return -0.5 * (ln(2 * math.pi * s) + (x - m) ** 2 / s)
    m = top(m, EPS)
    if kind == "poisson":
        return x * ln(m) - m
    shape, rate = m * m / s, m / s  # gamma by its moments; ln of the gamma function by Stirling's series
    big = shape + 8
    lg = (big - 0.5) * ln(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big)
    for i in range(8):
        lg = lg - ln(shape + i)
    return shape * ln(rate) - lg + (shape - 1) * ln(top(x, EPS)) - rate * x


def _quantile(x: np.ndarray, w: np.ndarray, q: float) -> float:
    """Linear interpolation between sorted values x that occur w times."""
    upto, at = np.cumsum(w), (w.sum() - 1) * q
    low, high = x[np.searchsorted(upto, np.floor(at), "right")], x[np.searchsorted(upto, np.ceil(at), "right")]
    return float(low + (high - low) * (at - np.floor(at)))


def fit_two(w: np.ndarray, a: np.ndarray, b: np.ndarray, kind: str, rounds: int) -> tuple[float, ...]:
    """(m0, m1, s0, s1, p1) by EM over bins with w values each, their sums a and sums of squares b, ordered by value."""
    x, n = a / w, w.sum()
    low, high = _quantile(x, w, 0.25), _quantile(x, w, 0.75)
    m0, m1 = (x.min(), x.max()) if low == high else (low, high)
    s0 = s1 = max(0.0, b.sum() / n - (a.sum() / n) ** 2) + EPS
    p1 = 0.5
    top, ln = np.maximum, np.log
    for _ in range(rounds):
        odds = math.log(max(p1, 1e-9)) + log_density(kind, x, m1, s1, ln, top) - math.log(max(1 - p1, 1e-9)) - log_density(kind, x, m0, s0, ln, top)
        r = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        w1, w0 = max((w * r).sum(), 1e-12), max((w * (1 - r)).sum(), 1e-12)
        m0, m1, p1 = (a * (1 - r)).sum() / w0, (a * r).sum() / w1, (w * r).sum() / n
        s0, s1 = max((b * (1 - r)).sum() / w0 - m0 * m0, EPS), max((b * r).sum() / w1 - m1 * m1, EPS)
    return float(m0), float(m1), float(s0), float(s1), float(p1)


def chance(kind: str):
    """The chance that v belongs to component 1, of columns v, m0, m1, s0, s1 and p1."""
    density = lambda i: log_density(kind, F.col("v"), F.col(f"m{i}"), F.col(f"s{i}"), F.ln, lambda x, y: F.greatest(x, F.lit(y)))
    odds = F.ln(F.greatest("p1", F.lit(1e-9))) + density(1) - F.ln(F.greatest(1 - F.col("p1"), F.lit(1e-9))) - density(0)
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0))))


def fit_on_bins(v: DataFrame, by: list[str], kind: str, rounds: int, bins: int) -> DataFrame:
    """(by, m0, m1, s0, s1, p1) of distinct values (by, v, w), a group's values or bins in one task."""
    span = v.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("kinds"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))
    place = F.col("lo") + F.floor((F.col("v") - F.col("lo")) / width) * width
    binned = v.join(span, by).groupBy(*by, F.when(F.col("kinds") <= bins, F.col("v")).otherwise(place).alias("bin"))
    binned = binned.agg(F.sum("w").cast("double").alias("w"), F.sum(F.col("w") * F.col("v")).alias("a"), F.sum(F.col("w") * F.col("v") ** 2).alias("b"))

    def fit(key, pdf):
        pdf = pdf.sort_values("bin")
        return pd.DataFrame([[*key, *fit_two(*(pdf[c].to_numpy(float) for c in "wab"), kind, rounds)]], columns=[*by, "m0", "m1", "s0", "s1", "p1"])

    kinds = ", ".join(f"{c} {v.schema[c].dataType.simpleString()}" for c in by)
    return graph.written(binned.groupBy(*by).applyInPandas(fit, f"{kinds}, m0 double, m1 double, s0 double, s1 double, p1 double"))


def fit_in_spark(v: DataFrame, by: list[str], kind: str, rounds: int) -> DataFrame:
    """(by, m0, m1, s0, s1, p1) of distinct values (by, v, w): each round is one aggregate, so no task holds a group's values
    and none are put together. Quartiles are read off running counts."""
    total = v.groupBy(*by).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("a"), F.sum(F.col("w") * F.col("v") ** 2).alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = v.withColumn("upto", F.sum("w").over(Window.partitionBy(*by).orderBy("v"))).join(total, by)
    at = {i: (F.col("n") - 1) * q for i, q in enumerate((0.25, 0.75))}
    read = [F.min(F.when(F.col("upto") > f(at[i]), F.col("v"))).alias(f"{c}{i}") for i in at for c, f in (("f", F.floor), ("c", F.ceil))]
    start = upto.groupBy(*by, "n", "a", "b", "lo", "hi").agg(*read)
    q = {i: F.col(f"f{i}") + (F.col(f"c{i}") - F.col(f"f{i}")) * (at[i] - F.floor(at[i])) for i in at}
    var = F.greatest(F.lit(0.0), F.col("b") / F.col("n") - (F.col("a") / F.col("n")) * (F.col("a") / F.col("n"))) + EPS
    means = [F.when(q[0] == q[1], F.col(e)).otherwise(q[i]).alias(f"m{i}") for i, e in enumerate(("lo", "hi"))]
    par = graph.written(start.select(*by, *means, var.alias("s0"), var.alias("s1"), F.lit(0.5).alias("p1")))
    for _ in range(rounds):
        r = v.join(par, by).withColumn("r1", chance(kind)).withColumn("r0", 1 - F.col("r1"))
        sums = [F.sum(F.col("w") * F.col(f"r{i}") * x).alias(f"{c}{i}") for i in (0, 1) for c, x in (("w", F.lit(1.0)), ("a", F.col("v")), ("b", F.col("v") * F.col("v")))]
        s = r.groupBy(*by).agg(F.sum("w").alias("n"), *sums)
        w = {i: F.greatest(F.col(f"w{i}"), F.lit(1e-12)) for i in (0, 1)}
        m = {i: F.col(f"a{i}") / w[i] for i in (0, 1)}
        var = {i: F.greatest(F.col(f"b{i}") / w[i] - m[i] * m[i], F.lit(EPS)) for i in (0, 1)}
        older, par = par, graph.written(s.select(*by, m[0].alias("m0"), m[1].alias("m1"), var[0].alias("s0"), var[1].alias("s1"), (F.col("w1") / F.col("n")).alias("p1")))
        graph.unwritten(older)
    return par


def two_components(values: DataFrame, by: list[str], value: str, kind: str = "gaussian", rounds: int = 30, hard: bool = False, bins: int | None = 16_384) -> DataFrame:
    """values plus prediction: 1 for the component with the higher mean, 0 for the other, null for null values.

    EM runs over a group's distinct values, or over ``bins`` equal bins of them (with their counts, sums and sums of
    squares) where there are more, so that a task holds a bounded table however many rows a group has; the parameters
    then judge every value itself. bins=None: every round adds up all distinct values in Spark, whatever their number; a
    round is one pass. It starts from the lower and upper quartile and is deterministic. kind: gaussian,
    poisson or gamma. A group of one value is all 0. hard: positives are what lies at or over the least positive (or over
    the largest negative) if that parts the two means, else null.
    """
    v = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    v = graph.written(v)
    par = fit_in_spark(v, by, kind, rounds) if bins is None else fit_on_bins(v, by, kind, rounds, bins)
    done = v.join(par, by).withColumn("r", chance(kind))
    high = F.when(F.col("m1") >= F.col("m0"), F.col("r") > 0.5).otherwise(F.col("r") <= 0.5)
    called = done.select(*by, "v", "w", high.cast("int").alias("prediction"))
    whole = Window.partitionBy(*by)
    called = called.withColumn("prediction", F.when(F.min("prediction").over(whole) == 1, 0).otherwise(F.col("prediction")))
    if hard:
        s = called.groupBy(*by).agg(*[f(F.when(F.col("prediction") == k, e)).alias(n) for n, f, k, e in (("min1", F.min, 1, F.col("v")), ("max0", F.max, 0, F.col("v")))], *[F.try_divide(F.sum(F.when(F.col("prediction") == k, F.col("v") * F.col("w"))), F.sum(F.when(F.col("prediction") == k, F.col("w")))).alias(f"mean{k}") for k in (0, 1)])
        c = called.join(s, by)
        called = c.withColumn("prediction", F.when(F.col("min1").isNull(), 0).when((F.col("mean0") < F.col("min1")) & (F.col("min1") < F.col("mean1")), (F.col("v") >= F.col("min1")).cast("int")).when((F.col("mean0") < F.col("max0")) & (F.col("max0") < F.col("mean1")), (F.col("v") > F.col("max0")).cast("int")))
    keys = called.select(*by, F.col("v").alias("__v"), "prediction")
    return values.withColumn("__v", F.col(value).cast("double")).join(keys, [*by, "__v"], "left").drop("__v")


def antibody_scores(counts: DataFrame, background: DataFrame | None = None, pseudocount: float = 1.0, cell: str = "cell_id", tag: str = "antibody", count: str = "count") -> DataFrame:
    """counts plus log (natural, of count + pseudocount) and z: the population standard score per antibody, over the same
    cells or over empty droplets."""
    log = F.ln(F.col(count) + pseudocount)
    base = (background if background is not None else counts).groupBy(tag).agg(F.avg(log).alias("__m"), F.stddev_pop(log).alias("__s"))
    return counts.withColumn("log", log).join(base, tag).withColumn("z", F.try_divide(F.col("log") - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def antibody_calls(counts: DataFrame, group: str | None = None, **kwargs) -> DataFrame:
    """antibody_scores plus prediction by a two-component mixture per antibody (and group)."""
    return two_components(antibody_scores(counts, **kwargs), [kwargs.get("tag", "antibody"), *([group] if group else [])], "z")


def guide_calls(counts: DataFrame, cell: str = "cell_id", guide: str = "guide", count: str = "count", least_cells: int = 10, least_reads: int = 10) -> DataFrame:
    """(cell, n_guides, n_reads, guides): per guide seen in enough cells a two-Poisson mixture of log2 counts; calls under
    least_reads are negative; positive guides are joined by '+' in order."""
    pos = counts.where(F.col(count) > 0)
    common = pos.groupBy(guide).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_cells).select(guide)
    called = two_components(pos.join(common, guide, "left_semi").withColumn("log2", F.log2(F.col(count))), [guide], "log2", "poisson")
    hit = (F.col("prediction") == 1) & (F.col(count) >= least_reads)
    per = called.groupBy(cell).agg(F.count_if(hit).alias("n_guides"), F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col(guide)))), "+").alias("guides"))
    reads = counts.groupBy(cell).agg(F.sum(count).alias("n_reads"))
    return reads.join(per, cell, "left").select(cell, F.coalesce("n_guides", F.lit(0)).alias("n_guides"), "n_reads", F.coalesce("guides", F.lit("")).alias("guides"))


def first_component(wide: DataFrame, columns: list[str], out: str) -> DataFrame:
    """wide plus the first component of a few standardised columns, turned so that its greatest weight is positive. Columns
    without spread count for nothing; rows with a null have null."""
    v = [F.col(c) for c in columns]
    some = wide.where(~F.greatest(*[c.isNull().cast("int") for c in (*v, v[0])]).cast("boolean"))
    pairs = [(i, j) for i in range(len(v)) for j in range(i)]
    seen = some.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(v) for n, f in (("m", F.avg), ("s", F.stddev_samp))], *[F.corr(v[i], v[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(v))
    for i, j in pairs:
        c = seen[f"r{i}_{j}"]
        r[i, j] = r[j, i] = 0.0 if c is None or c != c else c
    flat = [not seen[f"s{i}"] or seen[f"s{i}"] != seen[f"s{i}"] for i in range(len(v))]
    r[flat, :], r[:, flat] = 0.0, 0.0
    w = np.linalg.eigh(r)[1][:, -1]
    w = w * np.sign(w[np.abs(w).round(9).argmax()])
    return wide.withColumn(out, sum((((c - seen[f"m{i}"]) / seen[f"s{i}"]) * float(w[i]) for i, c in enumerate(v) if not flat[i]), F.when(~F.greatest(*[c.isNull().cast("int") for c in (*v, v[0])]).cast("boolean"), 0.0)))


def background_corrected(
    counts: DataFrame,
    empty: DataFrame,
    pseudocount: float = 10.0,
    cell: str = "cell_id",
    tag: str = "antibody",
    count: str = "count",
    denoise: bool = True,
    isotypes: list[str] | None = None,
    negatives: bool = True,
    clip: tuple[float, float] | None = None,
    accuracy: int = 100_000,
) -> DataFrame:
    """(cell, antibody, value): scores of log(count + pseudocount) against empty droplets, less (with denoise) their
    regression on the cell's technical component.

    That component is the cell's mean negative score (``negatives``), the score of its isotype control, or of several of
    these the first component over the cells, as standardised columns; ``isotypes`` are tags whose antibody binds nothing.
    A cell without some of them has no component and is regressed as an average one. clip: the shares between whose
    quantiles an antibody's values are kept, quantiles being order statistics within 1 / accuracy of all in rank.
    """
    z = antibody_scores(counts, empty, pseudocount, cell, tag, count).select(cell, tag, F.col("z").alias("value"))
    parts = []
    if denoise and negatives:
        parts.append(two_components(z, [cell], "value").where("prediction = 0").groupBy(cell).agg(F.avg("value").alias("n0")))
    if denoise and isotypes:
        named = [F.max(F.when(F.col(tag) == t, F.col("value"))).alias(f"n{i}") for i, t in enumerate(isotypes, 1)]
        parts.append(z.where(F.col(tag).isin(*isotypes)).groupBy(cell).agg(*named))
    if parts:
        wide = parts[0] if len(parts) == 1 else parts[0].join(parts[1], cell, "full")
        columns = [c for c in wide.columns if c != cell]
        wide = wide.withColumnRenamed(columns[0], "noise") if len(columns) == 1 else first_component(graph.written(wide), columns, "noise")
        middle = wide.agg(F.avg("noise")).first()[0] or 0.0
        d = z.join(wide.select(cell, "noise"), cell, "left").withColumn("noise", F.coalesce("noise", F.lit(0.0 if len(columns) == 1 and negatives else middle)))
        fit = d.groupBy(tag).agg(F.regr_slope("value", "noise").alias("b"), F.avg("noise").alias("c"))
        z = d.join(fit, tag).select(cell, tag, (F.col("value") - F.coalesce("b", F.lit(0.0)) * (F.col("noise") - F.col("c"))).alias("value"))
    if clip:
        z = graph.written(z)
        edges = z.groupBy(tag).agg(F.percentile_approx("value", list(clip), accuracy).alias("e"))
        z = z.join(edges, tag).select(cell, tag, F.least(F.greatest("value", F.get("e", F.lit(0))), F.get("e", F.lit(1))).alias("value"))
    return z


def unimodal_positives(values: DataFrame, called: DataFrame, by: list[str], value: str, key: str, depth: int = 4, level: float = 0.05, draws: int = 200) -> DataFrame:
    """called with positives split again while they have more than one mode (dip test against ``draws`` uniform samples),
    at most depth times; each round handles all groups, and a group's positives meet in one task as the test needs them."""
    from cytoplane.functions.pvalues import dip

    def test(k, pdf):
        x, rng = pdf["v"].to_numpy(float), np.random.default_rng(7)
        seen = dip(x)
        p = np.mean([dip(rng.random(len(x))) >= seen for _ in range(draws)]) if len(x) > 3 else 1.0
        return pd.DataFrame([[*k, bool(p < level)]], columns=[*by, "again"])

    kinds = ", ".join(f"{c} {called.schema[c].dataType.simpleString()}" for c in by)
    for _ in range(depth):
        pos = called.where("prediction = 1").select(*by, F.col(value).cast("double").alias("v"))
        again = graph.written(pos.groupBy(*by).applyInPandas(test, f"{kinds}, again boolean").where("again").select(*by))
        if again.isEmpty():
            break
        redo = two_components(called.where("prediction = 1").join(again, by, "left_semi").drop("prediction"), by, value).select(*by, key, F.col("prediction").alias("__p"))
        called = graph.written(called.join(redo, [*by, key], "left").withColumn("prediction", F.coalesce("__p", "prediction")).drop("__p"))
    return called
