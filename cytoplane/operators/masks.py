"""Cell and gene selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.operators.graph import nearest, written
from cytoplane.operators.windows import exact_quantiles, running_total


def over_cutoff(cells: DataFrame, metric: str, cluster: str, default: float, exceptions: dict | None = None, out: str = "passes") -> DataFrame:
    """cells plus whether metric is over its cluster's cutoff (strictly)."""
    cut = F.lit(float(default))
    for k, v in (exceptions or {}).items():
        cut = F.when(F.col(cluster) == F.lit(k), F.lit(float(v))).otherwise(cut)
    return cells.withColumn(out, F.col(metric) > cut)


def minor_clusters(cells: DataFrame, levels: list[str], most: float = 0.99, least: float = 0.01) -> DataFrame:
    """cells plus outlier: while the largest cluster of a level holds ``most`` of the remaining cells or more, cells of
    clusters under ``least`` are outliers and the next level is looked at. One small aggregate per level reaches the driver."""
    out, rest = None, cells
    for level in levels:
        share = rest.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
        total = share.agg(F.sum("n").alias("t"), F.max("n").alias("m")).first()
        if not total["t"] or total["m"] / total["t"] < most:
            break
        small = share.where(F.col("n") / F.lit(total["t"]) < least).select(level)
        gone = rest.join(small, level, "left_semi").select("cell_id")
        out = gone if out is None else out.unionByName(gone)
        rest = rest.join(small, level, "left_anti")
    flag = cells.select("cell_id").where(F.lit(False)) if out is None else out
    return cells.join(flag.select("cell_id", F.lit(True).alias("outlier")), "cell_id", "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))


def sparse_neighbourhoods(points: DataFrame, n: int = 10, quantile: float = 0.9, digits: int | None = None) -> DataFrame:
    """points (id, x, y) plus the distance to the n-th nearest other point and keep: whether it is within the quantile, both
    rounded to ``digits`` if given.

    Blocks of points meet blocks of points, and a pair of blocks keeps n distances per point. Points without coordinates,
    and all if there are no more than n, have null.
    """
    some = points.where("x IS NOT NULL AND y IS NOT NULL").select("id", F.array("x", "y").alias("vec"))
    nth = nearest(some, n, metric="euclidean").where(F.col("rank") == n).select(F.col("src").alias("id"), "distance")
    nth = written(nth)
    bar = exact_quantiles(nth, "distance", [quantile])[0]
    shown = lambda c: c if digits is None else F.round(c, digits)
    return points.join(nth, "id", "left").withColumn("keep", shown(F.col("distance")) <= shown(F.lit(bar).cast("double")))


def match_names(left: DataFrame, right: DataFrame, name: str, other: str, suffixes: tuple[str, ...] = ("_Lym", "_nucseq", "_45pos", "_45neg")) -> DataFrame:
    """left plus the matching name of right: the exact one, else the one with the last suffix that exists, else null."""
    tries = F.explode(F.array(F.struct(F.lit(99).alias("o"), F.col(name).alias("t")), *[F.struct(F.lit(i).alias("o"), F.concat(F.col(name), F.lit(s)).alias("t")) for i, s in enumerate(suffixes)]))
    hit = left.select(name, tries.alias("k")).join(right.select(F.col(other).alias("__r")).distinct(), F.col("k.t") == F.col("__r"))
    best = hit.groupBy(name).agg(F.max_by("__r", "k.o").alias(other))
    return left.join(best, name, "left")


def bernoulli(df: DataFrame, n: int, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """About n rows per group: each stays with chance min(1, n / size), decided by the md5 of seed and key, so that reruns
    and other engines agree."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.join(size, by).where(u < F.lit(n) / F.col("__n")).drop("__n")


def downsample_counts(df: DataFrame, key: str, count: str, share: float, seed: int = 0) -> DataFrame:
    """(key, n): a multinomial redraw of round(total * share) observations with chances count / total.

    Keys lie one after another on a line, each as long as its count; a draw is a place on it, by the md5 of seed and its
    number, so that reruns and other engines agree. The line is cut into about as many cells as there are keys, so that
    draws and keys meet by equal cells: a long key lies in many of them.
    """
    line = running_total(df.where(F.col(count) > 0).select(key, F.col(count).cast("long").alias("__n")), [key], "__n", "__hi")
    t = line.agg(F.sum("__n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    total, cells = t["t"] or 0, max(1, t["k"])
    width = total / cells or 1.0
    cell = lambda c: F.floor(c / width).cast("long")
    line = line.withColumn("__lo", F.col("__hi") - F.col("__n")).withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 13)  # 52 bits
    draws = df.sparkSession.range(round(total * share)).select((F.conv(digits, 16, 10).cast("double") / float(1 << 52) * total).alias("__u")).withColumn("__cell", cell(F.col("__u")))
    hit = draws.join(line, "__cell").where((F.col("__lo") <= F.col("__u")) & (F.col("__u") < F.col("__hi"))).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return df.select(key).join(hit, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
