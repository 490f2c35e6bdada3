"""Grouped aggregates, contingency tables and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.model import AnnotatedMatrix


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(col, n) of non-null values, most frequent first, ties by value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def breakdown(cells: DataFrame, cluster: str, value: str, field: str, least_genes: int, complexity: str = "nGene") -> DataFrame:
    """Counts of field among the cells of one cluster with at least least_genes genes."""
    return value_counts(cells.where((F.col(cluster) == value) & (F.col(complexity) >= least_genes)), field)


def cluster_means(m: AnnotatedMatrix, by: str, layer: str = "") -> DataFrame:
    """(by, gene_id, total, mean, n_cells) over all cells of the group; gene and group pairs without values are absent (mean 0)."""
    n = m.cells.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n_cells"))
    sums = m.layers[layer].join(m.cells.select("cell_id", by), "cell_id").where(F.col(by).isNotNull()).groupBy(by, "gene_id").agg(F.sum("value").alias("total"))
    return sums.join(n, by).select(by, "gene_id", "total", F.try_divide("total", "n_cells").alias("mean"), "n_cells")


def pseudobulk(m: AnnotatedMatrix, replicate: str, names: list, layer: str = "") -> DataFrame:
    """gene_id and one column of means per replicate of names; 0 where a replicate has no value of a gene."""
    means = cluster_means(m, replicate, layer)
    wide = means.groupBy("gene_id").pivot(replicate, names).agg(F.first("mean"))
    return m.genes.select("gene_id").join(wide, "gene_id", "left").na.fill(0.0)


def group_average(cells: DataFrame, by: str, cols: list[str], more_than: int) -> DataFrame:
    """Mean of each column per group, null unless more than more_than cells have a value."""
    return cells.groupBy(by).agg(*[F.when(F.count(c) > more_than, F.avg(c)).alias(c) for c in cols])


def frequency(cells: DataFrame, col: str, out: str = "frequency", blacklist: list | None = None, exclude_from_total: bool = False, second: str | None = None) -> DataFrame:
    """cells plus how often its value of col occurs among all cells, over the number of cells (of its group of second).

    Blacklisted and null values have null; with exclude_from_total blacklisted cells leave the denominator too.
    """
    bad = F.coalesce(F.col(col).isin(*(blacklist or [])), F.lit(False)) if blacklist else F.lit(False)
    counts = cells.where(~bad & F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    kept = cells.where(~bad) if exclude_from_total else cells
    if second:
        total = kept.groupBy(second).agg(F.count(F.lit(1)).alias("__t"))
        return cells.join(counts, col, "left").join(total, second, "left").withColumn(out, F.try_divide("__n", "__t")).drop("__n", "__t")
    total = kept.agg(F.count(F.lit(1)).alias("__t"))
    return cells.join(counts, col, "left").crossJoin(F.broadcast(total)).withColumn(out, F.try_divide("__n", "__t")).drop("__n", "__t")


def cross_table(df: DataFrame, rows: str, cols: str, names: list, axis: int | None = None) -> DataFrame:
    """Counts of rows by cols (one column per name; absent pairs null); axis 0 divides by column totals, 1 by row totals."""
    wide = df.groupBy(rows).pivot(cols, names).agg(F.count(F.lit(1)))
    names = [str(n) for n in names]
    if axis is None:
        return wide
    if axis == 1:
        total = sum((F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names), F.lit(0))
        return wide.select(rows, *[F.try_divide(F.col(f"`{n}`"), total).alias(n) for n in names])
    sums = wide.agg(*[F.sum(f"`{n}`").alias(f"__{n}") for n in names])
    return wide.crossJoin(F.broadcast(sums)).select(rows, *[F.try_divide(F.col(f"`{n}`"), F.col(f"`__{n}`")).alias(n) for n in names])


def complement_tables(df: DataFrame, group: str, cluster: str, weight: str | None = None) -> DataFrame:
    """For each group and cluster that occur: t11 both, t12 group only, t21 cluster only, t22 neither (counts or weights).

    Every pair of a group and a cluster has a row, with 0 where they never meet.
    """
    w = F.sum(weight) if weight else F.count(F.lit(1))
    d = df.where(F.col(group).isNotNull() & F.col(cluster).isNotNull())
    cell = d.groupBy(group, cluster).agg(w.alias("t11"))
    by_group, by_cluster = cell.groupBy(group).agg(F.sum("t11").alias("__g")), cell.groupBy(cluster).agg(F.sum("t11").alias("__c"))
    total = cell.agg(F.sum("t11").alias("__t"))
    t = by_group.crossJoin(by_cluster).join(cell, [group, cluster], "left").crossJoin(F.broadcast(total)).withColumn("t11", F.coalesce("t11", F.lit(0)))
    g, c, a = F.col("__g"), F.col("__c"), F.col("t11")
    return t.select(group, cluster, "t11", (g - a).alias("t12"), (c - a).alias("t21"), (F.col("__t") - g - c + a).alias("t22"))


def phi(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Phi coefficient of [[a, b], [c, d]]; null if a margin is empty."""
    return F.try_divide(a * d - b * c, F.sqrt(a + b) * F.sqrt(c + d) * F.sqrt(a + c) * F.sqrt(b + d))


def enrichment(df: DataFrame, group: str, cluster: str, weight: str | None = None) -> DataFrame:
    """complement_tables plus phi, fraction_of_cluster and fraction_of_group; Fisher's p is added by ``fisher_exact``."""
    t = complement_tables(df, group, cluster, weight)
    a, b, c, d = (F.col(k).cast("double") for k in ("t11", "t12", "t21", "t22"))
    return t.withColumn("phi", phi(a, b, c, d)).withColumn("fraction_of_cluster", F.try_divide(a, a + c)).withColumn("fraction_of_group", F.try_divide(a, a + b))


def row_sum(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """df plus the sum of columns, nulls counting as 0."""
    return df.withColumn(out, sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0)))


def joined_values(df: DataFrame, by: str, col: str, sep: str = "|", unique: bool = True) -> DataFrame:
    """The (distinct) values of col per group in order, joined by sep."""
    gathered = F.collect_set(col) if unique else F.collect_list(col)
    return df.groupBy(by).agg(F.array_join(F.array_sort(gathered), sep).alias(col))


def hashtag_assignment(calls: DataFrame, cell: str = "cell_id", tag: str = "tag", positive: str = "positive") -> DataFrame:
    """(cell, assignment) of long calls: the one positive tag, else 'doublet' or 'no replicate assigned'."""
    n = F.count_if(F.col(positive))
    name = F.max(F.when(F.col(positive), F.col(tag)))
    return calls.groupBy(cell).agg(F.when(n > 1, "doublet").when(n == 0, "no replicate assigned").otherwise(name).alias("assignment"))


def dot_plot_table(m: AnnotatedMatrix, by: str, genes: DataFrame, layer: str = "", normalize: str | None = None) -> DataFrame:
    """(by, gene_id, mean, fraction) of chosen genes per group over all its cells; mean as 'zscore' or 'minmax' per gene."""
    n = m.cells.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    x = m.layers[layer].join(genes.select("gene_id"), "gene_id", "left_semi").join(m.cells.select("cell_id", by), "cell_id")
    s = x.groupBy(by, "gene_id").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    t = n.crossJoin(genes.select("gene_id")).join(s, [by, "gene_id"], "left")
    t = t.select(by, "gene_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("fraction"))
    w = Window.partitionBy("gene_id")
    if normalize == "zscore":
        t = t.withColumn("mean", F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_samp("mean").over(w)))
    elif normalize == "minmax":
        t = t.withColumn("mean", F.try_divide(F.col("mean") - F.min("mean").over(w), F.max("mean").over(w) - F.min("mean").over(w)))
    return t


def repertoire(df: DataFrame, x: str, y: str, matched: bool = False, weight: str | None = None, normalize: bool = False) -> DataFrame:
    """Stacked counts of y per x: (x, y, rank, n, share).

    Agnostic: rank by count within x, largest first (ties by y). Matched: one order of y for all x (by first appearance
    in y's own order), zero-filled. share is n over the total of x if normalize, else n.
    """
    w = F.sum(weight) if weight else F.count(F.lit(1))
    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(w.alias("n"))
    if matched:
        ys = n.select(y).distinct()
        order = ys.withColumn("rank", F.row_number().over(Window.orderBy(y)))  # one row per category
        n = n.select(x).distinct().crossJoin(order).join(n, [x, y], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        n = n.withColumn("rank", F.row_number().over(Window.partitionBy(x).orderBy(F.desc("n"), y)))
    share = F.try_divide("n", F.sum("n").over(Window.partitionBy(x))) if normalize else F.col("n").cast("double")
    return n.withColumn("share", share).select(x, y, "rank", "n", "share")


def expand_counts(df: DataFrame, counts: str) -> DataFrame:
    """Each row as often as its count says; rows with null or no positive count go."""
    return df.where(F.col(counts) > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col(counts).cast("int")))).drop("__i")
