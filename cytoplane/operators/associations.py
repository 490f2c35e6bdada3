"""Associations of columns: contingency, variance between groups, two samples, overlaps of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.functions import pvalues
from cytoplane.operators.windows import running


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, statistic, df, p) of Pearson's test of independence of two columns; rows with a null don't count.

    Only combinations that occur are counted: n * (sum of n_ij^2 / (row * column) - 1). p is null with no freedom.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    side = lambda c: cells.groupBy(c).agg(F.sum("k").alias(f"n{c}"))
    t = cells.join(side("a"), "a").join(side("b"), "b")
    s = t.agg(F.sum("k").alias("n"), F.sum(F.col("k") ** 2 / F.col("na") / F.col("nb")).alias("q"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("df"))
    s = s.select(F.col("n").cast("long").alias("n"), (F.col("n") * (F.col("q") - 1)).alias("statistic"), "df")
    return s.withColumn("p", F.when(F.col("statistic").isNotNull() & (F.col("df") > 0), pvalues.chi_square_udf("statistic", "df")))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (statistic, df1, df2, p): the one-way test of equal means, from one aggregate per group; rows with a null
    don't count. Null statistic and p where the groups don't allow a test."""
    v = F.col(value).cast("double")
    g = df.where(F.col(group).isNotNull() & v.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    whole = g.agg(F.sum("n").alias("big"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("k"))
    t = g.crossJoin(F.broadcast(whole)).groupBy("big", "k").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"))
    t = t.withColumn("df1", F.col("k") - 1).withColumn("df2", (F.col("big") - F.col("k")).cast("long"))
    t = t.withColumn("statistic", F.try_divide(F.try_divide("between", "df1"), F.try_divide("within", "df2")))
    return t.select("statistic", "df1", "df2", F.when(F.col("statistic").isNotNull(), pvalues.f_test_udf("statistic", "df1", "df2")).alias("p"))


def two_sample_ks(df: DataFrame, value: str, first) -> DataFrame:
    """One row (n1, n2, statistic, p): the greatest distance of the distributions of rows where the condition ``first`` holds
    and where it doesn't (asymptotic p). Values are counted once and added up by ranges, so that no task sees them all."""
    v = df.where(F.col(value).isNotNull() & first.isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    run = running(v, ["v"], {"ca": ("a", F.sum), "cb": ("b", F.sum)})
    n = v.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    t = run.crossJoin(F.broadcast(n)).groupBy("n1", "n2").agg(F.max(F.abs(F.try_divide("ca", "n1") - F.try_divide("cb", "n2"))).alias("statistic"))
    return t.withColumn("p", F.when(F.col("statistic").isNotNull(), pvalues.ks_udf("statistic", "n1", "n2")))


def jaccard(df: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, both, jaccard) for groups a < b that share an item: the size of the intersection over that of the union of
    their distinct items. Groups are meant to be few (clusters, samples); items may be many."""
    d = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    n = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sets = d.groupBy("i").agg(F.array_sort(F.collect_set("g")).alias("gs")).groupBy("gs").agg(F.count(F.lit(1)).alias("k"))  # items in the same groups count once
    pairs = sets.select("k", "gs", F.posexplode("gs").alias("at", "a")).select("k", "a", F.explode(F.slice("gs", F.col("at") + 2, F.size("gs"))).alias("b"))
    both = pairs.groupBy("a", "b").agg(F.sum("k").alias("both"))
    t = both.join(n.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    return t.select("a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))
