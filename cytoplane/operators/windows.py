"""Ranks, quantile bins, genome windows, running scores and multiple-testing correction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.model import dealt
from cytoplane.operators.graph import written


def average_rank(col: str, by: list[str]) -> Column:
    """Rank with ties at their mean, ascending, within by (a window expression)."""
    w, ties = Window.partitionBy(*by).orderBy(col), Window.partitionBy(*by, col)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def exact_quantiles(df: DataFrame, col: str, shares: list[float], accuracy: int = 10_000) -> list[float | None]:
    """The quantiles of col by linear interpolation, exactly, and no task sees all values: None if there are none. Nulls don't
    count.

    A mergeable sketch brackets each order statistic between two values that are about 4 / accuracy of all apart in rank; one
    more pass counts what lies under each bracket and how often each value inside it occurs, and running counts of those
    tell the value. The two passes read df twice.
    """
    if not shares:
        return []
    v = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    edge = 2 / accuracy
    lows, highs = [max(0.0, q - edge) for q in shares], [min(1.0, q + edge) for q in shares]
    n, low, high, first, last = v.agg(F.count(F.lit(1)), F.percentile_approx("v", lows, accuracy), F.percentile_approx("v", highs, accuracy), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    low = [first if a == 0 else x for a, x in zip(lows, low)]
    high = [last if b == 1 else x for b, x in zip(highs, high)]
    # Of few values a bracket may hold one of the two that a quantile lies between: the other is the next one outside.
    outside = [F.max(F.when(F.col("v") < x, F.col("v"))).alias(f"b{i}") for i, x in enumerate(low)]
    outside += [F.min(F.when(F.col("v") > x, F.col("v"))).alias(f"a{i}") for i, x in enumerate(high)]
    under = v.agg(*[F.count_if(F.col("v") < x).alias(f"u{i}") for i, x in enumerate(low)], *outside).first()
    mine = F.filter(F.array(*[F.when(F.col("v").between(a, b), i) for i, (a, b) in enumerate(zip(low, high))]), lambda i: i.isNotNull())
    inside = v.groupBy("v").agg(F.count(F.lit(1)).alias("c")).select("v", "c", F.explode(mine).alias("i"))
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("v"))
    at = [(n - 1) * q for q in shares]
    want = lambda f: F.element_at(F.array(*[F.lit(float(int(f(a)) - under[i])) for i, a in enumerate(at)]), F.col("i") + 1)
    ranks = inside.withColumn("upto", upto).groupBy("i")
    found = {r["i"]: r for r in ranks.agg(F.min(F.when(F.col("upto") > want(math.floor), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > want(math.ceil), F.col("v"))).alias("b")).collect()}
    out = []
    for i, a in enumerate(at):
        lo = found[i]["a"] if math.floor(a) >= under[i] else under[f"b{i}"]
        hi = found[i]["b"] if found[i]["b"] is not None else under[f"a{i}"]
        out.append(lo if math.floor(a) == math.ceil(a) or lo == hi else (math.ceil(a) - a) * lo + (a - math.floor(a)) * hi)
    return out


def quantile_bins(df: DataFrame, col: str, n: int, out: str = "bin", few: bool = False) -> DataFrame:
    """df plus a bin number: n quantile edges by linear interpolation, equal edges merged, bins closed on the right and
    the first also on the left. Null values have no bin. Edges are those of ``exact_quantiles``, which reads df before;
    few: the values are so few (of genes, of clusters) that one task may hold them, and nothing is read before."""
    shares = [i / n for i in range(n + 1)]
    if few:
        edges = df.agg(F.array_distinct(F.percentile(col, F.array(*map(F.lit, shares)))).alias("__edges"))
        df = df.crossJoin(F.broadcast(edges))
    else:
        found = dict.fromkeys(q for q in exact_quantiles(df, col, shares) if q is not None)
        df = df.withColumn("__edges", F.array(*map(F.lit, found)).cast("array<double>"))
    below = F.size(F.filter("__edges", lambda e: e < F.col(col)))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("__edges")


def bh_adjust(df: DataFrame, p: str, out: str = "q", by: list[str] | None = None) -> DataFrame:
    """df plus Benjamini-Hochberg q-values of p (within by); null p stay null and don't count.

    Equal p have equal q, so distinct values are counted first. With ``by`` a family is a window of its own; the one
    family without it is dealt by ranges of p.
    """
    by = by or []
    n = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        w = Window.partitionBy(*by).orderBy("__p")
        n = n.withColumn("__upto", F.sum("__n").over(w)).withColumn("__m", F.sum("__n").over(Window.partitionBy(*by)))
        n = n.withColumn("__q", F.min(F.col("__p") * F.col("__m") / F.col("__upto")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    else:
        n = running(n, ["__p"], {"__upto": ("__n", F.sum)}).withColumn("__raw", F.col("__p") / F.col("__upto"))
        whole = n.agg(F.sum("__n").alias("__m"))
        n = running(n, ["__p"], {"__low": ("__raw", F.min)}, backwards=True).crossJoin(F.broadcast(whole)).withColumn("__q", F.col("__low") * F.col("__m"))
    q = n.select(*[F.col(c).alias(f"__{c}") for c in by], "__p", F.least(F.lit(1.0), F.col("__q")).alias(out))
    same = F.col(p) == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(q, same, "left").drop("__p", *[f"__{c}" for c in by])


def gene_windows(genes: DataFrame, size: int = 200, step: int = 50, contig: str = "contig", start: str = "start", gene: str = "gene_id") -> DataFrame:
    """(contig, window, gene_id): full windows of ``size`` genes in order of start, one every ``step`` genes of a contig."""
    order = Window.partitionBy(contig).orderBy(start, gene)
    g = genes.where(F.col(contig).isNotNull() & F.col(start).isNotNull())
    g = g.withColumn("__rn", F.row_number().over(order) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(contig)))
    first = F.greatest(F.lit(0), F.ceil((F.col("__rn") - (size - 1)) / step))
    last = F.least(F.floor(F.col("__rn") / step), F.floor((F.col("__n") - size) / step))
    g = g.where((F.col("__n") >= size) & (first <= last)).withColumn("window", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return g.select(contig, "window", gene)


def robust_window_means(x: DataFrame, windows: DataFrame, size: int, cut: int = 5, winsorize: bool = False, contig: str = "contig", rows: int | None = None) -> DataFrame:
    """(contig, window, cell_id, mean) of non-negative values: the ``cut`` largest of a window's genes are left out, or
    with winsorize replaced by the next largest. Absent values are zeros; cells without any value in a window are absent.
    rows: about how many values there are in all windows, if known."""
    key = [contig, "window", "cell_id"]
    v = dealt(x.join(windows, "gene_id"), rows, "cell_id").withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "gene_id")))
    rest = F.sum(F.when(F.col("rn") > cut, F.col("value")).otherwise(0.0))
    if not winsorize:
        return v.groupBy(*key).agg((rest / (size - cut)).alias("mean"))
    edge = F.coalesce(F.max(F.when(F.col("rn") == cut + 1, F.col("value"))), F.lit(0.0))
    return v.groupBy(*key).agg(((rest + cut * edge) / size).alias("mean"))


def running_enrichment(ranked: DataFrame, rank: str, hit: str, by: list[str] | None = None) -> DataFrame:
    """ranked plus es: share of the set met so far minus share of the others met so far, along rank (within by).

    With ``by`` a list is a window of its own; the one list without it is dealt by ranges of rank, which must tell rows apart.
    """
    hits, others = F.count_if(F.col(hit)), F.count_if(~F.col(hit))
    if by:
        w = Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*by)
        return ranked.withColumn("es", F.try_divide(hits.over(w), hits.over(whole)) - F.try_divide(others.over(w), others.over(whole)))
    flags = ranked.withColumn("__a", F.col(hit).cast("long")).withColumn("__b", (~F.col(hit)).cast("long"))
    run = running(flags, [rank], {"__h": ("__a", F.sum), "__o": ("__b", F.sum)})
    total = ranked.agg(hits.alias("__ht"), others.alias("__ot"))
    es = F.try_divide("__h", "__ht") - F.try_divide("__o", "__ot")
    return run.crossJoin(F.broadcast(total)).withColumn("es", es).select(*ranked.columns, "es")


def enrichment_score(ranked: DataFrame, rank: str, hit: str, by: list[str] | None = None) -> DataFrame:
    """(by, es): the running score farthest from 0, the first of equals, with its sign."""
    run = running_enrichment(ranked, rank, hit, by)
    return run.groupBy(*(by or [])).agg(F.max_by("es", F.struct(F.abs("es"), -F.col(rank))).alias("es"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the given order, with their place as rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_and_bottom(df: DataFrame, col: str, tie: str, n: int) -> DataFrame:
    """The n largest and the n smallest rows by col (ties by tie), with side 'top' or 'bottom'."""
    top = df.orderBy(F.desc(col), tie).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(col, tie).limit(n).withColumn("side", F.lit("bottom")))


def first_owner_top(df: DataFrame, cluster: str, gene: str, score: str, n: int, clusters: list) -> DataFrame:
    """The top n genes of each cluster in turn, leaving out genes that an earlier cluster has taken."""
    taken, out = None, None
    for c in clusters:
        own = df.where(F.col(cluster) == F.lit(c))
        own = own if taken is None else own.join(taken, gene, "left_anti")
        own = own.orderBy(F.desc(score), gene).limit(n)
        out = own if out is None else out.unionByName(own)
        taken = out.select(gene)
    return out


def running(df: DataFrame, order: list[str], amounts: dict, backwards: bool = False) -> DataFrame:
    """df plus, for each name in amounts, {name: (column, F.sum or F.min or F.max)}, that aggregate over all rows up to and
    with this one in order (backwards: from this one on), without one task that sees all rows.

    Rows are dealt by ranges of order and stored; each range is aggregated for itself, and the aggregates of the ranges
    (a row per partition) give what comes before. order must tell rows apart.
    """
    dealt = written(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()))
    per = dealt.groupBy("__part").agg(*[f(c).alias(f"{out}__t") for out, (c, f) in amounts.items()])
    to = (1, Window.unboundedFollowing) if backwards else (Window.unboundedPreceding, -1)
    beyond = Window.orderBy("__part").rowsBetween(*to)
    before = per.select("__part", *[f(f"{out}__t").over(beyond).alias(f"{out}__b") for out, (_, f) in amounts.items()])
    own = (Window.currentRow, Window.unboundedFollowing) if backwards else (Window.unboundedPreceding, Window.currentRow)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(*own)
    both = dealt.join(F.broadcast(before), "__part")
    for out, (c, f) in amounts.items():
        here, rest = f(c).over(w), F.col(f"{out}__b")
        both = both.withColumn(out, {F.sum: here + F.coalesce(rest, F.lit(0)), F.min: F.least(here, rest), F.max: F.greatest(here, rest)}[f])
    return both.drop("__part", *[f"{out}__b" for out in amounts])


def running_total(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """df plus the sum of amount over all rows up to and with this one in order; see ``running``."""
    return running(df, order, {out: (amount, F.sum)})


def global_ranks(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """(col, count, rank) of the distinct non-null values of col: their average rank among all rows."""
    n = running_total(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")), [col], "count", "__upto")
    return n.select(col, "count", (F.col("__upto") - (F.col("count") - 1) / 2).alias(out))


def dominance(df: DataFrame, value: str, reference: str) -> DataFrame:
    """df plus, per row, the fraction of reference rows (reference true) with a strictly smaller value."""
    per = df.groupBy(value).agg(F.count_if(F.col(reference)).alias("__k"))
    total = df.agg(F.count_if(F.col(reference)).alias("__n"))
    below = running_total(per, [value], "__k", "__upto").withColumn("__below", F.col("__upto") - F.col("__k")).crossJoin(F.broadcast(total))
    return df.join(below.select(value, F.try_divide("__below", "__n").alias("dominance")), value, "left")
