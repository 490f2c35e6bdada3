"""Diversity and overlap indices over counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, by: list[str], col: str, count: str | None) -> DataFrame:
    n = F.sum(count) if count else F.count(F.lit(1))
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(n.cast("double").alias("n"))


def simpson(df: DataFrame, col: str, by: list[str] | None = None, count: str | None = None, with_replacement: bool = False) -> DataFrame:
    """(by, simpson): sum of squared shares, or of y(y-1)/(T(T-1)) without replacement (null under two observations)."""
    c, by = _counts(df, by or [], col, count), by or []
    t = F.sum("n")
    value = F.try_divide(F.sum(F.col("n") ** 2), t**2) if with_replacement else F.try_divide(F.sum(F.col("n") * (F.col("n") - 1)), t * (t - 1))
    return c.groupBy(*by).agg(value.alias("simpson"))


def cell_simpson(cells: DataFrame, col: str, out: str = "simpson", blacklist: list | None = None, second: str | None = None, with_replacement: bool = False) -> DataFrame:
    """cells plus the index over all cells, or over those of its group of second, without blacklisted values."""
    kept = cells.where(~F.coalesce(F.col(col).isin(*blacklist), F.lit(False))) if blacklist else cells
    s = simpson(kept, col, [second] if second else None, with_replacement=with_replacement).withColumnRenamed("simpson", out)
    return cells.join(s, second, "left") if second else cells.crossJoin(F.broadcast(s))


def conditional_simpson(df: DataFrame, col: str, condition: str, with_replacement: bool = False) -> DataFrame:
    """One row: over values of col, the chance of drawing a value under the condition and again from all rows."""
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("double").alias("y"), F.count_if(F.col(condition)).cast("double").alias("yc"))
    t = c.agg(F.sum("y").alias("t"), F.sum("yc").alias("tc"))
    d = c.crossJoin(F.broadcast(t))
    share = F.try_divide("y", "t") if with_replacement else F.try_divide(F.col("y") - 1, F.col("t") - 1)
    return d.agg(F.sum(share * F.try_divide("yc", "tc")).alias("conditional_simpson"))


def morisita(df: DataFrame, key: str, sample: str, first, second, count: str | None = None) -> DataFrame:
    """One row: 2 * cross / (D1 + D2) of two samples' shares of key, D being the sum of squared shares."""
    c = _counts(df, [sample], key, count)
    share = lambda s, out: c.where(F.col(sample) == F.lit(s)).select(key, F.col("n").alias(out))
    t = share(first, "a").join(share(second, "b"), key, "full_outer").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    sa, sb = F.sum("a"), F.sum("b")
    cross = F.try_divide(F.sum(F.col("a") * F.col("b")), sa * sb)
    da, db = F.try_divide(F.sum(F.col("a") ** 2), sa**2), F.try_divide(F.sum(F.col("b") ** 2), sb**2)
    return t.agg(F.try_divide(2 * cross, da + db).alias("morisita"))


def hutcheson(df: DataFrame, key: str, sample: str, first, second) -> DataFrame:
    """One row: Hutcheson's t on Shannon diversities (natural logs), its degrees of freedom, and both diversities."""
    c = _counts(df.where(F.col(sample).isin(first, second)), [sample], key, None)
    total = c.groupBy(sample).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("s"))
    p = c.join(total, sample).withColumn("p", F.col("n") / F.col("t"))
    h = p.groupBy(sample).agg(F.max("t").alias("t"), F.max("s").alias("s"), (-F.sum(F.col("p") * F.ln("p"))).alias("h"), F.sum(F.col("p") * F.ln("p") ** 2).alias("q"))
    h = h.withColumn("v", (F.col("q") - F.col("h") ** 2) / F.col("t") + (F.col("s") - 1) / (2 * F.col("t") ** 2))
    pick = lambda s, k: F.max(F.when(F.col(sample) == F.lit(s), F.col(k)))
    one = h.agg(*[pick(s, k).alias(f"{k}{i}") for i, s in ((1, first), (2, second)) for k in ("t", "h", "v")])
    v = F.col("v1") + F.col("v2")
    return one.select(
        F.try_divide(F.col("h1") - F.col("h2"), F.sqrt(v)).alias("t"),
        F.try_divide(v**2, F.try_divide(F.col("v1") ** 2, F.col("t1")) + F.try_divide(F.col("v2") ** 2, F.col("t2"))).alias("df"),
        F.col("h1").alias("diversity1"), F.col("h2").alias("diversity2"),
    )
