"""As-of, guarded and completing joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], right_on: str | None = None) -> DataFrame:
    """left plus values of the last row of right with right_on <= on, within by; null if there is none.

    Both sides are stacked and the last value is carried along the order: one shuffle by ``by``, no pairs. Several rows of
    right at one place: the one with the largest values.
    """
    r_on, cols = right_on or on, [c for c in left.columns]
    l = left.select(*by, F.col(on).alias("__on"), F.lit(1).alias("__side"), F.struct(*cols).alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__r"))
    r = right.select(*by, F.col(r_on).alias("__on"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("__l"), F.struct(*values).alias("__r"))
    w = Window.partitionBy(*by).orderBy("__on", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("__v", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__l.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def guarded(left: DataFrame, right: DataFrame, key: str, least: float = 0.5, columns: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """left joined with right on key, which must be unique in left; raises if under ``least`` of right's keys match."""
    if not left.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    columns = columns or [c for c in right.columns if c != key]
    clash = [c for c in columns if c in left.columns]
    if clash and not overwrite:
        raise ValueError(f"{clash} exist already; pass overwrite=True to replace them")
    rate = match_rate(left, right, key).first()["rate"]
    if rate is not None and rate < least:
        raise ValueError(f"only {rate:.2f} of the keys match")
    return left.drop(*clash).join(right.select(key, *columns), key, "left")


def match_rate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of right, how many of them left has, and the rate."""
    k = right.select(key).distinct().join(left.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    n, hit = F.count(F.lit(1)), F.count("__hit")
    return k.agg(n.alias("n_keys"), hit.alias("n_matched"), F.try_divide(hit, n).alias("rate"))


def complete(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Every pair of an occurring first and second, with 0 where df has none."""
    return df.select(first).distinct().crossJoin(df.select(second).distinct()).join(df, [first, second], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def orthologs(genes: DataFrame, mart: DataFrame, key: str, source: str, target: str, out: str) -> DataFrame:
    """genes plus the distinct targets of mart for key, in order and joined by '|'."""
    t = mart.where(F.col(target).isNotNull()).groupBy(F.col(source).alias("__k")).agg(F.array_join(F.array_sort(F.collect_set(target)), "|").alias(out))
    return genes.join(t, genes[key] == t["__k"], "left").drop("__k")
