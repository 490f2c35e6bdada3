"""Functions for SQL: an aggregate, a scalar and a table function, registered by name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoplane.functions.scalars import HYDROPATHY


@F.pandas_udf(T.DoubleType())
def simpson_index(labels: pd.Series) -> float:
    """The chance that two of the group's labels drawn without replacement are equal; null under two. A task holds a group's
    labels: for groups without a bound use ``diversity.simpson``, which counts first."""
    n = labels.dropna().value_counts()
    total = int(n.sum())
    return float((n * (n - 1)).sum() / (total * (total - 1))) if total > 1 else None


@F.pandas_udf(T.DoubleType())
def gravy_index(peptides: pd.Series) -> pd.Series:
    """The mean hydropathy of each peptide's known residues; null for null, or without any."""
    mean = lambda s: sum(HYDROPATHY[c] for c in s) / len(s) if s else None
    return peptides.map(lambda s: None if s is None else mean([c for c in s.upper() if c in HYDROPATHY]))


@F.udtf(returnType=T.StructType([T.StructField(c, T.IntegerType()) for c in ("window", "first", "last")]))
class WindowStarts:
    """The full windows of ``size`` items, one every ``step``, in a list of n."""

    def eval(self, n: int, size: int, step: int) -> Iterator[tuple]:
        if n is not None:
            for w, first in enumerate(range(0, n - size + 1, step)):
                yield w, first, first + size - 1


def register(spark: SparkSession) -> None:
    """Makes simpson_index, gravy_index and window_starts known to the session's SQL."""
    spark.udf.register("simpson_index", simpson_index)
    spark.udf.register("gravy_index", gravy_index)
    spark.udtf.register("window_starts", WindowStarts)
