"""Nearest neighbours at size: neighbour descent, as joins of bounded lists and one bounded merge a round."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.operators.graph import unwritten, written

#: A distance is rounded to so many digits, so that one pair met in two places has one distance.
DIGITS = 9


def _unit(vecs) -> np.ndarray:
    x = np.stack(vecs.to_list() if isinstance(vecs, pd.Series) else vecs).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _best(src: np.ndarray, dst: np.ndarray, d: np.ndarray, k: int) -> pd.DataFrame:
    """The k least distances of each src, without repeated pairs."""
    out = pd.DataFrame({"src": src, "dst": dst, "distance": d})
    out = out.sort_values(["src", "distance", "dst"], kind="stable").drop_duplicates(["src", "dst"])
    return out[out.groupby("src", sort=False).cumcount() < k]


def _leaves(x: np.ndarray, rng: np.random.Generator, leaf: int) -> list[np.ndarray]:
    """Rows of x, split at the median of random differences of two rows until at most ``leaf`` are together."""
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        a, b = rng.choice(own, 2, replace=False)
        by = own[np.argsort(x[own] @ (x[a] - x[b]), kind="stable")]
        todo += [by[: len(by) // 2], by[len(by) // 2 :]]
    return out


def first_guess(points: DataFrame, k: int, sorts: int = 4, held: int = 4096, leaf: int = 64, seed: int = 17) -> DataFrame:
    """(src, dst, distance): for each point the k nearest of those that it shares a leaf with in one of ``sorts`` orders.

    An order is that of the products with a random direction: points are dealt by ranges of it, ``held`` neighbours in the
    order at a time are split further by directions of their own, and leaves are compared in full. Any point meets
    ``sorts`` leaves, whatever the number of points.
    """
    kind, vec = (points.schema[c].dataType.simpleString() for c in ("id", "vec"))
    width = points.select(F.max(F.size("vec"))).first()[0] or 0

    def by_order(direction: np.ndarray, number: int):
        def key(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(at=_unit(pdf["vec"]) @ direction)

        def near(batches):
            rest = None
            rng = np.random.default_rng(seed + number)

            def met(part: pd.DataFrame) -> pd.DataFrame:
                x, ids, found = _unit(part["vec"]), part["id"].to_numpy(), []
                for own in _leaves(x, rng, leaf):
                    d = np.round(np.maximum(1 - x[own] @ x[own].T, 0), DIGITS)
                    np.fill_diagonal(d, np.inf)
                    m = min(k, len(own) - 1)
                    if m:
                        at = np.argpartition(d, m - 1, axis=1)[:, :m]
                        found.append((np.repeat(ids[own], m), ids[own][at].ravel(), np.take_along_axis(d, at, 1).ravel()))
                return pd.DataFrame(dict(zip(("src", "dst", "distance"), (np.concatenate(c) for c in zip(*found)))) if found else {"src": ids[:0], "dst": ids[:0], "distance": np.empty(0)})

            for pdf in batches:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                while len(rest) >= 2 * held:
                    yield met(rest[:held])
                    rest = rest[held:]
            if rest is not None and len(rest):
                yield met(rest)

        keyed = points.mapInPandas(key, f"id {kind}, vec {vec}, at double")
        return keyed.repartitionByRange("at", "id").sortWithinPartitions("at", "id").mapInPandas(near, f"src {kind}, dst {kind}, distance double")

    rng, out = np.random.default_rng(seed), None
    for s in range(sorts):
        some = by_order(rng.normal(size=width), s)
        out = some if out is None else out.unionByName(some)
    return _merged(out, k)


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The k least distances (ties by id) of each src, a row a pair; other columns at their least.

    A pair that came several times has one rank, so that the limit of ranks holds before the shuffle too: a task sends on k
    neighbours of a point, however many candidates it has found for it.
    """
    rest = [F.min(c).alias(c) for c in rows.columns if c not in ("src", "dst", "distance")]
    near = rows.withColumn("__rank", F.dense_rank().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("__rank") <= k)
    return near.groupBy("src", "dst").agg(F.min("distance").alias("distance"), *rest)


def _local_joins(k: int):
    """Of rows (vs, flags, far, vecs), the lists of a point's neighbours, the new pairs that improve on one of the two: those
    with at least one of them new."""

    def run(batches):
        for pdf in batches:
            found = []
            for vs, fresh, far, vecs in zip(pdf["vs"], pdf["fresh"], pdf["far"], pdf["vecs"]):
                if len(vs) < 2:
                    continue
                x = _unit(vecs)
                fresh, far, ids = np.asarray(fresh, bool), np.asarray(far, float), np.asarray(vs)
                d = np.round(np.maximum(1 - x @ x.T, 0), DIGITS)
                ok = (fresh[:, None] | fresh[None]) & (d < far[:, None]) & (ids[:, None] != ids[None])
                a, b = np.nonzero(ok)
                found.append((ids[a], ids[b], d[a, b]))
            if found:
                yield _best(*(np.concatenate(c) for c in zip(*found)), k)

    return run


def neighbour_descent(points: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", sample: int | None = None, rounds: int = 12, least_updates: float = 0.001, seed: int = 17, include_self: bool = False) -> DataFrame:
    """(src, dst, rank, distance): about the k nearest by cosine distance, ``graph.nearest`` without its comparison of each
    point with each other. Distances are exact to nine digits; which neighbours are found is not certain.

    It starts from ``first_guess``. A round takes for each point up to ``sample`` (k, at most 16, by default) of its
    neighbours and of those it is a neighbour of, new ones and known ones apart, compares them with each other and keeps
    what is nearer than a point's k-th; it ends when under ``least_updates`` of all neighbours change, or after ``rounds``.
    A point that many have as neighbour gives a part of these, drawn by a hash and by its number of them, so that no list
    grows with the table; the merge of candidates is limited before its shuffle. So work per point and round depends
    on k and on the sample only. A null id or vector takes no part; a vector of zeros is at distance 1 from all; points
    equal to over k others have k of those. No more than one row an id; at least two points, or there are no rows.
    """
    sample = sample or min(k, 16)
    # Floats stay floats where they are shuffled and are doubles where they are compared.
    vec = F.col(vec_col) if points.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
    p = written(points.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), vec.alias("vec")))
    kind, n = p.schema["id"].dataType.simpleString(), p.count()
    near = stored = written(first_guess(p, k, seed=seed).withColumn("fresh", F.lit(1)))
    for r in range(rounds):
        draw = F.pmod(F.xxhash64(F.lit(seed + r), "src", "dst"), F.lit(1 << 20)) / float(1 << 20)
        drawn = near.withColumn("u", draw)
        counts = lambda end: drawn.groupBy(F.col(end).alias("at"), "fresh").agg(F.count(F.lit(1)).alias("n"))

        def some(end: str, other: str) -> DataFrame:
            """Edges at ``end``, about ``sample`` new and known ones each."""
            e = drawn.select(F.col(end).alias("at"), F.col(other).alias("v"), "fresh", "u").join(counts(end), ["at", "fresh"])
            return e.where(F.col("u") * F.col("n") < sample).select("at", "v", "fresh")

        forward, back = some("src", "dst"), some("dst", "src")
        lists = forward.unionByName(back).groupBy("at", "v").agg(F.max("fresh").alias("fresh"))
        # Lists without a new one compare nothing: they go before vectors are joined.
        lists = lists.groupBy("at").agg(F.collect_list(F.struct("v", "fresh")).alias("x")).where(F.exists("x", lambda e: e["fresh"] == 1)).select("at", F.inline("x"))
        far = near.groupBy("src").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
        # A point with under k neighbours takes any.
        told = p.join(far, p["id"] == far["src"], "left").select(F.col("id").alias("v"), "vec", F.when(F.col("n") == k, F.col("far")).otherwise(F.lit(3.0)).alias("far"))
        packed = lists.join(told, "v").groupBy("at").agg(F.collect_list(F.struct("v", "fresh", "far", "vec")).alias("x"))
        packed = packed.select(F.col("x.v").alias("vs"), F.col("x.fresh").alias("fresh"), F.col("x.far").alias("far"), F.col("x.vec").alias("vecs"))
        met = packed.mapInPandas(_local_joins(k), f"src {kind}, dst {kind}, distance double")
        used = forward.where("fresh = 1").select(F.col("at").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("used"))
        known = near.join(used, ["src", "dst"], "left").select("src", "dst", "distance", F.coalesce("used", "fresh").alias("fresh"), F.lit(0).alias("found"))
        both = _merged(known.unionByName(met.withColumns({"fresh": F.lit(1), "found": F.lit(1)})), k)
        older, now = stored, written(both)
        changed = now.agg(F.sum("found")).first()[0] or 0
        unwritten(older)
        stored, near = now, now.drop("found")
        if changed <= least_updates * n * k:
            break
    if include_self:
        near = near.select("src", "dst", "distance").unionByName(p.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1.0).alias("distance")))
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("rank") <= k)
    return out.select("src", "dst", "rank", F.greatest("distance", F.lit(0.0)).alias("distance"))
