"""Leading eigenvectors of large sparse symmetric graphs, as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.operators import components, graph, neighbours


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _times(weights: DataFrame, x: DataFrame, width: int, scale: float = 1.0) -> DataFrame:
    """(id, now, before) of x (id, now, before): now is the weights (src, dst, weight) times x's now, times scale, less x's
    before where it is given; before is x's now. Every node has an edge to itself."""
    met = weights.join(x.withColumnRenamed("id", "dst"), "dst")
    own = F.col("src") == F.col("dst")
    s = met.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("weight") * F.get("now", F.lit(i))).alias(f"s{i}") for i in range(width)], F.max(F.when(own, F.col("now"))).alias("was"), F.max(F.when(own, F.col("before"))).alias("older"))
    less = lambda i: F.col(f"s{i}") * scale - F.coalesce(F.get("older", F.lit(i)), F.lit(0.0))
    return s.select("id", F.array(*map(less, range(width))).alias("now"), F.col("was").alias("before"))


def _grams(x: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """now' now and before' now, of width x width each, added up in Spark."""

    def partial(batches):
        total = np.zeros((2 * width, width))
        for b in batches:
            if b.num_rows:
                now = _rows(b.column("now"))
                total[:width] += now.T @ now
                if not b.column("before").null_count:
                    total[width:] += _rows(b.column("before")).T @ now
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    out = np.zeros((2 * width, width))
    for i, s in components.array_sums(x.select("now", "before").mapInArrow(partial, "i int, sums array<double>"), ["i"], "sums", 2 * width).collect():
        out[i] = s
    return out[:width], out[width:]


def _turned(x: DataFrame, now: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """(id, now, before): x's arrays times small matrices; without one for before, before is null."""
    kind = x.schema["id"].dataType.simpleString()

    def turn(batches):
        for b in batches:
            if b.num_rows:
                first = pa.array(list(_rows(b.column("now")) @ now), pa.list_(pa.float64()))
                second = pa.nulls(b.num_rows, pa.list_(pa.float64())) if before is None else pa.array(list(_rows(b.column("before")) @ before), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("id"), first, second], ["id", "now", "before"])

    return x.select("id", "now", "before").mapInArrow(turn, f"id {kind}, now array<double>, before array<double>")


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    """A matrix r that makes columns with this gram matrix orthonormal: as many columns of r as there are directions."""
    w, v = np.linalg.eigh((gram + gram.T) / 2)
    good = w > max(w.max(initial=0.0), 1e-300) * 1e-13
    return v[:, good] / np.sqrt(w[good])


def leading(weights: DataFrame, k: int, extra: int = 8, degree: int = 5, most: int = 120, close: float = 1e-7) -> tuple[DataFrame, np.ndarray]:
    """((id, now), eigenvalues): the k eigenvectors of largest absolute eigenvalue of a symmetric table (src, dst, weight) in
    which every node has an edge to itself; ``now`` holds a node's entry of each.

    Subspace iteration with Chebyshev polynomials on k + extra vectors. A product joins edges with the nodes' arrays; only
    squares of k + extra columns reach the driver. It ends when every residual is under ``close`` of the largest value,
    or after ``most`` products. Vectors start from hashes of the ids, so reruns agree up to the order of sums.
    """
    weights = graph.written(weights.select("src", "dst", "weight"))
    nodes = weights.select(F.col("src").alias("id")).distinct()
    width = min(k + extra, nodes.count())
    if not width:
        return nodes.select("id", F.array().cast("array<double>").alias("now")), np.zeros(0)
    start = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.xxhash64("id", i) / float(2**63))
    x = graph.written(nodes.select("id", start.alias("now"), F.lit(None).cast("array<double>").alias("before")))
    used = 0
    while True:
        # Orthonormal columns: twice, since the first squares what is nearly parallel.
        for _ in range(2):
            root = _inverse_root(_grams(x, width)[0])
            older, x, width = x, graph.written(_turned(x, root)), root.shape[1]
            graph.unwritten(older)
        product = graph.written(_times(weights, x, width))
        used += 1
        gram, inside = _grams(product, width)
        w, turn = np.linalg.eigh((inside + inside.T) / 2)
        order = np.argsort(-np.abs(w), kind="stable")
        w, turn = w[order], turn[:, order]
        residual = np.sqrt(np.maximum(np.diag(turn.T @ gram @ turn) - w**2, 0))[:k]
        if residual.max(initial=0) <= close * max(np.abs(w).max(), 1e-300) or used >= most:
            done = graph.written(_turned(x, turn[:, :k]).select("id", "now"))
            graph.unwritten(x, product, weights)
            return done, w[:k]
        floor = max(abs(w[-1]), 1e-3 * abs(w[0]), 1e-300)
        graph.unwritten(x)
        x = graph.written(_turned(product, turn / floor, turn))
        graph.unwritten(product)
        for _ in range(degree - 1):
            older, x, used = x, graph.written(_times(weights, x, width, 2 / floor)), used + 1
            graph.unwritten(older)


def diffusion_on_neighbours(points: DataFrame, sigma: float, k: int = 10, nearest: int = 50, exact: int = 20_000, **how) -> DataFrame:
    """(id, component, value) of points (id, vec): as ``linalg.diffusion``, with the kernel kept between each point and its
    ``nearest`` neighbours (either way) and 0 elsewhere. Any number of points: neighbours come from blocks up to ``exact``
    points and from neighbour descent beyond, and the spectrum from ``leading``. With all others as neighbours it is the
    dense one.
    """
    near = graph.nearest(points, nearest) if points.limit(exact + 1).count() <= exact else neighbours.neighbour_descent(points, nearest)
    one_way = near.where("src <> dst").select("src", "dst", F.exp(-F.col("distance") / sigma).alias("weight"))
    both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    kernel = graph.written(both.unionByName(points.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))))
    d = graph.written(kernel.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d")))
    scaled = kernel.join(d.select(F.col("id").alias("src"), F.col("d").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("b")), "dst")
    vectors, w = leading(scaled.select("src", "dst", (F.col("weight") / F.sqrt(F.col("a") * F.col("b"))).alias("weight")), k + 1, **how)
    if len(w) < 2:
        return points.select("id", F.lit(1).alias("component"), F.lit(0.0).alias("value")).limit(0)
    long = vectors.join(d, "id").select("id", F.posexplode(F.transform("now", lambda x: x * F.sqrt("d"))).alias("component", "v")).where("component > 0")
    size = long.groupBy("component").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"), F.max_by("v", F.struct(F.round(F.abs("v"), 9), "v")).alias("largest"))
    step = F.element_at(F.array(*[F.lit(float(x * x)) for x in w[1:]]), F.col("component"))
    return long.join(F.broadcast(size), "component").select("id", "component", (F.col("v") / F.col("size") * F.sign("largest") * step).alias("value"))
