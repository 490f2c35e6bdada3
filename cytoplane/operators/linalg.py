"""Components, scores, factorisation, diffusion, densities and layouts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.model import AnnotatedMatrix
from cytoplane.operators import components, graph

flip = components.turned


def covariance(x: DataFrame, row: str, col: str, value: str, n_rows: int, centred: bool = True) -> tuple[list, np.ndarray]:
    """(columns, covariance) of a long table with implicit zeros. A row's values are packed once; each task adds up the
    products of its rows in one square of columns, and squares are summed in Spark row by row, so what is shuffled is the
    values once and a square per task, and what reaches the driver is one square, whose size callers bound (variable
    genes, windows, embedding components)."""
    cols = [r[0] for r in x.select(col).distinct().orderBy(col).collect()]
    at, k = {c: i for i, c in enumerate(cols)}, len(cols)

    def squares(batches):
        gram, total = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            own, names, values = b.column("p"), b.column("p").flatten().field("c").to_pylist(), b.column("p").flatten().field("v").to_numpy(zero_copy_only=False).astype(float)
            sizes = own.value_lengths().to_numpy()
            rows, places = np.repeat(np.arange(len(sizes)), sizes), np.fromiter((at[c] for c in names), np.int64, len(names))
            for s in range(0, len(sizes), 512):
                part = (rows >= s) & (rows < s + 512)
                dense = np.zeros((min(512, len(sizes) - s), k))
                np.add.at(dense, (rows[part] - s, places[part]), values[part])
                gram += dense.T @ dense
                total += dense.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array([*gram, total], pa.list_(pa.float64()))], ["i", "sums"])

    packed = x.groupBy(row).agg(F.collect_list(F.struct(F.col(col).alias("c"), F.col(value).cast("double").alias("v"))).alias("p")).select("p")
    tasks = 2 * x.sparkSession.sparkContext.defaultParallelism
    parts = packed.mapInArrow(squares, "i int, sums array<double>")
    out = np.zeros((k + 1, k))
    for i, s in components.array_sums(parts, ["i"], "sums", tasks).collect():
        out[i] = s
    out, mean = out[:k], out[k] / n_rows
    if centred:
        out = out - n_rows * np.outer(mean, mean)
    return cols, out / max(1, n_rows - 1)


def pca(m: AnnotatedMatrix, k: int, layer: str = "", genes: DataFrame | None = None, square: int = 1024) -> tuple[DataFrame, list[float]]:
    """((gene_id, pc, loading), explained variance ratios) of cells as observations.

    Up to ``square`` genes their covariance is made and solved; of more, subspace iteration finds the same components to
    some seven digits from products with k + 10 vectors, and the driver holds genes or cells, whichever are fewer, by k + 10.
    """
    x = m.layers[layer] if genes is None else m.layers[layer].join(genes.select("gene_id"), "gene_id", "left_semi")
    x = graph.written(x.select("cell_id", "gene_id", "value"))  # read several times below
    kind, n, spark = x.schema["gene_id"].dataType.simpleString(), m.cells.count(), m.cells.sparkSession
    many = x.where("value <> 0").select("gene_id").distinct().count()
    if many > max(square, n):
        return _pca_by_cells(x, k, n)
    if many > square:
        found = components.fit(components.Rows(x, "cell_id", "gene_id", "value", n), k)
        return found.loadings(spark, k, "gene_id", kind), found.ratios(k)
    cols, c = covariance(x, "cell_id", "gene_id", "value", n)
    w, v = np.linalg.eigh(c)
    top = np.argsort(-w)[:k]
    found = components.Components(cols, np.zeros(len(cols)), v[:, top], w[top], n, float(w.sum()))
    return found.loadings(spark, k, "gene_id", kind), found.ratios(k)


def _pca_by_cells(x: DataFrame, k: int, n: int) -> tuple[DataFrame, list[float]]:
    """``pca`` of a table (cell_id, gene_id, value) of n cells with more genes than these: the cells' side of the components is
    found, and a gene's loadings are sums over its cells, in Spark."""
    x = x.where("value <> 0").withColumn("value", F.col("value").cast("double"))
    spark, kind = x.sparkSession, x.schema["cell_id"].dataType.simpleString()
    names = [r[0] for r in x.select("cell_id").distinct().orderBy("cell_id").collect()]
    # Cells without values are rows of zeros, which their means count.
    rows = components.Rows(x, "gene_id", "cell_id", "value", n, names)
    u, w = components.fit_sides(rows, np.zeros(n, int), k) if n == len(names) else components.fit_sides(_Padded(rows, n), np.zeros(n, int), k)
    k = min(k, n)
    ends = [c for c in range(k) if w[0, c] > 0]
    sides = [(name, *(float(u[i, c] / np.sqrt(w[0, c])) for c in ends)) for i, name in enumerate(names)]
    sides = F.broadcast(spark.createDataFrame(sides, f"cell_id {kind}, " + ", ".join(f"u{c} double" for c in ends)))
    per = x.join(sides, "cell_id").groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"), *[F.sum(F.col("value") * F.col(f"u{c}")).alias(f"l{c}") for c in ends])
    # The vector of the absent cells adds nothing to a gene, as their values are 0; u is centred over all cells.
    per = graph.written(per)
    far = per.agg(F.sum(F.col("q") - F.col("s") ** 2 / n).alias("total"), *[F.max_by(f"l{c}", F.struct(F.abs(f"l{c}"), F.col(f"l{c}"))).alias(f"l{c}") for c in ends]).first()
    entry = [F.struct(F.lit(c + 1).alias("pc"), (F.col(f"l{c}") * (-1.0 if far[f"l{c}"] < 0 else 1.0)).alias("loading")) for c in ends]
    return per.select("gene_id", F.explode(F.array(*entry)).alias("e")).select("gene_id", "e.pc", "e.loading"), (w[0, :k] / far["total"]).tolist() if far["total"] else [0.0] * k


class _Padded:
    """Rows with so many columns of zeros behind their own."""

    def __init__(self, rows, n: int):
        self.rows, self.n = rows, n

    def square(self, vectors: np.ndarray) -> np.ndarray:
        own = len(self.rows.columns)
        return np.vstack([self.rows.square(vectors[:own]), np.zeros((self.n - own, vectors.shape[1]))])


def scores(m: AnnotatedMatrix, loadings: DataFrame, layer: str = "") -> DataFrame:
    """(cell_id, pc, score): values times loadings, not centred, summed in Spark; cells without any are absent."""
    return m.layers[layer].join(loadings, "gene_id").groupBy("cell_id", "pc").agg(F.sum(F.col("value") * F.col("loading")).alias("score"))


def score_vectors(s: DataFrame, k: int) -> DataFrame:
    """(cell_id, vec) with the first k components in order, absent ones 0."""
    return s.where(F.col("pc") <= k).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("pc", "score"))).alias("m")).select("cell_id", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def first_component_by(x: DataFrame, group: str, row: str, col: str, value: str, square: int = 1024) -> DataFrame:
    """(row, group, pc1): within each group, the centred first component of a table with implicit zeros, turned so that the
    score largest in size is positive.

    Tasks add up squares of columns for the rows they have, whatever group is large; a group's summed square (its size is
    that of the columns, windows by use) meets in one task for the eigenvector, and scores are sums over a join again. Of
    more than ``square`` columns none is made: all groups' rows take products with eleven vectors together
    (``components.fit_sides``), and the driver holds rows by eleven.
    """
    x = x.groupBy(group, row, col).agg(F.sum(value).cast("double").alias("v"))
    if x.select(col).distinct().limit(square + 1).count() > square:
        return _first_by_rows(x, group, row, col)
    cols = [r[0] for r in x.select(col).distinct().orderBy(col).collect()]
    at, k = {c: i for i, c in enumerate(cols)}, len(cols)
    kinds = {c: x.schema[c].dataType.simpleString() for c in (group, row, col)}

    def squares(batches):
        gram, own, n = np.zeros((k + 1, k + 1)), None, 0

        def flush():
            gram[k, k] = n
            return pd.DataFrame({group: [own] * (k + 1), "i": np.arange(k + 1, dtype=np.int32), "sums": list(gram)})

        for pdf in batches:
            for g, names, values in zip(pdf[group], pdf["c"], pdf["v"]):
                if n and g != own:
                    yield flush()
                    gram, n = np.zeros((k + 1, k + 1)), 0
                own, n = g, n + 1
                i, v = np.array([at[c] for c in names]), np.asarray(values, float)
                gram[np.ix_(i, i)] += np.outer(v, v)
                gram[k, i] += v
        if n:
            yield flush()

    def top(key, pdf):
        gram = np.stack(pdf.sort_values("i")["sums"].to_list())
        n = gram[k, k]  # the rows of the group
        mean = gram[k, :k] / n
        _, v = np.linalg.eigh(gram[:k, :k] - n * np.outer(mean, mean))
        return pd.DataFrame({group: key[0], col: cols, "loading": v[:, -1], "offset": float(mean @ v[:, -1])})

    rows = x.where(F.col(group).isNotNull()).groupBy(group, row).agg(F.collect_list(F.struct(col, "v")).alias("z")).select(group, F.col(f"z.{col}").alias("c"), "z.v").sortWithinPartitions(group)
    parts = rows.mapInPandas(squares, f"{group} {kinds[group]}, i int, sums array<double>")
    parts = components.array_sums(parts, [group, "i"], "sums", 2 * x.sparkSession.sparkContext.defaultParallelism)
    load = parts.groupBy(group).applyInPandas(top, f"{group} {kinds[group]}, {col} {kinds[col]}, loading double, offset double")
    pc = x.join(load, [group, col]).groupBy(row, group).agg((F.sum(F.col("v") * F.col("loading")) - F.first("offset")).alias("pc1"))
    turn = pc.groupBy(group).agg(F.max_by("pc1", F.abs("pc1")).alias("__far"))
    return pc.join(turn, group).select(row, group, F.when(F.col("__far") < 0, -F.col("pc1")).otherwise(F.col("pc1")).alias("pc1"))


def _first_by_rows(x: DataFrame, group: str, row: str, col: str) -> DataFrame:
    """``first_component_by`` of a table (group, row, col, v) with many columns."""
    x = graph.written(x.where(F.col(group).isNotNull()).select(F.struct(group, row).alias("at"), F.struct(group, col).alias("of"), "v"))
    names = [r[0] for r in x.select("at").distinct().orderBy("at").collect()]  # a row a row of the table
    number: dict = {}
    groups = np.array([number.setdefault(a[0], len(number)) for a in names], int)
    u, w = components.fit_sides(components.Rows(x, "of", "at", "v", len(names), names), groups, 1)
    own = [(a[0], a[1], float(v)) for a, v in zip(names, u[:, 0] * np.sqrt(w[groups, 0]))]
    kinds = {f.name: f.dataType.simpleString() for f in x.schema["at"].dataType.fields}
    pc = x.sparkSession.createDataFrame(own, f"`{group}` {kinds[group]}, `{row}` {kinds[row]}, pc1 double")
    turn = pc.groupBy(group).agg(F.max_by("pc1", F.abs("pc1")).alias("__far"))
    return pc.join(turn, group).select(row, group, F.when(F.col("__far") < 0, -F.col("pc1")).otherwise(F.col("pc1")).alias("pc1"))


def nmf(m: AnnotatedMatrix, k: int, layer: str = "", rounds: int = 50, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((gene_id, component, loading), (cell_id, component, score)) by multiplicative updates; loadings of a component add
    up to 1. Gene factors (genes by k) are small and kept on the driver; cell factors are updated where the cells are."""
    rng = np.random.default_rng(seed)
    # Read by every round: written once.
    packed = graph.written(m.layers[layer].groupBy("cell_id").agg(F.collect_list(F.struct("gene_id", "value")).alias("x")))
    genes = [r[0] for r in packed.select(F.explode("x.gene_id").alias("gene_id")).distinct().orderBy("gene_id").collect()]
    at = {g: i for i, g in enumerate(genes)}
    w = rng.random((len(genes), k)) + 1e-3

    def solve(w: np.ndarray, rows: list) -> tuple[np.ndarray, np.ndarray]:
        i = np.array([at[r["gene_id"]] for r in rows])
        v = np.array([r["value"] for r in rows], float)
        h, g, b = np.full(k, 1.0), w.T @ w, w[i].T @ v
        for _ in range(30):
            h *= b / np.maximum(g @ h, 1e-12)
        return h, np.stack([i, v])

    for _ in range(rounds // 10 or 1):
        own = w

        def sums(batches):
            xh, hh = np.zeros((len(genes), k)), np.zeros((k, k))
            for pdf in batches:
                for rows in pdf["x"]:
                    h, (i, v) = solve(own, rows)
                    np.add.at(xh, i.astype(int), v[:, None] * h)
                    hh += np.outer(h, h)
            yield pd.DataFrame({"all": [0], "sums": [np.concatenate([xh.ravel(), hh.ravel()])]})

        part = components.array_sums(packed.select("x").mapInPandas(sums, "all int, sums array<double>"), ["all"], "sums", 1).first()
        both = np.array(part["sums"]) if part else np.zeros(len(genes) * k + k * k)
        xh, hh = both[: len(genes) * k].reshape(len(genes), k), both[len(genes) * k :].reshape(k, k)
        for _ in range(10):
            w = w * xh / np.maximum(w @ hh, 1e-12)
        w = w / np.maximum(w.sum(axis=0), 1e-12)
    final = w

    def place(batches):
        for pdf in batches:
            for c, rows in zip(pdf["cell_id"], pdf["x"]):
                yield pd.DataFrame({"cell_id": c, "component": np.arange(1, k + 1), "score": solve(final, rows)[0]})

    spark = m.cells.sparkSession
    load = spark.createDataFrame([(g, j + 1, float(final[i, j])) for i, g in enumerate(genes) for j in range(k)], f"gene_id {m.x.schema['gene_id'].dataType.simpleString()}, component int, loading double")
    return load, packed.mapInPandas(place, f"cell_id {m.x.schema['cell_id'].dataType.simpleString()}, component int, score double")


def diffusion(points: DataFrame, sigma: float, k: int = 10, limit: int = 5000, landmarks: int | None = None, blocks: bool = False) -> DataFrame:
    """(id, component, value) of points (id, vec): exp(-cosine distance / sigma), columns normalised, eigenvectors by size of
    eigenvalue, each times its eigenvalue after one step.

    Exact for at most ``limit`` points; more raise unless ``landmarks`` says how many (at most limit, by a hash of the id)
    carry the spectrum: every other point then gets its values from its similarities to them, where it is (Nystroem's
    extension, which gives the landmarks their own values back). With ``blocks`` more than limit points are taken as exactly,
    in bounded memory and in time that grows with their square: blocks of points meet blocks of points, each two once, and the
    spectrum comes from products with k + 11 or one more than the vectors' entries (65 at most), which the driver holds.
    """
    if blocks and landmarks is None and points.limit(limit + 1).count() > limit:
        return _diffusion_of_blocks(points, sigma, k)
    if landmarks is None:
        rows = points.orderBy("id").limit(limit + 1).toPandas()
        if len(rows) > limit:
            raise ValueError(f"over {limit} points")
    else:
        rows = points.orderBy(F.xxhash64("id"), "id").limit(min(landmarks, limit)).toPandas()
    unit = lambda vecs: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))(np.stack(vecs.to_list()).astype(float))
    kind = points.schema["id"].dataType.simpleString()
    if not len(rows):
        return points.sparkSession.createDataFrame([], f"id {kind}, component int, value double")
    x = unit(rows["vec"])
    kernel = np.exp(-(1 - x @ x.T) / sigma)
    d = kernel.sum(axis=0)
    w, v = np.linalg.eigh(kernel / np.sqrt(np.outer(d, d)))
    order = np.argsort(-np.abs(w))[1 : k + 1]
    scaled = flip(np.sqrt(d)[:, None] * v[:, order])
    final = scaled / np.linalg.norm(scaled, axis=0) * w[order] ** 2
    if landmarks is None:
        return points.sparkSession.createDataFrame([(i, j + 1, float(final[r, j])) for r, i in enumerate(rows["id"].tolist()) for j in range(final.shape[1])], f"id {kind}, component int, value double")
    back = final / d[:, None] / w[order]  # a landmark's share in the value of a point similar to it

    def place(batches):
        for pdf in batches:
            if len(pdf):
                value = np.exp(-(1 - unit(pdf["vec"]) @ x.T) / sigma) @ back
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), value.shape[1]), "component": np.tile(np.arange(1, value.shape[1] + 1), len(pdf)), "value": value.ravel()})

    return points.select("id", "vec").mapInPandas(place, f"id {kind}, component int, value double")


class _Kernel:
    """The scaled kernel of ``diffusion`` as ``components.fit`` reads a covariance: by its products alone."""

    def __init__(self, points: DataFrame, sigma: float, block: int = 16_384):
        spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
        self.columns = [r[0] for r in points.select("id").orderBy("id").collect()]
        self.n, self.mean, self.total, self.sigma = len(self.columns), None, 0.0, sigma
        self.tasks = spark.sparkContext.defaultParallelism
        numbers = spark.createDataFrame(pd.DataFrame({"id": self.columns, "i": range(self.n)}), f"id {kind}, i long")
        k = max(1, -(-self.n // block), math.ceil(math.sqrt(4 * self.tasks)))
        own = graph.written(points.join(numbers, "id").select("i", "vec", (F.col("i") % k).cast("int").alias("own")))
        # The kernel is symmetric: a pair of blocks meets once, and its product goes to both.
        self.left = own.withColumn("b", F.col("own")).withColumn("c", F.explode(F.sequence("own", F.lit(k - 1))))
        self.right = own.withColumn("c", F.col("own")).withColumn("b", F.explode(F.sequence(F.lit(0), "own")))
        self.own, self.d = own, np.ones(self.n)
        self.d = self.times(np.ones((self.n, 1)))[:, 0]

    def start(self, most: int = 64) -> np.ndarray:
        """The directions in which the kernel of unit vectors is widest: one, and the vectors' own entries, as far as ``most``.
        exp(x'y / sigma) is a series whose first two terms these span."""
        out = np.zeros((self.n, 0))
        for b in self.own.select("i", F.slice(F.col("vec").cast("array<double>"), 1, most).alias("v"), F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("size")).toArrow().to_batches():
            if b.num_rows:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) / np.maximum(b.column("size").to_numpy(), 1e-300)[:, None]
                out = out if out.shape[1] else np.zeros((self.n, v.shape[1]))
                out[b.column("i").to_numpy()] = v
        return np.sqrt(self.d)[:, None] * np.hstack([np.ones((self.n, 1)), out])

    def times(self, vectors: np.ndarray) -> np.ndarray:
        root, sigma = 1 / np.sqrt(self.d)[:, None], self.sigma
        sent = self.left.sparkSession.sparkContext.broadcast(root * vectors)

        def units(t: pa.Table) -> np.ndarray:
            x = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1).astype(float)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        def product(l: pa.Table, r: pa.Table) -> pa.Table:
            i, j = (t.column("i").to_numpy() for t in (l, r))
            rows, sums = [], []
            if len(i) and len(j):
                x, y, v = units(l), np.ascontiguousarray(units(r).T / sigma), sent.value
                same, step = l.column("own")[0] == r.column("own")[0], max(1, (1 << 20) // len(j))
                own, other = v[j], np.zeros((len(j), v.shape[1]))
                for s in range(0, len(i), step):
                    kernel = x[s : s + step] @ y
                    kernel -= 1 / sigma
                    np.exp(kernel, out=kernel)
                    sums.append(kernel @ own)
                    if not same:
                        other += kernel.T @ v[i[s : s + step]]
                rows, sums = [i] if same else [i, j], sums if same else [*sums, other]
            flat = np.vstack(sums) if sums else np.zeros((0, 1))
            return pa.table([pa.array(np.concatenate(rows) if rows else [], pa.int64()), pa.array(list(flat), pa.list_(pa.float64()))], ["i", "s"])

        parts = self.left.groupBy("b", "c").cogroup(self.right.groupBy("b", "c")).applyInArrow(product, "i long, s array<double>")
        out = np.zeros(vectors.shape)
        for b in components.array_sums(parts, ["i"], "s", self.tasks).toArrow().to_batches():  # a row a point, of the width of vectors
            if b.num_rows:
                out[b.column("i").to_numpy()] = b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        sent.unpersist()
        return root * out


def _diffusion_of_blocks(points: DataFrame, sigma: float, k: int) -> DataFrame:
    """``diffusion`` without the kernel's square, which is positive definite: its values fall from 1 to 0."""
    kernel = _Kernel(points, sigma)
    found = components.fit(kernel, k + 1, close=1e-8, start=kernel.start())
    w = found.variances[1 : k + 1]
    scaled = flip(np.sqrt(kernel.d)[:, None] * found.vectors[:, 1 : k + 1])
    final = scaled / np.linalg.norm(scaled, axis=0) * w**2
    rows = pd.DataFrame({"id": np.repeat(np.array(kernel.columns), final.shape[1]), "component": np.tile(np.arange(1, final.shape[1] + 1), len(final)), "value": final.ravel()})
    return points.sparkSession.createDataFrame(rows, f"id {points.schema['id'].dataType.simpleString()}, component int, value double")


def cosine_to_centroid(points: DataFrame, cluster: str, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, cluster, similarity) of each vector with its cluster's mean vector."""
    p = points.where(F.col(cluster).isNotNull()).select(F.col(id_col).alias("id"), F.col(cluster).alias("cluster"), F.posexplode(vec_col).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    mean = p.groupBy("cluster", "pos").agg(F.avg("v").alias("m"))
    s = p.join(mean, ["cluster", "pos"]).groupBy("id", "cluster").agg(F.sum(F.col("v") * F.col("m")).alias("d"), F.sqrt(F.sum(F.col("v") ** 2)).alias("a"), F.sqrt(F.sum(F.col("m") ** 2)).alias("b"))
    return s.select("id", "cluster", F.try_divide("d", F.col("a") * F.col("b")).alias("similarity"))


def measured(c: str):
    """Neither null nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def kde_grid(points: DataFrame, px: int = 100, box: tuple[float, float, float, float] | None = None, side: float = 0.4, order: int = 10, reach: float = 7.0) -> DataFrame:
    """(i, j, gx, gy, density): gaussian density of (x, y) with Scott's bandwidth and full covariance on a px by px grid.

    A fast Gauss transform: in coordinates where the kernel is round and of unit width, points are added up in square boxes
    as moments about the box's centre, and a place of the grid reads the boxes within ``reach`` of it by its tile and eight
    around. A point is read once, whatever the grid; a box stands for all its points. The kernel's expansion ends at degree
    ``order`` and its tail at ``reach``: with the defaults a density is off by less than 1e-8 of the kernel's peak. Rows with
    a null or NaN don't count; where there is no spread in both directions densities are null.
    """
    p = points.where(measured("x") & measured("y")).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    s = p.agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    if box:
        s = s.withColumns(dict(zip(("x0", "x1", "y0", "y1"), map(F.lit, box))))
    n, vx, vy, vxy, x0, x1, y0, y1 = s.first()  # one row
    f = n ** (-1 / 3) if n else 0.0
    det = (vx * vy - vxy**2) * f * f if n > 1 else 0.0
    axis = lambda c: points.sparkSession.range(px).select(F.col("id").cast("int").alias(c))
    at = lambda i, a, b: F.lit(a).cast("double") + F.col(i) * F.lit(0.0 if a is None else b - a) / max(1, px - 1)
    grid = axis("i").crossJoin(axis("j")).withColumn("gx", at("i", x0, x1)).withColumn("gy", at("j", y0, y1))
    if not det > 1e-12 * max(vx or 0.0, vy or 0.0, 1e-300) ** 2 * f * f:
        return grid.withColumn("density", F.lit(None).cast("double"))
    width = np.sqrt(vx * f)
    slant = vxy * f / width
    height = np.sqrt(vy * f - slant**2)
    round_u = lambda x: (F.col(x) - float(x0)) / float(width)
    round_v = lambda y, u: (F.col(y) - float(y0) - F.col(u) * float(slant)) / float(height)
    middle = lambda c: (F.floor(F.col(c) / side) + 0.5) * side
    tile = lambda c: F.floor(F.col(c) / reach)

    power = lambda c, k: F.lit(1.0) if k == 0 else power(c, k - 1) * F.col(c)
    degrees = [(a, b) for a in range(order) for b in range(order - a)]
    q = p.withColumn("u", round_u("x")).withColumn("v", round_v("y", "u")).select("u", "v", middle("u").alias("cu"), middle("v").alias("cv"))
    q = q.select("cu", "cv", (F.col("u") - F.col("cu")).alias("t"), (F.col("v") - F.col("cv")).alias("w"))
    q = q.withColumn("e", F.exp(-(F.col("t") * F.col("t") + F.col("w") * F.col("w")) / 2))
    boxes = q.groupBy("cu", "cv").agg(*[F.sum(F.col("e") * power("t", a) * power("w", b)).alias(f"m{a}_{b}") for a, b in degrees])
    boxes = boxes.withColumn("tu", tile("cu")).withColumn("tv", tile("cv"))

    g = grid.withColumn("u", round_u("gx")).withColumn("v", round_v("gy", "u"))
    around = F.array(*map(F.lit, (-1, 0, 1)))
    g = g.withColumn("tu", F.explode(F.transform(around, lambda k: k + tile("u")))).withColumn("tv", F.explode(F.transform(around, lambda k: k + tile("v"))))
    met = g.join(boxes, ["tu", "tv"]).withColumn("du", F.col("u") - F.col("cu")).withColumn("dv", F.col("v") - F.col("cv"))
    met = met.withColumn("far", F.col("du") * F.col("du") + F.col("dv") * F.col("dv")).where(F.col("far") <= reach * reach)

    def horner(name: str, terms: list):
        total = terms[-1]
        for t in terms[-2::-1]:
            total = total * F.col(name) + t
        return total

    moment = lambda a, b: F.col(f"m{a}_{b}") / float(math.factorial(a) * math.factorial(b))
    value = horner("du", [horner("dv", [moment(a, b) for b in range(order - a)]) for a in range(order)])
    summed = met.groupBy("i", "j").agg(F.sum(F.exp(-F.col("far") / 2) * value).alias("s"))
    return grid.join(summed, ["i", "j"], "left").select("i", "j", "gx", "gy", (F.coalesce("s", F.lit(0.0)) / float(n * 2 * np.pi * np.sqrt(det))).alias("density"))


def kde_difference(points: DataFrame, mask: str, px: int = 100) -> DataFrame:
    """(i, j, gx, gy, density) of rows with mask minus rows without, on the grid of all rows."""
    p = points.where(measured("x") & measured("y"))
    r = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    a, b = (kde_grid(p.where(c), px, None if r[0] is None else tuple(map(float, r))).select("i", "j", "gx", "gy", "density") for c in (F.col(mask), ~F.col(mask)))
    return a.join(b.select("i", "j", F.col("density").alias("other")), ["i", "j"]).select("i", "j", "gx", "gy", (F.col("density") - F.col("other")).alias("density"))


def _layout_of_tables(edges: DataFrame, rounds: int, seed: int, pool: int = 4096) -> DataFrame:
    """``layout`` with positions in a table: a round joins edges with those of both ends and adds the pulls up by node; then every
    node is pushed off as many others as it has edges of its own, drawn from ``pool`` nodes (where they were before the round) that a hash takes anew each round."""
    kind = edges.schema["src"].dataType.simpleString()
    one = graph.written(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    both = graph.written(one.union(one.select("dst", "src", "weight")).toDF("u", "v", "w"))
    count = one.groupBy("src").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("src", "id")
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    far, turn = 10 * F.sqrt(-2 * F.log(u(0))), 2 * math.pi * u(1)
    nodes = both.select(F.col("u").alias("id")).distinct().join(count, "id", "left").na.fill(0, ["m"])
    at = graph.written(nodes.select("id", "m", (far * F.cos(turn)).alias("x"), (far * F.sin(turn)).alias("y")))
    n = at.count()

    for r in range(rounds):
        rate = 1 - r / rounds
        ends = both.join(at.select(F.col("id").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv")), "v").join(at.withColumnRenamed("id", "u"), "u")
        dx, dy = F.col("x") - F.col("xv"), F.col("y") - F.col("yv")
        factor = -2 / (1 + dx * dx + dy * dy) * F.col("w")
        cut = lambda c: F.greatest(F.least(factor * c, F.lit(4.0)), F.lit(-4.0)) * (rate * 0.5)
        pulled = ends.groupBy("u").agg(F.first("m").alias("m"), *[(F.first(c) + F.sum(cut(d))).alias(c) for c, d in (("x", dx), ("y", dy))])
        pulled = pulled.select(F.col("u").alias("id"), "m", "x", "y", F.xxhash64(F.lit(seed + r), "u").alias("h"))
        chance = F.pmod(F.xxhash64(F.lit(seed + r), "id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, pool / max(n, 1)))
        drawn = np.array(at.where(chance).orderBy("id").select("x", "y").limit(2 * pool).collect(), float).reshape(-1, 2)  # the pool

        def pushed(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                m, h, x = b.column("m").to_numpy(), b.column("h").to_numpy(), np.stack([b.column(c).to_numpy() for c in "xy"], axis=1)
                if len(drawn):
                    i = np.repeat(np.arange(len(m)), m)
                    j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
                    mixed = (h[i].astype(np.uint64) ^ (j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                    d = x[i] - drawn[((mixed >> np.uint64(33)) % np.uint64(len(drawn))).astype(np.int64)]
                    sq = (d**2).sum(1, keepdims=True)
                    np.add.at(x, i, np.clip(2 / ((0.01 + sq) * (1 + sq)) * d, -4, 4) * rate * 0.1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("m"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["id", "m", "x", "y"])

        older, at = at, graph.written(pulled.mapInArrow(pushed, f"id {kind}, m long, x double, y double"))
        graph.unwritten(older)
    return at.select("id", "x", "y")


def layout(edges: DataFrame, rounds: int = 200, seed: int = 17, limit: int = 20_000, landmarks: int | None = None, spread: int = 5, tables: bool = False) -> DataFrame:
    """(id, x, y): a neighbour-graph layout in the plane (attraction along edges, sampled repulsion), from a neighbour
    table (src, dst, weight) computed in Spark, all of whose edges count.

    The layout of at most ``limit`` nodes is one sequential optimisation; more raise unless ``landmarks`` says how many (at
    most limit, by a hash of the id) are laid out: every node belongs to the landmark that it reaches over the fewest edges
    (ties to the least id), and landmarks are tied by the edges between their nodes, summed. A node other than a landmark
    then lies at the weighted mean of its neighbours' landmarks and its own one, or where no landmark is reached in ``spread``
    rounds has null. With ``tables`` more than limit nodes are all laid out themselves, each round a join of edges and positions.
    """
    if landmarks is not None:
        both = graph.written(edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")))
        nodes = both.select(F.col("src").alias("id")).distinct()
        chosen = nodes.orderBy(F.xxhash64("id"), "id").limit(min(landmarks, limit)).select("id", F.col("id").alias("mark"))
        near = graph.written(chosen)
        for _ in range(spread):
            found = both.join(near.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("mark").alias("mark"))
            new = graph.written(found.join(near.select("id"), "id", "left_anti"))
            if new.isEmpty():
                break
            near = graph.written(near.unionByName(new))
        ends = both.join(near.select(F.col("id").alias("src"), F.col("mark").alias("a")), "src").join(near.select(F.col("id").alias("dst"), F.col("mark").alias("b")), "dst")
        ties = ends.where("a < b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
        alone = chosen.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"))
        placed = layout(graph.written(ties.unionByName(alone)), rounds, seed, limit)
        at = near.join(placed.withColumnRenamed("id", "mark"), "mark").select("id", "mark", "x", "y")
        pulls = both.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("weight")).join(at.select(F.col("id").alias("other"), "x", "y"), "other").select("id", "weight", "x", "y")
        pulls = pulls.unionByName(at.select("id", F.lit(1.0).alias("weight"), "x", "y"))
        mean = pulls.groupBy("id").agg(*[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c) for c in ("x", "y")])
        mean = mean.join(chosen.select("id"), "id", "left_anti")
        return nodes.join(mean.unionByName(placed), "id", "left")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    if nodes.limit(limit + 1).count() > limit:
        if tables:
            return _layout_of_tables(edges, rounds, seed)
        raise ValueError(f"over {limit} nodes")
    e = edges.select("src", "dst", "weight").toPandas()
    ids = np.unique(np.concatenate([e["src"], e["dst"]]))
    i, j, w = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"]), e["weight"].to_numpy(float)
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(len(ids), 2)) * 10
    for r in range(rounds):
        rate = 1 - r / rounds
        d = y[i] - y[j]
        sq = (d**2).sum(1, keepdims=True)
        pull = np.clip(-2 / (1 + sq) * d * w[:, None], -4, 4) * rate * 0.5
        np.add.at(y, i, pull)
        np.add.at(y, j, -pull)
        other = rng.integers(0, len(ids), len(i))
        d = y[i] - y[other]
        sq = (d**2).sum(1, keepdims=True)
        np.add.at(y, i, np.clip(2 / ((0.01 + sq) * (1 + sq)) * d, -4, 4) * rate * 0.1)
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(a, float(b), float(c)) for a, (b, c) in zip(ids.tolist(), y)], f"id {kind}, x double, y double")
