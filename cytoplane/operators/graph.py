"""Graphs as edge tables: neighbours, components, communities, silhouettes, trees."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df written once to the folder that the session names for checkpoints, and read back; removed when the driver ends.

    A temporary folder serves only where none is set and the master is local: elsewhere executors don't share one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cytoplane-')}"
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/cytoplane-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _located(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def _located(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def unwritten(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for t in tables:
        files, at = _located(t.sparkSession, t._written_at)
        files.delete(at, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of undirected edges (u, v): the least node reachable, by alternating star contractions; raises if
    they have not settled after ``rounds``."""
    e, last = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        s = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        now = s.select("u", F.col("m").alias("v")).union(s.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        older, e = e, written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        unwritten(older)
        seen = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().join(stars, "node", "left_anti").withColumn("component", F.col("node"))
    return stars.unionByName(roots)


def blocks_of(n: int, block: int, cores: int) -> int:
    """Blocks of n points: of ``block`` each until pairs of blocks are three a core, then larger ones, of 8 * block at most."""
    return max(1, -(-n // (8 * block)), min(-(-n // block), math.isqrt(3 * cores) + 1))


def nearest(points: DataFrame, k: int, include_self: bool = False, id_col: str = "id", vec_col: str = "vec", block: int = 2048, metric: str = "cosine") -> DataFrame:
    """(src, dst, rank, distance): the k nearest by cosine (or euclidean) distance, ties by id, exactly. Ids of any type
    that sorts.

    Blocks of points meet blocks of points; a pair of blocks is taken some rows at a time and keeps k rows per point. As many
    blocks as keep the cores busy are made, or as hold 8 * ``block`` points each, since every point is sent to all of them.
    """
    import numpy as np
    import pandas as pd

    n, kind = points.count(), points.schema[id_col].dataType.simpleString()
    blocks = blocks_of(n, block, points.sparkSession.sparkContext.defaultParallelism)
    b = points.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("b"))
    left = b.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    right = b.withColumn("c", F.col("b")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))

    def between(x, y):
        if metric == "euclidean":
            return np.sqrt(sum((x[:, None, i] - y[None, :, i]) ** 2 for i in range(x.shape[1])))
        return 1 - x @ y.T

    def run(pdf):
        l, r = pdf[pdf.side == 0].sort_values("id"), pdf[pdf.side == 1].sort_values("id")
        if not len(l) or not len(r):
            return pd.DataFrame({"src": l.id[:0], "dst": r.id[:0], "distance": np.empty(0)})
        x, y = (np.stack(w.to_list()).astype(float) for w in (l.vec, r.vec))
        if metric != "euclidean":
            x, y = (w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300) for w in (x, y))
        li, ri, m, out = l.id.to_numpy(), r.id.to_numpy(), min(k, len(y)), []
        step = max(1, (1 << 22) // len(y))
        for s in range(0, len(x), step):
            d = between(x[s : s + step], y)
            if not include_self:
                d[li[s : s + step, None] == ri[None]] = np.inf
            # All as near as the m-th, then the first m of a row: equal ones in the order of ids.
            at, to = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m])
            near = d[at, to]
            order = np.lexsort((to, near, at))
            at, to, near = at[order], to[order], near[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < m
            out.append(pd.DataFrame({"src": li[s + at[first]], "dst": ri[to[first]], "distance": near[first]}))
        out = pd.concat(out)
        return out[np.isfinite(out.distance)]

    some = left.unionByName(right).groupBy("b", "c").applyInPandas(run, f"src {kind}, dst {kind}, distance double")
    w = Window.partitionBy("src").orderBy("distance", "dst")
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "rank", "distance")


def silhouettes(points: DataFrame, id_col: str = "id", vec_col: str = "vec", label_col: str = "label", held: int = 1024) -> DataFrame:
    """(id, label, silhouette) by cosine distance, exactly and without pairs: the mean distance of a unit vector to a
    group's unit vectors is one minus its product with the group's mean unit vector.

    Groups' sums are vectors, added up element by element in Spark; ``held`` of them at a time meet as many points in one
    matrix product, of which a row a point is left. One row an id; null vectors or labels have no silhouette.
    """
    import numpy as np
    import pandas as pd

    p = points.where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull())
    p = p.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    u = p.withColumn("vec", F.transform("vec", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))))
    sums = u.select("label", F.posexplode("vec").alias("pos", "v")).groupBy("label", "pos").agg(F.sum("v").alias("s"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("vec"))
    sums = written(p.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(sums, "label"))
    groups, n = sums.count(), p.count()
    blocks, parts = max(1, -(-groups // held)), max(1, -(-n // held))
    to = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = u.withColumn("b", to("id", parts)).withColumn("c", every(blocks))
    right = sums.withColumn("c", to("label", blocks)).withColumn("b", every(parts))
    kind = {c: p.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(l, r):
        if not len(l) or not len(r):
            return pd.DataFrame({"id": l["id"][:0], "label": l["label"][:0], "a": np.empty(0), "b": np.empty(0)})
        dots = np.stack(l["vec"].to_list()) @ np.stack(r["vec"].to_list()).T
        size, own = r["n"].to_numpy(float), l["label"].to_numpy()[:, None] == r["label"].to_numpy()[None]
        away = (size - dots) / size
        inside = np.where(own & (size > 1), (size - dots) / np.maximum(size - 1, 1), np.nan)
        away[own] = np.inf
        none = np.isnan(inside).all(axis=1)
        a = np.where(none, np.nan, np.nanmax(np.where(none[:, None], 0.0, inside), axis=1))
        return pd.DataFrame({"id": l["id"], "label": l["label"], "a": a, "b": away.min(axis=1)})

    d = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(run, f"id {kind['id']}, label {kind['label']}, a double, b double")
    real = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    s = d.groupBy("id", "label").agg(F.max(real("a")).alias("a"), F.min(real("b")).alias("b"))
    return s.select("id", "label", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def communities(edges: DataFrame, rounds: int = 10, resolution: float = 1.0, seed: int = 17, degree: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(node, community): label moves by modularity gain over weighted edges (src, dst, weight), half of the nodes a round.

    A node moves to the neighbouring community with the greatest gain (ties to the least label); which nodes may move in
    a round is decided by a hash, so that neighbours don't swap for ever and reruns agree. degree (u, k): of nodes that
    stand for several, whose inner edges are not among ``edges``. start (node, community): where nodes are at first, each
    in one of its own by default; communities bear names of nodes.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").cast("double").alias("w")).where("u <> v")
    e = written(e.union(e.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    degree = written(e.groupBy("u").agg(F.sum("w").alias("k"))) if degree is None else degree
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    label = degree.select("u", F.col("u").alias("c")) if start is None else start.select(F.col("node").alias("u"), F.col("community").alias("c"))
    now = None
    for r in range(rounds):
        mass = label.join(degree, "u").groupBy("c").agg(F.sum("k").alias("mass"))
        near = e.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("links"))
        own = label.select("u", F.col("c").alias("own"))
        stay = own.withColumn("c", F.col("own")).join(near, ["u", "c"], "left").na.fill(0.0, ["links"]).select("u", "c", "links")
        options = near.join(own, "u").where("c <> own").select("u", "c", "links").unionByName(stay)
        score = options.join(degree, "u").join(mass, "c").join(own, "u")
        others = F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("links") - resolution * F.col("k") * others / total
        best = score.withColumn("gain", F.round(gain, 9)).groupBy("u", "own").agg(F.min_by("c", F.struct(-F.col("gain"), "c")).alias("c"))
        may = F.pmod(F.xxhash64(F.lit(seed + r), "u"), F.lit(2)) == 0
        older, now = now, written(best.select("u", F.when(may, F.col("c")).otherwise(F.col("own")).alias("c"), (F.col("c") != F.col("own")).alias("wants")))
        label = now.select("u", "c")
        if older is not None:
            unwritten(older)
        if now.where("wants").isEmpty():  # nor does any of those that this round's hash holds back
            break
    low = label.groupBy("c").agg(F.min("u").alias("community"))
    return label.join(low, "c").select(F.col("u").alias("node"), "community")


def refined_communities(edges: DataFrame, levels: int = 3, rounds: int = 10, resolution: float = 1.0, seed: int = 17) -> DataFrame:
    """(node, community): ``communities`` by levels. After each, communities are split into their connected parts, the parts
    become the nodes of a smaller graph with summed weights, and that is clustered again, until nothing merges. Every
    community is connected, and is named by its least node."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").cast("double").alias("w")).where("u <> v")
    e = written(e.union(e.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    degree = written(e.groupBy("u").agg(F.sum("w").alias("k")))
    label = degree.select(F.col("u").alias("node"), F.col("u").alias("community"))
    for level in range(levels):
        half = e.where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight"))
        c = written(communities(half, rounds, resolution, seed + level, degree))
        inside = e.join(c.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv AND u < v")
        if inside.isEmpty():
            break
        part = written(degree.select(F.col("u").alias("node")).join(components(inside.select("u", "v")), "node", "left").select("node", F.coalesce("component", "node").alias("part")))
        label = written(label.join(part.select(F.col("node").alias("community"), "part"), "community").select("node", F.col("part").alias("community")))
        degree = written(degree.join(part.withColumnRenamed("node", "u"), "u").groupBy(F.col("part").alias("u")).agg(F.sum("k").alias("k")))
        e = e.join(part.select(F.col("node").alias("u"), F.col("part").alias("pu")), "u").join(part.select(F.col("node").alias("v"), F.col("part").alias("pv")), "v")
        e = written(e.where("pu <> pv").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(F.sum("w").alias("w")))
        if e.isEmpty():
            break
    return label


def well_connected_parts(e: DataFrame, degree: DataFrame, community: DataFrame, resolution: float = 1.0, seed: int = 17, rounds: int = 12) -> DataFrame:
    """(node, part): each community taken apart into parts that hang together by more than chance.

    Every node starts as a part of its own. A node that is still alone joins the part of its community with the greatest
    gain, if that is not negative and both it and the part are well connected: the weight of the edges that tie a set to the
    rest of its community is at least resolution * K(set) * K(rest) / K(all), K being sums of degrees. In a round a hash
    decides which single nodes may join and which may be joined, so that no part that is joined moves. Ends when three
    rounds change nothing. e (u, v, w) holds both directions; parts are connected and bear the name of a node of theirs.
    """
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    own = degree.join(community.select(F.col("node").alias("u"), F.col("community").alias("c")), "u")
    own = written(own.join(own.groupBy("c").agg(F.sum("k").alias("kc")), "c").select("u", "k", "c", "kc"))
    inner = e.join(own.select("u", "c"), "u").join(own.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").where("c = cv")
    inner, at, still = written(inner.select("u", "v", "w")), own.select("u", F.col("u").alias("part")), 0
    tied = lambda links, k, kc: links >= resolution * k * (kc - k) / total - 1e-12
    for r in range(rounds):
        now = own.join(at, "u")
        ends = inner.join(at, "u").join(at.select(F.col("u").alias("v"), F.col("part").alias("other")), "v")
        cut = ends.where("part <> other").groupBy("part").agg(F.sum("w").alias("cut"))
        parts = now.groupBy("part").agg(F.sum("k").alias("ks"), F.max("kc").alias("kc"), F.count(F.lit(1)).alias("n")).join(cut, "part", "left")
        parts = parts.select("part", "ks", "n", tied(F.coalesce("cut", F.lit(0.0)), F.col("ks"), F.col("kc")).alias("well"))
        may = (F.col("n") == 1) & F.col("well") & (F.pmod(F.xxhash64(F.lit(seed + r), "part"), F.lit(2)) == 0)
        parts = written(parts.withColumn("may", may))
        movers = parts.where("may").select(F.col("part").alias("u"), F.col("ks").alias("k"))
        options = ends.where("part <> other").join(movers, "u").groupBy("u", "k", "other").agg(F.sum("w").alias("links"))
        options = options.join(parts.where("well AND NOT may").select(F.col("part").alias("other"), "ks"), "other")
        gain = F.round(F.col("links") - resolution * F.col("k") * F.col("ks") / total, 9)
        joins = options.withColumn("gain", gain).where("gain >= 0").groupBy("u").agg(F.min_by("other", F.struct(-F.col("gain"), "other")).alias("to"))
        after = written(at.join(joins, "u", "left").select("u", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved")))
        still, at = (still + 1 if after.where("moved").isEmpty() else 0), after.select("u", "part")
        if still == 3:
            break
    return at.select(F.col("u").alias("node"), "part")


def leiden(edges: DataFrame, levels: int = 6, rounds: int = 10, resolution: float = 1.0, seed: int = 17) -> DataFrame:
    """(node, community) of weighted edges (src, dst, weight): ``communities``, then ``well_connected_parts`` of each, which
    become the nodes of a smaller graph whose first partition is the communities they were parts of; and so on until no
    parts merge, or for so many levels. So what a level has put together badly the next may still take apart. Communities
    are connected and named by their least node."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").cast("double").alias("w")).where("u <> v")
    e = written(e.union(e.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    degree, start = written(e.groupBy("u").agg(F.sum("w").alias("k"))), None
    label = degree.select(F.col("u").alias("node"), F.col("u").alias("part"))
    for level in range(levels):
        half = e.where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight"))
        found = written(communities(half, rounds, resolution, seed + level, degree, start))
        nodes, kinds = found.agg(F.count(F.lit(1)), F.count_distinct("community")).first()
        if nodes == kinds or level == levels - 1:
            break
        part = written(well_connected_parts(e, degree, found, resolution, seed + level))
        if part.select("part").distinct().count() == nodes:
            break
        label = written(label.join(part.select(F.col("node").alias("part"), F.col("part").alias("to")), "part").select("node", F.col("to").alias("part")))
        start = found.join(part, "node").groupBy("part", "community").agg(F.min("node").alias("least")).select(F.col("part").alias("node"), "community")
        # A community's name has to be one of the new nodes.
        names = start.groupBy("community").agg(F.min("node").alias("name"))
        start = written(start.join(names, "community").select("node", F.col("name").alias("community")))
        degree = written(degree.join(part.withColumnRenamed("node", "u"), "u").groupBy(F.col("part").alias("u")).agg(F.sum("k").alias("k")))
        e = e.join(part.select(F.col("node").alias("u"), F.col("part").alias("pu")), "u").join(part.select(F.col("node").alias("v"), F.col("part").alias("pv")), "v")
        e = written(e.where("pu <> pv").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(F.sum("w").alias("w")))
    inside = e.join(found.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(found.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv AND u < v")
    whole = found.select("node").join(components(inside.select("u", "v")), "node", "left").select(F.col("node").alias("part"), F.coalesce("component", "node").alias("c"))
    out = written(label.join(whole, "part").select("node", "c"))
    return out.join(out.groupBy("c").agg(F.min("node").alias("community")), "c").select("node", "community")


def modularity(edges: DataFrame, label: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of (node, community) over weighted edges (src, dst, weight), each counted in both directions."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").cast("double").alias("w")).where("u <> v")
    e = e.union(e.select("v", "u", "w")).join(label.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(label.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    per = e.groupBy("cu").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    inside, squares, total = per.agg(F.sum("inside"), F.sum(F.col("k") ** 2), F.sum("k")).first()
    return float(inside / total - resolution * squares / total**2) if total else 0.0


def cluster_tree(cells: DataFrame, levels: list[str]) -> DataFrame:
    """(cluster, parent, level, n) of path labels; levels stop at the first that has an unassigned ('U') cell."""
    out = None
    for i, level in enumerate(levels):
        if not cells.where(F.col(level) == "U").isEmpty():
            break
        c = cells.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
        parts = F.size(F.split("cluster", "-"))
        c = c.select("cluster", F.when(parts > 1, F.regexp_replace("cluster", "-[^-]*$", "")).alias("parent"), F.lit(i).alias("level"), "n")
        out = c if out is None else out.unionByName(c)
    return out if out is not None else cells.sparkSession.createDataFrame([], "cluster string, parent string, level int, n long")
