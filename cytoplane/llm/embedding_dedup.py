"""Embedding near-dedup: a random-projection tree forest with spill, exact comparison inside leaves, components."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, hash128, spread_join, stored, table

#: Distinct vectors of a label on which its split points are fitted, at most (about); all vectors are indexed.
SAMPLE = 20_000
#: Vectors of a label that are placed in its trees at a time.
PLACED = 4096
#: A leaf's code: tree, leaf of the fitted part, and the sides taken in the levels below it.
TREE, LEAF, BELOW = 1 << 48, 1 << 28, 28
#: Fewest sampled vectors in a leaf whose quantiles are trusted.
FEWEST = 32


@dataclass
class Tree:
    """Random splits, the same direction for all nodes of a level, drawn anew from a seed wherever the tree is used. Node i
    splits on directions[level[i]] at cut[i]; what is
    within margin[i] goes both ways. Children < 0 are leaves ~child. A leaf that holds too much of the whole table though
    little of the sample is split on, below[leaf] times, by the next directions at the medians of what the sample has there."""

    seed: int
    shape: tuple[int, int]
    level: np.ndarray
    cut: np.ndarray
    margin: np.ndarray
    children: np.ndarray
    below: list[tuple[int, np.ndarray, np.ndarray]]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, code) for each leaf of each row."""
        p = x @ directions_of(self.seed, self.shape).T
        rows_out, codes = [], []
        open_ = [(0 if len(self.cut) else -1, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if not len(rows):
                continue
            if node >= 0:
                q = p[rows, self.level[node]] - self.cut[node]
                open_ += [(int(self.children[node, 0]), rows[q <= self.margin[node]]), (int(self.children[node, 1]), rows[q > -self.margin[node]])]
                continue
            first, cuts, margins = self.below[~node]
            side = np.zeros(len(rows), np.int64)
            for j in range(len(cuts)):
                q = p[rows, first + j] - cuts[j]
                low, high = q <= margins[j], q > -margins[j]
                rows, side = np.concatenate([rows[low], rows[high]]), np.concatenate([2 * side[low], 2 * side[high] + 1])
            rows_out.append(rows)
            codes.append(~node * LEAF + side)
        return np.concatenate(rows_out), np.concatenate(codes)


def directions_of(seed: int, shape: tuple[int, int]) -> np.ndarray:
    d = np.random.default_rng(seed).normal(size=shape)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _cut(p: np.ndarray, at: float, spill: float) -> tuple[float, float]:
    low, mid, high = np.quantile(p, [at - spill, at, at + spill])
    return float(mid), float(max(mid - low, high - mid))


def grow(x: np.ndarray, leaf: float, spill: float, rng: np.random.Generator, share: float = 1.0, tries: int = 3) -> Tree:
    """Recursive random splits of unit vectors x, a ``share`` of all, until at most ``leaf`` of all are expected in a node or
    ``tries`` directions don't part it."""
    deepest = int(2 * np.log2(max(2.0, len(x) / share / leaf))) + 2 * tries + 2
    seed, shape = int(rng.integers(1 << 62)), (deepest, x.shape[1])
    projected = x @ directions_of(seed, shape).T
    level, cut, margin, children, below = [], [], [], [], []
    open_ = [(np.arange(len(x)), 0, None)]
    while open_:
        rows, t, parent = open_.pop()
        here = None
        if len(rows) / share > leaf and len(rows) >= 2 * FEWEST:
            for u in range(t, min(t + tries, deepest)):
                p = projected[rows, u]
                mid, m = _cut(p, rng.uniform(0.4, 0.6), spill)
                sides = rows[p <= mid + m], rows[p > mid - m]
                if max(map(len, sides)) <= 0.9 * len(rows):
                    here = len(cut)
                    level.append(u)
                    cut.append(mid)
                    margin.append(m)
                    children.append([0, 0])
                    open_ += [(side, u + 1, (here, i)) for i, side in enumerate(sides)]
                    break
        if here is None:
            here = ~len(below)
            over = len(rows) / share / leaf
            n = min(BELOW, deepest - t, int(np.ceil(np.log(over) / np.log(2 / (1 + 2 * spill))))) if over > 1 and 8 <= len(rows) < 2 * FEWEST else 0
            further = [_cut(projected[rows, u], 0.5, spill) for u in range(t, t + n)]
            below.append((t, np.array([c for c, _ in further]), np.array([m for _, m in further])))
        if parent:
            children[parent[0]][parent[1]] = here
    return Tree(seed, shape, np.array(level, np.int64), np.array(cut), np.array(margin), np.array(children, np.int64).reshape(-1, 2), below)


def forest_shape(over: float, least: float, miss: float = 1e-6, fewest: int = 3, most: int = 40) -> tuple[int, float]:
    """(trees, spill) with the fewest rows in leaves that lose at most ``miss`` of the pairs at cosine ``least``, if projections
    are normal and a table ``over`` times a leaf is split: wide margins for shallow trees, more trees of narrow ones for deep."""
    normal, s, best = NormalDist(), math.sqrt(2 * (1 - least)), None
    for spill in (x / 100 for x in range(1, 16)):
        a = 2 * normal.inv_cdf(0.5 + spill) / s
        apart = 2 * s * (normal.pdf(a) - a * (1 - normal.cdf(a))) * normal.pdf(0.0)
        depth = math.log(max(over, 1.0)) / math.log(2 / (1 + 2 * spill))
        lost = 1 - (1 - apart) ** depth
        trees = fewest if lost <= miss ** (1 / fewest) else math.ceil(math.log(miss) / math.log(lost)) if lost < 1 else most
        rows = trees * (1 + 2 * spill) ** depth
        if trees <= most and (best is None or rows < best[0]):
            best = (rows, trees, spill)
    return (best[1], best[2]) if best else (most, 0.03)


def _unit(column) -> np.ndarray:
    x = np.asarray(column, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow_forest(x: np.ndarray, leaf: int, least: float, share: float, rng: np.random.Generator, planted: int = 5000, most: int = 60) -> list[Tree]:
    """As many trees as the shape asks for, and more until all ``planted`` pairs, sampled vectors and neighbours at cosine
    ``least``, share a leaf."""
    trees, spill = forest_shape(len(x) / share / leaf, least)
    one = x[rng.integers(0, len(x), planted)]
    other = rng.normal(size=one.shape)
    other -= (other * one).sum(1, keepdims=True) * one
    other = least * one + math.sqrt(1 - least * least) * other / np.linalg.norm(other, axis=1, keepdims=True)
    out, met = [], np.zeros(len(one), bool)
    while len(out) < trees or (len(out) < most and not met.all()):
        out.append(grow(x, leaf, spill, rng, share))
        (r1, c1), (r2, c2) = out[-1].place(one), out[-1].place(other)
        both = np.intersect1d(np.stack([r1, c1], 1).view("i8,i8").ravel(), np.stack([r2, c2], 1).view("i8,i8").ravel())
        met[both["f0"]] = True
    return out


def fit_forests(classes: DataFrame, sizes: DataFrame, leaf: int, least: float, sample: int, seed: int = 5) -> DataFrame:
    """(label, dim, forest) of the labels that don't fit a leaf, each grown where about ``sample`` of its rows at most, drawn by
    hash, have met. A forest holds seeds and split points: its size is that of the sample, never of the label."""
    large = spread_join(classes.select("label", "dim", "rep", "vec"), sizes.where(F.col("n") > leaf), ["label", "dim"], "rep")
    drawn = large.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < F.lit(float(sample)) / F.col("n") * (1 << 30))

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t, n = t.sort_by("rep"), t.column("n")[0].as_py()
        x = _unit(np.array(t.column("vec").to_pylist()))
        trees = grow_forest(x, leaf, least, min(1.0, sample / n), np.random.default_rng(seed))
        return pa.table({"label": t.column("label")[:1], "dim": t.column("dim")[:1], "forest": pa.array([pickle.dumps(trees)], pa.binary())})

    return drawn.groupBy("label", "dim").applyInArrow(one, f"label {classes.schema['label'].dataType.simpleString()}, dim int, forest binary")


def _index(key: tuple[pa.Scalar, ...], vectors: pa.Table, forest: pa.Table) -> pa.Table:
    """Some vectors of a label, each with the codes of the leaves it lies in; without a forest all are in one."""
    raw = vectors.column("vec").combine_chunks()
    flat = raw.flatten().to_numpy(zero_copy_only=False).reshape(len(raw), -1)
    codes: list = [np.zeros(1, np.int64)] * len(raw)
    if forest.num_rows and len(raw):
        x = _unit(flat)
        placed = [t.place(x) for t in pickle.loads(forest.column("forest")[0].as_py())]
        row = np.concatenate([r for r, _ in placed])
        code = np.concatenate([t * TREE + c for t, (_, c) in enumerate(placed)])
        by = np.lexsort((code, row))
        codes = np.split(code[by], np.cumsum(np.bincount(row, minlength=len(raw)))[:-1])
    columns = {c: vectors.column(c) for c in ("label", "dim", "rep", "mult")}
    columns["raw"] = pa.array([v.tobytes() for v in flat], pa.binary())
    columns["codes"] = pa.array(codes, pa.list_(pa.int64()))
    columns["own"] = pa.array([np.asarray(c, np.int64).tobytes() for c in codes], pa.binary())
    return pa.table(columns)


def _first_shared(own: np.ndarray, a: np.ndarray, b: np.ndarray, code: int, at_once: int = 1 << 14) -> np.ndarray:
    """For each pair of rows (a, b) of padded lists of codes: whether ``code`` is the least that both have."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a), at_once):
        x, y = own[a[s : s + at_once]], own[b[s : s + at_once]]
        for j in range(own.shape[1]):
            out[s : s + at_once] &= ~((x[:, j, None] == y) & (x[:, j, None] < code)).any(axis=1)
    return out


def _compare(least: float):
    """Links inside a leaf, or between two blocks of it: how many each row gained here, and the least row it is connected to."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim, code, i, j = (k.as_py() for k in key[1:])
        t = t.sort_by("rep")
        rep, mult, block = (t.column(c).to_numpy() for c in ("rep", "mult", "block"))
        raw = b"".join(t.column("raw").to_pylist())
        x = _unit(np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(rep) else np.float64).reshape(len(rep), dim))
        gained, top = np.zeros(len(rep), np.int64), np.arange(len(rep))
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        lists = [np.frombuffer(c, np.int64) for c in t.column("own").to_pylist()]
        own, found = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).max), []
        for k, c in enumerate(lists):
            own[k, : len(c)] = c
        for s in range(0, len(rows), 512):
            part = rows[s : s + 512]
            near = np.flatnonzero((x[part] @ x[cols].T >= least).ravel())
            a, b = part[near // len(cols)], cols[near % len(cols)]
            keep = a < b if i == j else a != b
            if keep.any():
                a, b = a[keep], b[keep]
                found.append((a, b))
                here = _first_shared(own, a, b, code)  # else an earlier leaf counts the pair
                a, b = a[here], b[here]
                gained += np.bincount(a, mult[b], len(rep)).astype(np.int64) + np.bincount(b, mult[a], len(rep)).astype(np.int64)
        if found:
            a, b = (np.concatenate(z) for z in zip(*found))
            while True:
                low = top.copy()
                np.minimum.at(low, a, top[b])
                np.minimum.at(low, b, top[a])
                low = low[low]
                if (low == top).all():
                    break
                top = low
        some = (gained > 0) | (top != np.arange(len(rep)))
        return pa.table([pa.array(rep[some]), pa.array(gained[some]), pa.array(rep[top[some]])], ["rep", "gained", "low"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, leaf: int = 1024, block: int = 2048, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Rows with equal labels and equally long vectors are linked if their cosine (double precision) is at least ``least``.
    Null labels, ids or vectors, zero vectors and null or non-finite components link with nothing. Rows with one vec_id
    count as several vectors. Equal vectors are one class with a multiplicity; n_links counts members. A pair is counted
    in the first leaf that it shares, so n_links needs no list of pairs; leaves of over ``block`` classes are compared in
    blocks, so no task holds more than two. A label's forest is fitted on at most about ``sample`` of its vectors, labels next
    to each other in tasks, and goes to that label's vectors only, some thousands at a time: nothing grows with the number
    of labels on the driver or in a broadcast. It indexes every vector; trees deepen with the label, and there are as many
    as lose a millionth of the pairs at cosine ``least`` if projections are normal, and more until all of 5 000 planted
    pairs are found.
    """
    plus_zero = F.transform(F.col(vec_col), lambda c: c + F.lit(0).cast("float"))  # no negative zero, so that equal vectors hash alike
    v = vectors.select(F.col(id_col).cast("long").alias("id"), plus_zero.alias("vec"), F.col(label_col).alias("label"))
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    ok = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    h1, h2 = hash128(F.col("vec"))
    v = v.withColumn("h1", h1).withColumn("h2", h2)
    classes = v.where(ok).groupBy("label", F.size("vec").alias("dim"), "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("vec").alias("vec"))
    classes = stored(classes)
    label_type = classes.schema["label"].dataType.simpleString()
    sizes = stored(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    forests = stored(fit_forests(classes, sizes, leaf, least, sample))
    parts = F.ceil(F.col("n") / PLACED).cast("int")
    dealt = spread_join(classes.select("label", "dim", "rep", "mult", "vec"), sizes, ["label", "dim"], "rep").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).drop("n")
    sent = forests.join(sizes, ["label", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    meet = dealt.groupBy("label", "dim", "part").cogroup(sent.groupBy("label", "dim", "part"))
    indexed = stored(meet.applyInArrow(_index, f"label {label_type}, dim int, rep long, mult long, raw binary, codes array<long>, own binary"))

    places = indexed.withColumn("code", F.explode("codes"))
    large = places.groupBy("label", "dim", "code").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    sized = places.join(large, ["label", "dim", "code"], "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / block).cast("int"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sized = sized.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    met = sized.select("label", "dim", "code", "i", "j", "rep", "mult", "raw", "own", "block").groupBy("label", "dim", "code", "i", "j").applyInArrow(_compare(least), "rep long, gained long, low long")
    met = stored(met)
    counts = met.groupBy("rep").agg(F.sum("gained").alias("gained"))
    joined = connected_components(met.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    known = classes.select("label", "h1", "h2", "rep", "mult").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "h1", "h2", (F.coalesce("gained", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    good = spread_join(v.where(ok).drop("vec"), known, ["label", "h1", "h2"], "id").select("id", "n_links", F.col("component").alias("component_id"))
    bad = v.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: All pairs of equal labels in double precision; components by the closure of links.
ORACLE = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
normed AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM fine),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
