"""Tables behind the usual figures: embeddings with centroids, marker heat maps, curves, and two-selection comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.model import AnnotatedMatrix
from cytoplane.operators import differential, masks, windows


def cluster_embedding(coords: DataFrame, cells: DataFrame, level: str, cluster: str | None = None, child: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((cell_id, x, y, label), (label, x, y, n)): coordinates of a cluster's cells by child cluster, and centroids."""
    c = cells if cluster is None else cells.where(F.col(level) == cluster)
    p = coords.join(c.select("cell_id", F.col(child or level).alias("label")), "cell_id")
    return p, p.groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def marker_heatmap(m: AnnotatedMatrix, markers: DataFrame, layer: str = "", k: int = 10, most_outside: float = 0.9) -> DataFrame:
    """(comparison, gene_id, cell_id, value) of the first k genes per cluster that fewer than most_outside of the other
    cells express; absent values are zeros left implicit."""
    best = windows.top_k(markers.where(F.col("FracExpr2") < most_outside).drop("rank"), ["comparison"], [F.desc_nulls_last("CommonLanguageEffectSize"), F.col("gene_id")], k)
    return m.layers[layer].join(best.select("comparison", "gene_id"), "gene_id").select("comparison", "gene_id", "cell_id", "value")


def colored_embedding(coords: DataFrame, m: AnnotatedMatrix, gene_id=None, attribute: str | None = None, layer: str = "") -> DataFrame:
    """(cell_id, x, y, color): a gene's value (0 where absent) or a cell attribute."""
    if attribute:
        return coords.join(m.cells.select("cell_id", F.col(attribute).alias("color")), "cell_id", "left")
    v = m.layers[layer].where(F.col("gene_id") == F.lit(gene_id)).select("cell_id", F.col("value").alias("color"))
    return coords.join(v, "cell_id", "left").withColumn("color", F.coalesce("color", F.lit(0.0)))


def enrichment_curves(scores: DataFrame, pathways: DataFrame, score: str = "score") -> DataFrame:
    """(pathway, rank, es) for every pathway (pathway, gene_id) that has a scored gene."""
    down = scores.withColumn("__down", -F.col(score)).withColumn("__one", F.lit(1))
    r = windows.running_total(down, ["__down", "gene_id"], "__one", "__rank").withColumn("rank", F.col("__rank").cast("int")).drop("__down", "__one", "__rank")
    names = pathways.join(scores.select("gene_id"), "gene_id", "left_semi").select("pathway").distinct()
    hit = pathways.select("pathway", "gene_id", F.lit(True).alias("hit")).distinct()
    return windows.running_enrichment(names.crossJoin(r).join(hit, ["pathway", "gene_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "rank", "hit", ["pathway"]).select("pathway", "rank", "es")


def in_view(coords: DataFrame, box: tuple[float, float, float, float], most: int, seed: int = 0) -> DataFrame:
    """About ``most`` of the points inside (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = box
    inside = coords.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).withColumn("__all", F.lit(1))
    return masks.bernoulli(inside, most, ["__all"], "cell_id", seed).drop("__all")


def compare_selections(m: AnnotatedMatrix, first: DataFrame, second: DataFrame, layer: str = "", n: int = 10) -> DataFrame:
    """The n genes highest in each of two selections of cells, by effect size."""
    sides = first.select(F.lit("selection").alias("comparison"), "cell_id", F.lit(1).alias("side")).unionByName(second.select(F.lit("selection").alias("comparison"), "cell_id", F.lit(2).alias("side")))
    d = differential.differential_expression(m, sides, layer).where("CommonLanguageEffectSize IS NOT NULL")
    return windows.top_and_bottom(d, "CommonLanguageEffectSize", "gene_id", n)

