"""The supplied tables read as an annotated matrix: suppliers as cells, parts as genes, summed quantities as counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.model import AnnotatedMatrix, from_tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """cells: cell_id, region, nation, path ('region-nation'), balance; genes: gene_id, gene, contig, start, size, price."""
    t = lambda n: table(spark, sf_dir, n)
    x = t("lineitem").select(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value"))
    nation = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("string").alias("region"))
    path = F.concat_ws("-", "region", F.col("s_nationkey").cast("string"))
    cells = t("supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("cell_id"), "region", F.col("s_nationkey").alias("nation"), path.alias("path"), F.col("s_acctbal").alias("balance"))
    genes = t("part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene"), F.col("p_brand").alias("contig"), F.col("p_partkey").alias("start"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    m = from_tables(x, cells, genes, t("lineitem").count())
    return m.subset(genes=None)


def normalized(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    from cytoplane.operators.layers import normalize_counts

    return normalize_counts(matrix(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


#: The same tables in SQL.
X = "x AS (SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
CELLS = "cells AS (SELECT s_suppkey AS cell_id, n_regionkey::VARCHAR AS region, s_nationkey AS nation, n_regionkey || '-' || s_nationkey AS path, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
GENES = "genes AS (SELECT p_partkey AS gene_id, p_name AS gene, p_brand AS contig, p_partkey AS start, p_size AS size, p_retailprice AS price FROM part)"
LOG = "lg AS (SELECT cell_id, gene_id, log2(1 + value * 10000.0 / sum(value) OVER (PARTITION BY cell_id)) AS value FROM x)"
BASE = f"WITH {X}, {CELLS}, {GENES}"
FULL = f"{BASE}, {LOG}"
#: Every cell and gene, zeros included.
DENSE = "d AS (SELECT c.cell_id, g.gene_id, coalesce(x.value, 0.0) AS value FROM cells c CROSS JOIN genes g LEFT JOIN x ON x.cell_id = c.cell_id AND x.gene_id = g.gene_id)"
