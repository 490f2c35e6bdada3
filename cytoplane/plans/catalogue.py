"""The registered queries on the matrix operators, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoplane.functions import pvalues, scalars
from cytoplane.model import combine
from cytoplane.operators import clustering, differential, diversity, genome, graph, groups, joins, layers, linalg, masks, mixtures, receptors, signatures, spatial, spectra, windows
from cytoplane.plans.fixtures import BASE, DENSE, FULL, GENES, X, matrix, normalized, table, vectors
from cytoplane.sources import readers, writers
from cytoplane.streaming import events as streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c: str | object, out: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    named = out or (c if isinstance(c, str) else None)
    x = F.round(col, 6) + F.lit(0.0)  # no negative zero
    return x.alias(named) if named else x


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, average per region, keep the ten highest genes of each region."""
    means = groups.cluster_means(normalized(spark, sf_dir), "region", "log")
    return windows.top_k(means, ["region"], [F.desc("mean"), F.col("gene_id")], 10).select("region", "gene_id", r6("mean"), "rank")


# ---- layers and quality


@query(f"WITH {X} SELECT cell_id, gene_id, value FROM x")
def matrix_build(spark, d):
    return matrix(spark, d).x


@query(f"{FULL} SELECT cell_id, gene_id, round(value, 6) AS value FROM lg")
def normalize_log2(spark, d):
    return normalized(spark, d).layers["log"].select("cell_id", "gene_id", r6("value"))


def _standardize_sql(key: str) -> str:
    return f"""{BASE}, {DENSE}, s AS (SELECT {key}, avg(value) AS m, var_pop(value) AS v FROM d GROUP BY 1)
    SELECT cell_id, gene_id, round((value - m) / CASE WHEN v <= 0 THEN 1 ELSE sqrt(v) END, 6) + 0.0 AS value FROM d JOIN s USING ({key})"""


@query(_standardize_sql("gene_id"))
def standardize_gene(spark, d):
    return layers.standardize(matrix(spark, d), "gene", out="s", digits=6).layers["s"]


@query(_standardize_sql("cell_id"))
def standardize_cell(spark, d):
    return layers.standardize(matrix(spark, d), "cell", out="s", digits=6).layers["s"]


@query(f"{BASE}, {DENSE} SELECT gene_id, round(var_pop(value), 6) AS gene_var FROM d GROUP BY 1")
def gene_variance(spark, d):
    return layers.gene_variances(matrix(spark, d)).genes.select("gene_id", r6("GeneVar", "gene_var"))


@query(f"""{BASE}, {DENSE}, v AS (SELECT gene_id, var_pop(value) AS gv FROM d GROUP BY 1),
bar AS (SELECT min(gv) AS b FROM (SELECT gv FROM v ORDER BY gv DESC LIMIT 51)) SELECT gene_id FROM v, bar WHERE round(gv, 6) > round(b, 6)""")
def variable_genes(spark, d):
    m = layers.gene_variances(matrix(spark, d))
    rounded = m.with_genes(m.genes.select("gene_id", r6("GeneVar")), overwrite=True)
    return layers.variable_genes(rounded, 50).select("gene_id")


MAD = "quantile_cont(abs(value - med), 0.5) / 0.6745"


@query(f"""{BASE}, {DENSE}, s AS (SELECT cell_id, sum(value) AS total, (count(*) FILTER (WHERE value > 0))::BIGINT AS n_gene, avg(value) AS m FROM d GROUP BY 1),
q AS (SELECT cell_id, quantile_cont(value, 0.5) AS med FROM d GROUP BY 1), md AS (SELECT cell_id, {MAD} AS mad FROM d JOIN q USING (cell_id) GROUP BY 1)
SELECT cell_id, round(total, 6) AS n_counts, n_gene, round(mad / m, 6) AS rel_mad FROM s JOIN md USING (cell_id)""")
def cell_qc(spark, d):
    c = layers.quality_metrics(matrix(spark, d), ribosomal=False, mitochondrial=False).cells
    return c.select("cell_id", r6("nCountsForCell", "n_counts"), F.col("nGene").alias("n_gene"), r6("AllGeneRelativeMeanAbsoluteDeviation", "rel_mad"))


@query(f"{BASE} SELECT g.gene_id, round(coalesce(sum(value), 0), 6) AS n_counts, (count(*) FILTER (WHERE value > 0))::BIGINT AS n_cell FROM genes g LEFT JOIN x ON x.gene_id = g.gene_id GROUP BY 1")
def gene_qc(spark, d):
    m = layers.moments(matrix(spark, d), "gene")
    return m.select("gene_id", r6("total", "n_counts"), F.col("nnz").alias("n_cell"))


@query(f"""{BASE}, {DENSE}, r AS (SELECT d.* FROM d JOIN genes USING (gene_id) WHERE starts_with(contig, 'Brand#2')),
s AS (SELECT cell_id, avg(value) AS m, max(value) AS hi, sum(value) AS t FROM r GROUP BY 1), q AS (SELECT cell_id, quantile_cont(value, 0.5) AS med FROM r GROUP BY 1),
md AS (SELECT cell_id, {MAD} AS mad FROM r JOIN q USING (cell_id) GROUP BY 1), a AS (SELECT cell_id, sum(value) AS total FROM d GROUP BY 1)
SELECT cell_id, round(mad / m, 6) AS rel_mad, round(hi / m, 6) AS max_over_mean, round(t / total, 6) AS fraction FROM s JOIN md USING (cell_id) JOIN a USING (cell_id)""")
def qc_prefix_fraction(spark, d):
    m = matrix(spark, d)
    x = layers.median_and_mad(m, "cell", only=m.genes.where(F.col("contig").startswith("Brand#2")))
    total = layers.moments(m, "cell").select("cell_id", "total")
    return x.join(total, "cell_id").select("cell_id", r6(F.try_divide("mad", "mean"), "rel_mad"), r6(F.try_divide("max", "mean"), "max_over_mean"), r6(F.try_divide(F.col("mean") * F.col("n"), F.col("total")), "fraction"))


# ---- groups


@query(f"""{FULL}, n AS (SELECT region, count(*) AS n FROM cells GROUP BY 1)
SELECT region, gene_id, round(sum(value) / any_value(n), 6) AS mean FROM lg JOIN cells USING (cell_id) JOIN n USING (region) GROUP BY 1, 2""")
def cluster_means(spark, d):
    return groups.cluster_means(normalized(spark, d), "region", "log").select("region", "gene_id", r6("mean"))


@query(f"""{FULL}, n AS (SELECT region, count(*) AS n FROM cells GROUP BY 1), s AS (SELECT region, gene_id, sum(value) / any_value(n) AS m FROM lg JOIN cells USING (cell_id) JOIN n USING (region) GROUP BY 1, 2)
SELECT g.gene_id, {', '.join(f'''round(coalesce(max(m) FILTER (WHERE region = '{i}'), 0), 6) AS r{i}''' for i in range(5))} FROM genes g LEFT JOIN s ON s.gene_id = g.gene_id GROUP BY 1""")
def pseudobulk_pivot(spark, d):
    p = groups.pseudobulk(normalized(spark, d), "region", [str(i) for i in range(5)], "log")
    return p.select("gene_id", *[r6(str(i), f"r{i}") for i in range(5)])


@query("SELECT c_nationkey AS nation, CASE WHEN count(c_acctbal) > 50 THEN round(avg(c_acctbal), 6) END AS balance FROM customer GROUP BY 1")
def patient_average(spark, d):
    return groups.group_average(table(spark, d, "customer"), "c_nationkey", ["c_acctbal"], 50).select(F.col("c_nationkey").alias("nation"), r6("c_acctbal", "balance"))


@query(f"""{FULL}, g AS (SELECT gene_id FROM genes WHERE contig = 'Brand#11'), n AS (SELECT region, count(*) AS n FROM cells GROUP BY 1),
s AS (SELECT region, gene_id, sum(value) AS s, count(*) FILTER (WHERE value > 0) AS k FROM lg JOIN cells USING (cell_id) GROUP BY 1, 2)
SELECT region, gene_id, round(coalesce(s, 0) / n, 6) AS mean, round(coalesce(k, 0) / n, 6) AS fraction FROM n CROSS JOIN g LEFT JOIN s USING (region, gene_id)""")
def dotplot_table(spark, d):
    m = normalized(spark, d)
    return groups.dot_plot_table(m, "region", m.genes.where("contig = 'Brand#11'"), "log").select("region", "gene_id", r6("mean"), r6("fraction"))


@query(f"""{FULL}, g AS (SELECT gene_id FROM genes WHERE contig = 'Brand#11'), n AS (SELECT region, count(*) AS n FROM cells GROUP BY 1),
s AS (SELECT region, gene_id, sum(value) AS s FROM lg JOIN cells USING (cell_id) GROUP BY 1, 2), t AS (SELECT region, gene_id, coalesce(s, 0) / n AS m FROM n CROSS JOIN g LEFT JOIN s USING (region, gene_id)),
u AS (SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi FROM t WINDOW w AS (PARTITION BY gene_id))
SELECT region, gene_id, CASE WHEN hi > lo THEN round((m - lo) / (hi - lo), 6) END AS mean FROM u""")
def dotplot_minmax(spark, d):
    m = normalized(spark, d)
    return groups.dot_plot_table(m, "region", m.genes.where("contig = 'Brand#11'"), "log", "minmax").select("region", "gene_id", r6("mean"))


@query("SELECT o_orderpriority AS priority, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY 1")
def metafield_breakdown(spark, d):
    return groups.breakdown(table(spark, d, "orders"), "o_orderstatus", "F", "o_orderpriority", 1000, "o_totalprice").withColumnRenamed("o_orderpriority", "priority")


@query("SELECT c_mktsegment AS segment, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def value_counts(spark, d):
    return groups.value_counts(table(spark, d, "customer"), "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN round(count(*) OVER (PARTITION BY c_mktsegment) / (count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') OVER ())::DOUBLE, 6) END AS frequency FROM customer""")
def value_frequency(spark, d):
    return groups.frequency(table(spark, d, "customer"), "c_mktsegment", blacklist=["BUILDING"], exclude_from_total=True).select("c_custkey", r6("frequency"))


@query("""SELECT c_custkey, round(count(*) OVER (PARTITION BY c_mktsegment) / (count(*) OVER (PARTITION BY c_nationkey))::DOUBLE, 6) AS frequency FROM customer""")
def value_frequency_grouped(spark, d):
    return groups.frequency(table(spark, d, "customer"), "c_mktsegment", second="c_nationkey").select("c_custkey", r6("frequency"))


STATUS, FLAG = ["F", "O", "P"], ["A", "N", "R"]


@query(f"SELECT o_orderpriority AS priority, {', '.join(f'''nullif(count(*) FILTER (WHERE o_orderstatus = '{s}'), 0)::BIGINT AS {s}''' for s in STATUS)} FROM orders GROUP BY 1")
def crosstab(spark, d):
    return groups.cross_table(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", STATUS).withColumnRenamed("o_orderpriority", "priority")


@query(f"SELECT o_orderpriority AS priority, {', '.join(f'''round(nullif(count(*) FILTER (WHERE o_orderstatus = '{s}'), 0) / (sum(count(*) FILTER (WHERE o_orderstatus = '{s}')) OVER ())::DOUBLE, 6) AS {s}''' for s in STATUS)} FROM orders GROUP BY 1")
def crosstab_norm0(spark, d):
    t = groups.cross_table(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", STATUS, 0)
    return t.select(F.col("o_orderpriority").alias("priority"), *[r6(s) for s in STATUS])


@query(f"SELECT o_orderpriority AS priority, {', '.join(f'''round(nullif(count(*) FILTER (WHERE o_orderstatus = '{s}'), 0) / count(*)::DOUBLE, 6) AS {s}''' for s in STATUS)} FROM orders GROUP BY 1")
def crosstab_norm1(spark, d):
    t = groups.cross_table(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", STATUS, 1)
    return t.select(F.col("o_orderpriority").alias("priority"), *[r6(s) for s in STATUS])


T2 = """c AS (SELECT o_orderstatus AS g, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2), gs AS (SELECT g, sum(n) AS gn FROM c GROUP BY 1), ks AS (SELECT k, sum(n) AS kn FROM c GROUP BY 1), t AS (SELECT sum(n) AS tn FROM c),
w AS (SELECT g, k, coalesce(n, 0)::BIGINT AS t11, (gn - coalesce(n, 0))::BIGINT AS t12, (kn - coalesce(n, 0))::BIGINT AS t21, (tn - gn - kn + coalesce(n, 0))::BIGINT AS t22 FROM gs CROSS JOIN ks CROSS JOIN t LEFT JOIN c USING (g, k))"""


@query(f"WITH {T2} SELECT * FROM w")
def complement_2x2(spark, d):
    return groups.complement_tables(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumnsRenamed({"o_orderstatus": "g", "o_orderpriority": "k"})


@query(f"""WITH {T2} SELECT g, k, round((t11::DOUBLE * t22 - t12::DOUBLE * t21) / (sqrt(t11 + t12) * sqrt(t21 + t22) * sqrt(t11 + t21) * sqrt(t12 + t22)), 6) AS phi,
round(t11 / (t11 + t21)::DOUBLE, 6) AS of_cluster, round(t11 / (t11 + t12)::DOUBLE, 6) AS of_group FROM w""")
def enrichment_phi(spark, d):
    e = groups.enrichment(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return e.select(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("k"), r6("phi"), r6("fraction_of_cluster", "of_cluster"), r6("fraction_of_group", "of_group"))


@query(f"""WITH {T2}, p AS (SELECT g, k, t11, i, lgamma(t11 + t12 + 1) + lgamma(t21 + t22 + 1) + lgamma(t11 + t21 + 1) + lgamma(t12 + t22 + 1) - lgamma(t11 + t12 + t21 + t22 + 1)
 - lgamma(i + 1) - lgamma(t11 + t12 - i + 1) - lgamma(t11 + t21 - i + 1) - lgamma(t22 - t11 + i + 1) AS l
FROM w, unnest(range(greatest(0, t11 - t22), least(t11 + t12, t11 + t21) + 1)) AS r(i)), o AS (SELECT g, k, l AS seen FROM p WHERE i = t11)
SELECT g, k, round(least(1.0, sum(exp(l)) FILTER (WHERE l <= seen + 1e-7)), 6) AS p FROM p JOIN o USING (g, k) GROUP BY 1, 2""")
def enrichment_fisher(spark, d):
    e = groups.complement_tables(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return e.select(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("k"), r6(pvalues.fisher_udf("t11", "t12", "t21", "t22"), "p"))


@query("SELECT user_id, count(*)::BIGINT AS n, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def joined_values(spark, d):
    e = table(spark, d, "events")
    return groups.joined_values(e, "user_id", "event_type", "+").withColumnRenamed("event_type", "kinds").join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")


@query("""WITH c AS (SELECT user_id, event_type, sum(value) > 500 AS pos FROM events GROUP BY 1, 2) SELECT user_id AS cell_id, CASE WHEN count(*) FILTER (WHERE pos) > 1 THEN 'doublet' WHEN count(*) FILTER (WHERE pos) = 0 THEN 'no replicate assigned' ELSE max(event_type) FILTER (WHERE pos) END AS assignment FROM c GROUP BY 1""")
def hashtag_assignment(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("tag")).agg((F.sum("value") > 500).alias("positive"))
    return groups.hashtag_assignment(c)


@query("""WITH n AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS n FROM customer GROUP BY 1, 2) SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY n DESC, y)::INT AS rank, n::BIGINT AS n, round(n / (sum(n) OVER (PARTITION BY x))::DOUBLE, 6) AS share FROM n""")
def repertoire_agnostic(spark, d):
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("x"), F.col("c_mktsegment").alias("y"))
    return groups.repertoire(t, "x", "y", normalize=True).withColumn("share", r6("share"))


@query("""WITH n AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS n FROM customer GROUP BY 1, 2), o AS (SELECT y, row_number() OVER (ORDER BY y)::INT AS rank FROM (SELECT DISTINCT y FROM n))
SELECT x, y, rank, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0)::DOUBLE, 6) AS share FROM (SELECT DISTINCT x FROM n) CROSS JOIN o LEFT JOIN n USING (x, y)""")
def repertoire_matched(spark, d):
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("x"), F.col("c_mktsegment").alias("y"))
    return groups.repertoire(t, "x", "y", matched=True).withColumn("share", r6("share"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem, unnest(range(l_quantity::BIGINT))")
def expand_counts(spark, d):
    return groups.expand_counts(table(spark, d, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey")


# ---- diversity

C = "c AS (SELECT event_type AS k, user_id AS s, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"


@query(f"WITH {C} SELECT s AS user_id, CASE WHEN sum(n) > 1 THEN round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 6) END AS simpson FROM c GROUP BY 1")
def simpson_by_group(spark, d):
    return diversity.simpson(table(spark, d, "events"), "event_type", ["user_id"]).select("user_id", r6("simpson"))


@query("WITH c AS (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT round(sum(n * n) / (sum(n) * sum(n)), 6) AS simpson FROM c")
def simpson(spark, d):
    return diversity.simpson(table(spark, d, "events"), "event_type", with_replacement=True).select(r6("simpson"))


@query("""WITH c AS (SELECT event_type, count(*)::DOUBLE AS y, (count(*) FILTER (WHERE value > 50))::DOUBLE AS yc FROM events GROUP BY 1) SELECT round(sum((y - 1) / (t - 1) * yc / tc), 6) AS conditional_simpson FROM c, (SELECT sum(y) AS t, sum(yc) AS tc FROM c)""")
def conditional_simpson(spark, d):
    return diversity.conditional_simpson(table(spark, d, "events").withColumn("big", F.col("value") > 50), "event_type", "big").select(r6("conditional_simpson"))


@query(f"""WITH {C}, t AS (SELECT k, coalesce(max(n) FILTER (WHERE s = 1), 0) AS a, coalesce(max(n) FILTER (WHERE s = 2), 0) AS b FROM c WHERE s IN (1, 2) GROUP BY 1)
SELECT round(2 * (sum(a * b) / (sum(a) * sum(b))) / (sum(a * a) / (sum(a) * sum(a)) + sum(b * b) / (sum(b) * sum(b))), 6) AS morisita FROM t""")
def morisita(spark, d):
    return diversity.morisita(table(spark, d, "events"), "event_type", "user_id", 1, 2).select(r6("morisita"))


@query(f"""WITH {C}, p AS (SELECT s, n / sum(n) OVER (PARTITION BY s) AS p, sum(n) OVER (PARTITION BY s) AS t, count(*) OVER (PARTITION BY s) AS m FROM c WHERE s IN (1, 2)),
h AS (SELECT s, any_value(t) AS t, -sum(p * ln(p)) AS h, (sum(p * ln(p) * ln(p)) - sum(p * ln(p)) * sum(p * ln(p))) / any_value(t) + (any_value(m) - 1) / (2 * any_value(t) * any_value(t)) AS v FROM p GROUP BY 1)
SELECT round((a.h - b.h) / sqrt(a.v + b.v), 6) AS t, round((a.v + b.v) * (a.v + b.v) / (a.v * a.v / a.t + b.v * b.v / b.t), 6) AS df, round(a.h, 6) AS diversity1, round(b.h, 6) AS diversity2 FROM h a, h b WHERE a.s = 1 AND b.s = 2""")
def hutcheson(spark, d):
    return diversity.hutcheson(table(spark, d, "events"), "event_type", "user_id", 1, 2).select(*[r6(c) for c in ("t", "df", "diversity1", "diversity2")])


# ---- masks, joins


@query(f"{BASE} SELECT cell_id, balance > CASE region WHEN '1' THEN 5000.0 ELSE 1000.0 END AS passes FROM cells")
def cluster_cutoff_mask(spark, d):
    return masks.over_cutoff(matrix(spark, d).cells, "balance", "region", 1000, {"1": 5000}).select("cell_id", "passes")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus <> 'P' AND o_custkey <= 500")
def predicate_query(spark, d):
    o = table(spark, d, "orders")
    return o.where(scalars.predicate(o, ["o_totalprice >= 1000", "o_orderstatus != P", "o_custkey <= 500"])).select("o_orderkey")


@query("""WITH a AS (SELECT 'all' AS l0, c_mktsegment AS l1, c_custkey FROM customer), s AS (SELECT l1, count(*) / (sum(count(*)) OVER ())::DOUBLE AS f FROM a GROUP BY 1)
SELECT c_custkey AS cell_id, f < 0.2 AND (SELECT max(f) FROM s) >= 0.2 AS outlier FROM a JOIN s USING (l1)""")
def outlier_levels(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.lit("all").alias("l0"), F.col("c_mktsegment").alias("l1"))
    return masks.minor_clusters(c, ["l0", "l1"], most=0.2, least=0.2).select("cell_id", "outlier")


@query("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), d AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a, p b),
n AS (SELECT id, d FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM d) WHERE rn = 11) SELECT id, round(d, 6) AS distance, round(d, 6) <= round((SELECT quantile_cont(d, 0.9) FROM n), 6) AS keep FROM n""")
def outlier_nth_neighbor(spark, d):
    p = vectors(spark, d).select("id", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    return masks.sparse_neighbourhoods(p, 10, 0.9, digits=6).select("id", r6("distance"), "keep")


SEG = "seg AS (SELECT contig, start, max(price) AS v, max(start + 60) AS e FROM genes WHERE gene_id % 40 = 0 GROUP BY 1, 2)"


def _segments(m):
    return m.genes.where("gene_id % 40 = 0").select("contig", "start", (F.col("start") + 60).alias("end"), F.col("price").alias("tau"))


@query(f"WITH {GENES}, {SEG} SELECT g.gene_id, round(s.v, 6) AS copy_ratio FROM genes g ASOF LEFT JOIN seg s ON g.contig = s.contig AND g.start >= s.start")
def copy_ratio_asof(spark, d):
    m = matrix(spark, d)
    return genome.copy_ratios(m.genes, _segments(m)).select("gene_id", r6("copy_ratio"))


WINDOWS = "n AS (SELECT gene_id, contig, row_number() OVER (PARTITION BY contig ORDER BY start, gene_id) - 1 AS rn, count(*) OVER (PARTITION BY contig) AS n FROM genes), w AS (SELECT contig, (s // 10)::INT AS window, gene_id FROM n, unnest(range(0, n - 20 + 1, 10)) AS u(s) WHERE rn >= s AND rn < s + 20)"


@query(f"WITH {GENES}, {SEG}, {WINDOWS}, r AS (SELECT g.gene_id, s.v FROM genes g ASOF JOIN seg s ON g.contig = s.contig AND g.start >= s.start) SELECT contig, \"window\", round(avg(v), 6) AS copy_ratio FROM w JOIN r USING (gene_id) GROUP BY 1, 2")
def window_copy_ratio(spark, d):
    m = matrix(spark, d)
    r = genome.copy_ratios(m.genes, _segments(m))
    return genome.window_copy_ratios(r.where("copy_ratio IS NOT NULL"), windows.gene_windows(m.genes, 20, 10)).select("contig", "window", r6("copy_ratio"))


@query("WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT count(*)::BIGINT AS n_keys, count(c_custkey)::BIGINT AS n_matched, round(count(c_custkey) / count(*)::DOUBLE, 6) AS rate FROM k LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) ON k = c_custkey")
def join_match_rate(spark, d):
    c = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k"))
    return joins.match_rate(c, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k").withColumn("rate", r6("rate"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 90 GROUP BY 1, 2) SELECT user_id, event_type, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT user_id FROM n) CROSS JOIN (SELECT DISTINCT event_type FROM n) LEFT JOIN n USING (user_id, event_type)")
def outer_zero_fill(spark, d):
    n = table(spark, d, "events").where("value > 90").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return joins.complete(n, "user_id", "event_type", "n")


@query("SELECT s_suppkey, s_name, t.target FROM supplier LEFT JOIN (SELECT c_nationkey AS k, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS target FROM customer GROUP BY 1) t ON s_nationkey = k")
def orthologs(spark, d):
    s = table(spark, d, "supplier")
    return joins.orthologs(s, table(spark, d, "customer"), "s_nationkey", "c_nationkey", "c_mktsegment", "target").select("s_suppkey", "s_name", "target")


# ---- windows


@query(f"WITH {X} SELECT cell_id, gene_id, rank() OVER (PARTITION BY cell_id ORDER BY value) + (count(*) OVER (PARTITION BY cell_id, value) - 1) / 2.0 AS r FROM x".replace("/ 2.0 AS r", "/ 2.0::DOUBLE AS r"))
def avg_rank(spark, d):
    return matrix(spark, d).x.select("cell_id", "gene_id", windows.average_rank("value", ["cell_id"]).alias("r"))


@query("""WITH e AS (SELECT list_sort(list_distinct(list(q))) AS e FROM (SELECT unnest(quantile_cont(p_retailprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS q FROM part))
SELECT p_partkey, greatest(len(list_filter(e, lambda x: x < p_retailprice)) - 1, 0)::INT AS bin FROM part, e""")
def qcut_bins(spark, d):
    return windows.quantile_bins(table(spark, d, "part"), "p_retailprice", 10).select("p_partkey", "bin")


@query(f"WITH {GENES}, {WINDOWS} SELECT contig, \"window\", gene_id FROM w")
def gene_windows(spark, d):
    return windows.gene_windows(matrix(spark, d).genes, 20, 10)


@query(f"""{BASE}, {WINDOWS}, v AS (SELECT w.contig, w."window", cell_id, value, row_number() OVER (PARTITION BY w.contig, w."window", cell_id ORDER BY value DESC, gene_id) AS rn FROM x JOIN w USING (gene_id))
SELECT contig, "window", cell_id, round(coalesce(sum(value) FILTER (WHERE rn > 3), 0) / 17, 6) AS mean FROM v GROUP BY 1, 2, 3""")
def robust_window_mean(spark, d):
    return genome.windowed_expression(matrix(spark, d), 20, 10, 3).select("contig", "window", "cell_id", r6("mean"))


@query("""WITH p AS (SELECT o_orderkey, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS rn, count(*) OVER () AS m FROM p)
SELECT o_orderkey, round(least(1.0, min(p * m / rn) OVER (ORDER BY p DESC, rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_adjust(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 % 10007) / 10007.0).alias("p"))
    return windows.bh_adjust(p, "p").select("o_orderkey", r6("q"))


RANKED = "sc AS (SELECT gene_id, sum(value) AS score FROM x GROUP BY 1), rk AS (SELECT gene_id, row_number() OVER (ORDER BY score DESC, gene_id) AS rank, contig = 'Brand#23' AS hit FROM sc JOIN genes USING (gene_id)), es AS (SELECT gene_id, rank, (count(*) FILTER (WHERE hit) OVER w) / (count(*) FILTER (WHERE hit) OVER ())::DOUBLE - (count(*) FILTER (WHERE NOT hit) OVER w) / (count(*) FILTER (WHERE NOT hit) OVER ())::DOUBLE AS es FROM rk WINDOW w AS (ORDER BY rank ROWS UNBOUNDED PRECEDING))"


def _scores(m):
    return m.x.groupBy("gene_id").agg(F.sum("value").alias("score"))


@query(f"{BASE}, {RANKED} SELECT gene_id, rank::INT AS rank, round(es, 6) AS es FROM es")
def es_curve(spark, d):
    m = matrix(spark, d)
    r = signatures.ranked_hits(_scores(m), m.genes.where("contig = 'Brand#23'"))
    return windows.running_enrichment(r, "rank", "hit").select("gene_id", "rank", r6("es"))


@query(f"{BASE}, {RANKED} SELECT round(arg_max(es, abs(es)), 6) AS es FROM es")
def gsea_es(spark, d):
    m = matrix(spark, d)
    return windows.enrichment_score(signatures.ranked_hits(_scores(m), m.genes.where("contig = 'Brand#23'")), "rank", "hit").select(r6("es"))


@query(f"""{BASE}, {RANKED}, pe AS (SELECT perm, gene_id, hit, row_number() OVER (PARTITION BY perm ORDER BY md5('0:' || perm || ':' || gene_id)) AS rank FROM rk, range(200) AS p(perm)),
pc AS (SELECT perm, (count(*) FILTER (WHERE hit) OVER w) / (count(*) FILTER (WHERE hit) OVER (PARTITION BY perm))::DOUBLE - (count(*) FILTER (WHERE NOT hit) OVER w) / (count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY perm))::DOUBLE AS es FROM pe WINDOW w AS (PARTITION BY perm ORDER BY rank ROWS UNBOUNDED PRECEDING)),
nu AS (SELECT perm, max(abs(es)) AS top FROM pc GROUP BY 1), ob AS (SELECT arg_max(es, abs(es)) AS es FROM es) SELECT round(es, 6) AS es, round(avg((abs(es) < top)::INT), 6) AS p FROM ob, nu GROUP BY es""")
def gsea_perm(spark, d):
    m = matrix(spark, d)
    return signatures.gsea(_scores(m), m.genes.where("contig = 'Brand#23'"), 200).select(r6("es"), r6("p"))


@query(f"""{FULL}, n AS (SELECT region, count(*) AS n FROM cells GROUP BY 1), s AS (SELECT region, gene_id, round(sum(value) / any_value(n), 6) AS mean FROM lg JOIN cells USING (cell_id) JOIN n USING (region) GROUP BY 1, 2)
SELECT region, gene_id, mean, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mean DESC, gene_id) AS rank FROM s) WHERE rank <= 10""")
def top_k_per_cluster(spark, d):
    s = groups.cluster_means(normalized(spark, d), "region", "log").select("region", "gene_id", r6("mean"))
    return windows.top_k(s, ["region"], [F.desc("mean"), F.col("gene_id")], 10)


@query("""(SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT o_orderkey, o_totalprice, 'bottom' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)""")
def top_bottom_n(spark, d):
    return windows.top_and_bottom(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


@query(f"""{FULL}, n AS (SELECT region, count(*) AS n FROM cells GROUP BY 1), s AS (SELECT region, gene_id, round(sum(value) / any_value(n), 6) AS mean FROM lg JOIN cells USING (cell_id) JOIN n USING (region) GROUP BY 1, 2),
{', '.join(f"t{i} AS (SELECT * FROM s WHERE region = '{i}'" + "".join(f" AND gene_id NOT IN (SELECT gene_id FROM t{j})" for j in range(i)) + " ORDER BY mean DESC, gene_id LIMIT 5)" for i in range(5))}
{' UNION ALL '.join(f"SELECT region, gene_id, mean FROM t{i}" for i in range(5))}""")
def first_owner_top(spark, d):
    s = groups.cluster_means(normalized(spark, d), "region", "log").select("region", "gene_id", r6("mean"))
    return windows.first_owner_top(s, "region", "gene_id", "mean", 5, ["0", "1", "2", "3", "4"])


@query("""WITH p AS (SELECT o_orderkey, o_totalprice / 1000 AS effect, ((o_orderkey * 7919 % 10007) / 10007.0::DOUBLE) ** 8 AS p FROM orders) SELECT o_orderkey, round(effect, 6) AS effect, round(-log10(greatest(p, 1e-300)), 6) AS minus_log10_p, -log10(greatest(p, 1e-300)) > 5 AS important FROM p""")
def volcano_table(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("e"), F.pow((F.col("o_orderkey") * 7919 % 10007) / 10007.0, F.lit(8.0)).alias("p"))
    return differential.volcano(p, "e", "p").select("o_orderkey", r6("effect"), r6("minus_log10_p"), "important")


@query("""SELECT o_orderkey, round((SELECT count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders b WHERE b.o_totalprice < a.o_totalprice) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::DOUBLE, 6) AS dominance FROM orders a""")
def dominance(spark, d):
    o = table(spark, d, "orders").withColumn("ref", F.col("o_orderstatus") == "F")
    return windows.dominance(o, "o_totalprice", "ref").select("o_orderkey", r6("dominance"))


# ---- combination


@query("SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def combine_matrices(spark, d):
    m = matrix(spark, d)
    return combine([m.subset(cells=F.col("cell_id") % 2 == i) for i in (0, 1)]).x


@query(f"{BASE}, a AS (SELECT * FROM x WHERE cell_id % 2 = 0 AND gene_id % 3 = 0 UNION ALL SELECT * FROM x WHERE cell_id % 2 = 1 AND gene_id % 5 = 0) SELECT g.gene_id, count(a.cell_id)::BIGINT AS n FROM (SELECT gene_id FROM genes WHERE gene_id % 3 = 0 OR gene_id % 5 = 0) g LEFT JOIN a USING (gene_id) GROUP BY 1")
def combine_misshaped(spark, d):
    m = matrix(spark, d)
    c = combine([m.subset(F.col("cell_id") % 2 == 0, F.col("gene_id") % 3 == 0), m.subset(F.col("cell_id") % 2 == 1, F.col("gene_id") % 5 == 0)])
    return c.genes.select("gene_id").join(c.x, "gene_id", "left").groupBy("gene_id").agg(F.count("cell_id").alias("n"))


@query(f"{BASE} SELECT x.* FROM x JOIN cells USING (cell_id) JOIN genes USING (gene_id) WHERE region = '2' AND size <= 5")
def subset_cells_genes(spark, d):
    return matrix(spark, d).subset(F.col("region") == "2", F.col("size") <= 5).x


# ---- scalars


@query(f"""WITH k AS (SELECT p_partkey, upper(regexp_replace(replace(p_name, ' ', ''), '[bjouxzBJOUXZ]', '-', 'g')) AS s FROM part), h AS (SELECT p_partkey, replace(s, '-', '') AS s FROM k)
SELECT p_partkey, CASE WHEN len(s) > 0 THEN round(list_sum(list_transform(string_split(s, ''), lambda c: CASE c {' '.join(f"WHEN '{k}' THEN {v}" for k, v in scalars.HYDROPATHY.items())} END::DOUBLE)) / len(s), 6) END AS gravy FROM h""")
def gravy(spark, d):
    s = F.upper(F.regexp_replace(F.regexp_replace("p_name", " ", ""), "[bjouxzBJOUXZ]", "-"))
    return table(spark, d, "part").select("p_partkey", r6(scalars.gravy(s), "gravy"))


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INT AS d FROM nation a JOIN nation b ON a.n_name < b.n_name")
def levenshtein_pairs(spark, d):
    n = table(spark, d, "nation").select("n_name")
    return n.alias("a").join(n.alias("b"), F.col("a.n_name") < F.col("b.n_name")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.levenshtein(F.col("a.n_name"), F.col("b.n_name")).alias("d"))


TCR = "t AS (SELECT p_partkey, (p_size % 5)::VARCHAR AS sample, CASE WHEN p_partkey % 4 = 0 THEN p_type || '---' || p_brand ELSE p_type END || '|' || CASE WHEN p_partkey % 3 = 0 THEN p_brand || '---' || p_type ELSE p_brand END AS tcr FROM part)"


def _tcrs(spark, d):
    p = table(spark, d, "part")
    a = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_type", F.lit("---"), "p_brand")).otherwise(F.col("p_type"))
    b = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("---"), "p_type")).otherwise(F.col("p_brand"))
    return p.select("p_partkey", (F.col("p_size") % 5).cast("string").alias("sample"), receptors.join_chains(a, b).alias("tcr"))


PARSED = "SELECT *, split_part(tcr, '|', 1) AS tra, split_part(split_part(tcr, '|', 2), '_', 1) AS trb FROM"
CHAINS = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, '---')) END::INT"


@query(f"WITH {TCR} SELECT p_partkey, tra, trb, {CHAINS.format('tra')} AS n_tra, {CHAINS.format('trb')} AS n_trb FROM ({PARSED} t)")
def tcr_parse(spark, d):
    return receptors.parse(_tcrs(spark, d)).select("p_partkey", "tra", "trb", "n_tra", "n_trb")


@query(f"WITH {TCR} SELECT sample, tcr, counts, {CHAINS.format('tra')} AS n_tra, {CHAINS.format('trb')} AS n_trb FROM ({PARSED} (SELECT sample, tcr, count(*)::BIGINT AS counts FROM t GROUP BY 1, 2))")
def tcr_counts(spark, d):
    return receptors.clone_counts(_tcrs(spark, d)).select("sample", "tcr", "counts", "n_tra", "n_trb")


def _pair_terms() -> str:
    return """pr AS (SELECT sample, tra, trb, counts FROM cl WHERE n_tra = 1 AND n_trb = 1), tot AS (SELECT sample, sum(counts) AS total FROM cl GROUP BY 1),
w AS (SELECT sample, tcr, counts, string_split(tra, '---') AS a, string_split(trb, '---') AS b FROM cl WHERE n_tra = 2 AND n_trb = 2),
c AS (SELECT sample, tcr, counts, a[1] AS a1, b[1] AS b1, a[2] AS a2, b[2] AS b2 FROM w UNION ALL SELECT sample, tcr, counts, a[2], b[1], a[1], b[2] FROM w),
j AS (SELECT c.*, p.counts AS x1, q.counts AS x2, total FROM c JOIN tot USING (sample) LEFT JOIN pr p ON p.sample = c.sample AND p.tra = a1 AND p.trb = b1 LEFT JOIN pr q ON q.sample = c.sample AND q.tra = a2 AND q.trb = b2),
l AS (SELECT *, x * ln((0.05 / 0.95) ** 2) + lgamma(x1 + counts + 1) - lgamma(x + 1) - lgamma(x1 + counts - x + 1) + lgamma(total - x2 - counts + 1) - lgamma(x1 + counts - x + 1) - lgamma(total - x2 - counts - (x1 + counts - x) + 1) AS lt
 FROM j, unnest(range(1, counts + least(x1, x2) + 1)) AS u(x) WHERE x1 > 0 AND x2 > 0 AND total - x2 - counts >= x1 + counts - x),
g AS (SELECT sample, tcr, a1, b1, max(lt) AS top FROM l GROUP BY 1, 2, 3, 4),
pv AS (SELECT sample, tcr, a1, b1, sum(exp(lt - top)) FILTER (WHERE x >= counts) / sum(exp(lt - top)) AS p FROM l JOIN g USING (sample, tcr, a1, b1) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {TCR}, cl AS (SELECT sample, tcr, counts, tra, trb, {CHAINS.format('tra')} AS n_tra, {CHAINS.format('trb')} AS n_trb FROM ({PARSED} (SELECT sample, tcr, count(*)::BIGINT AS counts FROM t GROUP BY 1, 2))), {_pair_terms()} SELECT sample, tcr, round(max(p), 6) AS p FROM w LEFT JOIN pv USING (sample, tcr) GROUP BY 1, 2")
def tcr_doublets(spark, d):
    return receptors.doublet_likelihood(receptors.clone_counts(_tcrs(spark, d)), 2, 2).select("sample", "tcr", r6("p"))


@query()
def tcr_summary(spark, d):
    return receptors.summary(_tcrs(spark, d)).select("sample", "tcr", "counts", "n_tra", "n_trb", r6("p"), r6("q"), "pair")


@query(f"""WITH {TCR}, c AS (SELECT DISTINCT tcr, string_split(tra, '---') AS ta, string_split(trb, '---') AS tb FROM ({PARSED} t)),
least_d AS (SELECT l.tcr AS a, r.tcr AS b, list_min(flatten(list_transform(l.ta, lambda u: list_transform(r.ta, lambda v: levenshtein(u, v))))) AS da, list_min(flatten(list_transform(l.tb, lambda u: list_transform(r.tb, lambda v: levenshtein(u, v))))) AS db FROM c l JOIN c r ON l.tcr < r.tcr)
SELECT a, b, (da + db)::INT AS d FROM least_d""")
def tcr_distances(spark, d):
    return receptors.pair_distances(receptors.parse(_tcrs(spark, d)))


@query(f"""WITH {TCR}, c AS (SELECT DISTINCT tcr, string_split(tra, '---') AS ta, string_split(trb, '---') AS tb FROM ({PARSED} t)),
least_d AS (SELECT l.tcr AS a, r.tcr AS b, list_min(flatten(list_transform(l.ta, lambda u: list_transform(r.ta, lambda v: levenshtein(u, v))))) AS da, list_min(flatten(list_transform(l.tb, lambda u: list_transform(r.tb, lambda v: levenshtein(u, v))))) AS db FROM c l JOIN c r ON l.tcr < r.tcr)
SELECT a, b, (da + db)::INT AS d FROM least_d WHERE da + db <= 2""")
def tcr_near_pairs(spark, d):
    return receptors.near_pairs(receptors.parse(_tcrs(spark, d)), 2)


@query("""WITH RECURSIVE p AS (SELECT DISTINCT p_name AS p FROM part), e AS (SELECT a.p AS u, b.p AS v FROM p a, p b WHERE levenshtein(a.p, b.p) <= 1),
r(p, c) AS (SELECT p, p FROM p UNION SELECT r.p, e.v FROM r JOIN e ON e.u = r.c), m AS (SELECT p, min(c) AS c FROM r GROUP BY 1),
f AS (SELECT DISTINCT a.c FROM m a JOIN m b ON a.c = b.c WHERE levenshtein(a.p, b.p) > 6) SELECT p AS peptide, CASE WHEN c IN (SELECT c FROM f) THEN '-1' ELSE c END AS cluster FROM m""")
def clonotype_components(spark, d):
    return receptors.cluster_peptides(table(spark, d, "part").select(F.col("p_name").alias("peptide")), "peptide")


@query("""SELECT page_id, regexp_replace(regexp_replace('gene_id "g' || page_id || '"; gene_name "' || url || '"; exon_number "' || (page_id % 7) || '";', '(gene_id "[^"]*)"', '\\1-exon' || (page_id % 7) || '"'), '(gene_name "[^"]*)"', '\\1-exon' || (page_id % 7) || '"') AS attribute FROM pages""")
def gtf_rewrite(spark, d):
    a = F.concat(F.lit('gene_id "g'), "page_id", F.lit('"; gene_name "'), "url", F.lit('"; exon_number "'), F.col("page_id") % 7, F.lit('";'))
    return table(spark, d, "pages").select("page_id", scalars.exon_attributes(a).alias("attribute"))


@query("""WITH p AS (SELECT o_orderkey, ((o_orderkey * 7919 % 10007) / 10007.0::DOUBLE) ** 4 AS p FROM orders) SELECT o_orderkey, CASE WHEN p >= 0.05 THEN 'n.s.' WHEN p >= 0.01 THEN '*' WHEN p <= 0.0001 THEN '****' ELSE repeat('*', least(4, floor(-log10(p)))::INT) END AS stars FROM p""")
def stars(spark, d):
    p = F.pow((F.col("o_orderkey") * 7919 % 10007) / 10007.0, F.lit(4.0))
    return table(spark, d, "orders").select("o_orderkey", scalars.stars(p).alias("stars"))


@query("""WITH s AS (SELECT o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')), a AS (SELECT count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM s WHERE g = 'F'), b AS (SELECT count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM s WHERE g = 'O')
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)), 6) AS cohens_d, round((a.m - b.m) / sqrt(b.s), 6) AS glass_delta FROM a, b""")
def effect_sizes(spark, d):
    o = table(spark, d, "orders")
    return o.agg(r6(scalars.cohens_d("o_totalprice", "o_orderstatus", "F", "O"), "cohens_d"), r6(scalars.glass_delta("o_totalprice", "o_orderstatus", "F", "O"), "glass_delta"))


@query(f"""{FULL}, sets AS (SELECT gene_id, CASE contig WHEN 'Brand#11' THEN 'a' WHEN 'Brand#12' THEN 'b' END AS k FROM genes WHERE contig IN ('Brand#11', 'Brand#12')), n AS (SELECT k, count(*) AS n FROM sets GROUP BY 1),
s AS (SELECT c.cell_id, n.k, coalesce((SELECT sum(value) FROM lg JOIN sets USING (gene_id) WHERE lg.cell_id = c.cell_id AND sets.k = n.k), 0) / n.n AS m FROM cells c CROSS JOIN n),
z AS (SELECT cell_id, k, (m - avg(m) OVER w) / stddev_samp(m) OVER w AS z FROM s WINDOW w AS (PARTITION BY k)), q AS (SELECT cell_id, max(z) FILTER (WHERE k = 'a') AS x, max(z) FILTER (WHERE k = 'b') AS y FROM z GROUP BY 1)
SELECT cell_id, round(x, 6) AS g1s, round(y, 6) AS g2m, round(degrees(CASE WHEN atan2(y, x) - atan2(-1, -1) < 0 THEN atan2(y, x) - atan2(-1, -1) + 2 * pi() ELSE atan2(y, x) - atan2(-1, -1) END), 5) AS angle FROM q""")
def cell_cycle_angle(spark, d):
    m = normalized(spark, d)
    a = signatures.cell_cycle_angle(m, m.genes.where("contig = 'Brand#11'"), m.genes.where("contig = 'Brand#12'"), "log")
    return a.select("cell_id", r6("g1s"), r6("g2m"), F.round("angle", 5).alias("angle"))


# ---- differential expression


def _rank_sum_sql(sides: str, select: str = "*") -> str:
    """U and friends over dense values, for (comparison, cell_id, side)."""
    return f"""{FULL}, sd AS ({sides}), dd AS (SELECT s.comparison, s.side, g.gene_id, coalesce(lg.value, 0.0) AS value FROM sd s CROSS JOIN genes g LEFT JOIN lg ON lg.cell_id = s.cell_id AND lg.gene_id = g.gene_id WHERE g.gene_id IN (SELECT gene_id FROM x)),
rr AS (SELECT *, rank() OVER (PARTITION BY comparison, gene_id ORDER BY value) + (count(*) OVER (PARTITION BY comparison, gene_id, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY comparison, gene_id, value) AS t FROM dd),
g AS (SELECT comparison, gene_id, count(*) FILTER (WHERE side = 1)::DOUBLE AS n1, count(*) FILTER (WHERE side = 2)::DOUBLE AS n2, sum(r) FILTER (WHERE side = 1) AS r1, sum(t::DOUBLE * t - 1) AS ties,
 avg(value) FILTER (WHERE side = 1) AS m1, avg(value) FILTER (WHERE side = 2) AS m2, avg(2 ** value) FILTER (WHERE side = 1) AS e1, avg(2 ** value) FILTER (WHERE side = 2) AS e2,
 count(*) FILTER (WHERE side = 1 AND value > 0) / (count(*) FILTER (WHERE side = 1))::DOUBLE AS f1, count(*) FILTER (WHERE side = 2 AND value > 0) / (count(*) FILTER (WHERE side = 2))::DOUBLE AS f2, max(value) > 0 AS seen, max(value) FILTER (WHERE side = 1) = min(value) FILTER (WHERE side = 1) AND max(value) FILTER (WHERE side = 2) = min(value) FILTER (WHERE side = 2) AS flat FROM rr GROUP BY 1, 2),
o AS (SELECT comparison, gene_id, r1 - n1 * (n1 + 1) / 2 AS u, n1, n2, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z, m1, m2, e1, e2, f1, f2, flat FROM g WHERE seen)
SELECT {select} FROM o"""


def _erfc(x: str) -> str:
    """The complementary error function of a number, by a series of positive terms."""
    return f"CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > 8 THEN 0.0 ELSE 1 - list_sum(list_transform(range(250), lambda k: exp(-({x}) * ({x}) + (2 * k + 1) * ln({x}) - lgamma(k + 1.5::DOUBLE)))) END"


DE_COLS = "comparison, gene_id, round(u, 6) AS u, CASE WHEN NOT flat THEN round(z, 5) END AS z, CASE WHEN NOT flat THEN round(u / (n1 * n2), 6) END AS cles, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(log2(e1) - log2(e2), 5) AS lfc, round(f1, 6) AS frac1, round(f2, 6) AS frac2"


def _de_cols(t):
    return t.select("comparison", "gene_id", r6("u"), (F.round("z", 5) + 0.0).alias("z"), r6("CommonLanguageEffectSize", "cles"), r6("MeanExpr1", "mean1"), r6("MeanExpr2", "mean2"), (F.round("Log2FoldChange", 5) + 0.0).alias("lfc"), r6("FracExpr1", "frac1"), r6("FracExpr2", "frac2"))


@query(_rank_sum_sql("SELECT '1' AS comparison, cell_id, CASE WHEN region = '1' THEN 1 ELSE 2 END AS side FROM cells", DE_COLS))
def de_mannwhitney(spark, d):
    m = normalized(spark, d)
    return _de_cols(differential.rank_sum(m, differential.sides_of(m.cells, "region", ["1"]), "log", with_p=False))


@query(_rank_sum_sql("SELECT a.path AS comparison, c.cell_id, CASE WHEN c.path = a.path THEN 1 ELSE 2 END AS side FROM (SELECT DISTINCT region, path FROM cells) a JOIN cells c ON c.region = a.region WHERE a.region IN (SELECT region FROM cells GROUP BY 1 HAVING count(DISTINCT path) > 1)", DE_COLS))
def de_all_levels(spark, d):
    m = normalized(spark, d)
    return _de_cols(differential.sibling_rank_sum(m, "path", "log", with_p=False))


@query(_rank_sum_sql("SELECT '1' AS comparison, cell_id, CASE WHEN region = '1' THEN 1 ELSE 2 END AS side FROM cells", "gene_id, p, q").replace("SELECT gene_id, p, q FROM o", f""", pv AS (SELECT gene_id, CASE WHEN flat THEN 1.0 ELSE least(1.0, {_erfc("z / sqrt(2)")}) END AS p FROM o), rp AS (SELECT *, row_number() OVER (ORDER BY p, gene_id) AS rn, count(*) OVER () AS m FROM pv)
SELECT gene_id, round(p, 6) AS p, round(least(1.0, min(p * m / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM rp"""))
def de_with_p(spark, d):
    m = normalized(spark, d)
    return differential.differential_expression(m, differential.sides_of(m.cells, "region", ["1"]), "log").select("gene_id", r6("p"), r6("BenjaminiHochbergQ", "q"))


@query(_rank_sum_sql("SELECT a.region AS comparison, c.cell_id, CASE WHEN c.region = a.region THEN 1 ELSE 2 END AS side FROM (SELECT DISTINCT region FROM cells) a CROSS JOIN cells c", "comparison, gene_id, rank::INT AS rank, cles") .replace("SELECT comparison, gene_id, rank::INT AS rank, cles FROM o", ", e AS (SELECT comparison, gene_id, CASE WHEN NOT flat THEN round(u / (n1 * n2), 6) END AS cles FROM o WHERE m1 > m2) SELECT * FROM (SELECT comparison, gene_id, row_number() OVER (PARTITION BY comparison ORDER BY cles DESC NULLS LAST, gene_id)::INT AS rank, cles FROM e) WHERE rank <= 20"))
def de_markers(spark, d):
    return differential.markers(normalized(spark, d), "region", "log", 20).select("comparison", "gene_id", "rank", r6("CommonLanguageEffectSize", "cles"))


@query()
def de_pseudobulk(spark, d):
    m = normalized(spark, d)
    v = groups.cluster_means(m, "nation", "log").select("gene_id", "nation", F.col("mean").alias("value"))
    return differential.replicate_tests(v, "nation", [0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11])


@query(f"""{FULL}, ry AS (SELECT cell_id, rank() OVER (ORDER BY balance) + (count(*) OVER (PARTITION BY balance) - 1) / 2.0::DOUBLE AS ry FROM cells), dd AS (SELECT c.cell_id, g.gene_id, coalesce(value, 0.0) AS value FROM cells c CROSS JOIN (SELECT DISTINCT gene_id FROM x) g LEFT JOIN lg USING (cell_id, gene_id)),
rx AS (SELECT cell_id, gene_id, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0::DOUBLE AS rx FROM dd) SELECT gene_id, round(corr(rx, ry), 6) AS rho FROM rx JOIN ry USING (cell_id) GROUP BY 1""")
def spearman_de(spark, d):
    m = normalized(spark, d)
    return differential.spearman(m, m.cells.select("cell_id", F.col("balance").alias("covariate")), "log", with_p=False).select("gene_id", r6("rho"))


@query(f"""{BASE}, v AS (SELECT cell_id, value AS a, price AS b FROM x JOIN genes USING (gene_id)), p AS (SELECT u.cell_id, sign(u.a - w.a) AS s, sign(u.b - w.b) AS t FROM v u JOIN v w USING (cell_id))
SELECT cell_id, round(sum(s * t) / (sqrt(sum(abs(s))) * sqrt(sum(abs(t)))), 6) AS tau FROM p GROUP BY 1""")
def kendall_cells(spark, d):
    m = matrix(spark, d)
    return differential.kendall_by(m.x.join(m.genes.select("gene_id", "price"), "gene_id"), "cell_id", "value", "price").select("cell_id", r6("tau"))


@query(f"""{BASE}, v AS (SELECT cell_id, gene_id::DOUBLE AS a, value AS b FROM x) SELECT u.cell_id, round(quantile_cont((w.b - u.b) / (w.a - u.a), 0.5), 6) AS slope FROM v u JOIN v w ON u.cell_id = w.cell_id AND u.a < w.a GROUP BY 1""")
def theil_sen(spark, d):
    v = matrix(spark, d).x.withColumn("a", F.col("gene_id").cast("double"))
    return differential.theil_sen(v, "cell_id", "a", "value").select("cell_id", r6("slope"))


@query(f"""WITH d AS (SELECT a.event_type AS c, b.value AS v, a.event_type = b.event_type AS one FROM (SELECT DISTINCT event_type FROM events) a CROSS JOIN events b), r AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY c, v)::DOUBLE AS k FROM d),
g AS (SELECT c, (count(*) FILTER (WHERE one))::BIGINT AS n1, (count(*) FILTER (WHERE NOT one))::BIGINT AS n2, sum(r) FILTER (WHERE one) AS r1, sum(k * k - 1) AS ties, avg(v) FILTER (WHERE one) AS m1, avg(v) FILTER (WHERE NOT one) AS m2, var_samp(v) FILTER (WHERE one) AS s1, var_samp(v) FILTER (WHERE NOT one) AS s2 FROM r GROUP BY 1),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1::DOUBLE * n2 AS nn, (n1 + n2)::DOUBLE AS n FROM g), z AS (SELECT *, (greatest(u, nn - u) - nn / 2 - 0.5) / sqrt(nn / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
SELECT c AS event_type, n1, n2, round(least(1.0, {_erfc("z / sqrt(2)")}), 6) AS p, round((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)), 6) + 0.0 AS cohens_d, round(u / nn, 6) AS cles FROM z""")
def category_tests(spark, d):
    t = differential.category_tests(table(spark, d, "events"), "event_type", "value")
    return t.select("event_type", "n1", "n2", r6("p"), r6("cohens_d"), r6("cles"))


# ---- signatures, genome


@query(f"""{FULL}, mu AS (SELECT gene_id, coalesce(sum(value), 0) / (SELECT count(*) FROM cells) AS m FROM genes LEFT JOIN lg USING (gene_id) GROUP BY 1), e AS (SELECT list_sort(list_distinct(list(q))) AS e FROM (SELECT unnest(quantile_cont(m, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS q FROM mu)),
b AS (SELECT gene_id, greatest(len(list_filter(e, lambda x: x < m)) - 1, 0) AS bin, contig = 'Brand#23' AS own FROM mu JOIN genes USING (gene_id), e), k AS (SELECT bin, 5 * count(*) AS k FROM b WHERE own GROUP BY 1),
c AS (SELECT gene_id FROM (SELECT gene_id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('0:' || gene_id)) AS rn FROM b WHERE NOT own) JOIN k USING (bin) WHERE rn <= k),
s AS (SELECT cell_id, sum(value) FILTER (WHERE gene_id IN (SELECT gene_id FROM b WHERE own)) AS a, sum(value) FILTER (WHERE gene_id IN (SELECT gene_id FROM c)) AS z FROM lg GROUP BY 1)
SELECT cell_id, round(coalesce(a, 0) / (SELECT count(*) FROM b WHERE own) - coalesce(z, 0) / (SELECT count(*) FROM c), 6) AS score FROM cells LEFT JOIN s USING (cell_id)""")
def module_score(spark, d):
    m = normalized(spark, d)
    return signatures.module_score(m, m.genes.where("contig = 'Brand#23'"), "log").select("cell_id", r6("score"))


@query()
def malignancy_score(spark, d):
    m = normalized(spark, d)
    kind = m.cells.select("cell_id", F.when(F.col("balance") > 5000, "malignant").otherwise("normal").alias("kind"))
    return genome.malignancy(m.with_cells(kind), "region", "kind", "malignant", 20, 10, 2, "log")


@query()
def dna_correspondence(spark, d):
    m = matrix(spark, d)
    return genome.correspondence(m, {"one": _segments(m)})


@query(f"""{BASE}, {WINDOWS}, v AS (SELECT w.contig, w."window", cell_id, value, row_number() OVER (PARTITION BY w.contig, w."window", cell_id ORDER BY value DESC, gene_id) AS rn FROM x JOIN w USING (gene_id)),
me AS (SELECT contig, "window", cell_id, round(coalesce(sum(value) FILTER (WHERE rn > 3), 0) / 17, 9) AS mean FROM v GROUP BY 1, 2, 3)
SELECT contig, "window", cell_id, rank() OVER (PARTITION BY cell_id ORDER BY mean) + (count(*) OVER (PARTITION BY cell_id, mean) - 1) / 2.0::DOUBLE AS rank FROM me""")
def wme_ranks(spark, d):
    means = genome.windowed_expression(matrix(spark, d), 20, 10, 3).withColumn("mean", F.round("mean", 9))
    return genome.window_ranks(means).select("contig", "window", "cell_id", "rank")


# ---- linear algebra and clustering


@query("""WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id AS cell_id, p AS pc, round(sum(v * ((i * p) % 7 - 3)), 5) AS score FROM l, unnest([1, 2, 3]) AS u(p) GROUP BY 1, 2""")
def pca_scores_given_loadings(spark, d):
    from cytoplane.model import AnnotatedMatrix

    v = vectors(spark, d)
    x = v.select(F.col("id").alias("cell_id"), F.posexplode("vec").alias("p", "v")).select("cell_id", (F.col("p") + 1).cast("long").alias("gene_id"), F.col("v").cast("double").alias("value"))
    load = spark.range(1, 65).select(F.col("id").alias("gene_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("pc")).withColumn("loading", ((F.col("gene_id") * F.col("pc")) % 7 - 3).cast("double"))
    m = AnnotatedMatrix({"": x}, v.select(F.col("id").alias("cell_id")), load.select("gene_id").distinct())
    return linalg.scores(m, load).select("cell_id", "pc", (F.round("score", 5) + 0.0).alias("score"))


@query("""WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM l GROUP BY 1, 2) SELECT vec_id AS id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS similarity FROM l JOIN c USING (label, i) GROUP BY 1""")
def cosine_to_centroid(spark, d):
    return linalg.cosine_to_centroid(vectors(spark, d), "label").select("id", r6("similarity"))


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT count(*)::DOUBLE AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), f AS (SELECT *, (n ** (-1.0 / 6)) ** 2 AS f FROM s),
g AS (SELECT i, j, x0 + i * (x1 - x0) / 19 AS gx, y0 + j * (y1 - y0) / 19 AS gy, n, vx * f AS vx, vy * f AS vy, vxy * f AS vxy FROM f, range(20) AS a(i), range(20) AS b(j))
SELECT i::INT AS i, j::INT AS j, round(sum(exp(-(vy * (gx - x) ** 2 - 2 * vxy * (gx - x) * (gy - y) + vx * (gy - y) ** 2) / (vx * vy - vxy * vxy) / 2)) / any_value(n * 2 * pi() * sqrt(vx * vy - vxy * vxy)), 4) AS density FROM g, p GROUP BY 1, 2""")
def kde_grid(spark, d):
    p = vectors(spark, d).select(F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    return linalg.kde_grid(p, 20).select("i", "j", F.round("density", 4).alias("density"))


@query("""WITH l AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label < 5 AS low FROM embeddings), box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l),
s AS (SELECT low, count(*)::DOUBLE AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM l GROUP BY 1), f AS (SELECT *, (n ** (-1.0 / 6)) ** 2 AS f FROM s),
g AS (SELECT low, i, j, x0 + i * (x1 - x0) / 19 AS gx, y0 + j * (y1 - y0) / 19 AS gy, n, vx * f AS vx, vy * f AS vy, vxy * f AS vxy FROM f, box, range(20) AS a(i), range(20) AS b(j)),
de AS (SELECT g.low, i, j, gx, gy, sum(exp(-(vy * (gx - x) ** 2 - 2 * vxy * (gx - x) * (gy - y) + vx * (gy - y) ** 2) / (vx * vy - vxy * vxy) / 2)) / any_value(n * 2 * pi() * sqrt(vx * vy - vxy * vxy)) AS density FROM g JOIN l ON l.low = g.low GROUP BY 1, 2, 3, 4, 5)
SELECT i::INT AS i, j::INT AS j, round(any_value(gx), 4) AS gx, round(any_value(gy), 4) AS gy, round(sum(CASE WHEN low THEN density ELSE -density END), 4) + 0.0 AS density FROM de GROUP BY i, j""")
def kde_difference(spark, d):
    p = vectors(spark, d).select(F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"), (F.col("label") < 5).alias("low"))
    return linalg.kde_difference(p, "low", 20).select("i", "j", F.round("gx", 4).alias("gx"), F.round("gy", 4).alias("gy"), (F.round("density", 4) + 0.0).alias("density"))


@query()
def pca_fit(spark, d):
    m = layers.gene_variances(normalized(spark, d), "log")
    load, _ = linalg.pca(m, 5, "log", layers.variable_genes(m, 100))
    return load


@query()
def nmf(spark, d):
    m = layers.gene_variances(normalized(spark, d), "log")
    some = m.subset(genes=None)
    genes = layers.variable_genes(some, 60).select("gene_id")
    return linalg.nmf(m.with_layer("v", m.layers["log"].join(genes, "gene_id", "left_semi")), 4, "v", 20)[1]


@query()
def diffusion(spark, d):
    return linalg.diffusion(vectors(spark, d), 0.5, 5, blocks=True)


@query()
def diffusion_neighbours(spark, d):
    return spectra.diffusion_on_neighbours(vectors(spark, d), 0.5, 5)


@query("""WITH l AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS src, b.id AS dst, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM l a JOIN l b ON a.id <> b.id)
SELECT src, dst, rank::INT AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM p) WHERE rank <= 5""")
def knn_graph(spark, d):
    n = graph.nearest(vectors(spark, d), 8).select("src", "dst", r6("distance"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where("rank <= 5")


@query("""WITH l AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT label, count(*) AS n FROM l GROUP BY 1), p AS (SELECT a.id, a.label, b.label AS other, sum(1 - list_cosine_similarity(a.v, b.v)) AS s FROM l a, l b GROUP BY 1, 2, 3),
q AS (SELECT p.id, p.label, max(CASE WHEN other = p.label AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN other <> p.label THEN s / n END) AS b FROM p JOIN n ON n.label = p.other GROUP BY 1, 2)
SELECT id, round(coalesce((b - a) / greatest(a, b), 0.0), 6) AS silhouette FROM q""")
def silhouette_exact(spark, d):
    return graph.silhouettes(vectors(spark, d)).select("id", r6("silhouette"))


@query()
def iterative_clustering(spark, d):
    return clustering.iterate(vectors(spark, d), 2, smallest=50)


@query()
def leiden_like(spark, d):
    return clustering.neighbour_communities(vectors(spark, d), 8, levels=2, scored=False)[0]


@query()
def umap_like(spark, d):
    n = graph.nearest(vectors(spark, d), 10)
    return linalg.layout(graph.written(n.select("src", "dst", F.exp(-F.col("distance")).alias("weight"))), 50, tables=True)


@query(f"""{BASE} SELECT region AS cluster, NULL::VARCHAR AS parent, 0 AS level, count(*)::BIGINT AS n FROM cells GROUP BY 1 UNION ALL SELECT path, region, 1, count(*)::BIGINT FROM cells GROUP BY 1, 2""")
def cluster_tree(spark, d):
    return graph.cluster_tree(matrix(spark, d).cells, ["region", "path"])


# ---- demultiplexing

ANTIBODY = "a AS (SELECT user_id AS cell_id, event_type AS antibody, round(sum(value), 6) AS n FROM events GROUP BY 1, 2)"


def _antibodies(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("cell_id"), F.col("event_type").alias("antibody")).agg(F.round(F.sum("value"), 6).alias("count"))


@query(f"WITH {ANTIBODY} SELECT cell_id, antibody, round(ln(n + 1), 6) AS log, round((ln(n + 1) - avg(ln(n + 1)) OVER w) / stddev_pop(ln(n + 1)) OVER w, 6) AS z FROM a WINDOW w AS (PARTITION BY antibody)")
def antibody_zscore(spark, d):
    return mixtures.antibody_scores(_antibodies(spark, d)).select("cell_id", "antibody", r6("log"), r6("z"))


@query()
def antibody_mixture(spark, d):
    return mixtures.antibody_calls(_antibodies(spark, d)).select("cell_id", "antibody", "prediction")


@query()
def guide_calls(spark, d):
    return mixtures.guide_calls(_antibodies(spark, d).withColumnRenamed("antibody", "guide"))


@query()
def background_corrected(spark, d):
    a = _antibodies(spark, d)
    return mixtures.background_corrected(a, a.where("cell_id % 5 = 0"))


@query(f"""WITH {ANTIBODY}, b AS (SELECT antibody, avg(ln(n + 10)) AS m, stddev_pop(ln(n + 10)) AS s FROM a WHERE cell_id % 5 = 0 GROUP BY 1), z AS (SELECT cell_id, antibody, (ln(n + 10) - m) / s AS z FROM a JOIN b USING (antibody)),
w AS (SELECT cell_id, max(z) FILTER (WHERE antibody = 'error') AS e, max(z) FILTER (WHERE antibody = 'view') AS v FROM z GROUP BY 1),
t AS (SELECT avg(e) AS me, stddev_samp(e) AS se, avg(v) AS mv, stddev_samp(v) AS sv, sign(corr(e, v)) AS r FROM w WHERE e IS NOT NULL AND v IS NOT NULL),
c AS (SELECT cell_id, (e - me) / se + r * (v - mv) / sv AS noise FROM w, t), d AS (SELECT cell_id, antibody, z, coalesce(noise, (SELECT avg(noise) FROM c)) AS noise FROM z JOIN c USING (cell_id)),
f AS (SELECT antibody, regr_slope(z, noise) AS b, avg(noise) AS c FROM d GROUP BY 1)
SELECT cell_id, antibody, round(z - coalesce(b, 0) * (noise - c), 6) + 0.0 AS value FROM d JOIN f USING (antibody)""")
def background_isotypes(spark, d):
    a = _antibodies(spark, d)
    out = mixtures.background_corrected(a, a.where("cell_id % 5 = 0"), isotypes=["error", "view"], negatives=False)
    return out.select("cell_id", "antibody", (F.round("value", 6) + 0.0).alias("value"))


# ---- sources, sinks, spatial, streams


@query(f"{BASE}, n AS (SELECT region AS p, row_number() OVER (ORDER BY region) - 1 AS i FROM (SELECT DISTINCT region FROM cells)) SELECT 1 AS line, (SELECT count(*) FROM cells) || ' ' || (SELECT count(*) FROM n) || ' 1' AS text UNION ALL SELECT 2, '# ' || string_agg(p, ' ' ORDER BY i) FROM n UNION ALL SELECT 3, string_agg(i::VARCHAR, ' ' ORDER BY cell_id) FROM cells JOIN n ON region = p")
def class_file(spark, d):
    return writers.class_lines(matrix(spark, d).cells, "region")


@query(f"{BASE}, g AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) AS i FROM genes), c AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS j FROM cells) SELECT i || ' ' || j || ' ' || value AS text FROM x JOIN g USING (gene_id) JOIN c USING (cell_id) WHERE value <> 0 UNION ALL SELECT (SELECT count(*) FROM genes) || ' ' || (SELECT count(*) FROM cells) || ' ' || (SELECT count(*) FROM x WHERE value <> 0)")
def matrix_market(spark, d):
    return writers.matrix_market(matrix(spark, d))


@query("SELECT 'balance' AS \"column\", 'numeric' AS kind UNION ALL SELECT 'nation', CASE WHEN count(DISTINCT s_nationkey) < count(*) * 0.1 THEN 'group' ELSE 'numeric' END FROM supplier UNION ALL SELECT 'region', 'group'")
def metadata_kinds(spark, d):
    return writers.metadata_kinds(matrix(spark, d).cells, ["balance", "nation", "region"])


@query(f"{BASE}, f AS (SELECT gene_id FROM genes WHERE contig <> 'Brand#11') SELECT x.* FROM x JOIN f USING (gene_id)")
def feature_filter(spark, d):
    m = matrix(spark, d)
    return readers.feature_matrix(m.x, m.genes.withColumn("type", F.col("contig")), exclude_types=["Brand#11"], rows=m.attrs["rows"]).x


@query(f"{BASE} SELECT cell_id, round(sum(value), 6) AS n_counts, row_number() OVER (ORDER BY sum(value) DESC, cell_id)::INT AS rank FROM x GROUP BY 1")
def barcode_rank_curve(spark, d):
    t = matrix(spark, d).x.groupBy("cell_id").agg(F.sum("value").alias("n"))
    ranked = windows.running_total(t.select("cell_id", "n", (-F.col("n")).alias("down"), F.lit(1).alias("one")), ["down", "cell_id"], "one", "rank")
    return ranked.select("cell_id", r6("n", "n_counts"), F.col("rank").cast("int").alias("rank"))


@query("WITH c AS (SELECT user_id AS barcode, CASE WHEN event_id % 2 = 0 THEN 'TRA' ELSE 'TRB' END AS chain, event_type AS cdr3, event_id FROM events) SELECT barcode, string_agg(cdr3, '---' ORDER BY event_id) FILTER (WHERE chain = 'TRA') AS \"TRA_cdr3\", string_agg(cdr3, '---' ORDER BY event_id) FILTER (WHERE chain = 'TRB') AS \"TRB_cdr3\" FROM c GROUP BY 1")
def vdj_contigs(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("barcode"), F.when(F.col("event_id") % 2 == 0, "TRA").otherwise("TRB").alias("chain"), F.col("event_type").alias("cdr3"), "event_id")
    return receptors.contigs_to_cells(e, ["cdr3"], order="event_id")


@query()
def alpha_outlines(spark, d):
    p = vectors(spark, d).select(F.lit("all").alias("k"), F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    return spatial.alpha_outlines(p, "k", 5.0)


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return streams.windowed(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, run""")
def event_sessions(spark, d):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return streams.sessions(table(spark, d, "events")).select("user_id", stamp("start"), stamp("end"), "n")
