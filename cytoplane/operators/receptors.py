"""Receptor clonotypes: parsing, multi-chain summaries, doublet likelihoods, distances and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.functions import pvalues
from cytoplane.operators.graph import components, written
from cytoplane.operators.windows import bh_adjust

#: Separators of chains, of the two kinds of chain, and of the sample.
CHAIN, KIND, SAMPLE = "---", "|", "_"
NO_PAIR = "No putative pairs with positive population"


def parse(df: DataFrame, col: str = "tcr") -> DataFrame:
    """df plus tra, trb (strings), n_tra and n_trb of 'a[---a]|b[---b][_sample]'; an empty side has 0 chains."""
    side = lambda i: F.coalesce(F.get(F.split(F.col(col), r"\|"), F.lit(i)), F.lit(""))
    beta = F.coalesce(F.get(F.split(side(1), SAMPLE), F.lit(0)), F.lit(""))
    n = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(F.col(c), CHAIN)))
    return df.withColumn("tra", side(0)).withColumn("trb", beta).withColumn("n_tra", n("tra")).withColumn("n_trb", n("trb"))


def contigs_to_cells(contigs: DataFrame, fields: list[str], barcode: str = "barcode", chain: str = "chain", order: str | None = None) -> DataFrame:
    """One row per barcode: each field of TRA and TRB contigs joined by '---' in order, as TRA_field and TRB_field."""
    by = F.col(order) if order else F.col(fields[0])
    packed = lambda f, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col(chain) == c) & F.col(f).isNotNull(), F.struct(by.alias("o"), F.col(f).cast("string").alias("v"))))), lambda s: s["v"]), CHAIN)
    return contigs.where(F.col(chain).isin("TRA", "TRB")).groupBy(barcode).agg(*[F.nullif(packed(f, c), F.lit("")).alias(f"{c}_{f}") for c in ("TRA", "TRB") for f in fields])


def join_chains(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(KIND), b)


def clone_counts(df: DataFrame, sample: str = "sample", tcr: str = "tcr", blacklist: list[str] | None = None) -> DataFrame:
    """(sample, tcr, counts, tra, trb, n_tra, n_trb); null and blacklisted receptors don't count."""
    d = df.where(F.col(tcr).isNotNull())
    d = d.where(~F.col(tcr).isin(*blacklist)) if blacklist else d
    return parse(d.groupBy(sample, tcr).agg(F.count(F.lit(1)).alias("counts")), tcr)


def doublet_likelihood(clones: DataFrame, n_tra: int, n_trb: int, rate: float = 0.05, sample: str = "sample", tcr: str = "tcr") -> DataFrame:
    """For clones with n_tra and n_trb chains: the likeliest pair of single-chain clones that a doublet would be made of.

    (sample, tcr, x1, x2, p, pair, q). 2 x 2: both pairings, by exact clones. 2 x 1 and 1 x 2: one exact clone and any
    single-chain clone with the remaining chain, either way round. p only where both parents occur; the largest wins; q
    over the non-null p of the class. Parents are found by joins on chains, summed beforehand.
    """
    single = clones.where("n_tra = 1 AND n_trb = 1").select(sample, "tra", "trb", "counts")
    exact = single.groupBy(sample, "tra", "trb").agg(F.sum("counts").alias("n"))
    any_a = single.groupBy(sample, "tra").agg(F.sum("counts").alias("n")).withColumn("trb", F.lit("*"))
    any_b = single.groupBy(sample, "trb").agg(F.sum("counts").alias("n")).withColumn("tra", F.lit("*"))
    parents = exact.unionByName(any_a.select(exact.columns)).unionByName(any_b.select(exact.columns))
    total = clones.groupBy(sample).agg(F.sum("counts").alias("total"))
    a, b = F.split("tra", CHAIN), F.split("trb", CHAIN)
    pick = lambda a1, b1, a2, b2: F.struct(a1.alias("a1"), b1.alias("b1"), a2.alias("a2"), b2.alias("b2"))
    star = F.lit("*")
    ways = {
        (2, 2): [pick(a[0], b[0], a[1], b[1]), pick(a[1], b[0], a[0], b[1])],
        (2, 1): [pick(a[0], b[0], a[1], star), pick(a[0], star, a[1], b[0])],
        (1, 2): [pick(star, b[0], a[0], b[1]), pick(a[0], b[0], star, b[1])],
    }[n_tra, n_trb]
    c = clones.where((F.col("n_tra") == n_tra) & (F.col("n_trb") == n_trb)).withColumn("w", F.explode(F.array(*ways))).select(sample, tcr, "counts", "w.*")
    p1 = parents.select(sample, F.col("tra").alias("a1"), F.col("trb").alias("b1"), F.col("n").alias("x1"))
    p2 = parents.select(sample, F.col("tra").alias("a2"), F.col("trb").alias("b2"), F.col("n").alias("x2"))
    c = c.join(p1, [sample, "a1", "b1"], "left").join(p2, [sample, "a2", "b2"], "left").join(total, sample).na.fill(0, ["x1", "x2"])
    p = F.when((F.col("x1") > 0) & (F.col("x2") > 0), pvalues.doublet_udf("x1", "x2", "counts", "total", F.lit(rate)))
    text = F.concat("a1", F.lit(KIND), "b1", F.lit(" (n="), "x1", F.lit(") + "), "a2", F.lit(KIND), "b2", F.lit(" (n="), "x2", F.lit(")"))
    c = c.withColumn("p", p).withColumn("pair", F.when(F.col("p").isNotNull(), text))
    best = c.groupBy(sample, tcr).agg(F.max_by(F.struct("x1", "x2", "p", "pair"), F.when(F.col("p").isNotNull(), F.struct("p", "pair"))).alias("b"))
    out = best.select(sample, tcr, "b.x1", "b.x2", "b.p", F.coalesce("b.pair", F.lit(NO_PAIR)).alias("pair"))
    return bh_adjust(out, "p", "q")


def summary(df: DataFrame, sample: str = "sample", tcr: str = "tcr", blacklist: list[str] | None = None, rate: float = 0.05) -> DataFrame:
    """clone_counts plus p, q and pair of the doublet tests of 1 x 2, 2 x 1 and 2 x 2 clones."""
    c = clone_counts(df, sample, tcr, blacklist)
    tests = None
    for shape in ((1, 2), (2, 1), (2, 2)):
        t = doublet_likelihood(c, *shape, rate, sample, tcr).select(sample, tcr, "p", "q", "pair")
        tests = t if tests is None else tests.unionByName(t)
    return c.join(tests, [sample, tcr], "left")


def summary_on_cells(cells: DataFrame, sample: str, tcr: str, suffix: str = "_multichain_summary", **kwargs) -> DataFrame:
    """cells plus every column of ``summary`` for its sample and receptor, with a suffix."""
    s = summary(cells, sample, tcr, **kwargs)
    named = s.select(sample, tcr, *[F.col(c).alias(c + suffix) for c in s.columns if c not in (sample, tcr)])
    return cells.join(named, [sample, tcr], "left")


def pair_distances(clones: DataFrame, key: str = "tcr") -> DataFrame:
    """(a, b, d) for distinct receptors a < b: the least edit distance over alpha chains plus that over beta chains; null
    where one of them has no chain of a kind. All pairs are the result asked for."""
    c = clones.select(key, F.split("tra", CHAIN).alias("ta"), F.split("trb", CHAIN).alias("tb")).distinct()
    l, r = c.select(*[F.col(x).alias(f"l_{x}") for x in c.columns]), c.select(*[F.col(x).alias(f"r_{x}") for x in c.columns])
    least = lambda x, y: F.array_min(F.flatten(F.transform(F.filter(x, lambda u: u != ""), lambda u: F.transform(F.filter(y, lambda v: v != ""), lambda v: F.levenshtein(u, v)))))
    d = least(F.col("l_ta"), F.col("r_ta")) + least(F.col("l_tb"), F.col("r_tb"))
    return l.join(r, F.col(f"l_{key}") < F.col(f"r_{key}")).select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"), d.alias("d"))


def shortened(text, most: int):
    """The distinct strings that ``most`` deletions at most leave of a string column, itself among them."""
    out = F.array(text)
    one = lambda x: F.transform(F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def near_strings(strings: DataFrame, most: int, kind: str = "kind", text: str = "text") -> DataFrame:
    """(kind, x, y, d) of the distinct strings of a kind at edit distance d of at most ``most``, each with itself too, in both
    orders. Strings at that distance have something in common after as many deletions in each, so they meet at hashes
    of what deletions leave; work grows with the strings and their neighbours. Nulls take no part."""
    s = strings.where(F.col(text).isNotNull()).select(kind, F.col(text).alias("x")).distinct()
    keys = s.select(kind, "x", F.explode(F.array_distinct(F.transform(shortened(F.col("x"), most), lambda v: F.xxhash64(v)))).alias("key"))
    pairs = keys.join(keys.withColumnRenamed("x", "y"), [kind, "key"]).select(kind, "x", "y").distinct()
    d = F.levenshtein(F.col("x"), F.col("y"), most)
    return pairs.withColumn("d", d).where(F.col("d").between(0, most))


def near_pairs(clones: DataFrame, most: int = 3, key: str = "tcr") -> DataFrame:
    """(a, b, d) of ``pair_distances`` where d is at most ``most``, without comparing all pairs: receptors without a chain of
    a kind have no distance.

    Distinct chains of a kind are compared first (``near_strings``). A receptor's pairs of an alpha and a beta chain are then led
    to the near ones of each, and meet receptors that have both: a chain that very many receptors share leads to no pair
    that isn't within ``most``.
    """
    parts = lambda c: F.filter(F.split(c, CHAIN), lambda u: u != "")
    c = clones.select(F.col(key).alias("a"), parts("tra").alias("ta"), parts("trb").alias("tb")).where("a IS NOT NULL").distinct()
    chains = c.select("a", F.explode("ta").alias("alpha"), "tb").select("a", "alpha", F.explode("tb").alias("beta")).distinct()
    chains = written(chains)
    both = chains.select(F.lit("alpha").alias("kind"), F.col("alpha").alias("text")).union(chains.select(F.lit("beta"), "beta"))
    near = written(near_strings(both, most))
    side = lambda kind, x, y, d: near.where(F.col("kind") == kind).select(F.col("x").alias(x), F.col("y").alias(y), F.col("d").alias(d))
    led = chains.join(side("beta", "beta", "beta2", "db"), "beta").join(side("alpha", "alpha", "alpha2", "da"), "alpha").where(F.col("da") + F.col("db") <= most)
    led = led.groupBy("a", "alpha2", "beta2").agg(F.min(F.col("da") + F.col("db")).alias("d"))
    other = chains.select(F.col("a").alias("b"), F.col("alpha").alias("alpha2"), F.col("beta").alias("beta2"))
    return led.join(other, ["alpha2", "beta2"]).where("a < b").groupBy("a", "b").agg(F.min("d").alias("d"))


def cluster_peptides(df: DataFrame, peptide: str, gene: str | None = None, max_dist: int = 6) -> DataFrame:
    """(gene, peptide, cluster): peptides connected by edit distances of at most 1 (within a gene), named by the least
    peptide; -1 (as text) for clusters in which some pair is farther than max_dist.

    Candidates for edges share the peptide with one place deleted. Whether a cluster has a far pair is told by each peptide's
    distance from the cluster's least one: over max_dist settles it, and otherwise a pair is only compared if both
    distances together are over max_dist.
    """
    by = [gene] if gene else []
    p = df.where(F.col(peptide).isNotNull()).select(*by, F.col(peptide).alias("p")).distinct()
    n = F.length("p")
    spots = F.array_union(F.array(F.col("p")), F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring("p", F.lit(1), i - 1), F.substring("p", i + 1, n))))
    k = p.withColumn("k", F.explode(spots))
    near = k.alias("l").join(k.alias("r"), [*by, "k"]).where("l.p < r.p").where(F.levenshtein(F.col("l.p"), F.col("r.p")) <= 1)
    name = lambda c: F.concat_ws("\u0001", *by, c)
    edges = near.select(*by, F.col("l.p").alias("u"), F.col("r.p").alias("v")).distinct()
    comp = components(edges.select(name("u").alias("u"), name("v").alias("v")))
    c = p.withColumn("node", name("p")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = F.element_at(F.split("component", "\u0001"), -1)
    off = c.withColumn("off", F.levenshtein("p", label))
    sure = off.groupBy("component").agg(F.max("off").alias("most"))
    open_ = off.join(sure.where((F.col("most") <= max_dist) & (2 * F.col("most") > max_dist)).select("component", "most"), "component").where(F.col("off") + F.col("most") > max_dist)
    pairs = open_.alias("l").join(open_.alias("r"), "component").where("l.p < r.p").where(F.col("l.off") + F.col("r.off") > max_dist)
    pairs = pairs.where(F.levenshtein(F.col("l.p"), F.col("r.p")) > max_dist).select("component")
    far = sure.where(F.col("most") > max_dist).select("component").union(pairs).distinct().withColumn("far", F.lit(True))
    return c.join(far, "component", "left").select(*by, F.col("p").alias(peptide), F.when(F.col("far"), "-1").otherwise(label).alias("cluster"))
