"""Layer transforms and per-cell or per-gene statistics, with implicit zeros taken into account."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.model import AnnotatedMatrix

#: Fixed value: a MAD over this is comparable with a standard deviation.
MAD_SCALE = 0.6745


def normalize_counts(m: AnnotatedMatrix, layer: str = "", out: str = "log", denominator: float = 1e4) -> AnnotatedMatrix:
    """log2(1 + value * denominator / total of the cell); zeros stay zeros, so the layer stays sparse."""
    x = m.layers[layer]
    total = x.groupBy("cell_id").agg(F.sum("value").alias("total"))
    return m.with_layer(out, x.join(total, "cell_id").withColumn("value", F.log2(1 + F.col("value") * denominator / F.nullif("total", F.lit(0.0)))))


def moments(m: AnnotatedMatrix, axis: str, layer: str = "") -> DataFrame:
    """(key, n, nnz, total, mean, var) per cell or gene, over zeros too; two passes, so that large means don't cancel.

    axis 'cell' gives statistics per cell (over genes), 'gene' per gene (over cells). Keys without values have zeros.
    """
    key = f"{axis}_id"
    keys, others = (m.cells, m.genes) if axis == "cell" else (m.genes, m.cells)
    n = others.agg(F.count(F.lit(1)).alias("n"))
    x = m.layers[layer]
    first = keys.select(key).join(x.groupBy(key).agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("value") > 0).alias("nnz"), F.sum("value").alias("total")), key, "left").crossJoin(F.broadcast(n))
    first = first.select(key, "n", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("nnz", F.lit(0)).alias("nnz"), F.coalesce("total", F.lit(0.0)).alias("total"))
    first = first.withColumn("mean", F.try_divide("total", "n"))
    squares = x.join(first.select(key, "mean"), key).groupBy(key).agg(F.sum((F.col("value") - F.col("mean")) ** 2).alias("ss"))
    full = first.join(squares, key, "left")
    ss = F.coalesce("ss", F.lit(0.0)) + (F.col("n") - F.col("stored")) * F.col("mean") ** 2
    return full.select(key, "n", "nnz", "total", "mean", F.try_divide(ss, F.col("n")).alias("var"))


def gene_variances(m: AnnotatedMatrix, layer: str = "") -> AnnotatedMatrix:
    """GeneVar: population variance over all cells."""
    return m.with_genes(moments(m, "gene", layer).select("gene_id", F.col("var").alias("GeneVar")))


def variable_genes(m: AnnotatedMatrix, n: int) -> DataFrame:
    """Genes whose GeneVar is over the (n+1)-th largest; ties with it drop out."""
    bar = m.genes.orderBy(F.desc("GeneVar")).limit(n + 1).agg(F.min("GeneVar").alias("bar"))
    return m.genes.crossJoin(F.broadcast(bar)).where(F.col("GeneVar") > F.col("bar")).drop("bar")


#: Genes of an axis that are sent to a task at once; a larger axis goes in several rounds.
AXIS = 1_000_000
#: Cells and genes of one task. A dictionary of a written column holds 131 072 numbers: the genes, or the values of their zeros and
#: of what is stored.
BLOCK, PART = 256, 65_536


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """v as Spark's round gives it (half up of the shortest decimals), without negative zeros; what is not finite stays."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(v) * 10.0**digits
        whole = np.floor(scaled + 0.5)
        # Where the product's own rounding could decide, or where it holds no fraction, decimals do.
        unsure = np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-15 * scaled + 1e-12) | (scaled >= 2.0**51))
        out = np.copysign(whole / 10.0**digits, v)
    step = Decimal(1).scaleb(-digits)
    for i in unsure:
        exact = Decimal(repr(float(v[i])))
        if not exact.is_finite():
            out[i] = v[i]
        elif exact.as_tuple().exponent >= -digits:
            out[i] = v[i]
        else:
            out[i] = float(exact.quantize(step, ROUND_HALF_UP, _WIDE))
    out[np.isnan(v)] = np.nan
    return out + 0.0


_WIDE = Context(prec=400)


def standardize(m: AnnotatedMatrix, axis: str, layer: str = "", out: str | None = None, most: int = AXIS, digits: int | None = None) -> AnnotatedMatrix:
    """(value - mean) / standard deviation (population; 1 if 0) per cell or per gene, rounded to ``digits``; the result is dense.

    Stored values are packed by cell and part of the gene axis, and a block of cells is filled up from the axis where it is, so
    that no zero is shuffled or computed. A task makes ``BLOCK`` cells of ``PART`` genes, gene by gene: equal genes and equal
    values then follow each other and the dictionaries of a written file hold, so that zeros take next to no disk. The axis is
    broadcast; one of over ``most`` genes goes in several rounds.
    """
    key, s = f"{axis}_id", moments(m, axis, layer)
    s = s.select(key, "mean", F.when(F.col("var") <= 0, 1.0).otherwise(F.sqrt("var")).alias("scale"))
    name, x, spark = out or f"{layer}_{axis}_standardized", m.layers[layer], m.cells.sparkSession
    whole = s if axis == "gene" else m.genes.select("gene_id", F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"))
    cells = m.cells.select("cell_id") if axis == "gene" else s
    kinds = {c: x.schema[c].dataType.simpleString() for c in ("cell_id", "gene_id")}
    rounded = (lambda v: v) if digits is None else (lambda v: half_up(v, digits))
    n_genes, n_cells, dense = m.genes.count(), m.cells.count(), None
    rounds, blocks = max(1, -(-n_genes // most)), max(1, -(-n_cells // BLOCK))
    parts = max(1, -(-n_genes // rounds // PART), min(-(-spark.sparkContext.defaultParallelism // blocks), n_genes))
    of = lambda c, k, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(k)).cast("int")
    for turn in range(rounds):
        own = F.lit(True) if rounds == 1 else F.pmod(F.xxhash64("gene_id"), F.lit(rounds)) == turn
        rows = whole.where(own).withColumn("part", of("gene_id", parts, 1)).orderBy("gene_id").toArrow()
        sent = spark.sparkContext.broadcast((rows.column("gene_id").combine_chunks(), *(rows.column(c).to_numpy() for c in ("mean", "scale", "part"))))
        packed = x.where(own).groupBy("cell_id", of("gene_id", parts, 1).alias("part")).agg(F.collect_list(F.struct("gene_id", F.col("value").cast("double").alias("value"))).alias("z"))
        every = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        filled = every.join(packed, ["cell_id", "part"], "left").withColumn("task", of("cell_id", blocks, 2) * parts + F.col("part"))
        filled = filled.repartitionById(blocks * parts, F.col("task")).mapInArrow(_filled(sent, rounded), f"cell_id {kinds['cell_id']}, gene_id {kinds['gene_id']}, value double")
        dense = filled if dense is None else dense.unionByName(filled)
    return m.with_layer(name, dense)


def _filled(sent, rounded, held: int = 1 << 15):
    """Batches of up to ``held`` dense values, of batches (cell_id, part, z, task[, mean, scale]); sent: a broadcast of genes, means,
    scales and parts. Cells of a task are filled together, gene by gene."""

    def fill(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        tasks = table.column("task").to_numpy()
        for task in np.unique(tasks).tolist():
            yield from block(table.take(pa.array(np.flatnonzero(tasks == task))).combine_chunks())

    def block(t: pa.Table):
        genes, mean, scale, part = sent.value
        here = np.flatnonzero(part == t.column("part")[0].as_py())
        genes, mean, scale = genes.take(pa.array(here)), mean[here], scale[here]
        cells, n = t.column("cell_id").combine_chunks(), len(t)
        z = t.column("z").combine_chunks()
        cell = np.repeat(np.arange(n), z.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int))
        flat = z.flatten()
        ids, value = flat.field("gene_id"), flat.field("value").to_numpy(zero_copy_only=False)
        place = pc.index_in(ids, value_set=genes).fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
        known = place >= 0
        place, value, cell = place[known], value[known], cell[known]
        if "mean" in t.column_names:
            m0, s0 = (t.column(c).to_numpy() for c in ("mean", "scale"))
            empty, stored = rounded((0 - m0) / s0), rounded((value - m0[cell]) / s0[cell])
        else:
            empty, stored = rounded((0 - mean) / scale), rounded((value - mean[place]) / scale[place])
        order = np.argsort(place, kind="stable")
        place, cell, stored = place[order], cell[order], stored[order]
        few = max(1, held // n)
        of_cells, of_genes = cells.take(pa.array(np.tile(np.arange(n), min(few, len(genes))))), np.repeat(np.arange(min(few, len(genes))), n)
        for lo in range(0, len(genes), few):
            hi = min(lo + few, len(genes))
            v = np.tile(empty, hi - lo) if "mean" in t.column_names else np.repeat(empty[lo:hi], n)
            a, b = np.searchsorted(place, (lo, hi))
            v[(place[a:b] - lo) * n + cell[a:b]] = stored[a:b]
            yield pa.RecordBatch.from_arrays([of_cells.slice(0, len(v)), genes.take(pa.array(of_genes[: len(v)] + lo)), pa.array(v)], ["cell_id", "gene_id", "value"])

    return fill


def zscore(df: DataFrame, col: str, by: list[str] | None = None, sample: bool = True) -> Column:
    """A window expression: sample (n-1) or population standard score of col; null where the deviation is 0."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    sd = F.stddev_samp(col).over(w) if sample else F.stddev_pop(col).over(w)
    return F.try_divide(F.col(col) - F.avg(col).over(w), sd)


def global_zscore(df: DataFrame, col: str, out: str, sample: bool = True) -> DataFrame:
    """df plus the score of col over all rows, from one aggregate row joined back rather than one partition of all rows."""
    sd = F.stddev_samp(col) if sample else F.stddev_pop(col)
    s = df.agg(F.avg(col).alias("__m"), sd.alias("__s"))
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.try_divide(F.col(col) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def min_max(df: DataFrame, col: str, out: str, by: list[str]) -> DataFrame:
    """df plus (col - min) / (max - min) within by; null if all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, F.try_divide(F.col(col) - low, high - low))


def _weighted_median(values: DataFrame, key: str, n: DataFrame) -> DataFrame:
    """(key, med) of values (key, v, weight) whose weights add up to the number of entries: the middle entry or pair."""
    w = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = values.groupBy(key, "v").agg(F.sum("weight").alias("weight")).withColumn("upto", F.sum("weight").over(w)).join(n, key)
    before, half = F.col("upto") - F.col("weight"), F.col("n") / 2
    low = F.max(F.when((before < F.ceil(half)) & (F.col("upto") >= F.ceil(half)), F.col("v")))
    high = F.max(F.when((before < F.floor(half) + 1) & (F.col("upto") >= F.floor(half) + 1), F.col("v")))
    return t.groupBy(key).agg(((low + high) / 2).alias("med"))


def median_and_mad(m: AnnotatedMatrix, axis: str, layer: str = "", only: DataFrame | None = None) -> DataFrame:
    """(key, n, med, mad, mean, max) per cell or gene over zeros too; mad is divided by 0.6745. only: ids of the other axis.

    Zeros enter as one value with their number as weight, so nothing is made dense.
    """
    key, other = f"{axis}_id", "gene_id" if axis == "cell" else "cell_id"
    keys, others = (m.cells, m.genes) if axis == "cell" else (m.genes, m.cells)
    x = m.layers[layer] if only is None else m.layers[layer].join(only.select(other), other, "left_semi")
    n = (others if only is None else only).agg(F.count(F.lit(1)).alias("n"))
    stats = keys.select(key).join(x.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("value").alias("s"), F.max("value").alias("hi")), key, "left").crossJoin(F.broadcast(n))
    zeros = F.col("n") - F.coalesce("k", F.lit(0))
    stats = stats.select(key, "n", zeros.alias("zeros"), F.try_divide(F.coalesce("s", F.lit(0.0)), F.col("n")).alias("mean"), F.when(zeros > 0, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi")).alias("max"))
    size = stats.select(key, "n")
    v = x.select(key, F.col("value").alias("v"), F.lit(1).cast("long").alias("weight")).unionByName(stats.where("zeros > 0").select(key, F.lit(0.0).alias("v"), F.col("zeros").alias("weight")))
    med = _weighted_median(v, key, size)
    away = v.join(med, key).select(key, F.abs(F.col("v") - F.col("med")).alias("v"), "weight")
    mad = _weighted_median(away, key, size).withColumnRenamed("med", "mad")
    return stats.drop("zeros").join(med, key, "left").join(mad, key, "left").withColumn("mad", F.col("mad") / MAD_SCALE)


def is_raw(m: AnnotatedMatrix, layer: str = "") -> Column:
    """An aggregate over the layer: whether all values are whole numbers."""
    return F.bool_and(F.col("value") == F.floor("value"))


def quality_metrics(m: AnnotatedMatrix, layer: str = "", gene: str = "gene", ribosomal: bool = True, mitochondrial: bool = True) -> AnnotatedMatrix:
    """Counts, complexity and robust spread per cell; counts and complexity per gene; the same for ribosomal (names that
    begin with RP or Rp) and mitochondrial genes (mt- or mt. in either case), with their share of the cell's counts."""
    x = m.layers[layer]
    per_cell = moments(m, "cell", layer).select("cell_id", F.col("total").alias("nCountsForCell"), F.col("nnz").alias("nGene"))
    spread = lambda s: F.try_divide(F.col("mad"), F.col("mean"))
    per_cell = per_cell.join(median_and_mad(m, "cell", layer).select("cell_id", spread("").alias("AllGeneRelativeMeanAbsoluteDeviation")), "cell_id")
    name = F.col(gene)
    sets = []
    if ribosomal:
        sets.append(("Ribosomal", name.startswith("RP") | name.startswith("Rp")))
    if mitochondrial:
        sets.append(("Mitochondrial", F.lower(name).startswith("mt-") | F.lower(name).startswith("mt.")))
    for prefix, mask in sets:
        some = m.genes.where(mask)
        d = median_and_mad(m, "cell", layer, some)
        cols = [spread("").alias(f"{prefix}RelativeMeanAbsoluteDeviation"), F.col("mean").alias(f"{prefix}Mean"), F.try_divide("max", "mean").alias(f"{prefix}MaxOverMean"), (F.col("mean") * F.col("n")).alias("__sum")]
        per_cell = per_cell.join(d.select("cell_id", *cols), "cell_id", "left").withColumn(f"{prefix}CountFraction", F.try_divide("__sum", "nCountsForCell")).drop("__sum")
    per_gene = moments(m, "gene", layer).select("gene_id", F.col("total").alias("nCountsForGene"), F.col("nnz").alias("nCell"))
    return m.with_cells(per_cell, overwrite=True).with_genes(per_gene, overwrite=True)
