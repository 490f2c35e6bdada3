"""Genome-position operators: copy ratios, windowed expression, malignancy, correspondence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.model import AnnotatedMatrix
from cytoplane.operators import linalg
from cytoplane.operators.differential import kendall_by, theil_sen
from cytoplane.operators.graph import written
from cytoplane.operators.joins import asof
from cytoplane.operators.windows import average_rank, dominance, gene_windows, robust_window_means


def copy_ratios(genes: DataFrame, segments: DataFrame, score: str = "tau", log2: bool = False, check_end: bool = False, contig: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """genes plus copy_ratio: the score of the last segment that begins at or before the gene on its contig (2^score if
    log2); null before the first segment, and with check_end also behind the segment's end."""
    s = segments.select(F.col(contig), F.col(start).alias("__s"), F.struct(F.col(end).cast("double").alias("e"), F.col(score).cast("double").alias("v")).alias("__seg"))
    out = asof(genes, s, [contig], start, ["__seg"], "__s")
    v = F.pow(F.lit(2.0), F.col("__seg.v")) if log2 else F.col("__seg.v")
    return out.withColumn("copy_ratio", F.when(F.col(start) <= F.col("__seg.e"), v) if check_end else v).drop("__seg")


def window_copy_ratios(ratios: DataFrame, windows: DataFrame, contig: str = "contig") -> DataFrame:
    """(contig, window, copy_ratio): mean over the window's genes that have one."""
    return windows.join(ratios.select("gene_id", "copy_ratio"), "gene_id").groupBy(contig, "window").agg(F.avg("copy_ratio").alias("copy_ratio"))


def windowed_expression(m: AnnotatedMatrix, size: int, step: int, cut: int = 0, layer: str = "", cells=None, from_log: bool = False, winsorize: bool = False) -> DataFrame:
    """(contig, window, cell_id, mean) over windows of genes with a position, for the cells that fit a predicate; from_log
    turns log2(1 + v) values back first."""
    x = m.layers[layer]
    x = x if cells is None else x.join(m.cells.where(cells).select("cell_id"), "cell_id", "left_semi")
    x = x.withColumn("value", F.pow(F.lit(2.0), "value") - 1) if from_log else x
    rows = m.attrs.get("rows")
    return robust_window_means(m.dealt(x, "gene_id"), gene_windows(m.genes, size, step), size, cut, winsorize, rows=rows and int(rows * max(1, size / step)))


def window_vectors(means: DataFrame) -> DataFrame:
    """(id, vec): each cell's windowed means in the order of contig and window, absent ones 0."""
    at = means.select("contig", "window").distinct().orderBy("contig", "window").collect()  # a row per window
    key = F.concat_ws(":", "contig", F.col("window").cast("string"))
    names = F.array(*[F.lit(f"{r['contig']}:{r['window']}") for r in at]) if at else F.array().cast("array<string>")
    m = means.groupBy(F.col("cell_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "mean"))).alias("m"))
    return m.select("id", F.transform(names, lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0))).alias("vec"))


def window_ranks(means: DataFrame) -> DataFrame:
    """Average rank of each window within its cell."""
    return means.withColumn("rank", average_rank("mean", ["cell_id"]))


def correspondence(m: AnnotatedMatrix, segments: dict[str, DataFrame], layer: str = "", score: str = "tau") -> DataFrame:
    """(segmentation, cell_id, tau, p): Kendall's tau-b of each cell's stored expression with the copy ratio of its genes."""
    out = None
    for name, s in segments.items():
        r = copy_ratios(m.genes, s, score).where("copy_ratio IS NOT NULL").select("gene_id", "copy_ratio")
        pairs = m.layers[layer].join(r, "gene_id")
        t = kendall_by(pairs, "cell_id", "value", "copy_ratio").withColumn("segmentation", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.select("segmentation", "cell_id", "tau", "p")


def correspondence_slopes(means: DataFrame, ratios: DataFrame, contig: str = "contig") -> DataFrame:
    """(cell_id, slope): Theil-Sen slope of windowed expression on the windows' copy ratio."""
    return theil_sen(means.join(ratios, [contig, "window"]).where("copy_ratio IS NOT NULL"), "cell_id", "copy_ratio", "mean")


def malignancy(m: AnnotatedMatrix, patient: str, kind: str, malignant: str, size: int, step: int, cut: int = 2, layer: str = "") -> DataFrame:
    """(cell_id, pc1, malignancy): per patient, the first component of windowed expression, turned so that malignant cells
    lie higher; the score is the fraction of the patient's other cells strictly below, 0 for those themselves."""
    means = windowed_expression(m, size, step, cut, layer).join(m.cells.select("cell_id", patient, kind), "cell_id")
    wide = means.withColumn("w", F.concat_ws(":", "contig", "window"))
    pc = linalg.first_component_by(wide, patient, "cell_id", "w", "mean").join(m.cells.select("cell_id", patient, kind), ["cell_id", patient])
    bad = F.col(kind) == malignant
    turn = pc.groupBy(patient).agg((F.avg(F.when(bad, F.col("pc1"))) < F.avg(F.when(~bad, F.col("pc1")))).alias("flip"))
    pc = pc.join(turn, patient).withColumn("pc1", F.when(F.col("flip"), -F.col("pc1")).otherwise(F.col("pc1")))
    w = Window.partitionBy(patient)
    below = F.count_if(~bad).over(Window.partitionBy(patient).orderBy("pc1").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count_if(~bad).over(Window.partitionBy(patient, "pc1"))
    score = F.when(bad, F.try_divide(below, F.count_if(~bad).over(w))).otherwise(0.0)
    return pc.select("cell_id", "pc1", score.alias("malignancy"))


def umi_networks(reads: DataFrame, place: list[str], umi: str = "umi", rounds: int = 100) -> DataFrame:
    """(place, umi, n, molecule): the molecule of each distinct UMI of a place (with its cell among the columns), named by the
    UMI that it was read as most often.

    A UMI read n times is an error of one that differs in a single letter and was read at least 2 n - 1 times, directly or
    through others; of several such it is that of the most read (ties: the least) that leads to it. UMIs of different
    lengths don't meet; null UMIs have no molecule; null places are places like others.

    UMIs meet at keys that leave out one letter each, at most as many as there are letters at a key, so a place with
    any number of UMIs is spread over its keys. Labels then flow from more read UMIs to less read ones only, the best so far a
    round, until none moves; raises if they still do after ``rounds``.
    """
    n = reads.where(F.col(umi).isNotNull()).groupBy(*place, F.col(umi).alias("umi")).agg(F.count(F.lit(1)).alias("n"))
    hashed = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(place)]) if place else F.lit(0)
    n = written(n.withColumn("at", hashed))
    left_out = F.transform(F.sequence(F.lit(1), F.length("umi")), lambda i: F.concat_ws("\0", i.cast("string"), F.substring("umi", F.lit(1), i - 1), F.substring("umi", i + 1, F.length("umi"))))
    keyed = n.where(F.length("umi") > 0).select("at", "umi", "n", F.explode(left_out).alias("key"))
    met = keyed.groupBy("at", "key").agg(F.collect_list(F.struct("umi", "n")).alias("x")).where(F.size("x") > 1)
    pairs = met.select("at", F.explode("x").alias("a"), "x").select("at", "a", F.explode("x").alias("b")).where("a.umi <> b.umi AND a.n >= 2 * b.n - 1")
    down = written(pairs.select("at", F.col("a.umi").alias("src"), F.col("b.umi").alias("dst")))
    # Only UMIs that something leads to or from have labels that may move; the others stand for themselves.
    ends = down.select("at", F.explode(F.array("src", "dst")).alias("umi")).distinct()
    best = written(n.join(ends, ["at", "umi"], "left_semi").select("at", "umi", F.struct((-F.col("n")).alias("less"), F.col("umi").alias("umi")).alias("top")))
    for _ in range(rounds):
        sent = down.join(best.select("at", F.col("umi").alias("src"), F.col("top").alias("sent")), ["at", "src"]).groupBy("at", F.col("dst").alias("umi")).agg(F.min("sent").alias("sent"))
        now = best.join(sent, ["at", "umi"], "left")
        now = written(now.select("at", "umi", F.least("top", F.coalesce("sent", "top")).alias("top"), F.coalesce(F.col("sent") < F.col("top"), F.lit(False)).alias("moved")))
        best = now.select("at", "umi", "top")
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("labels still move")
    named = best.select("at", "umi", F.col("top.umi").alias("molecule"))
    return n.join(named, ["at", "umi"], "left").select(*place, "umi", "n", F.coalesce("molecule", "umi").alias("molecule"))


def soft_clipped_starts(reads: DataFrame, networks: bool = False, contigs: str = "") -> DataFrame:
    """(chrom, start, end, strand, barcode, n): transcription starts of reads (chrom, pos, end, strand, cigar, seq, barcode,
    umi) whose first base outwards is a clipped G, counted once per UMI, or with ``networks`` once per molecule of
    ``umi_networks``. contigs: only those whose names hold this."""
    plus = F.col("strand") == "+"
    clip = F.when(plus, F.regexp_extract("cigar", "^([0-9]+)S", 1)).otherwise(F.regexp_extract("cigar", "([0-9]+)S$", 1))
    n = F.nullif(clip, F.lit("")).cast("int")
    base = F.when(plus, F.substring("seq", n, F.lit(1))).otherwise(F.substring("seq", F.length("seq") - n + 1, F.lit(1)))
    hit = reads.where(base == F.when(plus, "G").otherwise("C"))
    at = F.when(plus, F.col("pos")).otherwise(F.col("end"))
    once = hit.where(F.contains("chrom", F.lit(contigs))).select("chrom", at.alias("start"), "strand", "barcode", "umi")
    place = ["chrom", "start", "strand", "barcode"]
    once = umi_networks(once, place).select(*place, "molecule").distinct() if networks else once.distinct()
    return once.groupBy("chrom", "start", (F.col("start") + 1).alias("end"), "strand", "barcode").agg(F.count(F.lit(1)).alias("n"))
