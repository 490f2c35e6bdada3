"""python -m cytoplane.cli COMMAND ...: thin commands over readers, operators and writers."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cytoplane.functions import scalars
from cytoplane.model import combine
from cytoplane.operators import clustering, differential, genome, joins, layers, receptors, signatures, windows
from cytoplane.sources import readers, writers


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cytoplane")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str):
        s = sub.add_parser(name)
        for f in flags:
            s.add_argument(f, nargs="+" if f == "inputs" else None)
        return s

    command("combine", "output", "inputs")
    command("convert-triplets", "matrix", "features", "output").add_argument("--exclude", nargs="*", default=[])
    s = command("split-exons", "gtf", "output")
    s.add_argument("--gene", nargs="*", default=[])
    s.add_argument("--transcript-as-gene", action="store_true")
    command("add-receptors", "matrix", "contigs", "output").add_argument("--least", type=float, default=0.5)
    s = command("correspondence", "matrix", "output", "inputs")
    s.add_argument("--query", action="append", default=[])
    s.add_argument("--score", default="tau")
    command("subset", "matrix", "output").add_argument("--query", action="append", required=True)
    command("normalize", "matrix", "output").add_argument("--target", type=float, default=10_000.0)
    s = command("markers", "matrix", "level", "output")
    s.add_argument("--layer", default="")
    s.add_argument("--top", type=int, default=500)
    s = command("window-clusters", "matrix", "output")
    for flag, default in (("--size", 200), ("--step", 50), ("--cut", 5), ("--levels", 1)):
        s.add_argument(flag, type=int, default=default)
    s.add_argument("--layer", default="")
    command("transcription-starts", "reads", "output").add_argument("--contigs", default="chr")
    command("enrichment", "scores", "pathways", "output").add_argument("--weight", type=float, default=0.0)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("cytoplane").getOrCreate()
    if a.command == "combine":
        writers.matrix(combine([readers.matrix(spark, f) for f in a.inputs]), a.output)
    elif a.command == "convert-triplets":
        f = spark.read.option("sep", "\t").schema("name string, gene string, type string").csv(a.features).withColumn("at", F.monotonically_increasing_id())
        f = windows.running_total(f.withColumn("one", F.lit(1)), ["at"], "one", "upto")
        f = f.select((F.col("upto") - 1).cast("long").alias("gene_id"), "gene", "type")
        writers.matrix(readers.feature_matrix(readers.triplets(spark, a.matrix), f, exclude_types=a.exclude), a.output)
    elif a.command == "split-exons":
        writers.gtf(scalars.split_exons(readers.gtf(spark, a.gtf), a.gene, a.transcript_as_gene), a.output)
    elif a.command == "add-receptors":
        m = readers.matrix(spark, a.matrix)
        wide = receptors.contigs_to_cells(readers.vdj_contigs(spark, a.contigs), ["cdr3"])
        writers.matrix(type(m)(m.layers, joins.guarded(m.cells, wide, "barcode", a.least), m.genes, m.attrs), a.output)
    elif a.command == "subset":
        m = readers.matrix(spark, a.matrix)
        writers.matrix(m.subset(cells=scalars.predicate(m.cells, a.query)), a.output)
    elif a.command == "normalize":
        writers.matrix(layers.normalize_counts(readers.matrix(spark, a.matrix), denominator=a.target), a.output)
    elif a.command == "markers":
        writers.workbook(differential.markers(readers.matrix(spark, a.matrix), a.level, a.layer, a.top), a.output, "comparison")
    elif a.command == "transcription-starts":
        writers.text(genome.soft_clipped_starts(spark.read.parquet(a.reads), networks=True, contigs=a.contigs), a.output)
    elif a.command == "enrichment":
        writers.text(signatures.enrichment(spark.read.parquet(a.scores), spark.read.parquet(a.pathways), weight=a.weight), a.output)
    elif a.command == "window-clusters":
        means = genome.windowed_expression(readers.matrix(spark, a.matrix), a.size, a.step, a.cut, a.layer)
        writers.text(clustering.iterate(genome.window_vectors(means), a.levels), a.output)
    else:
        m = readers.matrix(spark, a.matrix)
        m = m.subset(cells=scalars.predicate(m.cells, a.query)) if a.query else m
        writers.text(genome.correspondence(m, {f: readers.segments(spark, f) for f in a.inputs}, score=a.score), a.output)


if __name__ == "__main__":
    main()
