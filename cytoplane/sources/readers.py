"""Readers that give tables of the annotated matrix; every one is a lazy Spark scan with a stated schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from cytoplane.model import AnnotatedMatrix, dealt, from_tables

GTF = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attribute string"
SEGMENTS = {"Chromosome": "contig", "Start.bp": "start", "End.bp": "end"}


def matrix(spark: SparkSession, folder: str) -> AnnotatedMatrix:
    """A matrix written by ``writers.matrix``: layer=<name> partitions under x, with cells and genes beside it."""
    x = spark.read.parquet(f"{folder}/x")
    names = [r[0] for r in x.select("layer").distinct().collect()]
    own = lambda n: x.where(F.col("layer") == n).drop("layer")
    layers = {("" if n == "main" else n): own(n) for n in names}
    return AnnotatedMatrix(layers, spark.read.parquet(f"{folder}/cells"), spark.read.parquet(f"{folder}/genes"))


def dense_text(spark: SparkSession, path: str, sep: str = "\t", gene_col: str | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """(gene, cell, value) of the non-zero entries of a text matrix with cells as columns; genes are the first column
    unless named. Negative values are kept."""
    t = spark.read.option("sep", sep).option("header", True).csv(path)
    gene = gene_col or t.columns[0]
    for a, b in (renames or {}).items():
        t = t.withColumnRenamed(a, b)
    cells = [c for c in t.columns if c != gene]
    long = t.unpivot([gene], cells, "cell", "value").select(F.col(gene).alias("gene"), "cell", F.col("value").cast("double").alias("value"))
    return long.where("value <> 0")


def triplets(spark: SparkSession, path: str, base: int = 1, sep: str = " ") -> DataFrame:
    """(gene_id, cell_id, value) of a coordinate file 'row column value' with ``base``-based indices; '%' lines and the
    size line (the first other one) are left out."""
    t = spark.read.option("sep", sep).option("comment", "%").schema("i long, j long, v double").csv(path).withColumn("__at", F.monotonically_increasing_id())
    first = t.agg(F.min("__at").alias("__first"))
    t = t.crossJoin(F.broadcast(first)).where("__at <> __first")
    return t.select((F.col("i") - base).alias("gene_id"), (F.col("j") - base).alias("cell_id"), F.col("v").alias("value"))


def feature_matrix(x: DataFrame, features: DataFrame, exclude_types: list[str] | None = None, whitelist: list[str] | None = None, as_cell_columns: list[str] | None = None, label: tuple[str, str] | None = None, cells: DataFrame | None = None, rows: int | None = None) -> AnnotatedMatrix:
    """A matrix from triplets and features (gene_id, gene, type): feature types excluded, genes kept by a list, some
    features turned into cell columns (0 where absent), a constant label column. rows: the number of x, if known."""
    x = dealt(x, rows, "gene_id")
    f = features
    f = f.where(~F.col("type").isin(exclude_types)) if exclude_types else f
    moved = f.where(F.col("gene").isin(as_cell_columns)) if as_cell_columns else None
    f = f.where(F.col("gene").isin(whitelist)) if whitelist else f
    f = f.where(~F.col("gene").isin(as_cell_columns)) if as_cell_columns else f
    c = cells if cells is not None else x.select("cell_id").distinct()
    if moved is not None:
        wide = x.join(moved.select("gene_id", "gene"), "gene_id").groupBy("cell_id").pivot("gene", as_cell_columns).agg(F.first("value"))
        c = c.join(wide, "cell_id", "left").na.fill(0.0, as_cell_columns)
    if label:
        c = c.withColumn(label[0], F.lit(label[1]))
    return from_tables(x.join(f.select("gene_id"), "gene_id", "left_semi"), c, f, rows, "gene_id")


def other_features_as_columns(x: DataFrame, features: DataFrame, expression: str = "Gene Expression") -> DataFrame:
    """cell_id and a column for each feature of another type that has a value other than 0 anywhere."""
    o = x.join(features.where(F.col("type") != expression).select("gene_id", "gene"), "gene_id").where("value <> 0")
    names = [r[0] for r in o.select("gene").distinct().orderBy("gene").collect()]
    return o.groupBy("cell_id").pivot("gene", names).agg(F.first("value")).na.fill(0.0)


def vdj_contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns of an annotation file, '#' lines left out; quotes belong to the attributes."""
    return spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(GTF).csv(path)


def segments(spark: SparkSession, path: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Copy-number segments with contig, start and end, other columns by their names with '.' as '_'; X is 23."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    r = SEGMENTS | (renames or {})
    t = t.toDF(*[r.get(c, c.replace(".", "_")) for c in t.columns])
    number = F.expr("try_cast(replace(contig, 'chr', '') AS int)")
    t = t.withColumn("contig", F.when(F.upper(F.regexp_replace("contig", "^chr", "")) == "X", 23).otherwise(number))
    return t.select("contig", *[F.col(c).cast("double" if c not in ("start", "end") else "long").alias(c) for c in t.columns if c != "contig"])


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(gene) of a one-column file, trimmed, without blanks and repeats."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''").distinct()


def signature(genes: DataFrame, names: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """(genes plus a flag for those in names, names that no gene has)."""
    flagged = genes.join(names.select("gene", F.lit(True).alias(out)).distinct(), "gene", "left").withColumn(out, F.coalesce(out, F.lit(False)))
    return flagged, names.join(genes, "gene", "left_anti")


def gene_positions(genes: DataFrame, positions: DataFrame, least: float = 0.95, with_x: bool = True) -> DataFrame:
    """genes with contig, start and end from positions (gene, contig, start, end); raises if under ``least`` of them are
    known. Only numbered contigs stay, and X with with_x; the first record of a gene counts."""
    known = genes.join(positions.select("gene").distinct().withColumn("k", F.lit(1)), "gene", "left").agg(F.avg(F.col("k").isNotNull().cast("double"))).first()[0]
    if known is not None and known < least:
        raise ValueError(f"only {known:.2f} of the genes are known")
    ok = F.col("contig").rlike("^[0-9]+$") | (F.lit(with_x) & (F.col("contig") == "X"))
    one = positions.where(ok).withColumn("rn", F.row_number().over(Window.partitionBy("gene").orderBy("contig", "start"))).where("rn = 1").drop("rn")
    return genes.join(one, "gene", "left")


class ArraySource(DataSource):
    """spark.read.format("cytoplane_npz").option("path", ...): coordinate triplets of an .npz sparse matrix in CSC or COO
    form, read in column ranges by parallel tasks (option 'tasks', default 8)."""

    @classmethod
    def name(cls) -> str:
        return "cytoplane_npz"

    def schema(self) -> str:
        return "gene_id long, cell_id long, value double"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options)


class ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tasks = options["path"], int(options.get("tasks", 8))

    def partitions(self):
        from pyspark.sql.datasource import InputPartition

        return [InputPartition(i) for i in range(self.tasks)]

    def read(self, partition):
        import numpy as np

        z, i, n = np.load(self.path, allow_pickle=False), partition.value, self.tasks
        if "indptr" in z:
            ptr = z["indptr"]
            cols = range(i * (len(ptr) - 1) // n, (i + 1) * (len(ptr) - 1) // n)
            rows, data = z["indices"], z["data"]
            for c in cols:
                for k in range(int(ptr[c]), int(ptr[c + 1])):
                    yield int(rows[k]), c, float(data[k])
        else:
            row, col, data = z["row"], z["col"], z["data"]
            for k in range(i * len(data) // n, (i + 1) * len(data) // n):
                yield int(row[k]), int(col[k]), float(data[k])


def workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """{sheet: table} of an .xlsx file on the driver as ``writers.workbook`` and office programs write it (inline or shared
    strings); the first row names the columns, values are texts, empty cells null."""
    import re
    import zipfile
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    texts = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")

    def number(ref: str) -> int:
        n = 0
        for c in re.match("[A-Z]+", ref)[0]:
            n = 26 * n + ord(c) - 64
        return n - 1

    out = {}
    with zipfile.ZipFile(path) as z:
        shared = [texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
            target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))].lstrip("/").removeprefix("xl/")
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(f"xl/{target}")).iter() if local(e) == "row"):
                got: dict[int, str] = {}
                for i, c in enumerate(row):
                    value = next((e.text for e in c if local(e) == "v"), None)
                    value = texts(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" else value
                    got[number(c.get("r")) if c.get("r") else i] = value
                rows.append([got.get(i) for i in range(max(got, default=-1) + 1)])
            cols = rows[0] if rows else []
            schema = ", ".join(f"`{c}` string" for c in cols)
            out[s.get("name")] = spark.createDataFrame([tuple((r + [None] * len(cols))[: len(cols)]) for r in rows[1:]], schema)
    return out
