"""Writers of matrices and of the text formats of other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.model import AnnotatedMatrix
from cytoplane.operators.windows import running_total


def matrix(m: AnnotatedMatrix, folder: str) -> None:
    """x (partitioned by layer), cells and genes as Parquet; ``readers.matrix`` reads it."""
    for name, x in m.layers.items():
        x.withColumn("layer", F.lit(name or "main")).write.mode("append").partitionBy("layer").parquet(f"{folder}/x")
    m.cells.write.parquet(f"{folder}/cells")
    m.genes.write.parquet(f"{folder}/genes")


def by_cluster(tables: DataFrame, folder: str, cluster: str = "cluster") -> None:
    """One folder of CSV per cluster."""
    tables.write.option("header", True).partitionBy(cluster).csv(folder)


def workbook(tables: DataFrame, path: str, sheet: str, most: int = 1_000_000) -> None:
    """An .xlsx file on the driver with one sheet per value of column ``sheet`` (in order), a header and the other columns.

    The format has room for about a million rows a sheet and one file is one driver's work, so more than ``most`` rows in
    all raise; meant for tables of top markers. Null cells stay empty.
    """
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    rows = tables.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    cols = [c for c in tables.columns if c != sheet]
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: str(r[sheet])):
        by.setdefault(str(r[sheet]), []).append([r[c] for c in cols])

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    at = range(1, len(by) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}worksheet+xml"/>' for i in at)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(at, by))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in at)
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, own in zip(at, by.values()):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [cols, *own])
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def sheet_name(cluster: Column, siblings: Column) -> Column:
    """'a up vs. b, c', or a shorter form where over 31 characters."""
    full = F.concat(cluster, F.lit(" up vs. "), F.array_join(siblings, ", "))
    short = F.concat(cluster, F.lit(" up"))
    return F.when(F.length(full) < 32, full).when(F.length(short) < 32, short).otherwise(F.right(cluster, F.lit(31)))


def class_lines(cells: DataFrame, phenotype: str, order: str = "cell_id") -> DataFrame:
    """(line, text): the three lines of a class file: sizes, names, and each cell's class index in order."""
    names = cells.where(F.col(phenotype).isNotNull()).select(phenotype).distinct()
    indexed = names.withColumn("i", F.row_number().over(Window.orderBy(phenotype)) - 1)
    row = lambda c, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(c).cast("string").alias("v")))), lambda s: s["v"]), " ")
    k = names.agg(F.count(F.lit(1)).alias("k"))
    n = cells.where(F.col(phenotype).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    one = n.crossJoin(k).select(F.lit(1).alias("line"), F.concat_ws(" ", F.col("n").cast("string"), F.col("k").cast("string"), F.lit("1")).alias("text"))
    two = indexed.agg(F.concat(F.lit("# "), row(phenotype, "i")).alias("text")).select(F.lit(2).alias("line"), "text")
    three = cells.join(indexed, phenotype).agg(row("i", order).alias("text")).select(F.lit(3).alias("line"), "text")
    return one.unionByName(two).unionByName(three)


def counts_and_meta(m: AnnotatedMatrix, kind: str, cells: list, layer: str = "", orthologs: DataFrame | None = None, gene: str = "gene", cell: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """(wide counts with a row per gene and a column per cell of ``cells``, (Cell, cell_type)); with orthologs (gene,
    target) rows are renamed, the first gene by name standing for several."""
    x = m.layers[layer].join(m.genes.select("gene_id", F.col(gene).alias("Gene")), "gene_id")
    if orthologs is not None:
        first = orthologs.groupBy("target").agg(F.min("gene").alias("gene"))
        x = x.join(first, x["Gene"] == first["gene"]).withColumn("Gene", F.col("target"))
    wide = x.groupBy("Gene").pivot("cell_id", cells).agg(F.sum("value")).na.fill(0.0)
    return wide, m.cells.select(F.col(cell).alias("Cell"), F.col(kind).alias("cell_type"))


def matrix_market(m: AnnotatedMatrix, layer: str = "") -> DataFrame:
    """(text): coordinate lines with 1-based dense indices of genes and cells in the order of their ids, largest first line
    being the sizes. Dense indices come from ids dealt by ranges, so no task sees a whole axis."""
    axis = lambda df, c: running_total(df.select(c, F.lit(1).cast("long").alias("one")), [c], "one", f"n_{c}").drop("one")
    g, c = axis(m.genes, "gene_id"), axis(m.cells, "cell_id")
    x = m.layers[layer].where("value <> 0").join(g, "gene_id").join(c, "cell_id")
    size = m.genes.agg(F.count(F.lit(1)).alias("a")).crossJoin(m.cells.agg(F.count(F.lit(1)).alias("b"))).crossJoin(x.agg(F.count(F.lit(1)).alias("n")))
    head = size.select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.concat_ws(" ", "a", "b", "n").alias("text"))
    body = x.select(F.col("n_gene_id").cast("long").alias("i"), F.col("n_cell_id").cast("long").alias("j"), F.concat_ws(" ", "n_gene_id", "n_cell_id", "value").alias("text"))
    return head.unionByName(body).orderBy("j", "i").select("text")


def metadata_kinds(cells: DataFrame, cols: list[str], share: float = 0.1, given: dict[str, str] | None = None) -> DataFrame:
    """(column, kind): 'group' for texts and for columns with few distinct values, else 'numeric'."""
    n = F.count(F.lit(1))
    kinds = dict(cells.dtypes)
    each = [F.struct(F.lit(c).alias("column"), F.when(F.lit(kinds[c] == "string") | (F.count_distinct(F.col(c)) < n * share), "group").otherwise("numeric").alias("kind")) for c in cols]
    out = cells.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    for c, k in (given or {}).items():
        out = out.withColumn("kind", F.when(F.col("column") == c, k).otherwise(F.col("kind")))
    return out


def text(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def gtf(df: DataFrame, path: str) -> None:
    """The nine columns of an annotation file, tab-separated, as they are (no header, no quoting)."""
    cols = "seqname source feature start end score strand frame attribute".split()
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in cols]).alias("value")).write.text(path)
