"""The annotated matrix: long value tables (one per layer) with cell and gene attribute tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task is dealt at most where the number of a layer's rows is known: what a task sorts and counts stays bounded.
TASK_ROWS = 250_000


def dealt(x: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """x, of about so many rows, dealt by keys over tasks of ``TASK_ROWS``. It stays as it is where the number isn't known or the
    session's number of partitions is enough."""
    tasks = -(-(rows or 0) // TASK_ROWS)
    return x.repartition(tasks, *keys) if tasks > int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")) else x


@dataclass(frozen=True)
class AnnotatedMatrix:
    """layers: name to (cell_id, gene_id, value), zeros implicit; cells and genes hold one row per id. Immutable."""

    layers: dict[str, DataFrame]
    cells: DataFrame
    genes: DataFrame
    attrs: dict[str, object] = field(default_factory=dict)

    @property
    def x(self) -> DataFrame:
        return self.layers[""]

    def dealt(self, x: DataFrame, *keys: str, times: float = 1) -> DataFrame:
        """``dealt`` by the attribute 'rows' (what a layer holds at most), ``times`` as many."""
        rows = self.attrs.get("rows")
        return dealt(x, rows and int(rows * times), *keys)

    def with_layer(self, name: str, x: DataFrame) -> AnnotatedMatrix:
        return replace(self, layers={**self.layers, name: x.select("cell_id", "gene_id", "value")})

    def _with(self, side: str, key: str, more: DataFrame, overwrite: bool) -> AnnotatedMatrix:
        have = getattr(self, side)
        new = [c for c in more.columns if c != key]
        clash = [c for c in new if c in have.columns]
        if clash and not overwrite:
            raise ValueError(f"{side} already has {clash}; pass overwrite=True to replace them")
        return replace(self, **{side: have.drop(*clash).join(more, key, "left")})

    def with_cells(self, more: DataFrame, overwrite: bool = False) -> AnnotatedMatrix:
        """Attributes joined to cells by cell_id; cells without a row get null."""
        return self._with("cells", "cell_id", more, overwrite)

    def with_genes(self, more: DataFrame, overwrite: bool = False) -> AnnotatedMatrix:
        return self._with("genes", "gene_id", more, overwrite)

    def with_attr(self, name: str, value: object) -> AnnotatedMatrix:
        return replace(self, attrs={**self.attrs, name: value})

    def subset(self, cells: Column | None = None, genes: Column | None = None) -> AnnotatedMatrix:
        """Cells and genes for which the predicates hold; values of others go by semi-joins."""
        c = self.cells if cells is None else self.cells.where(cells)
        g = self.genes if genes is None else self.genes.where(genes)

        def cut(x: DataFrame) -> DataFrame:
            x = x if cells is None else x.join(c.select("cell_id"), "cell_id", "left_semi")
            return x if genes is None else x.join(g.select("gene_id"), "gene_id", "left_semi")

        return replace(self, layers={k: cut(v) for k, v in self.layers.items()}, cells=c, genes=g)

    def dense(self, layer: str = "") -> DataFrame:
        """All cell and gene pairs with 0 where nothing is stored; only for operators that need zeros row by row."""
        pairs = self.cells.select("cell_id").crossJoin(self.genes.select("gene_id"))
        return pairs.join(self.layers[layer], ["cell_id", "gene_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))

    def check(self) -> None:
        """Raises unless ids are unique and every value has its cell and gene."""
        for frame, key in ((self.cells, "cell_id"), (self.genes, "gene_id")):
            if not frame.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{key} is not unique")
            for name, x in self.layers.items():
                if not x.join(frame, key, "left_anti").isEmpty():
                    raise ValueError(f"layer {name!r} has values of unknown {key}")


def from_tables(x: DataFrame, cells: DataFrame, genes: DataFrame, rows: int | None = None, by: str = "cell_id", **layers: DataFrame) -> AnnotatedMatrix:
    """A matrix from its tables; duplicate entries of a cell and gene are added up. rows: the number of x, if known, by which
    tasks are counted (attribute 'rows'); x is then dealt by ``by``."""
    x = dealt(x.select("cell_id", "gene_id", "value"), rows, by)
    x = x.groupBy("cell_id", "gene_id").agg(F.sum(F.col("value").cast("double")).alias("value"))
    return AnnotatedMatrix({"": x, **layers}, cells, genes, {"rows": rows} if rows else {})


def combine(parts: list[AnnotatedMatrix]) -> AnnotatedMatrix:
    """Matrices with disjoint cells, stacked; genes are united, and what a part lacks is an implicit zero.

    Attributes that only some parts have are null in the others; layers that not all parts have are dropped.
    """
    shared = [k for k in parts[0].layers if all(k in p.layers for p in parts)]
    cells, genes = parts[0].cells, parts[0].genes
    layers = {k: parts[0].layers[k] for k in shared}
    for p in parts[1:]:
        cells = cells.unionByName(p.cells, allowMissingColumns=True)
        genes = genes.unionByName(p.genes, allowMissingColumns=True)
        layers = {k: v.unionByName(p.layers[k]) for k, v in layers.items()}
    rest = [c for c in genes.columns if c != "gene_id"]
    return AnnotatedMatrix(layers, cells, genes.groupBy("gene_id").agg(*[F.max(c).alias(c) for c in rest]) if rest else genes.distinct())
