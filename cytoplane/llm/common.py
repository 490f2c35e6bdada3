"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space of the contracts: 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; no other character changes."""
    return F.translate(c, UPPER, LOWER)


def hash128(c: Column) -> list[Column]:
    """Two differently seeded 64-bit hashes: as a pair, free of collisions for any corpus that can be stored."""
    return [F.xxhash64(c), F.xxhash64(F.lit(0x5F3759DF), c)]


def crc_mod(id_col: Column, m: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % m


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lowers the session's bytes per Arrow batch to ``size``, for kernels that see whole texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def released(run):
    """run over Arrow batches; afterwards the worker, which Spark keeps for other tasks, gives unused memory back."""

    def inner(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. One of our own only where none is set and the master is local;
    elsewhere executors would each write to their own disk, so that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='cytoplane-')}"
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def _located(spark: SparkSession, path: str):
    """The file system and path of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and outlives executors. Removed when the driver
    ends, or earlier by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cytoplane-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, at = _located(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing reads any more."""
    for t in tables:
        files, at = _located(t.sparkSession, t._stored_at)
        files.delete(at, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links to (node, component): component is the smallest node reachable.

    Alternating large-star and small-star steps; each is a minimum per node (combined before the shuffle) joined back,
    so that no neighbour list is ever gathered and a hub with any number of links is split by the skew join.
    Nodes without links don't appear. Null ends and self-links are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, last = stored(e), None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        older, e = e, stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        discard(older)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.withColumnRenamed("u", "node").unionByName(roots.join(stars.select(F.col("u").alias("node")), "node", "left_anti"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, ways: int = 8, how: str = "inner", grows: bool = False) -> DataFrame:
    """left join right on keys, each key of left dealt over ``ways`` tasks by a hash of column ``by``; right has a row a key.

    grows: right grows with the table, so it is never broadcast, however small its file or its shuffle is packed. The extra key also makes both sides meet straight after their own exchange, so that skewed ones can be split further.
    """
    l = left.withColumn("__way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    r = right.withColumn("__way", F.explode(F.array(*[F.lit(i) for i in range(ways)])))
    r = r.hint("merge") if grows else r
    return l.join(r, [*keys, "__way"], how).drop("__way")
