"""Sharding: contiguous shards of near equal bytes, cut where global prefix sums of sizes reach equal targets."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table


def in_order(docs: DataFrame, order: list[str], text_col: str = "text") -> DataFrame:
    """docs dealt by ranges of order and sorted, plus __range and __pos: which range a row is in, and where in it. Written to
    the shared folder, so that both stay what they are whatever is lost or run again.

    Rows equal in ``order`` are told apart by a hash of the text and then by where they were read, so that no key, however
    many rows hold it, has to fit one range.
    """
    told = docs.withColumns({"__hash": F.xxhash64(text_col) if text_col in docs.columns else F.lit(0), "__read": F.monotonically_increasing_id()})
    keys = [*order, "__hash", "__read"]
    at = F.monotonically_increasing_id()
    dealt = told.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__hash", "__read").withColumn("__at", at)
    mask = (1 << 33) - 1  # an id holds the partition's number above 33 bits of the row's
    return stored(dealt.select(*docs.columns, F.shiftright("__at", 33).cast("int").alias("__range"), F.col("__at").bitwiseAND(F.lit(mask)).alias("__pos")))


def cut_points(placed: DataFrame, shards: int, size: str) -> tuple[list[int], dict[int, int]]:
    """The first row of each shard, by its place among all rows, and the rows before each range.

    What meets on the driver is a row per range (its bytes and rows) and per shard. Bytes are summed row by row only in ranges
    that a target lies in, one window a range.
    """
    totals = sorted(tuple(r) for r in placed.groupBy("__range").agg(F.sum(size), F.count(F.lit(1))).collect())
    before = [0, *accumulate(t[1] for t in totals)]
    rows = [0, *accumulate(t[2] for t in totals)]
    starts = {t[0]: rows[i] for i, t in enumerate(totals)}
    whole = before[-1]
    if not whole:
        return [0] + [rows[-1]] * (shards - 1), starts
    # The middle of a row, in bytes, decides: so a cut is at the row's end that is nearer to the target.
    holds = [bisect_right(before, k * whole // shards) - 1 for k in range(1, shards)]
    ranges = sorted(set(holds))
    offsets = placed.sparkSession.createDataFrame([(totals[i][0], before[i]) for i in ranges], "__range int, __before long")
    mine = placed.where(F.col("__range").isin([totals[i][0] for i in ranges])).join(F.broadcast(offsets), "__range")
    end = F.col("__before") + F.sum(size).over(Window.partitionBy("__range").orderBy("__pos"))
    exact = lambda c: c.cast("decimal(38,0)")
    mine = mine.select("__range", "__pos", exact((2 * end - F.col(size)) * exact(F.lit(shards))).alias("__middle"), exact(F.lit(2 * whole)).alias("__whole"))
    firsts: dict[int, list[tuple[int, int]]] = {}
    for r, shard, pos in mine.groupBy("__range", F.expr("__middle div __whole").alias("__shard")).agg(F.min("__pos")).collect():
        firsts.setdefault(r, []).append((shard, starts[r] + pos))
    # If no row of the range has its middle past the target, the next range's first row is the first that has.
    return [0] + [min([p for s, p in firsts[totals[i][0]] if s >= k], default=rows[i + 1]) for k, i in enumerate(holds, 1)], starts


def shard_documents(docs: DataFrame, shards: int = 40, order: list[str] | None = None, overhead: int = 16, text_col: str = "text", id_col: str = "doc_id", size_col: str | None = None) -> DataFrame:
    """docs plus size, shard and slot (replacing columns of those names): contiguous runs in ``order`` (by default the id),
    cut at equal shares of all bytes; slot counts from 0 in each shard.

    size: UTF-8 bytes of the text (null: none) plus ``overhead``, or ``size_col``, which must be over 0. A row belongs to
    the shard in which its middle byte lies, so a cut misses its target by half a row at most, and a row larger than a
    target leaves the shards that it covers empty. Every row gets a shard: rows without an id come first, repeated rows
    each have a slot of their own. Fewer rows than shards leave shards empty; no rows give none.

    Rows are dealt by ranges once and stored; totals are a row per range. With the cuts and the rows before each range
    known, every row's shard and slot follow from its place: nothing is shuffled again.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    size = F.col(size_col).cast("long") if size_col else F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + overhead
    base = docs.withColumn("__size", size).drop(*[c for c in ("shard", "slot") if c in docs.columns])
    placed = in_order(base, order or [id_col], text_col)
    firsts, starts = cut_points(placed.select("__range", "__pos", "__size"), shards, "__size")
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(sorted(starts.items()), "__range int, __rows long"))
    cuts = F.array(*[F.lit(x).cast("long") for x in firsts])
    out = placed.join(offsets, "__range").withColumn("__row", F.col("__rows") + F.col("__pos"))
    # The last of the shards that begin at or before the row: those before it with the same beginning are empty.
    out = out.withColumn("shard", F.size(F.filter(cuts, lambda c: c <= F.col("__row"))) - 1)
    out = out.withColumn("slot", F.col("__row") - F.get(cuts, F.col("shard")))
    return out.withColumn("size", F.col("__size")).drop("__range", "__pos", "__size", "__rows", "__row")


def write_shards(sharded: DataFrame, path: str, format: str = "parquet") -> None:
    """Shards as folders shard=0, shard=1, ..., each of files in the order of slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").format(format).save(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_documents(narrow.withColumn("bytes", F.col("bytes") + 16), 40, ["doc_id", "text_crc32"], size_col="bytes")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is CRC-32 bit by bit in whole bytes: a step of the reduction takes a byte, its inner one the byte's eight bits.
ORACLE = r"""
WITH sized AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT + 16 AS size FROM documents),
placed AS (
  SELECT doc_id, t, size, row_number() OVER o - 1 AS r, (sum(size) OVER o)::HUGEINT AS upto, (sum(size) OVER ())::HUGEINT AS whole
  FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT doc_id, t, size, r, ((2 * upto - size) * 40 // (2 * whole))::INT AS shard FROM placed),
crc AS (
  SELECT t, xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(t)), '..')]),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM (SELECT DISTINCT t FROM sized),
       (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, [0::BIGINT FOR i IN range(0, 8)]),
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS steps))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, NULL::INT AS grown_shard
FROM cut JOIN crc USING (t)
"""
