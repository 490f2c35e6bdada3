"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, hash128, lower_ascii, spread_join, table


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with ``text`` replaced by its kept lines, plus n_lines and n_dropped (replacing columns of those names).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Lines whose key has min_chars code
    points and is held by min_docs distinct documents stay in the smallest doc_id holding it and go elsewhere.
    Null or empty text: one empty line. A row without doc_id holds no key and loses no line. Repeated rows lose the
    same lines. Only hashes and positions are shuffled for the counts; texts move once, to meet their positions.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("__h", F.xxhash64(whole))

    # The text is hashed and split below the explode, so that neither happens again, nor is the text carried, for each line
    # (outer, since a text always has a line, and so that no filter splits it once more).
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(whole).alias("__h"), F.split(whole, "\n", -1).alias("__lines"))
    lines = own.select("__id", "__h", F.posexplode_outer("__lines").alias("pos", "line"))
    keyed = lines.select("__id", "__h", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = hash128(lower_ascii(F.col("key")))
    keyed = keyed.select("__id", "__h", "pos", h1.alias("h1"), h2.alias("h2"))
    held = keyed.groupBy("h1", "h2", "__id").agg(F.count(F.lit(1)).alias("n"))
    shared = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("__id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    drops = spread_join(keyed, shared, ["h1", "h2"], "__id").where(F.col("__id") != F.col("keeper"))
    drops = drops.groupBy("__id", "__h").agg(F.collect_set("pos").alias("__drop"))
    out = base.join(drops, (base[id_col] == drops["__id"]) & (base["__h"] == drops["__h"]), "left").drop(drops["__h"])
    out = out.withColumn("__lines", F.split(whole, "\n", -1))
    n = F.size("__lines")
    kept = F.when(F.col("__drop").isNull(), whole).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drop")), lambda i: F.get(F.col("__lines"), i)), "\n")
    )
    out = out.withColumn("__kept", kept).withColumn("n_lines", n.cast("long")).withColumn("n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.col("__kept")).drop("__lines", "__h", "__id", "__drop", "__kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (s.keeper IS NOT NULL AND k.doc_id <> s.keeper) AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
