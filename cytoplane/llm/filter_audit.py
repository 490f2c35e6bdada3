"""Filter interaction audit: what filters remove, keep and hide from each other, in every order of applying them."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash128, spread_join, table

WORD_GAP = r"[\x20\x09-\x0D]+"


def flag_documents(
    docs: DataFrame,
    min_words: int = 50,
    least_distinct_percent: int = 65,
    most_upper_percent: int = 5,
    marks: str = r"[#$%&*|]",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """docs without their text, plus booleans A to E: whether a document fails a filter (replacing columns of those names).

    A: under ``min_words`` words (maximal runs without ASCII white space, case-sensitive). B: 100 * distinct words under
    ``least_distinct_percent`` * words. C: 100 * A-Z over ``most_upper_percent`` * code points. D: holds one of
    ``marks``. E: the whole text is also that of a smaller id anywhere in the table. Null text counts as empty. A row
    without an id has no smaller one and is smaller than none: it fails E not, nor makes others fail. Repeated rows of one
    id don't make each other fail. Texts stay where they are; of each, two 64-bit hashes and its id are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP, -1), "")
    rest = [c for c in docs.columns if c not in (text_col, *"ABCDE")]
    h1, h2 = hash128(text)
    seen = docs.select(*rest, h1.alias("__h1"), h2.alias("__h2"), words.alias("__words"), F.length(text).alias("__n"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("__upper"), text.rlike(marks).alias("D"))
    n = F.size("__words")
    seen = seen.select(
        *rest,
        "__h1",
        "__h2",
        (n < min_words).alias("A"),
        (F.size(F.array_distinct("__words")) * 100 < n * least_distinct_percent).alias("B"),
        (F.col("__upper").cast("long") * 100 > F.col("__n").cast("long") * most_upper_percent).alias("C"),
        "D",
    )
    ids = docs.where(F.col(id_col).isNotNull()).select(h1.alias("__h1"), h2.alias("__h2"), F.col(id_col).alias("__id"))
    shared = ids.groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last").drop("__last")
    flagged = spread_join(seen, shared, ["__h1", "__h2"], id_col, how="left", grows=True)
    return flagged.withColumn("E", F.coalesce(F.col(id_col) > F.col("__first"), F.lit(False))).drop("__h1", "__h2", "__first")


def lattice(filters: str) -> tuple[list[tuple], list[tuple]]:
    """The edges (applied, bit, weight) of the lattice of subsets of ``filters``, and the steps (filter_order, step, filter,
    applied, bit) of all orders as paths through it. A subset is the sum of its filters' bits; the weight of an edge is the
    number of orders whose path takes it."""
    n, bit = len(filters), {f: 1 << i for i, f in enumerate(filters)}
    edges = [(s, b, math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) for s in range(1 << n) for b in bit.values() if not s & b]
    steps = [("".join(o), k + 1, f, sum(bit[x] for x in o[:k]), bit[f]) for o in itertools.permutations(filters) for k, f in enumerate(o)]
    return edges, steps


def interaction_audit(flagged: DataFrame, filters: str = "ABCDE", part: Column | str = "source", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """Per part, filter_order (each permutation of ``filters``, one letter a boolean column of flagged) and step: kept,
    removed, redundant, unique_fails, good_lost, toxic_lost and shapley, as counts of rows of that part.

    ``kept`` after the step; ``removed`` by its filter here; ``redundant``: failing it, removed before; ``unique_fails``:
    failing it alone; ``good_lost``, ``toxic_lost``: of those removed, the rows where good or toxic holds; ``shapley``:
    what its filter removes, summed over all orders. A null part is the empty string; nulls in a filter, good or toxic are
    false. No rows: no result.

    Rows are first counted by part and by the set of filters they fail, where they are (at most 4 * 2^n counts a part leave a task).
    These counts go to each (applied subset, next filter) edge of the lattice; n! orders are then joined to
    the n * 2^(n-1) edges on their paths, so that work for orders is the same for any number of rows.
    """
    edges, steps = lattice(filters)
    spark, yes = flagged.sparkSession, lambda c: F.coalesce(c, F.lit(False))
    fails = sum((F.when(yes(F.col(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    part = F.col(part) if isinstance(part, str) else part
    rows = flagged.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), fails.alias("fails"), *[(F.lit(False) if c is None else yes(c)).alias(k) for k, c in (("good", good), ("toxic", toxic))])
    counted = rows.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))

    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("weight")) for s, b, w in edges])).alias("edge")
    on = counted.select("*", edge).select("part", "fails", "good", "toxic", "n", "edge.*")
    before, here = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(F.col("bit")) != 0
    total = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    removed = ~before & here
    sums = on.groupBy("part", "applied", "bit", "weight").agg(
        total(~before & ~here, "kept"),
        total(removed, "removed"),
        total(before & here, "redundant"),
        total(F.col("fails") == F.col("bit"), "unique_fails"),
        total(removed & F.col("good"), "good_lost"),
        total(removed & F.col("toxic"), "toxic_lost"),
    )
    # An array of a part's edges: 2^(n-1) a filter, whatever the rows. Its weighted sum needs no second join.
    own = F.collect_list(F.struct("applied", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")).alias("edges")
    per_filter = sums.groupBy("part", "bit").agg(own, F.sum(F.col("removed") * F.col("weight")).alias("shapley")).select("part", "bit", "shapley", F.explode("edges").alias("e")).select("part", "bit", "shapley", "e.*")
    paths = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, applied int, bit int"))
    return per_filter.join(paths, ["applied", "bit"]).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs plus booleans good and toxic (replacing columns of those names): whether any label row of the id has quality = 1
    or toxic = 1; without label rows, or without an id, both are false."""
    held = labels.groupBy(F.col("doc_id").alias("__lid")).agg(F.max(F.col("quality") == 1).alias("__good"), F.max(F.col("toxic") == 1).alias("__toxic"))
    base = docs.select([c for c in docs.columns if c not in ("good", "toxic")])
    out = spread_join(base.withColumn("__lid", F.col(id_col)), held, ["__lid"], "E" if "E" in docs.columns else id_col, how="left", grows=True)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.withColumns({"good": yes("__good"), "toxic": yes("__toxic")}).drop("__lid", "__good", "__toxic")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    labelled = with_labels(flagged, table(spark, sf_dir, "labels"))
    return interaction_audit(labelled, good=F.col("good"), toxic=F.col("toxic")).drop("filter")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM base GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT b.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(b.t, '[^A-Z]', '', 'g')) > 5 * length(b.t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(b.t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN b.doc_id > f.first THEN 16 ELSE 0 END) AS fails
  FROM base b JOIN firsts f ON b.t = f.t LEFT JOIN marks m ON b.doc_id = m.doc_id),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM flagged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS applied
  FROM orders, (SELECT unnest(range(1, 6)) AS k)),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & applied = 0 AND fails & bit = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & applied <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
