"""MinHash near-dedup: fast similarity sketching, banding, exact verification, components.

Sketch: t bins; in round i < t every shingle is hashed to one bin and the least (round, value) stays in each bin; in
rounds t to 2t-1 every shingle is hashed into bin i-t, which fills what is still empty. Rounds stop once all bins of a
document are filled, so long documents take a few rounds and short ones are cheap anyway (Dahlgaard, Knudsen and Thorup,
"Fast Similarity Sketching", FOCS 2017).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, released, spread_join, stored, table

U = np.uint64
#: Text handled at once in a worker, in bytes.
AT_ONCE = 1 << 20
#: Shingles a member of a block has on average, at most; a bucket of longer texts is dealt over more blocks.
AVERAGE = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
BASE = U(0x9E3779B97F4A7C15) | U(1)
POWERS = np.cumprod(np.full(1 << 12, BASE, np.uint64), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global POWERS
    if n > len(POWERS):
        POWERS = np.cumprod(np.full(max(n, 2 * len(POWERS)), BASE, np.uint64), dtype=np.uint64)
    return POWERS[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, words being runs of other bytes than ASCII white space, A-Z lower-cased."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.flatnonzero(~BLANK[b])
    if not len(inside):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
    lengths = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(BYTE[b[inside]] * powers(int(lengths.max()))[place], first) + lengths.astype(np.uint64))


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, one of the whole sequence; of none, nothing."""
    w = word_hashes(raw)
    n = len(w)
    if n == 0:
        return w
    width = min(k, n)
    h = np.full(n - width + 1, U(width), np.uint64)
    for j in range(width):
        h = mix(h * BASE + w[j : n - width + 1 + j])
    return np.unique(h)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(len(sets), t) coordinates: the round in the top 16 bits, 48 bits of the value below. Sets must not be empty."""
    n = len(sets)
    out = np.full((n, t), np.iinfo(np.uint64).max, np.uint64)
    flat, open_ = out.reshape(-1), np.arange(n)
    x, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * t):
        h = mix(x ^ mix(np.array([i + 1], np.uint64) * U(0xD1B54A32D192ED03)))
        bins = ((h >> U(40)) * U(t) >> U(24)).astype(np.int64) if i < t else np.full(len(h), i - t)
        v = (U(i) << U(48)) | (mix(h) >> U(16))
        np.minimum.at(flat, owner * t + bins, v)
        still = (out[open_] == np.iinfo(np.uint64).max).any(axis=1)
        if not still.all():
            open_ = open_[still]
            if not len(open_):
                break
            go = np.zeros(n, bool)
            go[open_] = True
            keep = go[owner]
            x, owner = x[keep], owner[keep]
    return out


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(s), bands), np.uint64)
    part = s[:, : bands * rows].reshape(len(s), bands, rows)
    for j in range(rows):
        h = mix(h * BASE + part[:, :, j])
    return h


def _sketch_batches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            start, size = 0, 0
            for i in range(b.num_rows):
                size += len(texts[i].as_buffer() or b"")
                if size >= AT_ONCE or i == b.num_rows - 1:
                    yield one(ids.slice(start, i + 1 - start), texts.slice(start, i + 1 - start))
                    start, size = i + 1, 0

    def one(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", k) for x in texts]
        some = [i for i, s in enumerate(sets) if len(s)]
        digest: list = [None] * len(sets)
        keys: list = [None] * len(sets)
        codes: list = [None] * len(sets)
        if some:
            s = sketches([sets[i] for i in some], bands * rows)
            b = band_keys(s, bands, rows).view(np.int64)
            short = (mix(s) >> U(56)).astype(np.uint8)
            for j, i in enumerate(some):
                digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                keys[i], codes[i] = b[j], short[j].tobytes()
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary())],
            ["id", "n", "digest", "bands", "code"],
        )

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * |A and B| >= percent * |A or B|, on the whole sets.

    Texts travel to their pairs row by row: a document with any number of partners is split like any skewed join key.
    """
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("raw").alias("raw_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("raw").alias("raw_b")), "b").select("a", "b", "raw_a", "raw_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        last: tuple = (None, None)
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            u, v = [], []
            for a, b, ra, rb in zip(*(batch.column(i) for i in range(4))):
                if last[0] != a.as_py():
                    last = (a.as_py(), shingle_set(plain.decompress(ra.as_py()), k))
                x, y = last[1], shingle_set(plain.decompress(rb.as_py()), k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    u.append(a.as_py())
                    v.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return two.mapInArrow(released(run), "u long, v long")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = pa.array([squeeze.compress(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), raw], ["id", "raw"])


def _linked(k: int, percent: int, least: float):
    """Links between a bucket's minor members and its others: sketches that agree in ``least`` of the coordinates, then whole sets.

    A pair is looked at in the first bucket that it shares, and only while its ends aren't connected by links found here,
    so that a block gives fewer links than it has members.
    """

    def run(pdf):
        import pandas as pd
        import zstandard

        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            key = pdf["key"].iloc[0]
            codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
            bands = np.stack(right["bands"].to_list())
            ids, comps, n, minor = (right[c].to_numpy() for c in ("rep", "comp", "n", "minor"))
            raw = dict(zip(left["rep"], left["raw"])) | dict(zip(right["rep"], right["raw"]))
            sets: dict[int, np.ndarray] = {}
            above: dict[int, int] = {}
            plain = zstandard.ZstdDecompressor()

            def top(c: int) -> int:
                while (up := above.get(c, c)) != c:
                    above[c] = c = above.get(up, up)
                return c

            def whole(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingle_set(plain.decompress(raw[i]), k)
                return sets[i]

            for x in left.itertuples(index=False):
                may = np.flatnonzero((comps != x.comp) & (100 * np.minimum(n, x.n) >= percent * np.maximum(n, x.n)) & (~minor | (ids > x.rep)))
                may = may[(codes[may] == np.frombuffer(x.code, np.uint8)).mean(axis=1) >= least]
                same = bands[may] == np.asarray(x.bands)
                may = may[np.asarray(x.bands)[same.argmax(axis=1)] == key] if len(may) else may
                for i in may:
                    a, b = top(int(x.comp)), top(int(comps[i]))
                    if a != b:
                        u, v = whole(x.rep), whole(int(ids[i]))
                        both = len(np.intersect1d(u, v, assume_unique=True))
                        if 100 * both >= percent * (len(u) + len(v) - both):
                            above[max(a, b)] = min(a, b)
                            links.append((x.rep, int(ids[i])))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, bands: int = 25, rows: int = 6, block: int = 512, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words: runs of other characters than ASCII white space, A-Z lower-cased. Documents whose sets of k-word shingles have
    100 * |A and B| >= percent * |A or B| are linked; component_id is the smallest doc_id reachable. Null or empty texts
    have no shingles and no links. Rows that share a doc_id are one document; a null doc_id is never a component's name.

    Equal sets are folded into one class first. Classes that share a band meet the bucket's hub (the class met in most
    buckets) and links are verified on whole sets; classes joined thereby need no other comparison inside a bucket. The
    rest of a bucket is compared in blocks by whole sketches, and likely pairs are verified too, until connected. So a
    group of copies costs one comparison a member, and nothing is capped. Blocks are bounded by members and by shingles.
    """
    t, p = bands * rows, percent / 100
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = stored(source.mapInArrow(released(_sketch_batches(k, bands, rows)), "id long, n long, digest binary, bands array<long>, code binary"))
    classes = sk.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("code").alias("code"))
    classes = stored(classes)
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(spread_join(buckets, shared, ["key"], "rep"))
    nodes = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    ranked = members.join(nodes, "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("rep")).alias("neg"), F.col("n").alias("hub_n"))).alias("x"))
    hubs = stored(hubs.select("key", (-F.col("x.neg")).alias("hub"), "x.hub_n"))
    close = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pairs = spread_join(members, hubs, ["key"], "rep").where((F.col("rep") != F.col("hub")) & close("n", "hub_n"))
    pairs = stored(pairs.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())

    texts = source.where(F.col("id").isNotNull()).mapInArrow(released(_compressed), "id long, raw binary")
    texts = stored(texts.join(nodes.select(F.col("rep").alias("id")), "id", "left_semi"))
    links = stored(_verified(pairs, texts, k, percent))
    joined = connected_components(links)

    placed = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    placed = spread_join(placed.select("key", "rep", "n", "size", "comp"), hubs.select("key", "hub").join(joined.withColumnRenamed("node", "hub"), "hub", "left").select("key", F.coalesce("component", "hub").alias("hub_comp")), ["key"], "rep")
    placed = placed.where("size > 2").withColumn("minor", F.col("comp") != F.col("hub_comp"))
    open_ = placed.groupBy("key").agg(F.sum(F.col("minor").cast("long")).alias("minors"), F.sum("n").alias("all_n"), F.sum(F.when(F.col("minor"), F.col("n"))).alias("minor_n")).where("minors > 0")
    rest = spread_join(placed, open_, ["key"], "rep").join(classes.select("rep", "code", "bands"), "rep").join(texts.select(F.col("id").alias("rep"), "raw"), "rep")
    rest = stored(rest)
    deal = lambda rows, shingles: F.ceil(F.greatest(F.col(rows) / block, F.col(shingles) / (block * AVERAGE))).cast("int")
    rest = rest.withColumn("lefts", deal("minors", "minor_n")).withColumn("rights", deal("size", "all_n"))
    rest = rest.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("lefts")).cast("int")).withColumn("j", F.pmod(F.xxhash64("rep"), F.col("rights")).cast("int"))
    cols = ["key", "i", "j", "side", "rep", "n", "comp", "minor", "code", "bands", "raw"]
    left = rest.where("minor").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("side", F.lit(0))
    right = rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("side", F.lit(1))
    late = left.select(cols).unionByName(right.select(cols)).groupBy("key", "i", "j").applyInPandas(_linked(k, percent, p - 4.5 * (p * (1 - p) / t) ** 0.5), "u long, v long")
    late = stored(late.distinct())
    if not late.isEmpty():
        joined = connected_components(links.unionByName(late))

    named = classes.select("digest", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sk.select("id", "n", "digest").join(named, "digest", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Shared shingles counted by a join; components by the closure of links.
ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded),
one AS (SELECT doc_id, unnest(s) AS g FROM shingled),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN shingled x ON x.doc_id = a JOIN shingled y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM shingled s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
