"""Toxicity: a linear-chain CRF tags toxic spans; marginals give document scores and offending offsets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, released, table
from .crf import Crf
from .language_id import batches_of_texts

#: Bounds of the training sample: rows a class, and code points a training text (others are not drawn, never cut).
PER_CLASS, TRAIN_CHARS = 1500, 12_000


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, chars: int = TRAIN_CHARS, epochs: int = 8, text_col: str = "text", id_col: str = "doc_id") -> Crf | None:
    """Learns from at most per_class rows of each class, drawn by a hash of the id; the driver gets that sample.

    labels: doc_id and toxic 0/1; a doc_id with several labels counts as toxic if one is 1; null labels don't count.
    Token labels: a word of a toxic text is toxic if it, its first four or its first five bytes stand in many more
    places of toxic texts than of clean ones, and more than chance would give one of millions of words (a stem counts
    only if no clean text has the word); all other words are clean.
    Places are told apart by the words around them, so that copies of one text count once. None unless both classes have rows.
    """
    one = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in one.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, 1.1 * per_class / n))])
    draw = F.pmod(F.xxhash64(F.lit(13), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    ids = one.where(draw < share[F.col("toxic")]).select(F.col(id_col).alias("i"), F.col("toxic").alias("y"))  # at most about 2.2 * per_class rows
    rows = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= chars)).join(F.broadcast(ids), F.col(id_col) == F.col("i")).select("i", "y", F.col(text_col).alias("x")).collect()
    taken: Counter = Counter()
    sample = []
    for r in sorted(rows, key=lambda r: (r.y, r.i, r.x)):
        taken[r.y] += 1
        if taken[r.y] <= per_class:
            sample.append((int(r.y > 0), r.x.encode()))
    if not taken.get(0) or len(taken) < 2:
        return None
    model = Crf([0, 1], prefixes=(2, 3, 4, 5), suffixes=(2, 3))
    texts = [x for _, x in sample]
    t = model.tokens(texts)
    y = np.array([c for c, _ in sample])
    owner = np.repeat(np.arange(len(texts)), t.counts)
    around = (np.roll(t.word, 1).astype(np.int64) * 0x9E3779B1 ^ np.roll(t.word, -1).astype(np.int64) * 0x85EBCA6B) & 0x7FFFFFFF
    n_bad, n_good = max(1, int((y[owner] == 1).sum())), max(1, int((y[owner] == 0).sum()))

    def odd(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each slot, whether it stands in many more places of toxic texts than of clean ones, and in how many clean ones."""
        at = slots.astype(np.int64) << 31 | around
        bad, good = (np.bincount(np.unique(at[y[owner] == c]) >> 31, minlength=len(model.lexicon)) for c in (1, 0))
        share, n = n_bad / (n_bad + n_good), np.maximum(bad + good, 1)
        q = np.clip(bad / n, 1e-12, 1 - 1e-12)
        evidence = n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))  # minus the log of the chance, at least
        out = (evidence >= 18) & ((bad + 0.1) / n_bad >= 30 * (good + 0.1) / n_good)
        out[0] = False
        return out, good

    odd_word, clean = odd(t.word)
    stem = odd(t.affixes[:, 3])[0][t.affixes[:, 3]] | odd(t.affixes[:, 2])[0][t.affixes[:, 2]]
    marked = (y[owner] == 1) & (odd_word[t.word] | stem & (clean[t.word] == 0))
    model.lexicon[t.word[stem | odd_word[t.word]]] = True
    gold = np.split(marked.astype(np.int64), np.cumsum(t.counts)[:-1])
    return model.fit(texts, gold, epochs)


def tag_documents(docs: DataFrame, model: Crf | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs plus score (double) and spans (array<struct<start,end>>, code points), replacing columns of those names.

    score is the greatest posterior of the toxic tag over the text's words; spans are runs of words of ``least`` or more.
    Null text, no word or no model: 0 and no spans. Whole texts, no shuffle.
    """
    docs = docs.drop("score", "spans")
    spans_type = "array<struct<start:int,end:int>>"
    schema = docs.withColumn("score", F.lit(0.0)).withColumn("spans", F.array().cast(spans_type)).schema
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model_of.value
        for b in batches:
            score, spans = [], []
            for _, texts in batches_of_texts(b.column(text_col)):
                if crf is None:
                    score += [0.0] * len(texts)
                    spans += [[]] * len(texts)
                    continue
                t = crf.tokens(texts)
                p = crf.marginals(crf.emissions(t), t.counts)[:, 1]
                last = np.cumsum(t.counts)
                for d, (text, n, stop) in enumerate(zip(texts, t.counts, last)):
                    own = p[stop - n : stop]
                    score.append(min(1.0, float(own.max())) if n else 0.0)
                    hit = np.flatnonzero(own >= least) + stop - n
                    out = []
                    if len(hit):
                        chars = np.cumsum((np.frombuffer(text + b" ", np.uint8) & 0xC0) != 0x80) - 1
                        for g in np.split(hit, np.flatnonzero(np.diff(hit) != 1) + 1):
                            out.append({"start": int(chars[t.begin[g[0]] - t.offsets[d]]), "end": int(chars[t.end[g[-1]] - t.offsets[d]])})
                    spans.append(out)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array(spans, kind)], [*b.schema.names, "score", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    out = tag_documents(docs, model)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
