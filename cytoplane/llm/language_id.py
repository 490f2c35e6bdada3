"""Language ID: a linear-chain CRF labels words in code-switched text; marginals are summed to a language per document."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, released, table
from .crf import Crf

#: Bounds of the training sample: rows a language, and code points a training text (others are not drawn, never cut).
PER_LANGUAGE, TRAIN_CHARS = 300, 20_000
AT_ONCE = 1 << 20


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def batches_of_texts(column: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about at_once bytes; null is empty."""
    start, size, texts = 0, 0, []
    for i, x in enumerate(column):
        texts.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
        size += len(texts[-1])
        if size >= at_once:
            yield start, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, texts


def read_out(p: np.ndarray, counts: np.ndarray, lead: float) -> np.ndarray:
    """A distribution per text from those of its words: their mean over the whole text and, weighted by lead, a mean that
    fades by position (by e in ten words), since a text that switches counts as the language that it starts in."""
    first = np.cumsum(counts) - counts
    fade = np.exp(-(np.arange(len(p)) - np.repeat(first, counts)) / 10.0)[:, None]

    def per_text(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        return total[first + counts] - total[first]

    whole = per_text(p) / np.maximum(counts, 1)[:, None]
    early = per_text(p * fade) / np.maximum(per_text(fade), 1e-12)
    return (whole + lead * early) / (1 + lead)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = TRAIN_CHARS, lexicon: int = 500, epochs: int = 3, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Crf | None:
    """Learns from at most per_language rows a label, drawn by a hash of the id, in a task of its own: only the model, of a fixed
    size, comes to the driver.

    Each word of a text carries the text's label, so the learned transitions express how much words stay in a language;
    the lexicon holds each label's most frequent words; how much the start of a text counts is what does best on the
    sample. None without rows.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.1 * per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    drawn = labelled.where((draw < share[F.col(lang_col)]) & (F.length(text_col) <= chars)).select(F.col(lang_col).alias("y"), F.col(text_col).alias("x"), F.col(id_col).alias("i"))
    labels = sorted(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learn(labels, [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in "yxi"))], per_language, lexicon, epochs)
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    learned = drawn.repartition(1).mapInArrow(released(run), "model binary").collect()
    return pickle.loads(learned[0][0]) if learned else None


def learn(labels: list[str], rows: list[tuple], per_language: int, lexicon: int, epochs: int) -> Crf | None:
    """The model of a sample of rows (label, text, id)."""
    taken: Counter = Counter()
    sample = []
    for y, x, _ in sorted(rows, key=lambda r: (r[0], str(r[2]), r[1])):
        taken[y] += 1
        if taken[y] <= per_language:
            sample.append((y, x.encode()))
    if not sample:
        return None
    model = Crf(labels)
    texts = [x for _, x in sample]
    index = {y: i for i, y in enumerate(model.labels)}
    t = model.tokens(texts)
    y = np.repeat([index[lang] for lang, _ in sample], t.counts)
    for j in range(len(model.labels)):
        slots, n = np.unique(t.word[y == j], return_counts=True)
        model.lexicon[slots[np.argsort(-n, kind="stable")[:lexicon]]] = True
    model.fit(texts, [np.full(n, index[lang]) for n, (lang, _) in zip(t.counts, sample)], epochs)
    p = np.concatenate([model.marginals(model.emissions(u), u.counts) for u in (model.tokens(texts[k : k + 256]) for k in range(0, len(texts), 256))]).astype(np.float64)
    gold = np.array([index[lang] for lang, _ in sample])
    right = lambda lead: np.mean(read_out(p, t.counts, lead).argmax(axis=1) == gold)
    model.lead = max((0.0, 0.25, 0.5, 1.0, 2.0), key=lambda lead: (right(lead), -lead))
    return model


def label_documents(docs: DataFrame, model: Crf | None, least_score: float = 0.0, text_col: str = "text", untrained: str = "und") -> DataFrame:
    """docs plus lang_pred and score (replacing columns of those names).

    score is the predicted language's share in ``read_out`` of the posteriors of the text's words. ``und`` with score 0 if the text is null
    or has no letter, or if the score is under least_score. Without a model, texts with a letter get ``untrained`` with
    score 0. Whole texts, no shuffle.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    model_of = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model_of.value
        for b in batches:
            lang, score = [], []
            for _, texts in batches_of_texts(b.column(text_col)):
                if crf is None:
                    lang += [untrained if has_letter(raw.decode()) else "und" for raw in texts]
                    score += [0.0] * len(texts)
                    continue
                t = crf.tokens(texts)
                mean = read_out(crf.marginals(crf.emissions(t), t.counts).astype(np.float64), t.counts, crf.lead)
                for raw, m, n in zip(texts, mean, t.counts):
                    j = int(m.argmax())
                    known = n and has_letter(raw.decode()) and m[j] >= least_score
                    lang.append(crf.labels[j] if known else "und")
                    score.append(min(1.0, max(0.0, float(m[j]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    out = label_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
