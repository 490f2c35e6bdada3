"""The cleaning pipeline over ``documents``: language, lines, near-duplicates, benchmark leaks, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the
columns of documents. ``run`` applies them in turn, each on what the one before it left in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.llm import bpe, decontaminate, language_id, line_dedup, minhash
from cytoplane.llm.common import stored, table


def _own(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with columns beside those of ``documents`` under names that no operator uses, and the columns as they were."""
    known = ("doc_id", "text", "lang", "source", "n_chars")
    names = {c: c if c in known else f"__extra{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(new).alias(old) for old, new in names.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter (``und``) go; the classifier learns from a bounded sample of docs.

    A null lang becomes the predicted one; if nothing could be learned from, lang stays null.
    """
    d, back = _own(docs)
    model = language_id.train(d)
    out = language_id.label_documents(d, model, untrained="unknown").where("lang_pred <> 'und'")
    return (out.withColumn("lang", F.coalesce("lang", "lang_pred")) if model else out).select(back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of 10 code points or more stays only in the smallest doc_id holding it; n_chars follows the text.

    A null text becomes an empty one; documents that lose all lines stay, empty.
    """
    d, back = _own(docs)
    out = line_dedup.dedup_lines(d)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays, with all of its
    rows; rows without a doc_id stay."""
    gone = minhash.near_duplicates(docs, k=5, percent=80, bands=30, rows=5).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of 24 normalised bytes or more go; shorter ones any clean text may hold."""
    d, back = _own(docs)
    return decontaminate.mark_leaks(d, table(spark, sf_dir, "benchmark"), short=False).where(F.size("leaks") == 0).select(back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("bpe", tokenize),
]

#: A conditional random field isn't expressible in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
