"""Token counts: overlap resynchronisation over huge documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, released, table

_LOADED: dict = {}
MARK = "▁".encode()


class PieceCounter:
    """Counts the pieces of a sentencepiece model as encoding a whole text would.

    Texts over ``chunk`` bytes are encoded as overlapping chunks with offsets and spliced at a boundary that both
    chunks have and that is proven stable: a space after another character, where no piece of the vocabulary holds a
    space mark after another character, so that no merge crosses it whatever stands around. Where an overlap has no
    such boundary it is widened, in the end to the rest of the text. A vocabulary without that property is never cut.
    """

    def __init__(self, path: str, chunk: int = 16384, overlap: int = 512):
        import sentencepiece

        self.sp, self.chunk, self.overlap = sentencepiece.SentencePieceProcessor(model_file=path), chunk, overlap
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not self.sp.is_control(i))
        self.cuts = not any(a != "▁" and b == "▁" for p in pieces for a, b in zip(p, p[1:]))

    def pieces(self, raw: bytes, start: int, end: int) -> list[tuple[int, int]]:
        """(begin, id) of each piece of raw[start:end], begin in bytes of raw."""
        return [(start + p.begin, p.id) for p in self.sp.encode(raw[start:end].decode(), return_type="proto").pieces]

    def splice(self, raw: bytes, at: int, left: list[tuple[int, int]], right: list[tuple[int, int]], end: int) -> int | None:
        """The first stable position after at that is a boundary on both sides, with the same pieces up to the next one."""
        both = {b for b, _ in left} & {b for b, _ in right}
        stable = [p for p in sorted(both) if at < p < end and raw[p] == 0x20 and raw[p - 1] != 0x20 and raw[p - 3 : p] != MARK]
        for p, q in zip(stable, stable[1:]):
            if [x for x in left if p <= x[0] < q] == [x for x in right if p <= x[0] < q]:
                return p
        return None

    def count(self, text: str) -> int:
        raw = text.encode()
        if len(raw) <= self.chunk + self.overlap or not self.cuts:
            return len(self.sp.encode(text))

        def whole(at: int) -> int:
            """at, moved back to where a character begins."""
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at -= 1
            return min(at, len(raw))

        total, since, start, wide, left = 0, 0, 0, self.overlap, None
        while True:
            end, nxt = whole(start + self.chunk + wide), whole(start + self.chunk)
            left = left if left is not None and wide == self.overlap else self.pieces(raw, start, end)
            if end >= len(raw):
                return total + sum(b >= since for b, _ in left)
            until = whole(nxt + self.chunk + self.overlap)
            right = self.pieces(raw, nxt, until)
            p = self.splice(raw, nxt, left, right, min(end, until))
            if p is None:
                wide *= 2
                continue
            total += sum(since <= b < p for b, _ in left)
            since, start, left, wide = p, nxt, right, self.overlap

    def counts(self, texts: list[str]) -> list[int]:
        small = [t for t in texts if len(t) <= self.chunk // 4]
        found = iter([len(x) for k in range(0, len(small), 256) for x in self.sp.encode(small[k : k + 256], num_threads=1)])
        return [next(found) if len(t) <= self.chunk // 4 else self.count(t) for t in texts]


def _counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    key = (path, chunk, overlap)
    if key not in _LOADED:
        _LOADED[key] = PieceCounter(*key)
    return _LOADED[key]


def count_tokens(docs: DataFrame, model_path: str, chunk: int = 16384, overlap: int = 512, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """docs without its text, plus n_bytes, n_tokens and over_limit (replacing columns of those names). Null text counts as empty. No shuffle."""
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*kept, F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = rows.drop("__text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path, chunk, overlap)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                n = counter.counts(part.column("__text").to_pylist())
                cols = [part.column(i) for i, name in enumerate(part.schema.names) if name != "__text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], [*(x for x in part.schema.names if x != "__text"), "n_tokens"])

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(released(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
