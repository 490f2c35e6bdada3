"""BPE encoding and decoding through a distinct-word table."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, released, stored, table

_LOADED: dict = {}
#: Fixed value: how byte-level BPE vocabularies of this kind split a text into words before merging.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text in one chunk of documents that shares a dictionary, in bytes of UTF-8.
CHUNK = 16 << 20


class Words:
    """Splits texts into words as the tokenizer does, and encodes and decodes single words."""

    def __init__(self, path: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies that leave the text as it is are supported")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.names = frozenset(special)
        self.word = regex.compile(WORD)
        #: Above, letters and numbers depend on the Unicode version, so there the tokenizer's own splitter is asked.
        self.rare = regex.compile("[^\\x00-ԯ‐-‧€]")
        self.pieces = self._pieces(spec)

    @staticmethod
    def _pieces(spec: dict) -> list[bytes]:
        """The bytes of each id: printable bytes stand for themselves, the others for the characters from 256 on."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in spec["model"]["vocab"].items():
            out[i] = bytes(of[c] for c in piece)
        for t in spec["added_tokens"]:
            out[t["id"]] = t["content"].encode()
        return out

    def _plain(self, text: str) -> list[str]:
        if not self.rare.search(text):
            return self.word.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.names else self._plain(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)]


def _words(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    parts = [squeeze.compress(bytes(memoryview(x).cast("B")) if isinstance(x, np.ndarray) and x.size else bytes(x) if isinstance(x, bytes) else b"") for x in arrays]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def _unpack(blob: bytes, n: int) -> list[bytes]:
    import zstandard

    plain, at, out = zstandard.ZstdDecompressor(), 4 * n, []
    for size in np.frombuffer(blob[: 4 * n], np.uint32).tolist():
        out.append(plain.decompress(blob[at : at + size]))
        at += size
    return out


def _pack_sequence(x: np.ndarray) -> bytes:
    """Word ranks byte by byte: frequent words have small ranks, so the upper bytes are mostly zero."""
    return _pack(*(np.ascontiguousarray((x >> (8 * k)).astype(np.uint8)) for k in range(4)))


def _unpack_sequence(blob: bytes) -> np.ndarray:
    low, *upper = (np.frombuffer(p, np.uint8) for p in _unpack(blob, 4))
    out = low.astype(np.uint32)
    for k, p in enumerate(upper, 1):
        out |= p.astype(np.uint32) << np.uint32(8 * k)
    return out


ROW = ["dest", "kind", "at", "id", "blob"]
DOCUMENT, DICTIONARY, WORDS = 0, 1, 2


def _chunked(path: str, buckets: int, chunk_bytes: int, most: int, id_type: pa.DataType):
    """For each chunk of documents: a row per document with the ranks of its words, a row with the bucket of each rank,
    and a row per bucket with the chunk's words in it. A chunk ends at chunk_bytes of text or ``most`` distinct words."""

    def rows(chunk: int, ids: list, sequences: list, names: list[str]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(sequences) if sequences else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
        rank = np.empty(len(names), np.uint32)
        rank[order] = np.arange(len(names), dtype=np.uint32)
        raw = [names[i].encode() for i in order.tolist()]
        bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % np.uint32(buckets)
        stamp = hashlib.blake2b(b"\0".join(raw), digest_size=8).digest()
        made: list[tuple] = [(chunk, DICTIONARY, 0, None, stamp + _pack(bucket))]
        made += [(chunk, DOCUMENT, 0, i, _pack_sequence(rank[s])) for i, s in zip(ids, sequences)]
        by = np.argsort(bucket, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
            words = [raw[i] for i in part.tolist()]
            made.append((int(bucket[part[0]]), WORDS, chunk, None, stamp + _pack(np.array([len(w) for w in words], np.uint32), b"".join(words))))
        kinds = (pa.int64(), pa.int32(), pa.int64(), id_type, pa.binary())
        for k in range(0, len(made), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[k : k + 4096]), kinds)], ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, n = _words(path), TaskContext.get().partitionId(), 0

        def fresh() -> tuple[list, list, defaultdict]:
            return [], [], defaultdict(itertools.count().__next__)

        (ids, sequences, place), size = fresh(), 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                text = x.as_py() or ""
                own = words.split(text)
                ids.append(i)
                sequences.append(np.fromiter(map(place.__getitem__, own), np.uint32, len(own)))
                size += len(x.as_buffer() or b"")
                if size >= chunk_bytes or len(place) >= most:
                    yield from rows(FIRST_CHUNK + (part << 20) + n, ids, sequences, list(place))
                    (ids, sequences, place), size, n = fresh(), 0, n + 1
        if ids:
            yield from rows(FIRST_CHUNK + (part << 20) + n, ids, sequences, list(place))

    return run


#: Destinations of chunks; those of buckets are below.
FIRST_CHUNK = 1 << 50


def _distinct(t: pa.Table) -> tuple[list[tuple], list[bytes]]:
    """A bucket's requests, (chunk, stamp, words), and its distinct words in order of their bytes."""
    asked = []
    for k, c, x in zip(t.column("kind").to_pylist(), t.column("at").to_pylist(), t.column("blob")):
        if k == WORDS:
            blob = x.as_py()
            sizes, joined = _unpack(blob[8:], 2)
            ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64).tolist()
            asked.append((c, blob[:8], [joined[i:j] for i, j in zip([0, *ends], ends)]))
    return asked, sorted(set().union(*(own for _, _, own in asked))) if asked else []


def _encoded(path: str):
    """The word table of one bucket: its distinct words, numbered, each encoded once."""

    def run(t: pa.Table) -> pa.Table:
        _, words = _distinct(t)
        bucket = t.column("dest")[0].as_py() if len(words) else 0
        coded = _words(path).encode([w.decode() for w in words])
        return pa.table([pa.array([bucket] * len(words), pa.int64()), pa.array(range(len(words)), pa.int32()), pa.array(coded, pa.list_(pa.int32()))], ["bucket", "no", "ids"])

    return run


def _gather(start: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[start : start + n] for each pair, one after another."""
    return flat[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _answered(t: pa.Table, decoded: pa.Table) -> pa.Table:
    """To each chunk that asked a bucket: the ids of its words, in its order, and the bytes that the ids' pieces make up."""
    asked, words = _distinct(t)
    if not asked:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["chunk", "bucket", "ids"])
    decoded = decoded.sort_by("no").combine_chunks()
    if decoded.num_rows != len(words):
        raise RuntimeError("a bucket of words came out differently when it was computed again")
    lists = decoded.column("x").chunk(0)
    n = lists.value_lengths().to_numpy().astype(np.int64)
    first = np.cumsum(n) - n
    inner = lists.flatten()
    ids = inner.field("i").to_numpy().astype(np.uint32)
    pieces = inner.field("piece").cast(pa.large_binary())
    at = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
    raw = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    begin, end = at[first], at[first + n]
    number, bucket, out = {w: k for k, w in enumerate(words)}, t.column("dest")[0].as_py(), []
    for chunk, stamp, own in asked:
        k = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
        size = end[k] - begin[k]
        out.append((chunk, bucket, stamp + _pack(n[k].astype(np.uint32), _pack_sequence(_gather(first[k], n[k], ids)), size.astype(np.uint32), _gather(begin[k], size, raw))))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["chunk", "bucket", "ids"])


def _assembled(digests: bool, id_type: pa.DataType):
    """The documents of one chunk from the ids and the decoded bytes of its words, joined back by position."""

    def run(own: pa.Table, coded: pa.Table) -> pa.Table:
        ids: list = []
        out: list[list] = [[], [], []]
        kinds = own.column("kind").to_pylist()
        at = kinds.index(DICTIONARY) if DICTIONARY in kinds else None
        if at is not None:
            blob = own.column("blob")[at].as_py()
            bucket = np.frombuffer(_unpack(blob[8:], 1)[0], np.uint32)
            count, by = np.zeros(len(bucket), np.int64), np.argsort(bucket, kind="stable")
            first = np.searchsorted(bucket[by], np.arange(int(bucket.max(initial=0)) + 2))
            got, parts = 0, []
            start = np.zeros(len(bucket), np.int64)
            text: list[bytes] = [b""] * len(bucket)
            for b, x in zip(coded.column("bucket").to_pylist(), coded.column("ids")):
                x = x.as_py()
                if x[:8] != blob[:8]:
                    raise RuntimeError("a chunk of documents came out differently when it was computed again")
                n, flat, size, raw = _unpack(x[8:], 4)
                n, flat, size = np.frombuffer(n, np.uint32), _unpack_sequence(flat), np.frombuffer(size, np.uint32)
                ranks = by[first[b] : first[b + 1]]
                count[ranks], start[ranks] = n, got + np.cumsum(n, dtype=np.int64) - n
                parts.append(flat)
                got += len(flat)
                ends = np.cumsum(size, dtype=np.int64).tolist()
                for r, i, j in zip(ranks.tolist(), [0, *ends], ends):
                    text[r] = raw[i:j]
            known = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            del parts
            named = [",".join(map(str, known[i : i + n].tolist())).encode() for i, n in zip(start.tolist(), count.tolist())] if digests else []
            for kind, i, x in zip(kinds, own.column("id").to_pylist(), own.column("blob")):
                if kind != DOCUMENT:
                    continue
                s = _unpack_sequence(x.as_py())
                places, n = s.tolist(), count[s]
                ids.append(i)
                out[0].append(int(n.sum()))
                decoded = b"".join([text[p] for p in places]).decode("utf-8", "replace").encode()
                if digests:
                    out[1].append(hashlib.sha256(b",".join([named[p] for p in places])).hexdigest())
                    out[2].append(hashlib.sha256(decoded).hexdigest())
                else:
                    out[1].append(_gather(start[s], n, known).astype(np.int32))
                    out[2].append(decoded)
        if not digests:
            ends = np.cumsum([0, *map(len, out[1])]).astype(np.int32)
            coded_ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *out[1]])))
            out[1] = []
            return pa.table([pa.array(ids, id_type), pa.array(out[0], pa.int64()), coded_ids, pa.array(out[2], pa.binary()).cast(pa.string())], ["id", "n_tokens", "ids", "decoded"])
        return pa.table([pa.array(ids, id_type), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str, digests: bool = False, chunk_bytes: int = CHUNK, most_words: int = 600_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string) per row of docs; with digests, ids_sha256 and decoded_sha256 instead.

    Each chunk of documents (a stretch of an input partition) replaces words by ranks in its own dictionary and sends the
    dictionary, in buckets by hash, to the word table, where every distinct word is encoded once. Its ids are exploded,
    joined with the vocabulary's pieces and put together again by position. Ids and decoded bytes go back to the chunks
    in dictionary order and are joined to the documents by position. What is shuffled is the packed ranks, the chunks'
    dictionaries both ways and a row per distinct word, never a row per word or token of the corpus.

    All uses of the chunks read one exchange. A chunk that is computed anew after a loss must have the same dictionary:
    documents that come out of a shuffle, whose order may change then, are written to the shared folder first; should a
    chunk differ even so, the job fails rather than give wrong ids. Null or empty text: no tokens, an empty text back.
    Special strings become their ids. Rows with one id, or a null id, stay apart; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if "Exchange" in source._jdf.queryExecution().executedPlan().toString():
        source = stored(source)
    total = source.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    n = max(-(-total // chunk_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = source.schema["id"].dataType
    arrow = to_arrow_type(kind)
    named = f"id {kind.simpleString()}"
    chunks = source.mapInArrow(released(_chunked(path, n, chunk_bytes, most_words, arrow)), f"dest long, kind int, at long, {named}, blob binary").repartition(n, "dest")
    table_ = chunks.groupBy("dest").applyInArrow(_encoded(path), "bucket long, no int, ids array<int>").repartition(n, "bucket")
    pieces = table_.select("bucket", "no", F.posexplode("ids").alias("pos", "i")).join(F.broadcast(vocabulary(spark, path)), "i")
    pieces = pieces.groupBy("bucket", "no").agg(F.array_sort(F.collect_list(F.struct("pos", "i", "piece"))).alias("x"))
    coded = chunks.groupBy("dest").cogroup(pieces.groupBy("bucket")).applyInArrow(_answered, "chunk long, bucket long, ids binary")
    cols = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = chunks.groupBy("dest").cogroup(coded.groupBy("chunk")).applyInArrow(_assembled(digests, arrow), f"{named}, n_tokens long, {cols}")
    return out.withColumnRenamed("id", id_col)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(i int, piece binary): the bytes of each id. Its size is that of the vocabulary, whatever the corpus."""
    pieces = _words(path).pieces
    return spark.createDataFrame(pa.table([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["i", "piece"]))


def decode_ids(coded: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, decoded) of rows with unique doc_id through a join of ids with the vocabulary, put together by position.

    The vocabulary has a fixed number of rows whatever the corpus, so it is broadcast. Null or empty ids: an empty text.
    """
    spark = coded.sparkSession
    exploded = coded.select(F.col(id_col).alias("id"), F.posexplode(ids_col).alias("pos", "i")).join(F.broadcast(vocabulary(spark, path)), "i")
    joined = exploded.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("x"))
    joined = joined.select("id", F.decode(F.unhex(F.array_join(F.transform("x", lambda p: p["h"]), "")), "UTF-8").alias("decoded"))
    return coded.select(F.col(id_col)).join(joined, F.col(id_col).eqNullSafe(joined["id"]), "left").select(id_col, F.coalesce("decoded", F.lit("")).alias("decoded"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)
