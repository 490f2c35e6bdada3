"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hash128, released, table
from .language_id import batches_of_texts

U = np.uint64
BASE = U(0x9E3779B97F4A7C15) | U(1)
MAP = np.full(256, 32, np.uint8)
MAP[48:58] = np.arange(48, 58)
MAP[97:123] = np.arange(97, 123)
MAP[65:91] = np.arange(97, 123)
MAP[128:] = np.arange(128, 256)
FILTER_BITS = 22
LEAKS = "array<struct<item_id:bigint,edits:int,start:int,end:int>>"
LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def normal(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, runs of other ASCII than letters and digits as one space, none at the ends; and where each byte was."""
    c = MAP[np.frombuffer(raw, np.uint8)]
    blank = c == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    if len(at) and blank[at[-1]]:
        at = at[:-1]
    if len(at) and blank[at[0]]:
        at = at[1:]
    return c[at], at


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q bytes, put together from hashes of powers of two."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    h, width, out, done = c.astype(np.uint64) + U(1), 1, None, 0
    while True:
        power = U(pow(int(BASE), width, 1 << 64))
        if q & width:
            n = len(c) - done - width + 1
            out = h if out is None else out[:n] * power + h[done : done + n]
            done += width
        if done == q:
            return (out ^ (out >> U(29))) * BASE
        h = h[:-width] * power + h[width:]
        width *= 2


def edit_distance_within(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of item in text on the diagonals low to high (text minus item position),
    by alignment in that band; None over ``most`` edits."""
    big = 1 << 20
    width = high - low + 1
    lane = np.arange(width)

    def inside(i: int) -> np.ndarray:
        j = i + low + lane
        return (j >= 0) & (j <= len(text))

    row = np.where(inside(0), 0, big)
    origin = np.where(inside(0), low + lane, -1)
    for i in range(1, len(item) + 1):
        j = i + low + lane
        ok = inside(i)
        sub = row + np.where((j >= 1) & (j <= len(text)), text[np.clip(j - 1, 0, len(text) - 1)] != item[i - 1], 1)
        gone = np.append(row[1:], big) + 1
        now = np.where(ok, np.minimum(np.where(j >= 1, sub, big), gone), big)
        start = np.where((j >= 1) & (sub <= gone), origin, np.append(origin[1:], -1))
        chain = now - lane
        best = np.minimum.accumulate(chain)
        at = np.maximum.accumulate(np.where(chain == best, lane, 0))
        row, origin = np.where(ok, best + lane, big), start[at]
    k = int(row.argmin())
    return (int(row[k]), int(origin[k]), len(item) + low + k) if row[k] <= most else None


def ends_within(item: bytes, text: bytes, most: int) -> list[int]:
    """The ends in text of all occurrences of item with at most ``most`` edits: a column of the alignment a step, its
    differences held as bits of two whole numbers, so that memory is that of the item."""
    m, where = len(item), {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, edits, out = full, 0, m, []
    for j, c in enumerate(text):
        same = where.get(c, 0)
        straight = same | down
        level = (((same & up) + up) ^ up) | same
        right_up, right_down = down | (full & ~(level | up)), up & level
        edits += (right_up & top > 0) - (right_down & top > 0)
        right_up, right_down = right_up << 1 & full, right_down << 1 & full
        up, down = right_down | (full & ~(straight | right_up)), right_up & straight
        if edits <= most:
            out.append(j + 1)
    return out


#: Bounds of what is in memory at once: grams hashed, (text place, item) pairs counted, (text place, item place) pairs of
#: one item in one text that are put in bands one by one. Beyond the last a band is judged by text places alone.
GRAMS, PAIRS, PLACED = 1 << 20, 1 << 20, 1 << 21
#: From so many bands on, ends of occurrences are looked for first; so many alignments of repeated passages are remembered.
MANY_BANDS, REMEMBERED = 16, 4096


@dataclass
class Index:
    """The q-grams of a slice of benchmark items: sorted hashes, postings and what each item asks for. ``owners`` are the
    distinct (hash, item) pairs, a run of postings each. Short items are kept by their first word."""

    q: int
    items: list
    texts: list[np.ndarray]
    budget: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    owners_of: np.ndarray  # first owner of each hash, and one past the last
    owner_item: np.ndarray
    owner_first: np.ndarray  # first posting of each owner, and one past the last
    place_of: np.ndarray
    by_item: np.ndarray  # owners by item, in the order of hashes
    item_first: np.ndarray
    owner_slot: np.ndarray
    filter: np.ndarray
    short: dict[bytes, list[tuple[bytes, list]]]

    @staticmethod
    def build(rows: list[tuple], q: int, rate: float, min_chars: int, short: bool = True) -> Index:
        items, texts, brief = [], [], {}
        for i, t in sorted(((i, t) for i, t in rows if i is not None and t), key=lambda r: (r[0], r[1])):
            c, _ = normal(t.encode())
            if len(c) >= max(min_chars, q):
                items.append(i)
                texts.append(c)
            elif len(c) and short:
                brief.setdefault(c.tobytes(), []).append(i)
        firsts: dict = {}
        for c, ids in brief.items():
            firsts.setdefault(c.split(b" ")[0], []).append((c, ids))
        size = np.array([len(t) for t in texts], np.int64)
        budget = np.minimum((rate * size).astype(np.int64), (size - q) // q)
        h = [gram_hashes(t, q) for t in texts]
        flat = np.concatenate(h) if h else np.empty(0, np.uint64)
        item_of = np.repeat(np.arange(len(h)), [len(x) for x in h]).astype(np.int32)
        place_of = np.concatenate([np.arange(len(x)) for x in h]) if h else np.empty(0, np.int64)
        by = np.argsort(flat, kind="stable")  # so by hash, item and place
        flat, item_of, place_of = flat[by], item_of[by], place_of[by].astype(np.int32)
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        owner = new.copy()
        owner[1:] |= item_of[1:] != item_of[:-1]
        owner_first = np.flatnonzero(owner)
        hashes, slot = flat[new], np.cumsum(new)[owner_first] - 1
        owners_of = np.searchsorted(slot, np.arange(len(hashes) + 1))
        owner_item = item_of[owner_first]
        by_item = np.argsort(owner_item, kind="stable")
        item_first = np.searchsorted(owner_item[by_item], np.arange(len(items) + 1))
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(hashes >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        return Index(q, items, texts, budget, size - q + 1 - q * budget, hashes, owners_of, owner_item, np.append(owner_first, len(flat)), place_of, by_item, item_first, slot, bits, firsts)

    def known(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, slot of its hash) of each q-gram of c that some item has, hashed piece by piece."""
        places, slots = [], []
        for s in range(0, max(0, len(c) - self.q + 1) if len(self.hashes) else 0, GRAMS):
            h = gram_hashes(c[s : s + GRAMS + self.q - 1], self.q)
            at = np.flatnonzero(self.filter[(h >> U(64 - FILTER_BITS)).astype(np.int64)])
            slot = np.searchsorted(self.hashes, h[at])
            true = self.hashes[np.minimum(slot, len(self.hashes) - 1)] == h[at]
            places.append(at[true] + s)
            slots.append(slot[true].astype(np.int32))
        return (np.concatenate(places), np.concatenate(slots)) if places else (np.empty(0, np.int64), np.empty(0, np.int32))

    def shared(self, doc: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """(doc, item) keys, doc times the number of items plus item, of pairs that share at least as many text places as
        the item needs: what an occurrence leaves in place stands at places of its own."""
        n = (self.owners_of[slot + 1] - self.owners_of[slot]).astype(np.int64)
        upto = np.cumsum(n)
        cuts = np.unique(np.append(np.searchsorted(upto, np.arange(PAIRS, upto[-1] if len(n) else 0, PAIRS)), [0, len(n)]))
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            m = n[a:b]
            owner = np.repeat(self.owners_of[slot[a:b]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            own, times = np.unique(np.repeat(doc[a:b], m) * len(self.items) + self.owner_item[owner], return_counts=True)
            both = np.concatenate([keys, own])
            keys, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times]), len(keys)).astype(np.int64)
        return keys[counts >= self.needed[keys % max(1, len(self.items))]]

    def bands(self, i: int, size: int, places: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The bands of diagonals (text minus item position) in which a text of ``size`` shares as many q-grams with item i as
        its budget leaves in place. Band b takes the cells b and b + 1 of budget + 1 diagonals each, the first cell
        beginning at minus the item's length: any budget + 2 neighbours share a band, so each occurrence lies in one."""
        own = self.by_item[self.item_first[i] : self.item_first[i + 1]]
        o = np.searchsorted(self.owner_slot[own], slots)
        have = self.owner_slot[own][np.minimum(o, len(own) - 1)] == slots
        places, own = places[have], own[o[have]]
        n = self.owner_first[own + 1] - self.owner_first[own]
        m, step = len(self.texts[i]), int(self.budget[i]) + 1
        if n.sum() <= PLACED:
            at = np.repeat(self.owner_first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = self.place_of[at].astype(np.int64)
            cell = (np.repeat(places, n) - place + m) // step
            met = np.unique(np.concatenate([cell, cell - 1]) * m + place[np.tile(np.arange(len(place)), 2)])
            band, count = np.unique(met // m, return_counts=True)
            return band[count >= self.needed[i]]
        first = np.arange((size + m) // step + 1) * step - m
        return np.flatnonzero(np.searchsorted(places, first + 2 * step - 1 + m) - np.searchsorted(places, first) >= self.needed[i])

    def verified(self, i: int, c: np.ndarray, plain: bytes, bands: np.ndarray, memory: dict) -> list[tuple]:
        """(edits, start, end) in the bands: all exact places that don't overlap, from the left, and the best alignment of each
        band without an exact one."""
        item, m, k = self.texts[i].tobytes(), len(self.texts[i]), int(self.budget[i])
        first = bands * (k + 1) - m
        last = first + 2 * k + 1
        found, runs, open_ = [], [], []
        for a, b in zip(np.maximum(first, 0).tolist(), np.minimum(last + m, len(c)).tolist()):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        for a, b in runs:
            while (at := plain.find(item, a, b)) >= 0:
                found.append((0, at, at + m))
                a = at + m
        if not k:
            return found
        open_ = [(a, b) for a, b in zip(first.tolist(), last.tolist()) if plain.find(item, max(a, 0), b + m) < 0]
        if len(open_) > MANY_BANDS:
            ends = [a + e for a, b in runs for e in ends_within(item, plain[a:b], k)]
            open_ = [(a, b) for a, b in open_ if (x := bisect.bisect_left(ends, a + m - k)) < len(ends) and ends[x] <= b + m + k]
        for a, b in open_:
            low = max(a, 0)
            key = (i, a - low, plain[low : b + m])
            if key not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[key] = edit_distance_within(self.texts[i], c[low : b + m], a - low, b - low, k)
            if memory[key]:
                edits, start, end = memory[key]
                found.append((edits, low + start, low + end))
        return found

    def brief(self, plain: bytes) -> list[tuple]:
        """(item id, 0, start, end) of short items, where they stand as whole words; of one item's places, from the left
        those that don't overlap."""
        words = plain.split(b" ")
        hits = [n for n, w in enumerate(words) if w in self.short]
        if not hits:
            return []
        ends = np.cumsum([len(w) + 1 for w in words])
        done, out = {}, []
        for n in hits:
            at = int(ends[n]) - len(words[n]) - 1
            for c, ids in self.short[words[n]]:
                end = at + len(c)
                if at >= done.get(c, 0) and plain.startswith(c, at) and plain[end : end + 1] in (b"", b" "):
                    done[c] = end
                    out += [(i, 0, at, end) for i in ids]
        return out

    def find(self, texts: list[bytes]) -> list[list[dict]]:
        """The leaks of each text: for each item its occurrences within its budget, the best of those that overlap.

        Memory is that of the texts and of a bounded number of pairs, however often a q-gram stands in a text and in items.
        """
        parts = [normal(t) for t in texts]
        gap = np.zeros(self.q, np.uint8)  # no byte of a normal text
        lengths = np.array([len(c) + len(gap) for c, _ in parts], np.int64)
        offset = np.cumsum(lengths) - lengths
        pos, slot = self.known(np.concatenate([x for c, _ in parts for x in (c, gap)])) if parts else self.known(gap)
        met: list[list[tuple]] = [self.brief(c.tobytes()) if self.short else [] for c, _ in parts]
        if len(pos):
            doc = np.searchsorted(offset, pos, "right") - 1
            memory: dict = {}
            for key in self.shared(doc, slot).tolist():
                d, i = divmod(key, len(self.items))
                a, b = np.searchsorted(doc, [d, d + 1])
                c = parts[d][0]
                bands = self.bands(i, len(c), pos[a:b] - offset[d], slot[a:b])
                if len(bands):
                    met[d] += [(self.items[i], *x) for x in apart(self.verified(i, c, c.tobytes(), bands, memory))]
        out = []
        for text, (_, at), found in zip(texts, parts, met):
            chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1 if found else None
            spans = {(i, edits, int(chars[at[a]]), int(chars[at[b - 1]]) + 1 if b > a else int(chars[at[a]])) for i, edits, a, b in found}
            out.append([dict(zip(("item_id", "edits", "start", "end"), x)) for x in sorted(spans)])
        return out


def apart(places: list[tuple]) -> list[tuple]:
    """Of (edits, start, end) the best ones that don't overlap, by start: fewest edits first, then the earliest."""
    starts, taken = [], []
    for edits, a, b in sorted(set(places)):
        k = bisect.bisect_left(starts, a)
        if (k == len(taken) or b <= taken[k][1]) and (k == 0 or taken[k - 1][2] <= a):
            starts.insert(k, a)
            taken.insert(k, (edits, a, b))
    return taken


def _marked(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            found: list[list[dict]] = []
            for _, texts in batches_of_texts(b.column("__text")):
                found += own.find(texts)
            leaks = pa.array(found, LEAK_TYPE)
            yield pa.RecordBatch.from_arrays([leaks if n == "leaks" else c for n, c in zip(b.schema.names, b.columns)], b.schema.names)

    return run


def mark_leaks(
    docs: DataFrame,
    items: DataFrame,
    q: int = 10,
    rate: float = 0.08,
    min_chars: int = 24,
    slice_bytes: int = 2 << 20,
    short: bool = True,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """docs plus ``leaks`` (replacing a column of that name): the places at which the text holds a benchmark item as a whole
    with at most rate * length edits (fewer for items too short for the q-gram bound), as a sorted set of item, edits and
    place in code points. Of places of one item that overlap the best one counts.

    Case and ASCII punctuation don't count. Items are compared with all documents in slices of about slice_bytes, each
    broadcast by itself, so the size of what is broadcast is bounded however many items there are; documents stream by
    once a slice, and only with several slices are they shuffled, once, to meet what was found in equal texts. Null or
    empty texts leak nothing; items without an id, a letter or a digit are not looked for. Items of under min_chars
    normalised bytes count where they stand word for word, or with ``short`` false not at all (any prose may hold them).
    Items with equal texts are all found; repeated benchmark rows make no difference, and neither does the number of
    slices. Repeated documents stay apart. Texts and items that repeat the same few characters take time in proportion to
    their lengths, and bounded memory.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    listed = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = listed.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    listed = listed.distinct() if slices > 1 else listed  # a row however often repeated fills no slice

    def marked(df: DataFrame, s: int) -> DataFrame:
        rows = listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == s).collect()
        index = spark.sparkContext.broadcast(Index.build([tuple(r) for r in rows], q, rate, min_chars, short))
        return df.mapInArrow(released(_marked(index)), df.schema)

    whole = F.coalesce(F.col(text_col), F.lit(""))
    if slices == 1:
        return marked(docs.withColumn("leaks", F.array().cast(LEAKS)).withColumn("__text", whole), 0).drop("__text")
    keyed = docs.drop("leaks").withColumn("__h1", hash128(whole)[0]).withColumn("__h2", hash128(whole)[1])
    bare = keyed.select("__h1", "__h2", whole.alias("__text"), F.array().cast(LEAKS).alias("leaks"))
    found = None
    for s in range(slices):
        some = marked(bare, s).where(F.size("leaks") > 0).select("__h1", "__h2", F.explode("leaks").alias("x"))
        found = some if found is None else found.unionByName(some)
    found = found.groupBy("__h1", "__h2").agg(F.array_sort(F.collect_set("x")).alias("leaks"))
    return keyed.join(found, ["__h1", "__h2"], "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS))).drop("__h1", "__h2")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.edits", "x.start", "x.end")
