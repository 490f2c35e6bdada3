"""Secret scans in native expressions: key patterns, and sliding-window Shannon entropy with an allow-list."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs without anything required around them: the longest run is the leftmost match, so its least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
#: Character classes: name, what the candidate consists of, alphabet, least bits of a window of 20.
CLASSES = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 3.0),
    ("upper hex", "^[0-9A-F]+$", "0123456789ABCDEF", 3.0),
    ("mixed hex", "^(?=.*[0-9])[0-9A-Fa-f]+$", "0123456789ABCDEFabcdef", 3.1),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=", 3.3),
    ("lower", "^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 3.4),
    ("upper", "^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.4),
    ("base64", "^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
#: A path's segment that looks like a word or a version, as chance alone hardly makes it between two slashes. The repeated
#: group is possessive: the matcher loops over it, where it would else call itself once for each repetition and run out of
#: stack. Nothing is lost by that, since no part of the group can also match what follows it.
SEGMENT = "(?:v[0-9]{1,3}|[A-Z]{3,}|[A-Za-z][a-z]++[0-9]{0,3}+(?:[_-][A-Z]?[a-z]++[0-9]{0,3}+)*+)"
#: Candidates that hold one of these are known not to be secrets: placeholders, UUIDs, runs of the alphabet, paths.
ALLOW = (
    "(?i)example|placeholder|changeme|dummy|your[_-]|lorem",
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "(?i)abcdefghij|0123456789|1234567890",
    f"/{SEGMENT}/{SEGMENT}/",
)


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def before(values: Column, zero: int, combine, levels: int = 3, width: int = 32) -> Column:
    """For each of an array of ints, what ``combine`` makes of zero and all those before it: an exclusive scan.

    Runs of ``width`` are combined, what comes of them again, ``levels`` times over; inside a run each element takes those
    before it. So the work is in proportion to the array (up to some ten million elements), and no array grows step by step.
    """
    upto = lambda run, i, start: F.aggregate(F.slice(run, F.lit(1), i), start, combine)
    if levels == 0:
        return F.transform(values, lambda x, i: upto(values, i, F.lit(zero)))

    def spread(runs: Column, at: Column) -> Column:
        return F.flatten(F.transform(runs, lambda run, b: F.transform(run, lambda x, i: upto(run, i, F.get(at, b)))))

    def by_runs(runs: Column) -> Column:
        sums = F.transform(runs, lambda run: F.aggregate(run, F.lit(zero), combine))
        return _bound(_bound(sums, lambda s: before(s, zero, combine, levels - 1, width)), lambda at: spread(runs, at))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")), lambda b: F.slice(values, b * width + 1, F.lit(width)))
    return F.when(F.size(values) > 0, _bound(cut, by_runs)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,m>> of the pattern's leftmost non-overlapping matches, in code points.

    Lengths of what stands between matches and of the matches add up to positions; texts without a match cost one scan.
    """
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def placed(found: Column) -> Column:
        steps = F.transform(found, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
        at = _bound(steps, lambda n: before(n, 0, lambda a, b: a + b))
        spans = F.transform(F.arrays_zip(found.alias("x"), at.alias("at")), lambda z: F.struct((z["at"] + F.length(z["x"]["gap"])).alias("start"), (z["at"] + F.length(z["x"]["gap"]) + F.length(z["x"]["m"])).alias("end"), z["x"]["m"].alias("m")))
        return F.filter(spans, lambda s: s["m"].isNotNull())

    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(text.rlike(pattern), _bound(zipped, placed)).otherwise(none)


def window_entropy(s: Column, alphabet: str, width: int) -> Column:
    """The greatest Shannon entropy, in bits, of a window of ``width`` characters sliding over s (shorter: 0).

    The state holds the count of each character in the window and the sum of c*log2(c); a step changes two counts.
    """
    new = F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(alphabet)) - 1)
    none = F.array_repeat(F.lit(None).cast("int"), width)
    f = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(width + 2)])

    def step(acc: Column, x: Column) -> Column:
        same = x["new"].eqNullSafe(x["old"])
        grown, had = F.get(acc["counts"], x["new"]), F.coalesce(F.get(acc["counts"], x["old"]), F.lit(1))
        total = F.when(same, acc["total"]).otherwise(acc["total"] + F.get(f, grown + 1) - F.get(f, grown) + F.get(f, had - 1) - F.get(f, had))
        counts = F.transform(acc["counts"], lambda v, k: F.when(same, v).when(k == x["new"], v + 1).when(k == x["old"], v - 1).otherwise(v))
        n = acc["n"] + 1
        best = F.when(n >= width, F.greatest(acc["best"], F.lit(math.log2(width)) - total / width)).otherwise(acc["best"])
        return F.struct(n.alias("n"), counts.alias("counts"), total.alias("total"), best.alias("best"))

    zero = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    pairs = F.arrays_zip(new.alias("new"), F.slice(F.concat(none, new), F.lit(1), F.length(s)).alias("old"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["best"])


def reaches(s: Column, alphabet: str, width: int, bits: float, piece: int = 4096) -> Column:
    """Whether some window of s reaches ``bits``. s is taken in pieces, each with the ``width`` - 1 characters after it, so that
    what one holds in memory doesn't grow with s; pieces after the first that does are not looked at."""
    if piece < width:
        raise ValueError("a piece holds a window at least")

    def any_piece(pieces: Column) -> Column:
        with_rest = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(pieces, i + 1), 1, width - 1), F.lit(""))))
        return F.aggregate(with_rest, F.lit(False), lambda found, p: F.when(found, True).otherwise(window_entropy(p, alphabet, width) >= bits))

    whole = window_entropy(s, alphabet, width) >= bits
    return F.when(F.length(s) <= piece, whole).otherwise(_bound(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), any_piece))


def find_secrets(docs: DataFrame, width: int = 20, classes: tuple = CLASSES, allow: tuple = ALLOW, text_col: str = "text") -> DataFrame:
    """docs plus base and added: arrays of (start, rank, end, kind), rank being the kind's place in KINDS.

    base: assignments to a key-like name with a value of 8 characters or more, access ids of 16 or more, hex runs of 32
    or more; spans are whole matches in code points, end exclusive. added: runs of 20 or more token characters of which
    some window of ``width`` reaches its class's entropy, that no allow-list pattern fits and no base span meets.
    Null text counts as empty. Each row stands for itself, whatever its id; nothing is shuffled. Columns named base or
    added are replaced. Time grows with the length of a text, however many spans it has, also where all of it is one
    candidate; the matcher's stack does not.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def spans(kind: str, pattern: str, keep=None) -> Column:
        found = _matches(text, pattern)
        found = F.filter(found, keep) if keep else found
        rank = KINDS.index(kind)
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    def random_looking(x: Column) -> Column:
        # A window's entropy is the same whatever alphabet holds its characters: the class that asks least of x decides.
        hit, ok = F.lit(False), F.lit(False)
        for _, shape, alphabet, bits in sorted(classes, key=lambda c: -c[3]):
            hit = F.when(x["m"].rlike(shape), reaches(x["m"], alphabet, width, bits)).otherwise(hit)
        for p in allow:
            ok = ok | x["m"].rlike(p)
        return ~ok & hit

    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8
    base = F.array_sort(F.concat(spans("assign", ASSIGN, value), spans("access", ACCESS), spans("hex", HEX)))
    def clear(cands: Column) -> Column:
        # Neither kind of span overlaps itself among candidates, so a candidate can only meet a base span that starts before
        # it (then the greatest end so far shows it) or the very next span by start.
        def judged(z: Column) -> Column:
            end = _bound(F.transform(z, lambda x: F.when(x["kind"] == KINDS[3], 0).otherwise(x["end"])), lambda e: before(e, 0, lambda a, b: F.greatest(a, b)))

            def free(x: Column, i: Column, last: Column) -> Column:
                after = F.get(z, i + 1)
                return (x["kind"] == KINDS[3]) & (F.get(last, i) <= x["start"]) & F.coalesce((after["kind"] == KINDS[3]) | (after["start"] >= x["end"]), F.lit(True))

            return _bound(end, lambda last: F.filter(z, lambda x, i: free(x, i, last)))

        return F.when((F.size(cands) > 0) & (F.size("base") > 0), _bound(F.array_sort(F.concat("base", cands)), judged)).otherwise(cands)

    out = docs.withColumn("base", base)
    return out.withColumn("added", _bound(spans("entropy", CANDIDATE, random_looking), clear))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "base", "added")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
