"""Filter audit, fill-in-the-middle and sharding against brute force, with nulls, empties, ties, repeats and name clashes."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cytoplane.llm import fill_in_middle as fim
from cytoplane.llm import filter_audit, sharding
from test_operators import ODD, prose

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [*ODD, "<P>", "a <S> b\nc", "x<\nS>y<\nM>", "\n\nx\n", "#" * 10, "AB C" * 20, "\r\n \n", "a\n" * 5000, "é\n😀\nß"]
    for _ in range(60):
        words = prose(rng, rng.randint(1, 120)).split()
        words = [w.upper() if rng.random() < 0.1 else w for w in words] + rng.choices(words, k=rng.choice([0, 0, 80])) + rng.choices(["", "$", "a|b"], k=rng.randint(0, 2))
        text = "".join(w + rng.choice(["\n", " ", " ", "\t"]) for w in words)
        texts += [text] * rng.choice([1, 1, 1, 4])
    texts += [texts[-1]] * 50
    sources = ["s", "s", "s", None, "", "ü"]
    out = [(i, t, rng.choice(sources)) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[0], out[1], out[1], (None, texts[-1], "s"), (None, None, "s"), (None, texts[-1], None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns whose names the operators use themselves.
    return spark.createDataFrame([(*r, 3, 1, "x", 0, True) for r in rows], "doc_id long, text string, source string, n int, shard int, form string, size int, E boolean")


def audit_by_hand(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    counts = collections.Counter()
    parts = {s or "" for _, _, s in rows}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        docs.append((s or "", {f for f, v in fails.items() if v}, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, fails, good, toxic in docs:
            gone = False
            for k, f in enumerate(order, 1):
                key = (part, order, k)
                counts[*key, "unique_fails"] += fails == {f}
                if f in fails:
                    counts[*key, "redundant" if gone else "removed"] += 1
                    counts[*key, "good_lost"] += good and not gone
                    counts[*key, "toxic_lost"] += toxic and not gone
                    counts[part, f, "shapley"] += not gone
                    gone = True
                counts[*key, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, k): (*(counts[p, o, k, x] for x in names), counts[p, o[k - 1], "shapley"]) for p in parts for o in map("".join, itertools.permutations("ABCDE")) for k in range(1, 6)}


def audit(spark, docs, labels):
    at = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.interaction_audit(filter_audit.with_labels(filter_audit.flag_documents(docs), at), good=F.col("good"), toxic=F.col("toxic")).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert len(got) == len(out) and all(r.filter == r.filter_order[r.step - 1] for r in out)
    return got


def test_audit_equals_every_order_by_hand(spark, docs, rows):
    rng = random.Random(3)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, len(rows), 2)]
    labels += [*labels[:5], (labels[0][0], 1, 1), (None, 1, 1), (10**6, 1, 1)]
    assert audit(spark, docs, labels) == audit_by_hand(rows, labels)


def test_audit_of_empty_tables(spark, docs, rows):
    assert audit(spark, docs.limit(0), [(1, 1, 1)]) == {}
    assert audit(spark, docs, []) == audit_by_hand(rows, [])


def test_audit_of_other_filters_and_few_parts(spark):
    flagged = spark.createDataFrame([("p", True, False), ("p", True, True), ("p", None, True)], "source string, x boolean, y boolean")
    out = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.interaction_audit(flagged, "xy").collect()}
    assert out == {("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (0, 1, 1, 1, 3), ("yx", 1): (1, 2, 0, 1, 3), ("yx", 2): (0, 1, 1, 1, 3)}


def test_lattice_has_80_edges_and_600_steps():
    edges, steps = filter_audit.lattice("ABCDE")
    assert len(edges) == 80 and len(steps) == 600
    assert sum(w for _, _, w in edges) == 600 and {(s, b) for s, b, _ in edges} == {(s, b) for *_, s, b in steps}


def middle_by_hand(i, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.SENTINELS) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("draw", [{}, {"seed": 11, "percent": 60, "spm_percent": 20}])
def test_middle_equals_cuts_by_hand_and_comes_back(spark, docs, rows, draw):
    out = fim.fill_in_middle(docs, **draw).withColumn("back", fim.restored("output", "form")).collect()
    by_hand = {"seed": draw.get("seed", 7), "percent": draw.get("percent", 100), "spm": draw.get("spm_percent", 50)}
    expected = collections.Counter((i, t, *middle_by_hand(i, t, **by_hand)) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.text, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == expected
    assert all(r.back == (r.text or "") and r.n == 3 for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_middle_of_long_texts_and_no_rows(spark, docs):
    long = ["x" * 3_000_000, "\n" * 300_000, "ab\n" * 300_000]
    d = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    out = fim.fill_in_middle(d).withColumn("back", fim.restored("output", "form")).select("n_units", (F.col("back") == F.col("text")).alias("same")).collect()
    assert sorted(tuple(r) for r in out) == [(1, True), (300_000, True), (300_000, True)]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_middle_with_other_units_and_sentinels(spark, docs, rows):
    marks = ("[PRE(]", "[SUF.]", "[MID|]")
    out = fim.fill_in_middle(docs, unit=r"\S+\s*|\s+", sentinels=marks).withColumn("back", fim.restored("output", "form", marks)).collect()
    assert all(r.back == (r.text or "") for r in out) and sum(r.form != "plain" for r in out) > 50


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "P>", "<M>"), ("<P>>", "<P>", "<M>")])
def test_sentinels_that_could_be_mistaken_are_refused(spark, docs, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, sentinels=marks)


def shards_by_hand(sizes, shards):
    """The shard of each of sizes in order, and its slot."""
    out, upto, seen = [], 0, collections.Counter()
    for s in sizes:
        k = (2 * upto + s) * shards // (2 * sum(sizes))
        out.append((k, seen[k]))
        seen[k] += 1
        upto += s
    return out


@pytest.mark.parametrize("shards", [1, 7, 40, 500])
def test_shards_equal_prefix_sums_by_hand(spark, docs, rows, shards):
    out = sharding.shard_documents(docs.repartition(5), shards).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter((i, t) for i, t, _ in rows)
    out.sort(key=lambda r: (r.shard, r.slot))
    assert [r.doc_id is not None for r in out] == sorted(r.doc_id is not None for r in out)
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert ids == sorted(ids)
    assert all(r.size == len((r.text or "").encode()) + 16 for r in out)
    assert [(r.shard, r.slot) for r in out] == shards_by_hand([r.size for r in out], shards)
    bytes_ = collections.Counter()
    for r in out:
        bytes_[r.shard] += r.size
    whole, largest = sum(bytes_.values()), max(r.size for r in out)
    assert all(abs(bytes_[k] - whole / shards) <= largest for k in range(shards))


def test_a_key_of_all_rows_is_dealt_over_ranges(spark):
    d = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    out = sharding.shard_documents(d, 40).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("k")).collect()
    assert {(r.n, r.a, r.b, r.k) for r in out} == {(125, 0, 124, 125)} and len(out) == 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would be put together again
    try:
        assert sharding.in_order(d, ["doc_id"]).select("__range").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_huge_sizes_and_no_rows(spark, docs):
    assert sharding.shard_documents(docs.limit(0), 40).count() == 0
    sizes = [10**17, 3, 10**17 - 1, 10**17 + 1, 1]
    d = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, bytes long")
    out = sharding.shard_documents(d, 1000, size_col="bytes").orderBy("doc_id").collect()
    assert [(r.shard, r.slot) for r in out] == shards_by_hand(sizes, 1000)


def test_written_shards_hold_their_rows(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_documents(docs, 5), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 5


def test_queries_equal_their_sql_and_checksums(spark):
    out = sharding.op13_sharding(spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in out)
    assert {r.shard for r in out} == set(range(40))


def test_audit_broadcasts_no_table_that_grows(spark):
    """Labels are a small file and many rows: neither they nor the texts met twice go through the driver."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 150).cast("string")).alias("text"), F.lit("a").alias("source"))
    at = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    flagged = filter_audit.with_labels(filter_audit.flag_documents(docs), at)
    rows = flagged.collect()
    assert "Broadcast" not in flagged._jdf.queryExecution().executedPlan().toString()
    assert sum(r.good for r in rows) == 300 and sum(r.E for r in rows) == 250
