"""The pipeline's stages in turn on the small fixture."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="fixtures are absent")
def test_stages_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols, left = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n = docs.count()
        assert 0.7 * left < n <= left
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == cols
        left = n
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == {r.doc_id: r.n_tokens for r in docs.collect()}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string, n_chars long, score double, leaks string, n_lines int, kept boolean, component_id long"
    long = "word and other words " * 20_000
    rows = [(1, "hello there world of words", "aa"), (2, None, "aa"), (3, "", None), (4, "123 ...", "bb"), (None, "hello there world of words again and again", "aa"), (5, long, "bb"), (5, long, "bb"), (6, long + "x", None), (7, "uvw xyz uvw yyx", "bb")]
    docs = spark.createDataFrame([(*r, None, 1, 0.5, "l", 7, None, None) for r in rows], cols)
    spark.createDataFrame([(1, "uvw xyz uvw yyx but longer than any"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = [[None, 1, 5, 5, 6, 7]] * 2 + [[None, 1, 5, 5, 7]] * 2  # 6 is a near copy of 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted((r.doc_id for r in got), key=lambda i: i or 0) == want[k]
        assert all((r.score, r.leaks, r.n_lines, r.kept) == (0.5, "l", 7, None) for r in got)
        docs = spark.createDataFrame(got, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.decoded) for r in last} == texts


def test_language_stage_without_a_model(spark, tmp_path):
    stage = corpus_pipeline.STAGES[0][1]
    long = "many words of one text " * 1000  # over the bound of a training text
    rows = [(1, "hello there", None), (2, "12 ...", None), (3, None, None), (4, "καλημέρα", None)]
    for more in ([], [(5, long, "aa")]):
        docs = spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string")
        assert sorted((r.doc_id, r.lang) for r in stage(spark, docs, str(tmp_path)).collect()) == [(1, None), (4, None), *[(i, lang) for i, _, lang in more]]


def test_language_stage_fills_lang(spark, tmp_path):
    rows = [(i, "uno dos tres cuatro cinco", "es") if i % 2 else (i, "one two three four five", "en") for i in range(40)]
    docs = spark.createDataFrame([*rows, (90, "two three one", None), (91, "cinco tres dos", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert got == {**{i: lang for i, _, lang in rows}, 90: "en", 91: "es"}


def test_stages_on_a_text_of_many_megabytes(spark, tmp_path):
    """Every stage takes a text of 5 MB whole (the test JVM has a heap of 1 GB): nothing of it is cut, and it meets its near copy and its benchmark item."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 9))) for _ in range(5000)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(60_000)]
    long = "\n".join(lines)
    assert len(long) > 4_500_000
    leak = " ".join(rng.choices(words, k=20))
    rows = [(1, long, "aa"), (2, long.replace(words[7], words[8]), "aa"), (3, "a few words of another text", "bb"), (4, f"{long[-2_000_000:]} {leak}", "aa")]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dedup = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path))
    kept = {r.doc_id: r.text for r in dedup.collect()}
    assert kept[1] == long and len(kept[2]) < 0.02 * len(long) and kept[4].endswith(leak)
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).select("doc_id").collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).select("doc_id").collect()) == [1, 2, 3]
    assert {r.doc_id: r.decoded for r in corpus_pipeline.tokenize(spark, docs.where("doc_id in (1, 3)"), str(tmp_path)).collect()} == {1: long, 3: rows[2][1]}


def test_language_id_learns_in_a_task(spark, monkeypatch):
    from cytoplane.llm import language_id
    from cytoplane.llm.crf import Crf

    rows = [(i, " ".join(["der hund und die katze", "the dog and the cat"][i % 2].split() * (1 + i % 5)), "de" if i % 2 == 0 else "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = language_id.learn(["de", "en"], [(lang, text, i) for i, text, lang in rows], 300, 500, 3)

    def refuse(*args, **how):
        raise AssertionError("the driver learns")

    monkeypatch.setattr(Crf, "fit", refuse)
    model = language_id.train(docs)
    assert model.labels == want.labels and model.lead == want.lead
    t = model.tokens([text.encode() for _, text, _ in rows])
    assert (model.marginals(model.emissions(t), t.counts) == want.marginals(want.emissions(t), t.counts)).all()
    assert language_id.train(docs.limit(0)) is None
