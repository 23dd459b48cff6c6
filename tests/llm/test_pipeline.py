"""The pipeline's stages on a small table, against what each must keep."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sevspark.llm import queries  # noqa: E402


def test_stages_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.toxic_model(spark, docs, folder)
    texts = {r.doc_id: r.text for r in docs.collect()}
    keep = {i for i, s in zip(texts, model.scores(list(texts.values()))) if s < 0.5}
    now = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == keep
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:4] == ["doc_id", "piece", "start", "length"] and {r.doc_id for r in out.collect()} <= keep


def test_stages_keep_clean_rows_and_survive_odd_ones(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    base, passage = prose(100), prose(60)
    rows = [(1, base), (2, base), (3, base + " end"), (4, prose(80) + " " + passage), (5, passage + " " + prose(70)), (6, None), (7, ""), (None, prose(50)), (8, prose(40))]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    single = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {x.doc_id for x in single.collect()} == {1, 4, 5, 6, 7, None, 8}
    cut = {x.doc_id: x.text for x in corpus_pipeline.cut_repeats(spark, single, "").collect()}
    assert passage in cut[4] and passage.split()[0] not in cut[5].split() and cut[1] == base and set(cut) == {1, 4, 5, 6, 7, None, 8}
    mixed = corpus_pipeline.mix_sources(spark, single, "")
    assert mixed.columns == docs.columns and {x.doc_id for x in mixed.collect()} <= set(cut)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats, corpus_pipeline.mix_sources, corpus_pipeline.pack):
        assert stage(spark, docs.where("false"), "").count() == 0


def test_near_duplicates_keep_unrelated_texts_of_one_id(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    none, other, one, two = (prose(60) for _ in range(4))
    rows = [(None, none), (None, other), (None, other + " end"), (3, one), (3, two), (4, two + " end")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(x.doc_id, x.text.removesuffix(" end")) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {(None, none), (None, other), (3, one), (3, two)}
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 4


def test_mixing_deals_whole_copies_to_repeated_rows(spark):
    """A source that is cut inside a group of repeated rows gives as many rows as the mix takes."""
    rows = [(1, "a b", "x")] * 40 + [(2, "c d", "y")] * 40 + [(3, "e f", "z")] * 40
    docs = spark.createDataFrame([(i, t, "en", s, 3) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.source: x["count"] for x in corpus_pipeline.mix_sources(spark, docs, "").groupBy("source").count().collect()}
    # weights 5, 2, 1 of 360 words, at most 160 of x: 133 and 67 words of y and z
    assert got["x"] == 80 and 66 <= got["y"] <= 67 and 33 <= got["z"] <= 34


def test_cut_repeats_shuffles_texts_once(spark):
    """Both joins of the operator read one exchange of texts, and the stage joins them to their rows no more."""
    r = random.Random(6)
    prose = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    passage, odd = prose(60), prose(30).replace(" ", "  \n")
    texts = [prose(80) + " " + passage, passage + "\t " + prose(70), odd, passage, None, "", odd + prose(5)]
    docs = spark.createDataFrame([(i, t, "en", "s%d" % i, 7 * i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        cut = corpus_pipeline.cut_repeats(spark, docs, "")
        got = {x.doc_id: x for x in cut.collect()}
    finally:
        spark.conf.set(broadcast, before)
    assert cut.columns == docs.columns and set(got) == {0, 1, 2, 4, 5, 6}
    assert all(got[i].text == texts[i] and got[i].n_chars == 7 * i for i in (0, 2, 4, 5))
    assert got[1].text == " ".join(texts[1].split()[60:]) and got[1].n_chars == len(got[1].text)
    assert got[6].n_chars == len(got[6].text) < len(texts[6]) and [got[i].source for i in (0, 1, 6)] == ["s0", "s1", "s6"]
    plan = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 2 and plan.count("ReusedExchange") == 1
