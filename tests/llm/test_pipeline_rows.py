"""Decisions of the pipeline's stages belong to rows, not to keys."""

import pytest

import corpus_pipeline as p
from docsieve.llm import quality

LONG = "plain words about a river and a town beside it with boats and nets and men who sing at dawn "
JUNK = " ".join(f"w{i}%%%%" for i in range(60))


@pytest.fixture
def labelled(spark, tmp_path):
    d = f"file://{tmp_path}"
    rows = [(i, int(i % 2), 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def corpus(spark, more):
    rows = [(i, f"{LONG * 2} number {i}" if i % 2 else f"{JUNK} {i}", "en", f"s{i % 2}", 0, "x") for i in range(60)]
    return spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string, source string, n_chars long, tail string").repartition(3)


MORE = [(100, f"{JUNK} namesake", "en", "s1", 0, "y"), (100, f"{LONG} namesake", "en", "s0", 0, "y"), (None, f"{JUNK} nobody", "en", "s0", 0, None), (None, f"{LONG} nobody", None, None, None, None), (7, None, None, None, None, None), (8, "", "en", "s1", 0, "z")]


def test_quality_judges_rows(spark, labelled):
    docs = corpus(spark, MORE)
    kept = [(r.doc_id, r.text) for r in p.good(spark, docs, labelled).collect()]
    assert (100, f"{JUNK} namesake") not in kept and (100, f"{LONG} namesake") in kept
    assert (None, f"{JUNK} nobody") not in kept and (None, f"{LONG} nobody") in kept
    assert {i for i, _ in kept} >= {i for i in range(60) if i % 2}
    assert p.good(spark, docs, labelled).schema == docs.schema


def test_ties_and_repeats_score_alike(spark, labelled):
    docs = corpus(spark, [(i, "same words here", "en", "s", 0, "t") for i in (70, 70, 71)])
    model = quality.train(docs, spark.read.parquet(f"{labelled}/labels.parquet"))
    tails = [r.tail for r in quality.score(docs, model).where("doc_id >= 70").collect()]
    assert len(tails) == 3 and len(set(tails)) == 1


def test_near_duplicates_judge_rows(spark, labelled):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, text), (None, text), (1, "another text " + text[::-1]), (None, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, d long, t string")
    out = p.distinct_documents(spark, docs, labelled)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, text), (1, "another text " + text[::-1]), (2, "")])
    keyed = docs.selectExpr("cast(doc_id as string) doc_id", "text", "lang", "source", "d", "t")
    assert p.distinct_documents(spark, keyed, labelled).count() == 3


def test_stages_take_odd_and_no_rows(spark, labelled):
    docs = corpus(spark, [*MORE, *MORE])
    for name, stage in p.STAGES:
        assert stage(spark, docs, labelled).count() > 0, name
        assert stage(spark, docs.limit(0), labelled).count() == 0, name
    mixed = p.mixture(spark, docs, labelled)
    assert mixed.schema == docs.schema and {r.text for r in mixed.collect()} <= {r.text for r in docs.collect()}
    assert p.tokens(spark, docs, labelled).count() == docs.count()
