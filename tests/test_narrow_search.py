from docsieve.functions.text import tokenize
from docsieve.operators import search
from docsieve.plans import catalog, corpus
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_an_index_never_move(spark):
    index = corpus.index(spark, SF)
    assert "Join" not in plan(index.chunks)
    found = search.ranked(index, "the license version of apache")
    assert search.phrases("the license version of apache") and found.count() == search.lexical(index.postings, index.terms, index.stats, tokenize("license version apache")).count()


def test_a_blend_is_computed_once(spark):
    index = corpus.index(spark, SF)
    blend = search.ranked(index, "edoution", index.chunks.select("chunk_id", F.lit(0.6).alias("sem")))
    assert "Join" not in plan(blend) and blend.count() == index.chunks.count()


def test_the_gate_reads_postings_of_its_terms_only(spark):
    p = plan(catalog.search_confidence_gate(spark, SF))
    assert "In(term, [" in p


def test_chains_stream_and_are_sealed_once(spark):
    chains = catalog._chains(spark, SF)
    assert "Pandas" not in plan(chains) and "MapInArrow" not in plan(catalog.ledger_chain_verify(spark, SF))
    first = chains.groupBy("user_id").agg(F.min("seq").alias("a"), F.max("seq").alias("z"), F.count(F.lit(1)).alias("n"))
    assert first.where("a <> 0 or z <> n - 1").isEmpty()
