from docsieve.functions import text
from docsieve.operators import index as ix
from pyspark.sql import functions as F

TEXTS = ["Rule 3.8(d)(1) applies; applied rules", None, "", "x-y-z 1.2.3.4 LC-6655 a-1-b--c-2d", "Kelvin K2 été2026-11 don't", "the of and", "a" * 50 + " 1." + "2" * 39, "running runs ran 2.0(a) 2.0a"]


def plain(df):
    return sorted((r.k, r.term, r.tf, r["len"]) for r in df.collect())


def test_tokens_are_counted_where_the_text_is(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "k int, t string")
    counted = text.tokens(rows, "t").groupBy("k", "term").agg(F.count(F.lit(1)).alias("tf"))
    want = plain(counted.join(counted.groupBy("k").agg(F.sum("tf").alias("len")), "k"))
    for run in (text.RUN, 5):
        monkeypatch.setattr(text, "RUN", run)
        monkeypatch.setattr(text, "SENT", 3)
        monkeypatch.setattr(text, "KNOWN", 4)
        got = ix.postings_of(rows, "k", "t")
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and plain(got) == want
        assert got.schema.simpleString() == "struct<k:int,term:string,tf:bigint,len:bigint>"


def test_texts_of_one_key_count_as_one(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (1, "red red"), (None, "hen"), (None, "hen")], "k int, t string")
    got = sorted(((r.k or 0, r.term, r.tf, r["len"]) for r in ix.postings_of(rows, "k", "t").collect()))
    assert got == [(0, "hen", 2, 2), (1, "fox", 1, 4), (1, "red", 3, 4), (2, "hen", 1, 2), (2, "red", 1, 2)]
