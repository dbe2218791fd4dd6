"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docsieve.llm import bpe, chroma, labelled, lineruns, mixing, oracle, quality, recipes, secrets, simhash, toxicity, urls
from docsieve.session import table
from docsieve.shared import shared_dir


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), seen=True)
    held = F.coalesce(labelled.fold() == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_secrets(spark, sf_dir):
    """With a new ledger, so that all blobs are unseen."""
    out = secrets.scan_documents(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/docsieve-{uuid.uuid4().hex}-ledger")
    base = secrets.listed("spans", secrets.KINDS[:3])
    n = {f"n_{k}": secrets.counted("spans", k) for k in secrets.KINDS[:3]}
    return out.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(base, 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op3_exact_dedup(spark, sf_dir):
    return recipes.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_chroma(spark, sf_dir):
    """No table has audio: every vector of embeddings is played, a note for each component."""
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", chroma.played)
    return chroma.align(prints, "vec_id")


def op5_mixing(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", F.expr("_mix.size * _mix.times").alias("taken"))


def op6_quality(spark, sf_dir):
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=2, width=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


def op9_byte_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    out = lineruns.dedup_lines(table(spark, sf_dir, "documents"))
    runs = F.array_join(F.transform("_runs", lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ",")
    n = F.aggregate("_runs", F.lit(0), lambda s, r: s + r["b"] - r["a"] + 1)
    return out.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_cut"), F.coalesce(runs, F.lit("")).alias("runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_exact_dedup, op4_chroma, op5_mixing, op6_quality, op7_simhash, op8_url_filter, op9_byte_bpe, op10_line_dedup)}
ORACLE = oracle.ORACLE
