"""BM25 retrieval with structural boosts, an optional semantic blend, and the gate that refuses."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.functions.text import rounded, snippet, tokenize
from docsieve.operators.index import Index
from docsieve.shared import cut

K1, B = 1.5, 0.75
SEM_WEIGHT, SEM_LEAST, SEM_GATE, GATE = 0.45, 0.5, 0.49, 0.28
#: Candidates that the phrase boost sees; each phrase's factor and their product's limit.
PHRASE_TOP, PHRASE, PHRASE_MOST = 150, 1.8, 2.5


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def lexical(postings: DataFrame, terms: DataFrame, stats: DataFrame, words: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, bm, m, mi): score, matched terms and their idf of every text with one of the words. Only their postings are read."""
    words = list(dict.fromkeys(words))
    n, avg = stats.select("n").scalar(), stats.select("avg_len").scalar()
    few = F.broadcast(terms.where(F.col("term").isin(*words)))  # at most a row for each query word
    hit = postings.where(F.col("term").isin(*words)).join(few, "term").withColumn("idf", idf(F.col("df"), n))
    each = F.col("idf") * bm25(F.col("tf"), F.col("len"), avg)
    return hit.groupBy(key).agg(F.sum(each).alias("bm"), F.count(F.lit(1)).alias("m"), F.sum("idf").alias("mi"))


def phrases(query: str) -> list[str]:
    words = [w for w in re.split("[^a-z0-9]+", query.lower()) if len(w) > 1 and tokenize(w)]
    return list(f"{a} {b}" for a, b in zip(words, words[1:]))


def phrase_boost(text: Column, pairs: list[str]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(1.0)
    for p in pairs:
        out = F.least(out * F.when(low.contains(p), PHRASE).otherwise(1.0), F.lit(PHRASE_MOST))
    return out


def boosted(query: str, words: list[str], now_ms: int | None) -> Column:
    """The factor of title, heading, tags, coverage, recency (only with a clock) and inbound links. Stems are sought in raw text."""
    some = lambda c: F.greatest(*(F.coalesce(F.lower(c).contains(w), F.lit(False)).cast("int") for w in words), F.lit(0)) > 0
    whole = F.coalesce(F.lower("title").contains(query.lower()), F.lit(False))
    tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.greatest(*(t.contains(w).cast("int") for w in words), F.lit(0)) > 0)
    out = F.when(whole, 1.6).when(some(F.col("title")), 1.25).otherwise(1.0) * F.when(some(F.col("heading")), 1.2).otherwise(1.0) * F.when(tagged, 1.15).otherwise(1.0)
    out = out * (1 + 0.15 * F.col("m") / len(words))
    if now_ms is not None:
        out = out * (1 + 0.08 * F.greatest(F.lit(0.0), 1 - (F.lit(now_ms) - F.col("mtime_ms")) / 86_400_000.0 / 90))
    return out * (1 + 0.12 * F.log1p(F.coalesce("inbound", F.lit(0))))


def ranked(index: Index, query: str, semantic: DataFrame | None = None, now_ms: int | None = None) -> DataFrame:
    """(chunk_id, rel, score, first, m, mi, sem): before the cap by note. semantic: (chunk_id, sem), a cosine for every chunk."""
    words = list(dict.fromkeys(tokenize(query))) or [""]
    meta = index.chunks.select("chunk_id", "rel", "title", "heading", "tags", "mtime_ms").join(index.notes.select("rel", "inbound"), "rel")
    found = lexical(index.postings, index.terms, index.stats, words)
    rows = meta.join(found, "chunk_id", "left" if semantic is not None else "inner")
    rows = rows.fillna({"bm": 0.0, "m": 0, "mi": 0.0}).withColumn("bm", F.col("bm") * boosted(query, words, now_ms)).select("chunk_id", "rel", "bm", "m", "mi")
    if semantic is not None:
        rows = cut(rows.join(semantic, "chunk_id").withColumn("sem", F.greatest("sem", F.lit(0.0))), "blended")  # all chunks, as a few numbers each: the best and the ranking read it
        most = rows.agg(F.max("bm")).scalar()
        rows = rows.withColumn("first", (1 - SEM_WEIGHT) * F.when(most > 0, F.col("bm") / most).otherwise(0.0) + SEM_WEIGHT * F.col("sem")).where((F.col("m") > 0) | (F.col("sem") >= SEM_LEAST))
    else:
        rows = rows.withColumn("sem", F.lit(None).cast("double")).withColumn("first", F.col("bm"))
    if pairs := phrases(query):
        edge = rows.select("first", "chunk_id").orderBy(F.desc("first"), "chunk_id").limit(PHRASE_TOP)
        top = index.chunks.select("chunk_id", phrase_boost(F.col("text"), pairs).alias("boost")).join(F.broadcast(edge.select("chunk_id")), "chunk_id", "left_semi")  # PHRASE_TOP rows at most
        rows = rows.join(F.broadcast(top), "chunk_id", "left").withColumn("score", F.col("first") * F.coalesce("boost", F.lit(1.0)))
    else:
        rows = rows.withColumn("score", F.col("first"))
    return rows.select("chunk_id", "rel", "score", "first", "m", "mi", "sem")


def capped(rows: DataFrame, per_note: int, k: int, order: list) -> DataFrame:
    """The first k in order, of each note per_note at most; a note's later rows leave by a group limit, then only k remain."""
    w = Window.partitionBy("rel").orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_note).drop("_r").orderBy(*order).limit(k)


def gate(hits: int, top: float, sem_top: float | None, info_share: float, strictness: float, hybrid: bool) -> tuple[float, bool]:
    """(confidence, weak)."""
    half_up = lambda x: math.floor(x * 100 + 0.5) / 100
    m = 0.4 + 1.2 * min(1.0, max(0.0, strictness))
    if hybrid:
        return min(1.0, half_up(top * (0.5 + 0.5 * info_share))), hits == 0 or ((sem_top or 0) < SEM_GATE * min(m, 1.3) and info_share < GATE * m)
    return half_up(info_share), hits == 0 or half_up(info_share) < GATE * m


def search(index: Index, query: str, k: int = 8, per_note: int = 2, semantic: DataFrame | None = None, strictness: float = 0.5, now_ms: int | None = None) -> dict:
    """Hits (k rows at most), confidence and whether to refuse. A query without a term finds nothing unless semantic is given."""
    words, hybrid = list(dict.fromkeys(tokenize(query))), semantic is not None
    if not words and not hybrid:
        return {"hits": [], "confidence": 0.0, "weak": True, "info_share": 0.0, "qterms": [], "mode": "lexical"}
    order = [F.desc("score"), F.desc("first"), F.asc("chunk_id")]
    best = capped(ranked(index, query, semantic, now_ms), per_note, k, order)
    about = index.chunks.select("chunk_id", "title", "heading", "heading_path", "tags", "text", "mtime_ms").join(F.broadcast(best), "chunk_id")
    about = about.join(index.notes.select("rel", "folder", "inbound", F.size("outlinks").alias("outlinks")), "rel")
    shown = about.withColumn("shown", rounded(F.col("score"), 3)).withColumn("sem", rounded(F.col("sem"), 2)).withColumn("mtime", F.date_format(F.timestamp_millis("mtime_ms"), "yyyy-MM-dd"))
    rows = sorted(shown.collect(), key=lambda r: (-r.score, -r["first"], r.chunk_id))  # k rows
    n = index.stats.first()["n"]
    known = {r.term: r.df for r in index.terms.where(F.col("term").isin(*words)).collect()} if words else {}
    total = sum(math.log(1 + (n - known.get(w, 0) + 0.5) / (known.get(w, 0) + 0.5)) for w in words) or 1
    share = min(1.0, max(0.0, (rows[0].mi if rows else 0.0) / total))
    confidence, weak = gate(len(rows), rows[0].shown if rows else 0, rows[0].sem if rows else None, share, strictness, hybrid)
    names = ("title", "heading", "heading_path", "tags", "sem", "mtime", "folder", "inbound", "outlinks")
    hits = [{"id": r.chunk_id, "note": r.rel, "score": r.shown, "coverage": f"{r.m}/{len(words)}", "snippet": snippet(r.text, set(words)), "text": r.text} | {c: r[c] for c in names} for r in rows]
    return {"hits": hits, "confidence": confidence, "weak": weak, "info_share": math.floor(share * 100 + 0.5) / 100, "qterms": words, "mode": "hybrid" if hybrid else "lexical"}
