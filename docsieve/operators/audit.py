"""Structural findings over notes and links, the scored report, snapshots and alerts."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.canonical import canonical_json, sha256

DAY_MS = 86_400_000
KINDS = ("orphans", "broken_links", "stale", "duplicate_titles", "stubs", "untagged")
REPORTED = 100


def own(notes: DataFrame) -> DataFrame:
    """Without the derived cards."""
    return notes.where(~F.col("rel").startswith("cards/"))


def orphans(notes: DataFrame) -> DataFrame:
    return own(notes).where((F.col("inbound") == 0) & (F.size("outlinks") == 0)).select(F.col("rel").alias("note"), "title")


def broken_links(notes: DataFrame, names: DataFrame) -> DataFrame:
    links = own(notes).select(F.col("rel").alias("from"), F.explode("outlinks").alias("link"))
    return links.join(names.select("key"), F.lower("link") == F.col("key"), "left_anti")


def stale(notes: DataFrame, now_ms: int, days: int = 180) -> DataFrame:
    age = F.lit(now_ms) - F.col("mtime_ms")
    old = own(notes).where((age > days * DAY_MS) & (F.col("has_markers") | (F.col("open_tasks") > 0)))
    return old.select(F.col("rel").alias("note"), "title", F.floor(age / DAY_MS + 0.5).cast("long").alias("age_days"), "open_tasks")


def duplicate_titles(notes: DataFrame) -> DataFrame:
    groups = own(notes).groupBy(F.lower("title").alias("title")).agg(F.sort_array(F.collect_list("rel")).alias("notes"))
    return groups.where(F.size("notes") > 1)


def stubs(notes: DataFrame) -> DataFrame:
    return own(notes).where("stub").select(F.col("rel").alias("note"), "title", F.col("word_count").alias("words"))


def untagged(notes: DataFrame) -> DataFrame:
    return own(notes).where(F.size("tags") == 0).select(F.col("rel").alias("note"), "title")


def findings(notes: DataFrame, names: DataFrame, now_ms: int, days: int = 180) -> dict[str, DataFrame]:
    return dict(zip(KINDS, (orphans(notes), broken_links(notes, names), stale(notes, now_ms, days), duplicate_titles(notes), stubs(notes), untagged(notes)), strict=True))


def item_keys(found: dict[str, DataFrame]) -> DataFrame:
    """(kind, item_key) of all findings, uncut."""
    key = {"broken_links": F.concat("from", F.lit("->"), "link"), "duplicate_titles": F.concat(F.lit("title:"), "title")}
    parts = [df.select(F.lit(k).alias("kind"), key.get(k, F.col("note") if "note" in df.columns else F.lit(None)).alias("item_key")) for k, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts(found: dict[str, DataFrame]) -> DataFrame:
    """(kind, n), kinds without a finding too."""
    spark = next(iter(found.values())).sparkSession
    n = item_keys(found).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(k,) for k in found], "kind string").join(n, "kind", "left").fillna({"n": 0})


def raw_archive(notes: DataFrame) -> DataFrame:
    """One row (raw): more than 0.30 of the notes untagged and fewer than 0.70 with front matter."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    both = own(notes).agg(share(F.size("tags") == 0).alias("u"), share(F.col("has_frontmatter")).alias("f"))
    return both.select(F.coalesce((F.col("u") > 0.30) & (F.col("f") < 0.70), F.lit(False)).alias("raw"))


def penalty(kind: str, n: Column, raw: Column) -> Column:
    each, most = {"broken_links": (6, 24), "stale": (4, 16), "orphans": (2, 12), "duplicate_titles": (3, 9), "candidates": (1, 10)}[kind]
    return F.when(raw, 0).otherwise(F.least(n * each, F.lit(most))) if kind == "orphans" else F.least(n * each, F.lit(most))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def scored(counted: DataFrame, raw: DataFrame, contradictions: Column | None = None) -> DataFrame:
    """One row: a penalty for each kind, score and grade, from counts (kind, n)."""
    n = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    row = counted.agg(*map(n, ("broken_links", "stale", "orphans", "duplicate_titles", "candidates")))
    is_raw = raw.scalar()
    kinds = ("broken_links", "stale", "orphans", "duplicate_titles")
    row = row.select(*(penalty(k, F.col(k), is_raw).cast("int").alias(f"p_{k}") for k in kinds), (contradictions if contradictions is not None else penalty("candidates", F.col("candidates"), is_raw)).cast("int").alias("p_contradictions"))
    score = F.greatest(F.lit(0), 100 - sum(F.col(c) for c in row.columns))
    return row.withColumn("integrity_score", score.cast("int")).withColumn("grade", grade(score))


def report(index, now_ms: int, vault: str = "", days: int = 180, pairs: list[dict] | None = None, adjudicated: bool = False, at: str | None = None, timeouts: list | None = None, threshold: float = 0.82) -> dict:
    """The scored report: counts in full, REPORTED items of each kind; pairs of similar passages come from the caller, None without vectors."""
    found = findings(index.notes, index.names, now_ms, days)
    n = {r.kind: r.n for r in counts(found).collect()}
    confirmed = [p for p in pairs or [] if p.get("relation") == "contradict"]
    heavy = min(40, sum(15 if p["both_controlled"] else 8 for p in confirmed)) if adjudicated else min(10, len(pairs or []))
    spark = index.notes.sparkSession
    raw = raw_archive(index.notes)
    row = scored(spark.createDataFrame([(k, v) for k, v in n.items()], "kind string, n long"), raw, F.lit(heavy)).first()
    totals = index.notes.agg(F.count(F.lit(1)).alias("n"), F.count_if("controlled").alias("c")).first()
    order = {"stale": F.desc("age_days"), "broken_links": F.col("from"), "duplicate_titles": F.col("title")}
    items = {k: [r.asDict(recursive=True) for r in df.orderBy(order.get(k, F.col(df.columns[0]))).limit(REPORTED).collect()] for k, df in found.items()}
    out = {
        "kind": "integrity_report", "vault": vault, "integrity_score": row.integrity_score, "grade": row.grade, "raw_archive": bool(raw.first()[0]),
        "generated_at": at or datetime.fromtimestamp(now_ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z"),
        "totals": {"notes": totals.n, "chunks": index.stats.first()["n"]}, "controlled_coverage": {"controlled": totals.c, "total": totals.n},
        "penalties": {k[2:]: row[k] for k in row.asDict() if k.startswith("p_")}, "extraction": {"timeouts": timeouts or []},
        "findings": [{"key": k, "count": n[k], "items": items[k]} for k in KINDS],
        "contradictions": {"available": pairs is not None, "adjudicated": adjudicated, "threshold": threshold, "candidate_count": len(pairs or []), "confirmed_contradictions": len(confirmed) if adjudicated else None,
                           "controlled_overlaps": sum(bool(p["both_controlled"]) for p in pairs or []), "candidates": pairs or []},
    }
    return out | {"report_sha256": sha256(canonical_json(out))}


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, kind, item_key): new and resolved, repeats kept; both (kind, item_key)."""
    on = ["kind", "item_key"]
    new = after.join(before, on, "left_anti").select(F.lit("new").alias("change"), *on)
    return new.unionByName(before.join(after, on, "left_anti").select(F.lit("resolved").alias("change"), *on))


def events(changes: DataFrame, score_before: int | None, score_after: int, source: str = "", least_drop: int = 5) -> DataFrame:
    """(severity, type, source, detail): confirmed contradictions high, broken links and a score drop medium, stale notes low. None before: silent."""
    kinds = {"confirmed": ("high", "new_contradiction"), "broken_links": ("medium", "new_broken_link"), "stale": ("low", "newly_stale")}
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in kinds.items() for x in (k, v[i])))[F.col("kind")]
    out = changes.where((F.col("change") == "new") & F.col("kind").isin(*kinds)).select(pick(0).alias("severity"), pick(1).alias("type"), F.lit(source).alias("source"), F.col("item_key").alias("detail"))
    if score_before is None:
        return out.limit(0)
    if score_before - score_after >= least_drop:
        out = out.unionByName(changes.sparkSession.createDataFrame([("medium", "score_drop", source, f"{score_before} -> {score_after}")], out.schema))
    return out
