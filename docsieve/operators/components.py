"""Connected components by alternating large-star and small-star steps, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.shared import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (a, b): every vertex that isn't the least of its component, with that least vertex.

    Each round is two shuffled steps over at most the edges; rounds grow with the logarithm of the longest path. Rounds are
    written to the shared folder. A hub's edges meet in a join, which adaptive execution splits. Loops and repeats don't
    matter; null ends are dropped. No edges: an empty table.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            return now
        half = cut(_large_star(now), "large")
        after = cut(_small_star(half), "small")
        discard(half)
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            return now
    raise RuntimeError("components did not settle")
