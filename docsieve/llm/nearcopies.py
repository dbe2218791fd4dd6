"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 at least.

Candidates meet by SimHash ball hashing, and in minhash bands where their fingerprints are farther apart; exact check, components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import simhash
from docsieve.operators.components import connected_components
from docsieve.shared import cut, discard, sized_join

WIDTH, LEAST = 5, 0.8
#: Differing bits of SimHash fingerprints (op7's) up to which ball hashing finds every pair.
DISTANCE = 5
#: Two at 0.8 share a band but for one in 10,000: 1 - (1 - 0.8^6)^30.
BANDS, ROWS = 30, 6
#: Shingles that are mixed at once; rows whose sets a worker holds.
_BLOCK, _ROWS = 1 << 12, 500
_MIX = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_A, _B = _MIX[0] | np.uint64(1), _MIX[1]
_FLIP = 0x5DEECE66D1234567


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of shingles of UTF-8 text: words by ASCII white space, A-Z lowered; shorter texts are one shingle."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    parts = map(b" ".join, zip(*(words[i : n + i] for i in range(width)), strict=True)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64, n))


def vertex(hashes: np.ndarray) -> int:
    """One number for a shingle set."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), 7)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of minima; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (hashes[None, at : at + _BLOCK] * _A + _B).min(axis=1))
    return np.array([xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


#: Longs of a parity map, and its columns: bit i is odd if so are the set's shingles in cell i. Two maps differ in no more bits
#: than their sets in shingles, so a pair whose maps differ too much is ruled out without loss.
MAP = 16
_MAP = [f"m{i}" for i in range(MAP)]
#: A row's own columns: whether its key is null, the key (null: any), the text's hash.
_ROW = ["_near_z", "_near_d", "_near_t"]


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType
    return docs.withColumns(dict(zip(_ROW, (F.col(key).isNull(), F.coalesce(F.col(key), F.lit("0").cast(kind)), F.xxhash64(F.col(text).cast("string"))), strict=True)))


def parity(hashes: np.ndarray) -> np.ndarray:
    cells = (hashes >> np.uint64(40)).astype(np.int64) % (64 * MAP)
    return np.packbits(np.bincount(cells, minlength=64 * MAP) & 1, bitorder="little").view(np.int64)


def _near(a: str, b: str, least: float) -> str:
    """SQL: whether the sets behind two sides may be similar enough, by their sizes n and their maps."""
    differ = " + ".join(f"bit_count({a}.{m} ^ {b}.{m})" for m in _MAP)
    return f"least({a}.n, {b}.n) >= {least} * greatest({a}.n, {b}.n) - 1e-9 and {differ} <= ({a}.n + {b}.n) * {(1 - least) / (1 + least)!r}D + 1e-9"


def _signed(rows: DataFrame, text: str) -> DataFrame:
    """(_ROW, v, n, fp, bands, _MAP) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                raws = [x.as_py() or b"" for x in part.column(3)]
                sets = [shingles(x) for x in raws]
                fps = np.array([simhash.fingerprint(x) for x in raws], np.uint64).view(np.int64)
                v = np.array([vertex(x) for x in sets], np.uint64).view(np.int64)
                keys = [bands(x).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(v), pa.array([len(x) for x in sets], pa.int32()), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, np.stack([parity(x) for x in sets], axis=1))], [*_ROW, "v", "n", "fp", "bands", *_MAP])

    kept = rows.select(*_ROW, F.col(text).cast("string").cast("binary").alias("_raw"))
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:3])
    return kept.mapInArrow(run, f"{own}, v bigint, n int, fp bigint, bands array<bigint>, {', '.join(f'{m} bigint' for m in _MAP)}")


def _sets(rows: DataFrame, text: str) -> DataFrame:
    """(v, s): the shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                sets = [shingles(x.as_py() or b"") for x in batch.column(0).slice(at, _ROWS)]
                v = np.array([vertex(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["v", "s"])

    return rows.select(F.col(text).cast("string").cast("binary").alias("_raw")).mapInArrow(run, "v bigint, s array<bigint>")


def _verified(pairs: DataFrame, reps: DataFrame, text: str, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of least or more. Sets are made of the texts that pairs need only."""
    need = cut(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "need")
    sets = cut(_sets(sized_join(reps, need, "v", "left_semi"), text), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    met = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u"))
    out = cut(met.where(F.col("i") >= least * F.col("u") - 1e-9).select("a", "b"), "verified")
    discard(sets)
    return out


def links(buckets: DataFrame, maps: DataFrame, reps: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """(v, root): every set that isn't the first of its component, of all pairs that share a bucket and are similar enough.

    buckets (v, k), maps (v, n, _MAP) and reps (v, text) of distinct sets. First each set is compared to three of its bucket's
    (the least by three orders), which joins most of a large group. Then the pairs of a bucket that aren't joined yet are
    compared by their maps, inside the join, and those that these don't rule out by their shingles, so no pair is left out;
    those joined already can't change a component.
    """
    often = buckets.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("c1"), F.max("v").alias("c2"), F.expr(f"min(v ^ {_FLIP}L) ^ {_FLIP}L").alias("c3")).where("m > 1")
    often = cut(often, "centres")
    shared = cut(buckets.join(often.select("k", "c1", "c2", "c3"), "k"), "shared")
    discard(buckets)
    star = shared.select("v", F.explode(F.array_distinct(F.array("c1", "c2", "c3"))).alias("c")).where("v <> c")
    first = cut(star.select(F.least("v", "c").alias("a"), F.greatest("v", "c").alias("b")).distinct(), "stars")
    some = cut(sized_join(maps, shared.select("v").distinct(), "v", "left_semi"), "maps")
    pairs = first.join(some.alias("x"), F.col("a") == F.col("x.v")).join(some.alias("y"), F.col("b") == F.col("y.v")).where(_near("x", "y", least))
    found = _verified(cut(pairs.select("a", "b"), "near"), reps, text, least)
    rooted = connected_components(found).toDF("v", "root")
    placed = cut(shared.select("k", "v").join(rooted, "v", "left").withColumn("c", F.coalesce("root", "v")).drop("root"), "placed")
    discard(shared)
    mixed = cut(placed.select("k", "c").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"), "mixed")
    open_ = cut(placed.join(mixed, "k").join(some, "v"), "open")
    meet = open_.alias("x").join(open_.alias("y"), F.expr(f"x.k = y.k and x.v < y.v and x.c <> y.c and {_near('x', 'y', least)}"))
    rest = cut(meet.select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "rest")
    discard(placed)
    discard(open_)
    return connected_components(found.unionByName(_verified(rest, reps, text, least))).toDF("v", "root")


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with one row of each group of near copies: the least key (null after all), of equal keys the least hash of the text.

    Pairs at DISTANCE or fewer bits of their fingerprints meet in ball hashing; similar ones whose fingerprints are farther
    apart meet in minhash bands, but for one in 10,000 at 0.8. All that meet are judged by exact Jaccard, not by their bits.
    Rows are told apart by key and text, null keys included, so of repeated rows one stays, and a row never goes with a
    namesake. Keys may be of any type that has an order. Empty and null texts are one group. A very long text's shingles are
    held by one worker. An empty table gives none. Names of docs that start with _near_ are taken.
    """
    named = _named(docs, key, text)
    signed = cut(_signed(named, text), "signed")
    balls = simhash.meetings(cut(signed.select("v", "fp").distinct(), "prints"), DISTANCE)
    buckets = cut(balls.unionByName(signed.select("v", F.explode("bands").alias("k"))).distinct(), "buckets")
    maps = signed.select("v", "n", *_MAP).dropDuplicates(["v"])
    keys = cut(signed.groupBy(*_ROW, "v").agg(F.count(F.lit(1)).alias("rows")), "keys")
    place = F.struct(*_ROW)
    chosen = keys.groupBy("v").agg(F.min(place).alias("x")).select("v", "x.*")
    reps = cut(named.select(*_ROW, text).join(chosen, _ROW).groupBy("v").agg(F.first(text).alias(text)), "reps")
    roots = cut(links(buckets, maps, reps, text, least), "roots")
    discard(reps)
    discard(signed)
    rooted = keys.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    first = cut(rooted.groupBy("root").agg(F.min(place).alias("first")), "firsts")  # written, so that a large group's rows can be split
    judged = cut(rooted.join(first, "root").select(*_ROW, "rows", (place != F.col("first")).alias("goes")), "judged")
    kept = sized_join(named, cut(judged.where("goes").select(_ROW), "dropped"), _ROW, "left_anti")
    again = cut(judged.where("not goes and rows > 1").select(_ROW), "again")
    if again.isEmpty():
        return kept.drop(*_ROW)
    once = sized_join(kept, again, _ROW, "left_semi").dropDuplicates(_ROW)
    return sized_join(kept, again, _ROW, "left_anti").unionByName(once).drop(*_ROW)
