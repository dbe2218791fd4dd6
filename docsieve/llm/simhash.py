"""SimHash near-duplicates: fingerprints, meet-in-the-middle ball hashing, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.operators.components import connected_components
from docsieve.shared import cut, sized_join

#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash, unsigned, of UTF-8 text: words by ASCII white space, A-Z lowered, every shingle counted."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i : n + i] for i in range(width)), strict=True))
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    for at in range(0, n, _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", width) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    kept = docs.select(F.col(key), F.col(text).cast("string").cast("binary").alias("_raw"))
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, fp bigint")


def _ball(fp: str, radius: int) -> str:
    """SQL for the array of all values within radius bits of fp; radius 0 or 1."""
    flips = f"transform(sequence(0, 63), i -> {fp} ^ shiftleft(1L, i))"
    return f"concat(array({fp}), {flips})" if radius else f"array({fp})"


def links(reps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links among distinct fingerprints fp whose components are those of all pairs at distance or fewer bits.

    Each emits its ball of half the radius; two at 2 bits or fewer meet in one variant at least. All that meet in a variant
    are within the distance of one another, so a chain through them by value keeps every component, and a variant has 65
    takers at most: no bucket can grow with the data. Pairs are verified by their differing bits.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance: 0, 1 or 2")
    near = reps.select("fp", F.expr(f"explode({_ball('fp', (distance + 1) // 2)})").alias("v"))
    chain = near.select("fp", F.lag("fp").over(Window.partitionBy("v").orderBy("fp")).alias("b"))
    found = chain.where("b is not null and b <> fp").select(F.col("fp").alias("a"), "b").distinct()
    if distance == 1:  # within one bit of a common variant may still be two bits apart
        found = near.alias("x").where("v <> fp").join(reps.select(F.col("fp").alias("v")), "v").select(F.col("fp").alias("a"), F.col("v").alias("b"))
    return found.where(F.expr(f"bit_count(a ^ b) <= {distance}"))


def _block_balls(fp: str, distance: int) -> str:
    """SQL for an array of keys that two fingerprints at distance or fewer bits share one of.

    The bits stand in blocks, one for each three of distance; in one of them two such differ by two bits at most, so the balls
    of one bit around that block's value meet. A key is a value and its block's number.
    """
    n, balls = distance // 3 + 1, []
    for i in range(n):
        low, width = 64 * i // n, 64 * (i + 1) // n - 64 * i // n
        value = f"(shiftrightunsigned({fp}, {low}) & {(1 << width) - 1 if n > 1 else -1}L)"
        ball = f"concat(array({value}), transform(sequence(0, {width - 1}), i -> {value} ^ shiftleft(1L, i)))"
        balls.append(f"transform({ball}, x -> x | {i << width}L)")
    return f"concat({', '.join(balls)})"


def meetings(prints: DataFrame, distance: int) -> DataFrame:
    """(v, k): each key k that balls of two rows of prints (v, fp) share, with all that share it.

    Any two at distance or fewer bits meet in a key at least, and some that are farther apart do. Keys are as long as a block:
    up to a distance of 5, 32 bits or more, so that few meet by chance.
    """
    balls = prints.select("v", F.expr(f"explode({_block_balls('fp', distance)})").alias("k"))
    met = cut(balls.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k"), "met")
    return sized_join(balls, met, "k", "left_semi")


def near_duplicates(docs: DataFrame, distance: int = 2, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): component_id is the least key that links of fingerprints reach, the row's own included.

    Equal fingerprints are one vertex, so exact copies cost nothing more. Rows with a null key take part in links but give
    no component_id. Empty texts share fingerprint zero. Repeated rows stay repeated; an empty table gives none. A very long
    text is hashed whole by one worker, 8 bytes a shingle; other columns of docs are left out, whatever their names.
    """
    fps = cut(fingerprints(docs, width, key, text), "fps")
    reps = cut(fps.groupBy("fp").agg(F.min(key).alias("first")), "reps")
    roots = connected_components(links(reps.select("fp"), distance)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    class_of = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(class_of, "fp").select(key, "fp", "component_id")
