"""Labelled rows for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.shared import cut, sized_join


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key's text, modulo 5; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def with_label(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", how: str = "left", most: int | None = None) -> DataFrame:
    """(key, _text, _fold, _label): the largest label of a key, or null; rows of fold 0 never have one.

    Keys and labels are broadcast while their count allows, else joined by shuffle. most: only so many labelled keys, the
    first by hash, for a bounded training sample.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key) != 0)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    if most is not None:
        ids = docs.select(key).where(F.col(key).isNotNull() & (fold(key) != 0)).distinct()
        own = own.join(ids, key, "left_semi").orderBy(F.xxhash64(key), key).limit(most)
    base = docs.select(key, F.col(text).cast("string").alias("_text"), F.coalesce(fold(key), F.lit(1)).alias("_fold"))
    return sized_join(base, cut(own, "labels"), key, how)
