"""Small vaults as records."""

from pyspark.sql import functions as F

from docsieve.operators import index as ix
from docsieve.sources import vault

DAY = 86_400_000
NOW = 1_700_000_000_000


def records(spark, files: dict, folders=(), mtimes=None):
    rows = [(rel, rel.rsplit("/", 1)[-1].rsplit(".", 1)[0], (mtimes or {}).get(rel, NOW), text) for rel, text in files.items()]
    return vault.parsed(spark.createDataFrame(rows, "rel string, name string, mtime_ms long, content string"), folders)


def build(spark, files: dict, **options):
    return ix.build(records(spark, files, **options))


def by(df, key):
    return {r[key]: r for r in df.collect()}


__all__ = ["DAY", "NOW", "F", "build", "by", "records"]
