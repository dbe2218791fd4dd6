"""Notes, chunks, postings and statistics of a corpus, as tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.functions import parse
from docsieve.functions.ids import dense_ids
from docsieve.functions.text import term_counts
from docsieve.shared import cut

RECORD = "rel string, name string, title string, body string, tags array<string>, outlinks array<string>, mtime_ms bigint, controlled boolean, authority string, source string, has_frontmatter boolean"


@dataclass
class Index:
    """notes(rel, title, ... inbound), chunks(chunk_id, rel, ... text), postings(term, chunk_id, tf, len), terms(term, df), stats(n, avg_len), names(key, rel)."""

    notes: DataFrame
    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    names: DataFrame

    def write(self, path: str) -> None:
        """Postings are sorted by term, so that a query's terms prune row groups."""
        for f in fields(self):
            df = getattr(self, f.name)
            (df.sortWithinPartitions("term") if f.name == "postings" else df).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


def names_of(records: DataFrame) -> DataFrame:
    """(key, rel): lower-cased names and titles; of equal ones the last in the order of rel, its title after its name."""
    both = records.select(F.lower("name").alias("key"), "rel", F.lit(0).alias("kind")).unionAll(records.select(F.lower("title"), "rel", F.lit(1)))
    return both.where("key is not null").groupBy("key").agg(F.max(F.struct("rel", "kind"))["rel"].alias("rel"))


def inbound(records: DataFrame, names: DataFrame) -> DataFrame:
    """(rel, inbound): links from other notes; two spellings of one target count twice."""
    links = records.select(F.col("rel").alias("src"), F.explode("outlinks").alias("target"))
    hit = links.join(names, F.lower("target") == F.col("key")).where("src <> rel")
    return hit.groupBy("rel").agg(F.count(F.lit(1)).alias("inbound"))


def postings_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, len), counted where the text is. Only texts whose key isn't theirs alone move, to be counted as one."""
    twice = cut(texts.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "shared-keys")
    if twice.isEmpty():
        return term_counts(texts, key, text)
    of = lambda how: term_counts(texts.join(twice, F.col(key).eqNullSafe(F.col("_key")), how), key, text)
    several = of("left_semi").groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return of("left_anti").unionByName(several.withColumn("len", F.sum("tf").over(Window.partitionBy(key))))


def build(records: DataFrame, folder_depth: int = 1) -> Index:
    """All tables from records (see RECORD). Every note has a chunk at least; chunk ids are dense in the order of rel, then place."""
    metrics = parse.metrics(F.coalesce("body", F.lit("")))
    names = cut(names_of(records), "names")
    folder = F.when(F.instr("rel", "/") > 0, F.regexp_extract("rel", rf"^((?:[^/]+/){{0,{folder_depth - 1}}}[^/]+)/", 1)).otherwise("")
    notes = records.withColumns(metrics | {"folder": folder}).drop("body").join(inbound(records, names), "rel", "left")
    notes = cut(notes.withColumn("inbound", F.coalesce("inbound", F.lit(0))), "notes")
    parts = parse.chunks(records.select("rel", "title", "tags", "mtime_ms", "controlled", "body"))
    chunks = cut(dense_ids(parts, ["rel", "pos"], "chunk_id"), "chunks")
    postings = cut(postings_of(chunks.select("chunk_id", F.concat_ws(" ", "title", "heading", "text").alias("t")), "chunk_id", "t"), "postings")
    terms = cut(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    return Index(notes, chunks, postings, terms, stats_of(chunks.select("chunk_id"), postings, "chunk_id"), names)


def stats_of(keys: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """One row (n, avg_len); texts without a token count with length 0."""
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t"))
    n = keys.agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", (total.scalar() / F.greatest("n", F.lit(1))).alias("avg_len"))
