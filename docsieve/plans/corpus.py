"""The documents table seen as a vault: a note and a chunk for each row, with links, dates and tags by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import index as ix
from docsieve.session import table
from docsieve.shared import cut

BASE_MS, DAY_MS = 1_600_000_000_000, 86_400_000


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents; a twentieth of the link targets don't exist."""
    docs = table(spark, sf_dir, "documents")
    ids = docs.agg(F.max("doc_id")).scalar()
    span = F.expr("cast(floor((m + 1) * 21 / 20) as bigint)")
    target = lambda a, b: F.concat(F.lit("doc"), ((F.col("doc_id") * a + b) % F.col("span")).cast("string"))
    rows = docs.withColumn("m", ids).withColumn("span", span).withColumn("words", F.filter(F.split("text", " "), lambda w: w != ""))
    links = F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(target(7, 1), target(3, 2)))
    return rows.select(
        F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("rel"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
        F.array_join(F.slice("words", 1, 6), " ").alias("title"), F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("tags"), links.alias("outlinks"),
        (F.lit(BASE_MS) + F.col("doc_id") * DAY_MS).alias("mtime_ms"), F.col("source").isin("src0", "src1").alias("controlled"), (F.col("doc_id") % 4 != 0).alias("has_frontmatter"), "source",
        F.col("text").contains("###").alias("has_markers"), (F.col("doc_id") % 5 == 0).cast("int").alias("open_tasks"), F.size("words").alias("word_count"), (F.size("words") < 12).alias("stub"), "doc_id", "text",
    )


NOTES_SQL = f"""m as (select cast(floor((max(doc_id) + 1) * 21 / 20) as bigint) span from documents),
w as (select *, list_filter(string_split(text, ' '), lambda x: x <> '') words from documents),
notes as (select source || '/' || lpad(doc_id::varchar, 8, '0') || '.md' rel, 'doc' || doc_id as name, array_to_string(words[1:6], ' ') title, case when doc_id % 7 = 0 then [] else [lang] end tags,
 case when doc_id % 9 = 0 then [] else ['doc' || ((doc_id * 7 + 1) % span), 'doc' || ((doc_id * 3 + 2) % span)] end outlinks, {BASE_MS} + doc_id * {DAY_MS} mtime_ms, source in ('src0', 'src1') controlled, doc_id % 4 <> 0 has_frontmatter,
 contains(text, '###') has_markers, (doc_id % 5 = 0)::int open_tasks, len(words) word_count, len(words) < 12 stub, doc_id, text from w, m),
keys as (select key, max(rel) rel from (select lower(name) as key, rel from notes union all select lower(title), rel from notes) group by key),
links as (select rel src, unnest(outlinks) link from notes),
inb as (select k.rel, count(*) inbound from links join keys k on lower(link) = k.key where src <> k.rel group by k.rel),
full_notes as (select notes.*, coalesce(inbound, 0) inbound from notes left join inb using (rel))"""


def full_notes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = ix.names_of(records)
    return records.join(ix.inbound(records, names), "rel", "left").fillna({"inbound": 0}), names


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings_of(table(spark, sf_dir, "documents"), "doc_id", "text")


#: What an application has built of a folder: queries share it, as they would share an index on disk.
_BUILT: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, terms and statistics of the bare texts, built once an application."""

    def build():
        post = cut(postings(spark, sf_dir), "postings")  # in runs by term, so that a query's terms prune pages
        stats = cut(ix.stats_of(table(spark, sf_dir, "documents").select("doc_id"), post, "doc_id"), "stats")
        return post, cut(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms"), stats

    return _once(spark, sf_dir, "lexical", build)


def index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """An index whose chunks are the documents, chunk_id being doc_id, built once an application."""

    def build():
        texts = notes(spark, sf_dir)
        records, names = full_notes(texts.drop("text"))  # links are counted without the texts, which never move
        kept = cut(records.withColumn("folder", F.col("source")), "notes")
        chunks = texts.select(F.col("doc_id").alias("chunk_id"), "rel", "title", F.lit("").alias("heading"), F.array().cast("array<string>").alias("heading_path"), "tags", "mtime_ms", "controlled", "text")
        post = cut(ix.postings_of(chunks.select("chunk_id", F.concat_ws(" ", "title", "heading", "text").alias("t")), "chunk_id", "t"), "postings")
        terms = cut(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
        return ix.Index(kept, chunks, post, terms, cut(ix.stats_of(chunks.select("chunk_id"), post, "chunk_id"), "stats"), names)

    return _once(spark, sf_dir, "index", build)
