"""Folders of Markdown and office files, and documents of connectors, as records (see operators.index.RECORD)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import parse
from docsieve.shared import file_names
from docsieve.sources.extract import BINARY, TIMEOUT_MS, extracted

SKIPPED = frozenset("__pycache__ build coverage dist env node_modules out target tmp vendor venv Library".split())
DOCUMENT = "id string, source string, key string, uri string, title string, body string, metadata map<string,string>, tags array<string>, links array<string>, controlled boolean, authority string, version string, updated_at bigint, content_hash string"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, mtime_ms, content), a file at a time."""
    from pyarrow import fs

    for batch in batches:
        for i in range(len(batch)):
            path = batch.column(0)[i].as_py()
            system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
            with system.open_input_stream(at) as f:
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([f.read()], pa.binary())], ["path", "mtime_ms", "content"])


def scan(spark: SparkSession, folder: str, exts: tuple = (".md", ".markdown")) -> DataFrame:
    """(rel, name, ext, mtime_ms, content) of files by extension in any case; hidden and build folders are left out by path.

    Spark's own file listing skips names that start with an underscore: those are listed apart and opened by the tasks, on file
    systems that pyarrow opens by their URI.
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "content")
    if more := file_names(spark, root, r"/_"):
        ends = tuple(e.lower() for e in exts)
        inside = [(p, t) for p, t in more if p.lower().endswith(ends) and "/_" in p[len(p) - len(p.split(root.split("://")[-1], 1)[-1]) :]]
        if inside:
            listed = spark.createDataFrame(inside, "path string, mtime_ms bigint").repartition("path")
            files = files.unionByName(listed.mapInArrow(_opened, "path string, mtime_ms bigint, content binary").select("path", F.timestamp_millis("mtime_ms").alias("modificationTime"), "content"))
    bare = root.split("://")[-1] if "://" in root else root
    rel = F.regexp_replace(F.expr(f"substr(path, instr(path, '{bare}') + {len(bare)} + 1)"), "^/", "")
    rows = files.select(rel.alias("rel"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    rows = rows.withColumn("ext", F.lower(F.regexp_extract("rel", r"(\.[^./]+)$", 1))).where(F.col("ext").isin(*exts))
    parts = F.split("rel", "/")
    rows = rows.where(~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED)))
    return rows.withColumn("name", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", ""))


def folder_of(rel: Column) -> Column:
    return F.when(F.instr(rel, "/") > 0, F.substring_index(rel, "/", 1)).otherwise("")


def parsed(files: DataFrame, folders: tuple = ()) -> DataFrame:
    """Records of files (rel, name, mtime_ms, content string)."""
    body = F.col("content")
    fm, rest = parse.front_matter(body)
    rows = files.withColumn("fm", fm).withColumn("body", rest)
    return rows.select(
        "rel", "name", parse.title_of(F.col("fm"), F.col("body"), F.col("name")).alias("title"), "body", parse.tags_of(body, F.col("fm")["tags"]).alias("tags"), parse.links_of(body).alias("outlinks"), "mtime_ms",
        parse.controlled_of(F.col("fm"), folder_of(F.col("rel")), folders).alias("controlled"), F.col("fm")["authority"].alias("authority"), F.lit("filesystem").alias("source"), (F.size("fm") > 0).alias("has_frontmatter"),
    )


def records(spark: SparkSession, folder: str, exts: tuple = (".md", ".markdown", ".txt"), folders: tuple = (), timeout_ms: int = TIMEOUT_MS, fn: Callable | None = None, ocr: Callable | None = None) -> DataFrame:
    """Text files parsed; office files extracted, or present by their name with the reason. timed_out marks those that took too long."""
    files = scan(spark, folder, exts)
    text = parsed(files.where(~F.col("ext").isin(*BINARY)).withColumn("content", F.decode("content", "UTF-8")), folders).withColumn("timed_out", F.lit(False))
    if not set(exts) & set(BINARY):
        return text
    got = extracted(files.where(F.col("ext").isin(*BINARY)), timeout_ms, *([fn] if fn else []), ocr=ocr)
    missing = F.concat(F.lit("["), F.upper(F.substring("ext", 2, 9)), F.lit(" document — text not extractable: "), F.col("note"), F.lit(". Findable by filename.]"))
    none = F.array().cast("array<string>")
    other = got.select(
        "rel", "name", F.col("name").alias("title"), F.when(F.col("ok"), F.col("text")).otherwise(missing).alias("body"), none.alias("tags"), none.alias("outlinks"), "mtime_ms",
        (folder_of(F.col("rel")).isin(*folders) if folders else F.lit(False)).alias("controlled"), F.lit(None).cast("string").alias("authority"), F.lit("filesystem").alias("source"), F.lit(False).alias("has_frontmatter"), "timed_out",
    )
    return text.unionByName(other)


def documents(rows: DataFrame, source: str, now_ms: int) -> DataFrame:
    """Documents with defaults: key or uri or title; title or key or Untitled; empty lists; a content hash. Columns that rows lack are null."""
    kinds = dict(x.strip().split(" ", 1) for x in DOCUMENT.split(", "))
    has = lambda c: F.col(c).cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c])
    full = lambda c: F.when(has(c) != "", has(c))
    key = F.coalesce(has("key"), has("uri"), has("title"), F.lit(""))
    none = F.array().cast("array<string>")
    src = F.coalesce(full("source"), F.lit(source))
    return rows.select(
        F.concat(src, F.lit(":"), key).alias("id"), src.alias("source"), key.alias("key"), full("uri").alias("uri"), parse.trimmed(F.coalesce(full("title"), F.when(key != "", key), F.lit("Untitled"))).alias("title"),
        F.coalesce(has("body"), F.lit("")).alias("body"), F.coalesce(has("metadata"), F.create_map().cast(kinds["metadata"])).alias("metadata"), F.coalesce(has("tags"), none).alias("tags"), F.coalesce(has("links"), none).alias("links"),
        F.coalesce(has("controlled"), F.lit(False)).alias("controlled"), has("authority").alias("authority"), has("version").alias("version"), F.coalesce(has("updated_at"), F.lit(now_ms)).alias("updated_at"), F.sha2(F.coalesce(has("body"), F.lit("")), 256).alias("content_hash"),
    )


def document_records(docs: DataFrame) -> DataFrame:
    """Records of documents; a connector's tags and links first, then those in the text."""
    rel = F.when(F.col("key") != "", F.col("key")).otherwise(F.col("id"))
    base = F.regexp_replace(F.element_at(F.split(rel, r"[/\\]"), -1), r"\.[^.]+$", "")
    return docs.select(
        rel.alias("rel"), F.when(F.col("key").rlike(r"[./\\]"), base).otherwise(F.col("title")).alias("name"), "title", "body", F.array_union(F.transform("tags", F.lower), parse.tags_of(F.col("body"), F.lit(""))).alias("tags"),
        F.array_union("links", parse.links_of(F.col("body"))).alias("outlinks"), F.col("updated_at").alias("mtime_ms"), "controlled", "authority", "source", (F.size("metadata") > 0).alias("has_frontmatter"),
    )


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents of after that are new or whose content hash differs."""
    old = before.select("id", F.col("content_hash").alias("_h"))
    return after.join(old, "id", "left").where(~F.col("_h").eqNullSafe(F.col("content_hash"))).drop("_h")


def stale_copies(source: DataFrame, target: DataFrame) -> DataFrame:
    """(rel, name) of source (rel, mtime_ms) to copy: target (name, mtime_ms) has them not, or older. Folders become __ in a name."""
    named = source.withColumn("name", F.replace("rel", F.lit("/"), F.lit("__")))
    return named.join(target.select("name", F.col("mtime_ms").alias("_m")), "name", "left").where("_m is null or _m < mtime_ms").select("rel", "name")


def mirror(spark: SparkSession, source: str, target: str) -> int:
    """Copies the Markdown files under source that target lacks or has older, secrets masked, folders as __ in the name; how many."""
    from docsieve.operators.masking import masked
    from docsieve.shared import _path, put_file

    files = lambda d: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").load(d)
    root, out = source.rstrip("/"), target.rstrip("/")
    fs, at = _path(spark, out)
    fs.mkdirs(at)
    rel = F.regexp_replace(F.substring_index("path", root.split("://")[-1] + "/", -1), "^/+", "")
    own = files(root).select(rel.alias("rel"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    there = files(out).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_millis("modificationTime").alias("mtime_ms"))
    todo, n = own.join(stale_copies(own.select("rel", "mtime_ms"), there), "rel").select("name", masked(F.decode("content", "UTF-8")).alias("text")), 0
    for r in todo.toLocalIterator():
        put_file(spark, f"{out}/{r.name}", r.text)
        n += 1
    return n


class Connectors:
    """Factories of connectors by name; a connector has documents() -> DataFrame and healthcheck() -> dict."""

    def __init__(self):
        self._made: dict[str, Callable] = {}

    def register(self, name: str, factory: Callable) -> None:
        self._made[name] = factory

    def names(self) -> list[str]:
        return sorted(self._made)

    def get(self, name: str, **config):
        if name not in self._made:
            raise KeyError(f"no connector {name}; there are {', '.join(self.names())}")
        made = self._made[name](**config)
        for method in ("documents", "healthcheck"):
            if not callable(getattr(made, method, None)):
                raise TypeError(f"connector {name} lacks {method}()")
        return made


class FolderConnector:
    def __init__(self, spark: SparkSession, folder: str, exts: tuple = (".md", ".markdown", ".txt"), folders: tuple = (), now_ms: int = 0):
        self.spark, self.folder, self.exts, self.folders, self.now_ms = spark, folder, exts, folders, now_ms

    def documents(self) -> DataFrame:
        r = records(self.spark, self.folder, self.exts, self.folders)
        kept = r.select(F.col("rel").alias("key"), F.concat(F.lit("file://"), "rel").alias("uri"), "title", "body", "tags", F.col("outlinks").alias("links"), "controlled", "authority", F.col("mtime_ms").alias("updated_at"), F.create_map(F.lit("name"), "name").alias("metadata"))
        return documents(kept, "filesystem", self.now_ms)

    def healthcheck(self) -> dict:
        try:
            return {"ok": True, "detail": f"{scan(self.spark, self.folder, self.exts).count()} files"}
        except Exception as e:  # noqa: BLE001
            return {"ok": False, "detail": str(e)[:200]}
