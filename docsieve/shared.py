"""Tables in the folder that the driver and all executors share: lineage cuts that survive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast, and bytes on disk where it's a table that cut() wrote; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a local master (tests), a temporary one that it sets."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='docsieve-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _size(spark: SparkSession, path: str) -> int:
    fs, at = _path(spark, path)
    return fs.getContentSummary(at).getLength()


def file_names(spark: SparkSession, root: str, wanted: str) -> list[tuple[str, int]]:
    """(path, mtime_ms) of files under root whose path matches the regular expression, those in folders with a dot too, which Spark's readers pass over."""
    fs, at = _path(spark, root)
    found, it, pattern = [], fs.listFiles(at, True), re.compile(wanted)
    while it.hasNext():
        f = it.next()
        if pattern.search(f.getPath().toString()):
            found.append((f.getPath().toString(), f.getModificationTime()))
    return found


def put_file(spark: SparkSession, path: str, content: str, new: bool = False) -> None:
    """Writes a small file of any Hadoop file system: beside its place, then renamed over it in one step, so that a crash
    leaves the old file or the new one. new: in place at once, and an error if there is one."""
    fs, at = _path(spark, path)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs.mkdirs(at.getParent())
    fs.setWriteChecksum(False)  # a local file's checksum would outlive what replaces it
    try:
        out = fs.create(at, False) if new else fs.create(jvm.Path(f"{path}.tmp"), True)
        out.write(bytearray(content.encode()))
        out.close()
    finally:
        fs.setWriteChecksum(True)
    if not new:
        over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        over[0] = jvm.Options.Rename.OVERWRITE
        jvm.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(jvm.Path(f"{path}.tmp"), at, over)


def cut(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and returns the reader of what was written; the files go when the application ends."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/docsieve-{uuid.uuid4().hex}-{label}"
    df.write.mode("overwrite").parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._docsieve_path = path
    return out


def cut_in_buckets(df: DataFrame, by: str, label: str) -> DataFrame:
    """cut(), with rows in as many buckets by a column as a shuffle has partitions, so that a join on it moves the other side only."""
    spark, name = df.sparkSession, f"docsieve_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{label}"
    df.write.mode("overwrite").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    out = spark.table(name)
    out._docsieve_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a table that cut() wrote and that no later plan reads."""
    if df is not None and (path := getattr(df, "_docsieve_path", None)):
        fs, at = _path(df.sparkSession, path)
        fs.delete(at, True)


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a wide left side to a narrow written table: by broadcast if its counted rows and its bytes are few enough, else by shuffle."""
    path = getattr(right, "_docsieve_path", None)
    if (not path or _size(right.sparkSession, path) <= BROADCAST_BYTES) and right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only. Where no other character could change, the faster lower() gives the same."""
    other = r"[[\p{Lu}\p{Lt}\p{So}\p{Nl}\p{Cn}]&&[^A-Z]]"
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike(other), slow).otherwise(F.lower(text))
