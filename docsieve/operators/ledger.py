"""A hash-chained, append-only ledger in JSON lines: sequential to append, parallel to verify."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.functions.canonical import canonical, canonical_json, sha256
from docsieve.operators.citations import recheck
from docsieve.shared import _path, put_file

GENESIS = "0" * 64
ENTRY = "seq bigint, ts string, kind string, prev_hash string, payload string, entry_hash string"


def seal(seq: int, prev_hash: str, kind: str, payload) -> str:
    return sha256(f"{seq}|{prev_hash}|{kind}|{canonical_json(payload)}")


def seal_column(payload: str = "payload") -> Column:
    return F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "prev_hash", "kind", payload), 256)


class Ledger:
    """path is a folder of any Hadoop file system with a file of JSON lines for each append, named by its first seq; ts isn't sealed.

    A file is created once and never rewritten, and its name is taken by the first to ask for it: of two writers one fails, and
    nothing that is sealed is touched again. Only the last file is read to append. A single file of JSON lines at path can be
    read and verified as well, and is the first segment if more is appended.
    """

    def __init__(self, spark: SparkSession, path: str, now: Callable[[], str] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.now = now or (lambda: datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"))

    def last(self) -> dict | None:
        fs, at = _path(self.spark, self.path)
        if not fs.exists(at):
            return None
        if fs.getFileStatus(at).isFile():
            whole = self.path
        else:
            names = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().endswith(".jsonl"))
            if not names:
                return None
            whole = f"{self.path}/{names[-1]}"
        lines = self.spark.read.text(whole).where(F.trim("value") != "").tail(1)
        return json.loads(lines[0].value) if lines else None

    def append(self, kind: str, payload) -> dict:
        return self.extend([(kind, payload)])[0]

    def extend(self, items: list[tuple]) -> list[dict]:
        """Seals items one after another behind the last entry and writes them as one new file."""
        if not items:
            return []
        before = self.last()
        seq, prev, out = (before["seq"] + 1, before["entry_hash"], []) if before else (0, GENESIS, [])
        first = seq
        for kind, payload in items:
            entry = {"seq": seq, "ts": self.now(), "kind": kind, "prev_hash": prev, "payload": payload, "entry_hash": seal(seq, prev, kind, payload)}
            out.append(entry)
            seq, prev = seq + 1, entry["entry_hash"]
        fs, at = _path(self.spark, self.path)
        if fs.exists(at) and fs.getFileStatus(at).isFile():  # becomes the first segment
            aside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.first")
            fs.rename(at, aside)
            fs.mkdirs(at)
            fs.rename(aside, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_segment(0)}"))
        put_file(self.spark, f"{self.path}/{_segment(first)}", "".join(f"{json.dumps(e, ensure_ascii=False)}\n" for e in out), new=True)
        return out

    def entries(self) -> DataFrame:
        return entries(self.spark, self.path)


def _segment(first: int) -> str:
    return f"{first:020}.jsonl"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, seq, ts, kind, prev_hash, payload, entry_hash): line_no is a file's number plus the place in it; payload in canonical JSON.

    Files are read side by side, each by one task. A missing ledger is empty.
    """
    fs, at = _path(spark, path)
    if not fs.exists(at) or (fs.getFileStatus(at).isDirectory() and not len(fs.listStatus(at))):
        return spark.createDataFrame([], f"line_no bigint, {ENTRY}")
    first = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{20})\.jsonl$", 1).try_cast("bigint"), F.lit(0))
    lines = spark.read.text(path, wholetext=True).select(first.alias("first"), F.posexplode(F.split("value", "\n")).alias("at", "v")).where(F.trim("v") != "")
    get = lambda f, t="string": F.get_json_object("v", f"$.{f}").cast(t).alias(f)
    return lines.select((F.col("first") + F.col("at")).alias("line_no"), get("seq", "bigint"), get("ts"), get("kind"), get("prev_hash"), canonical(F.get_json_object("v", "$.payload")).alias("payload"), get("entry_hash"))


def verify(chain: DataFrame, order: str = "line_no", by: list[str] | None = None) -> DataFrame:
    """(by, ok, count, broken_at, reason), a row for each ledger: the first entry whose place, link or seal is wrong.

    Each entry needs only the one before it: the neighbour comes by an equi-join on place, so no task holds a whole chain.
    """
    by = by or []
    own = chain.withColumn("_at", F.col(order).cast("long"))
    before = own.select(*by, (F.col("_at") + 1).alias("_at"), F.col("entry_hash").alias("_prev"))
    rows = own.join(before, [*by, "_at"], "left").withColumn("_prev", F.coalesce("_prev", F.when(F.col("_at") == 0, GENESIS)))
    reason = F.when(~F.col("seq").eqNullSafe(F.col("_at")), "seq out of order").when(~F.col("prev_hash").eqNullSafe(F.col("_prev")), "prev_hash linkage").when(~F.col("entry_hash").eqNullSafe(seal_column()), "entry_hash mismatch")
    bad = rows.withColumn("_why", reason)
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct("_at", "seq", "_why")))
    out = bad.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), first.alias("b"))
    return out.select(*by, F.col("b").isNull().alias("ok"), "count", F.col("b.seq").alias("broken_at"), F.col("b._why").alias("reason"))


def tail(chain: DataFrame, n: int = 1) -> DataFrame:
    return chain.orderBy(F.desc("line_no")).limit(n)


def kind_counts(chain: DataFrame) -> DataFrame:
    return chain.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def rescan(ledger: Ledger, append: bool = False) -> dict:
    """Every sealed answer by today's rules; changed verdicts become corrections, appended only if asked."""
    rows, corrections = [], []
    for e in ledger.entries().where("kind = 'answer_receipt'").orderBy("line_no").toLocalIterator():
        check = recheck(json.loads(e.payload))
        rows.append({"seq": e.seq, "entry_hash": e.entry_hash} | check)
        if check["changed"]:
            corrections.append({"corrects_seq": e.seq, "corrects_entry_hash": e.entry_hash} | {k: v for k, v in check.items() if k != "changed"})
    done = ledger.extend([("receipt_correction", c) for c in corrections]) if append and corrections else []
    return {"rows": rows, "corrections": corrections, "appended": done}
