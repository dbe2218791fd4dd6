"""Secret scans over a content-addressed ledger of blob and rule-version pairs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.shared import _path, sized_join

_SPAN = "array<struct<kind:string,start:long,stop:long>>"


@dataclass(frozen=True)
class Rules:
    """What is looked for: (kind, marks, pattern, group, least) in the order in which spans at one start are listed.

    A text without any of the marks, in either case, isn't matched; a match counts if its group has least characters. The
    version is a digest of all of it, so a ledger never takes findings of other rules for those of these.
    """

    kinds: tuple[tuple[str, tuple[str, ...], str, int, int], ...]

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self.kinds).encode()).hexdigest()[:16]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(k[0] for k in self.kinds)


#: access and hex take whole runs, so their least length can stand in the pattern; a short value of assign uses up its match.
RULES = Rules((
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", ("akia",), r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", (), r"[0-9a-f]{24,}", 0, 24),
    ("github", ("gh",), r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", ("eyj",), r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("pem", ("-----begin ",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
))
#: The first three are the base.
KINDS = RULES.names


@lru_cache(maxsize=8)
def _patterns(rules: Rules) -> list:
    return [(n, name, marks, re.compile(pattern, re.A), group, least) for n, (name, marks, pattern, group, least) in enumerate(rules.kinds)]


def find(text: str, rules: Rules = RULES) -> list[tuple[str, int, int]]:
    """Spans (kind, start, stop) in code points by start, then kind; of each kind leftmost and without overlap. Word ends are ASCII's."""
    out, low = [], text.lower()
    for n, kind, marks, pattern, group, least in _patterns(rules):
        if not marks or any(m in low for m in marks):
            out += [(m.start(), n, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, stop) for start, _, kind, stop in sorted(out)]


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, z): each content once in a task, compressed for the way to where it is scanned."""
    import zstandard

    seen, press = set(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs, out = [], []
        for blob, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if blob not in seen:
                seen.add(blob)
                blobs.append(blob)
                out.append(press.compress(raw.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(out, pa.binary())], ["blob", "z"])


def _scan(rules: Rules):
    """A mapper to (blob, spans): all copies of a blob are in one task, which scans the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        seen, unpress = set(), zstandard.ZstdDecompressor()
        for batch in batches:
            blobs, out = [], []
            for blob, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if blob not in seen:
                    seen.add(blob)
                    blobs.append(blob)
                    text = unpress.decompress(z.as_py()).decode("utf-8", "replace")
                    out.append([dict(zip(("kind", "start", "stop"), x, strict=True)) for x in find(text, rules)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(out, kind)], ["blob", "spans"])

    return run


class BlobLedger:
    """A Parquet table (blob, rules, spans) of every scanned blob, by rule version, findings or not."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, rules: Rules = RULES) -> DataFrame:
        schema = f"blob binary, spans {_SPAN}, rules string"
        fs, at = _path(self.spark, self.path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).where(F.col("rules") == rules.version)

    def scan(self, versions: DataFrame, text: str = "text", rules: Rules = RULES) -> None:
        """Scans the blobs of versions that the ledger lacks under this rule version, and adds them.

        Unseen blobs are found by digest; only their content moves, once for each task that reads it, compressed. A scan
        that dies adds nothing and is done again by the next.
        """
        content = addressed(versions, text)
        known = self.rows(rules)
        if not known.isEmpty():
            fresh = content.select("blob").distinct().join(known.select("blob"), "blob", "left_anti")
            content = sized_join(content, fresh, "blob", "left_semi")
        blobs = content.select("blob", "_raw").mapInArrow(_content, "blob binary, z binary").repartition("blob")
        found = blobs.mapInArrow(_scan(rules), f"blob binary, spans {_SPAN}")
        found.withColumn("rules", F.lit(rules.version)).write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
        """versions with blob and spans (in place of columns so named), an empty list where nothing was found; the text goes.

        Only blobs with findings are joined back.
        """
        hits = self.rows(rules).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
        out = addressed(versions.drop("spans"), text).drop("_raw").join(hits, "blob", "left")
        return out.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {_SPAN})")))


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """versions with blob, the SHA-256 of the content (null: empty), and _raw in place of the text."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return versions.withColumn("_raw", raw).withColumn("blob", F.unhex(F.sha2("_raw", 256))).drop(text)


def listed(spans: str, kinds: tuple = KINDS) -> Column:
    """kind:start:stop of the spans of these kinds, comma-joined."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan_documents(docs: DataFrame, ledger_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, spans): findings of every row, each distinct text scanned once under the rule version, now or in an earlier run.

    Null texts count as empty; repeated rows stay repeated, null keys too; an empty table gives none; other columns are left
    out, whatever their names. A very long text is held whole, compressed on its way and plain in the worker that scans it.
    """
    ledger = BlobLedger(docs.sparkSession, ledger_path)
    versions = docs.select(key, F.col(text).alias("_text"))
    ledger.scan(versions, "_text")
    return ledger.findings(versions, "_text")
