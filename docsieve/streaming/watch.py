"""A folder that is watched: each trigger lists it, and a change rebuilds the index, newest version first."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators import audit
from docsieve.operators.ledger import Ledger
from docsieve.shared import _path


def manifest(spark: SparkSession, folder: str, exts: tuple) -> DataFrame:
    """(path, length, mtime_ms): content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.unix_millis("modificationTime").alias("mtime_ms")).where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*exts))


def signature(files: DataFrame) -> tuple:
    return tuple(files.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(path, length, mtime_ms))")).first())


class Reindexer:
    """Micro-batches come one after another, so however many changes fall into a pass, one more pass follows it.

    rebuild(should_abort) makes a version; should_abort() tells of a change since. A failure leaves the last version in place
    and the next trigger tries again.
    """

    def __init__(self, spark: SparkSession, folder: str, rebuild: Callable[[Callable[[], bool]], None], exts: tuple = (".md", ".markdown")):
        self.spark, self.folder, self.rebuild, self.exts, self.seen, self.failures = spark, folder, rebuild, exts, None, []

    def step(self, *_: object) -> bool:
        now = signature(manifest(self.spark, self.folder, self.exts))
        if now == self.seen:
            return False
        try:
            self.rebuild(lambda: signature(manifest(self.spark, self.folder, self.exts)) != now)
            self.seen = now
        except Exception as e:  # noqa: BLE001  the watcher must outlive a failed pass
            self.failures.append(str(e))
        return True

    def start(self, checkpoint: str, every: str = "1500 milliseconds"):
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Versions:
    """Tables written under path/<n>; readers take the newest that is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def latest(self) -> str | None:
        fs, at = _path(self.spark, self.path)
        if not fs.exists(at):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [int(n) for n in names if n.isdigit() and fs.exists(_path(self.spark, f"{self.path}/{n}/_DONE")[1])]
        return f"{self.path}/{max(done)}" if done else None

    def write(self, save: Callable[[str], None]) -> str:
        last = self.latest()
        path = f"{self.path}/{int(last.rpartition('/')[2]) + 1 if last else 1}"
        save(path)
        fs, at = _path(self.spark, f"{path}/_DONE")
        fs.create(at, True).close()
        return path


def console_sink(events: list[dict]) -> None:
    for e in events:
        print(json.dumps(e))


def file_sink(path: str) -> Callable[[list[dict]], None]:
    def send(events: list[dict]) -> None:
        with open(path, "a") as f:
            f.writelines(json.dumps(e) + "\n" for e in events)

    return send


def webhook_sink(url: str, post: Callable[[str, bytes], None]) -> Callable[[list[dict]], None]:
    """post(url, body) may fail; alerts go on."""

    def send(events: list[dict]) -> None:
        try:
            post(url, json.dumps({"events": events}).encode())
        except Exception:  # noqa: BLE001
            pass

    return send


class Surveillance:
    """A cycle: findings of now against those of the last snapshot, events of what changed, to every sink and the ledger.

    look() gives (items (kind, item_key), score). The first cycle is silent. Snapshots are versions, so a lost write leaves the last.
    """

    def __init__(self, spark: SparkSession, state: str, look: Callable[[], tuple[DataFrame, int]], sinks: list[Callable], ledger: Ledger | None = None, source: str = "", least_drop: int = 5):
        self.spark, self.state, self.look, self.sinks, self.ledger, self.source, self.least_drop = spark, Versions(spark, state), look, sinks, ledger, source, least_drop

    def cycle(self, *_: object) -> dict:
        items, score = self.look()
        last = self.state.latest()
        before = self.spark.read.parquet(f"{last}/items") if last else items.limit(0)
        old = self.spark.read.parquet(f"{last}/score").first()["score"] if last else None

        def save(path: str) -> None:
            items.write.parquet(f"{path}/items")
            self.spark.createDataFrame([(score,)], "score int").write.parquet(f"{path}/score")

        now = self.spark.read.parquet(f"{self.state.write(save)}/items")
        changes = audit.drift(before, now)
        found = [r.asDict() for r in audit.events(changes, old, score, self.source, self.least_drop).collect()] if old is not None else []
        for sink in self.sinks:
            sink(found)
        out = {"score": score, "score_delta": score - old if old is not None else 0, "events": len(found), "new": changes.where("change = 'new'").count() if old is not None else 0, "resolved": changes.where("change = 'resolved'").count()}
        if self.ledger:
            self.ledger.append("surveillance_cycle", out | {"source": self.source})
        return out | {"fired": found}

    def start(self, checkpoint: str, every: str = "1 hour"):
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(self.cycle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


#: Rows that are sealed at once.
SEALED_ROWS = 500


def sealed(stream: DataFrame, ledger: Ledger, kind: str, checkpoint: str, columns: list[str]):
    """Each micro-batch's rows, in the order of columns, are sealed by the one writer, SEALED_ROWS at a time.

    What of a batch is sealed already, as after a crash, isn't sealed again: the order tells how far it came. The chain is
    sequential, so rows pass through the driver, a partition of them at a time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = ledger.entries().where(F.col("kind") == kind).where(F.get_json_object("payload", "$.batch") == str(batch_id)).count()
        rows = batch.select(*columns).orderBy(*columns).select(F.to_json(F.struct(*columns))).toLocalIterator()
        held: list[tuple] = []
        for i, r in enumerate(rows):
            if i >= done:
                held.append((kind, json.loads(r[0]) | {"batch": batch_id}))
            if len(held) >= SEALED_ROWS:
                ledger.extend(held)
                held = []
        ledger.extend(held)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; works on batches and streams (with a watermark)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def stamp() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
