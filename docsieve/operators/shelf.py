"""What is kept beside the notes: the shelf of cards, the access log, and the bundle an auditor asks for."""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.operators.ledger import Ledger, verify
from docsieve.shared import _path, put_file

#: Records of the access log that are shown.
SHOWN = 500
ATTESTATION = "Answers and reports are entries of a hash-sealed chain; verifying it recomputes every seal, so a later edit shows."


def slug(name: str) -> str:
    """As text.slugify() gives for a column."""
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", name.lower()))[:60] or "entity"


def put_card(spark: SparkSession, vault: str, entity: str, markdown: str, ledger: Ledger | None = None, **about) -> str:
    """Writes a card to the vault's shelf and seals its receipt; its place in the vault. A card of the same name is replaced."""
    rel = f"cards/{slug(entity)}.md"
    put_file(spark, f"{vault.rstrip('/')}/{rel}", markdown)
    if ledger:
        ledger.append("card_receipt", {"entity": entity, **about})
    return rel


def shelf(spark: SparkSession, vault: str) -> DataFrame:
    """(file, entity, type, generated, facts_verified, facts_dropped, receipt) of the cards in the vault; no folder, no cards.

    Only the front matter's lines count. A card without an entity is named by its file.
    """
    folder = f"{vault.rstrip('/')}/cards"
    fs, at = _path(spark, folder)
    if not fs.exists(at):
        return spark.createDataFrame([], "file string, entity string, type string, generated string, facts_verified bigint, facts_dropped bigint, receipt string")
    cards = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("name"), "value")
    grab = lambda k: F.regexp_extract("value", rf"(?m)^{k}: (.*)$", 1)
    base = F.regexp_replace("name", r"\.md$", "")
    entity = F.get_json_object(F.concat(F.lit('{"e":'), grab("entity"), F.lit("}")), "$.e")
    number = lambda k: F.coalesce(grab(k).try_cast("bigint"), F.lit(0)).cast("bigint")
    return cards.select(F.concat(F.lit("cards/"), "name").alias("file"), F.coalesce(F.nullif(entity, F.lit("")), base).alias("entity"), *(grab(k).alias(k) for k in ("type", "generated")), *(number(k).alias(k) for k in ("facts_verified", "facts_dropped")), grab("receipt").alias("receipt"))


def log_access(spark: SparkSession, path: str, records: list[dict]) -> None:
    """Adds records of who did what, as one new file of JSON lines, which no writer shares."""
    at = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
    put_file(spark, f"{path.rstrip('/')}/{at}-{uuid.uuid4().hex}.jsonl", "".join(f"{json.dumps(r, ensure_ascii=False)}\n" for r in records), new=True)


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record): every record that is JSON, in order of file and line."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], "file string, line int, record string")
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "record"))
    return lines.where(F.trim("record") != "").where(F.try_parse_json("record").isNotNull())


def latest_access(spark: SparkSession, path: str, shown: int = SHOWN) -> dict:
    """{count, records}: how many there are, and the last of them, the newest first."""
    log = access_log(spark, path)
    rows = log.orderBy(F.desc("file"), F.desc("line")).limit(shown).collect()
    return {"count": log.count(), "records": [json.loads(r.record) for r in rows]}


def compliance_export(report: dict, ledger: Ledger, folder: str, at: str | None = None) -> dict:
    """The bundle: the report's posture, the chain's verification and an attestation. Entries are written to folder, as many as there are.

    The chain may be long, so the bundle names the folder with its entries (JSON lines, in parts by the order of seq).
    """
    chain = ledger.entries()
    checked = verify(chain).first()
    verification = checked.asDict() if checked else {"ok": True, "count": 0, "broken_at": None, "reason": None}
    chain.sort("seq").write.mode("overwrite").json(f"{folder.rstrip('/')}/entries")
    bundle = {
        "generated_at": at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "vault": report.get("vault"),
        "integrity": {"score": report["integrity_score"], "grade": report["grade"], "report_sha256": report["report_sha256"], "controlled_coverage": report["controlled_coverage"], "findings": [{"key": f["key"], "count": f["count"]} for f in report["findings"]]},
        "ledger": {"verification": verification, "entries": "entries"}, "attestation": ATTESTATION,
    }
    put_file(ledger.spark, f"{folder.rstrip('/')}/bundle.json", json.dumps(bundle, ensure_ascii=False, indent=1))
    return bundle


def titleized(name):
    """A name's words in capitals, without its extension: a Column of a Column."""
    words = F.regexp_replace(F.regexp_replace(name, "[-_]", " "), r"(?i)\.[a-z]+$", "")
    parts = F.regexp_extract_all(words, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    first = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[A-Za-z0-9_]"), first(p)).otherwise(p)), "")
