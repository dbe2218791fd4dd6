"""Session logs, chat exports and agent turn logs as transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.shared import file_names

TURNS = "id string, date string, title string, n_turns int, body string"


def _joined(turns: DataFrame, key: str, order: list[str]) -> Column:
    """Turns in order as **role:** text paragraphs."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "role", "text")))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("**"), r["role"], F.lit(":** "), r["text"])), "\n\n")


def transcripts(turns: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """(key, n_turns, body) of turns (key, role, text and what orders them); empty and interrupted turns are left out."""
    order = order or ["turn"]
    kept = turns.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~F.col("text").startswith("[Request interrupted"))
    return kept.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_turns"), _joined(kept, key, order).alias("body"))


def since(rows: DataFrame, date: str | None, column: str = "date") -> DataFrame:
    return rows if date is None else rows.where(F.col(column) >= date)


def session_logs(spark: SparkSession, path: str) -> DataFrame:
    """(id, date, title, n_turns, body) of JSON lines with timestamp and message {role, content}; content is text or blocks of text."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.posexplode(F.split("value", "\n")).alias("line", "v"))
    get = lambda p: F.get_json_object("v", p)
    blocks = F.from_json(get("$.message.content"), "array<struct<type:string,text:string>>")
    text = F.when(get("$.message.content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n\n")).otherwise(get("$.message.content"))
    name = F.regexp_extract("f", r"([^/]+)\.jsonl$", 1)
    rows = lines.select(name.alias("id"), "line", get("$.timestamp").alias("ts"), get("$.message.role").alias("role"), text.alias("text")).where(F.col("role").isin("user", "assistant"))
    said = rows.where((F.col("role") == "user") & ~F.col("text").rlike(r"^[<\[]") & (F.trim("text") != ""))
    title = said.groupBy("id").agg(F.min(F.struct("line", "text"))["text"].alias("t")).select("id", F.substring(F.regexp_replace("t", r"\s+", " "), 1, 90).alias("title"))
    date = rows.groupBy("id").agg(F.substring(F.min_by("ts", "line"), 1, 10).alias("date"))
    return transcripts(rows, "id", ["line"]).join(date, "id").join(title, "id", "left").select("id", "date", "title", "n_turns", "body")


def chat_exports(spark: SparkSession, path: str) -> DataFrame:
    """The same of arrays of conversations whose mapping holds messages, by their time of creation."""
    part = "struct<create_time:double,author:struct<role:string>,content:struct<parts:array<string>,text:string>>"
    schema = f"id string, conversation_id string, title string, create_time double, mapping map<string,struct<message:{part}>>"
    each = spark.read.schema(schema).json(path, multiLine=True).withColumn("id", F.coalesce("id", "conversation_id"))
    rows = each.select("id", "title", F.col("create_time").alias("t0"), F.posexplode(F.map_values("mapping")).alias("node", "m")).select("id", "title", "t0", "node", "m.message.*").where(F.col("author.role").isin("user", "assistant"))
    strings = F.filter(F.coalesce("content.parts", F.array().cast("array<string>")), lambda p: (p != "") & ~p.startswith("{"))
    turns = rows.select("id", "title", "t0", F.coalesce("create_time", F.lit(0.0)).alias("time"), "node", F.col("author.role").alias("role"), F.when(F.size(strings) > 0, F.array_join(strings, "\n")).otherwise(F.col("content.text")).alias("text"))
    about = turns.groupBy("id").agg(F.first("title").alias("title"), F.date_format(F.timestamp_millis((F.first("t0") * 1000).cast("long")), "yyyy-MM-dd").alias("date"))
    return transcripts(turns, "id", ["time", "node"]).join(about, "id").select("id", "date", "title", "n_turns", "body")


def turn_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, ts, role, text) of agents' JSON lines, whose fields go by several names."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "v"))
    first = lambda *names: F.coalesce(*(F.get_json_object("v", f"$.{n}") for n in names))
    text = F.coalesce(first("text", "response_text", "message", "content"), F.substring(F.get_json_object("v", "$.payload"), 1, 400))
    return lines.select("file", "line", first("timestamp", "ts", "created_at").alias("ts"), first("role", "kind", "type").alias("role"), text.alias("text")).where("text is not null")


def owned(sessions: DataFrame, notes: DataFrame) -> DataFrame:
    """sessions with note: the first existing note (by name) of notes (id, note), or null."""
    first = notes.groupBy("id").agg(F.min("note").alias("note"))
    return sessions.join(first, "id", "left")


#: Agents' logs: JSON lines named by turns, or below a folder with a dot. Other names by parameter.
TURN_LOGS = r"turn[^/]*\.jsonl$|/\.[^/]+/.*\.jsonl$"


def turn_log_files(spark: SparkSession, root: str, wanted: str = TURN_LOGS) -> DataFrame:
    """(path, project, name, mtime_ms) of agents' logs under root, all of them, however many; the project is the first folder below root."""
    found = file_names(spark, root, wanted)
    files = spark.createDataFrame(found, "path string, mtime_ms bigint")
    parts = F.split(F.regexp_replace(F.substring_index("path", root.split("://")[-1].rstrip("/") + "/", -1), "^/+", ""), "/")
    return files.select("path", F.element_at(parts, 1).alias("project"), F.element_at(parts, -1).alias("name"), "mtime_ms")


def turn_notes(spark: SparkSession, root: str, wanted: str = TURN_LOGS) -> DataFrame:
    """(note, body) of each agent's log with something said: a note's name is project__slug of the file, secrets are masked."""
    from docsieve.functions.text import slugify
    from docsieve.operators.masking import masked

    files = turn_log_files(spark, root, wanted)
    paths = [r.path for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "note string, body string")
    said = turn_logs(spark, paths).where("text <> ''")
    when = F.when(F.coalesce("ts", F.lit("")) == "", "").otherwise(F.concat(F.lit("("), F.substring("ts", 1, 19), F.lit(")")))
    line = F.concat(F.lit("**"), F.coalesce("role", F.lit("entry")), F.lit("** "), when, F.lit(": "), F.col("text"))
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  sources differ in how they write a place
    files = files.withColumn("path", plain("path"))
    lines = said.select(plain("file").alias("path"), "line", line.alias("v")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "v"))), lambda x: x["v"]), "\n\n").alias("lines"))
    body = F.concat(F.lit("# "), "project", F.lit(" — "), "name", F.lit("\n\n*Agent turn-log*\n\n---\n\n"), "lines")
    note = F.concat("project", F.lit("__"), slugify(F.regexp_replace("name", r"\.jsonl$", "")), F.lit(".md"))
    return files.join(lines, "path").select(note.alias("note"), masked(body).alias("body"))


def put_notes(notes: DataFrame, folder: str) -> int:
    """Writes notes (note, body) that folder lacks or has otherwise, each in one step; how many. Unchanged ones aren't touched.

    Tasks compare; the driver puts what is new in place, one partition of it at a time.
    """
    from docsieve.shared import _path, put_file

    spark, root = notes.sparkSession, folder.rstrip("/")
    fs, at = _path(spark, root)
    fs.mkdirs(at)
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(root).select(F.element_at(F.split("path", "/"), -1).alias("note"), F.decode("content", "UTF-8").alias("_old"))
    new, n = notes.join(there, "note", "left").where(~F.col("_old").eqNullSafe(F.col("body"))).select("note", "body"), 0
    for r in new.toLocalIterator():
        put_file(spark, f"{root}/{r.note}", r.body)
        n += 1
    return n
