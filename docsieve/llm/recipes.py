"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.shared import cut, lower_az

#: Bytes of a chunk at least (but for a text's last) and at most.
SHORTEST, LONGEST = 512, 8192
#: Bytes by which chunks end: those that leave 5 on division by 8; of these, the ones inside longer letters.
_ENDING, _INSIDE = ("".join(f"\\x{i:02x}" for i in range(first + 5, last, 8)) for first, last in ((0, 256), (128, 192)))
#: A chunk ends where three such bytes are alike in place: every second one, or the last of three letters of three or four bytes
#: each. In any script that is some one place in 300 to 500.
#: The last byte is looked at first, as one in eight has the others looked at.
BORDER = rf"(?<=[{_ENDING}])(?:(?<=[{_ENDING}].[{_ENDING}]..)|(?<=[{_INSIDE}])(?:(?<=[{_INSIDE}]..[{_INSIDE}]...)|(?<=[{_INSIDE}]...[{_INSIDE}]....)))"


def chunk_pattern(shortest: int = SHORTEST, longest: int = LONGEST, border: str = BORDER) -> str:
    """Matches chunk after chunk: the least length from shortest on that ends at a border or the text's end, else the longest."""
    return rf"(?s).{{{shortest},{longest}}}?(?:{border}|\z)|.{{{longest}}}|.+\z"


def _chunks(text: str, pattern: str) -> Column:
    """Chunks of the text's UTF-8 bytes, each byte as the character of that number."""
    return F.regexp_extract_all(F.decode(F.col(text).cast("binary"), "ISO-8859-1"), F.lit(pattern), F.lit(0))


def _digest(chunk: Column, key_chars: int) -> Column:
    return F.unhex(F.substring(F.sha2(chunk, 256), 1, key_chars))


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str | None = None, key_chars: int = 64) -> DataFrame:
    """(key, text_sha256, recipe): recipe is the ordered list of verified chunk identifiers of the text with A-Z lowered.

    An identifier is the chunk's digest of key_chars hex digits. It is verified by content: distinct chunks, found by their
    whole text, are counted for each digest. Digests of several contents (none, for whole SHA-256 digests in practice) get
    the content's rank appended, at the price of one more pass. Chunk text crosses the network once, each content once for
    each task that reads it; afterwards only identifiers move. Null texts count as empty, whose recipe is an empty list.
    """
    pattern = pattern or chunk_pattern()
    base = docs.select(F.col(key), lower_az(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_n"))
    kinds = base.select(F.explode(_chunks("_n", pattern)).alias("c")).distinct()
    shared = kinds.select(_digest(F.col("c"), key_chars).alias("k")).groupBy("k").count().where("count > 1").select("k")
    shared = cut(shared, "ambiguous")
    sha = F.sha2("_n", 256).alias("text_sha256")
    if shared.isEmpty():
        return base.select(key, sha, F.transform(_chunks("_n", pattern), lambda c: _digest(c, key_chars)).alias("recipe"))
    ranked = kinds.withColumn("k", _digest(F.col("c"), key_chars)).join(shared, "k")
    ranked = cut(ranked.select("k", "c", F.row_number().over(Window.partitionBy("k").orderBy("c")).alias("r")), "ranks")
    rows = cut(base.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = rows.select("_row", F.posexplode(_chunks("_n", pattern)).alias("p", "c")).withColumn("k", _digest(F.col("c"), key_chars))
    parts = parts.join(ranked, ["k", "c"], "left").select("_row", "p", F.expr("concat(k, unhex(lpad(hex(coalesce(r, 0)), 8, '0')))").alias("id"))
    lists = parts.groupBy("_row").agg(F.expr("transform(array_sort(collect_list(struct(p, id))), x -> x.id)").alias("recipe"))
    empty = F.expr("cast(array() as array<binary>)")
    return rows.join(lists, "_row", "left").select(key, sha, F.coalesce("recipe", empty).alias("recipe"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str | None = None, key_chars: int = 64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), a row for each of docs, dropped ones too.

    Documents are equal if their recipes are, so if their texts are identical after lower-casing A-Z only. The largest key of
    a group stays. Rows that repeat a key and a text are marked alike. Null keys never win: a group of nothing else has a
    null keep_id and stays. Groups are counted before they are shuffled, and only groups of several rows are written and joined
    back, by identifier list, where adaptive execution splits the rows of a large one. An empty table gives none; a very long
    text is read whole, as one list of chunks; other columns of docs are left out, whatever their names.
    """
    own = cut(recipes(docs, key, text, pattern, key_chars), "recipes")
    groups = cut(own.groupBy("recipe").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    out = own.join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id"))
    return out.select(key, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(key).eqNullSafe(keep).alias("kept"), "text_sha256")
