"""Line dedup: repeated runs of lines by distributed prefix doubling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.shared import cut, discard

#: Words of a repeated run at least, for its later copies to go.
LEAST_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]"
_SPACE = " \t\n\x0b\x0c\r"
#: Where lines part. Behind a line's end; and at seams, where something was put into running text: before a capital after a
#: word in lower case, or after a sentence's first word, that ends no sentence; before lower case after the end of a sentence,
#: of several words if the last of them has no capital; at the bars of a table's cells. A seam has one space or tab, and the
#: word before it 62 characters at most.
#: Looks back over one or two characters come first, as those over a word are dear.
SEAM = (
    r"(?<=[\n \t])(?:(?<=\n)|(?<=[^ \t\n.!?][ \t])(?=\p{Lu})(?:(?<=[ \t\n]\p{Ll}[^ \t\n]{0,61}[ \t])|(?<=[.!?][ \t\n]\p{Lu}[^ \t\n]{0,61}[ \t])|(?<=[ \t\n]\|[ \t]))"
    r"|(?<=[.!?][ \t])(?=[\p{Ll}|])(?:(?<=[^ \t\n.!?][ \t\n][^ \t\n]{0,60}[.!?][ \t])|(?<=[ \t\n]\p{Lu}[^ \t\n]{0,59}[.!?][ \t])))"
)
_DOC = ["z", "d", "t"]
_PLACE = [*_DOC, "seq"]


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[Column, Column, Column]:
    """Whether there is a key (those without come first), the key, and the text's hash: rows equal in all are one document."""
    return F.col(key).isNotNull(), F.coalesce(F.col(key), F.lit("0").cast(docs.schema[key].dataType)), F.xxhash64(F.col(text).cast("string"))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(z, d, t, seq, words, h1, h2): the lines that have words, numbered within their document, by a digest of 128 bits."""
    found = F.filter(F.split("_text", SEAM), lambda x: x.rlike(_WORD))
    each = docs.select(*(c.alias(n) for c, n in zip(_keyed(docs, key, text), _DOC, strict=True)), F.col(text).cast("string").alias("_text"))
    each = each.select(*_DOC, F.posexplode(found).alias("seq", "line")).withColumn("line", F.btrim("line", F.lit(_SPACE)))
    words = F.regexp_count("line", F.lit(f"{_WORD}+"))
    return each.select(*_PLACE, words.alias("words"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def _ranked(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """by and r of what is there more than once: r rises in the order of by. Only sums meet, and one global sort of them."""
    often = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(by)
    return cut(often.orderBy(by).withColumn("r", F.monotonically_increasing_id()), label)


def _windows(active: DataFrame, least: int) -> DataFrame:
    """(z, d, t, s, m): from each line on, and up to each line, the fewest lines in a row that have least words, all of them active.

    Together they cover exactly all runs of active lines with least words. As a line has a word at least, m is bounded.
    """
    order = Window.partitionBy(_DOC).orderBy("seq")
    rows = F.collect_list(F.struct("seq", "words"))
    fewest = "aggregate({0}, struct(0 as n, 0 as w, 0 as m), (a, x) -> if(a.m <> 0, a, if(x.seq = seq {1} a.n, struct(a.n + 1 as n, a.w + x.words as w, if(a.w + x.words >= {2}, a.n + 1, 0) as m), struct(a.n as n, a.w as w, -1 as m))), a -> a.m)"
    both = active.select(*_PLACE, rows.over(order.rowsBetween(0, least - 1)).alias("on"), rows.over(order.rowsBetween(1 - least, 0)).alias("back"))
    both = both.select(*_PLACE, F.expr(fewest.format("on", "+", least)).alias("a"), F.expr(fewest.format("reverse(back)", "-", least)).alias("b"))
    spans = F.expr("filter(array(struct(seq as s, a as m), struct(seq - b + 1 as s, b as m)), x -> x.m > 0)")
    return both.select(*_DOC, F.explode(F.array_distinct(spans)).alias("x")).select(*_DOC, "x.s", "x.m")


def _doubled(state: DataFrame, reach: int) -> DataFrame:
    """From the order of suffixes by their first reach lines to that by twice as many, without those that are alone."""
    after = state.select(*_DOC, (F.col("seq") - reach).alias("seq"), F.col("r").alias("r2"))
    pairs = cut(state.join(after, _PLACE).select(*_PLACE, F.col("r").alias("r1"), "r2"), "pairs")
    ranks = _ranked(pairs, ["r1", "r2"], "ranks")
    out = cut(pairs.join(ranks, ["r1", "r2"]).select(*_PLACE, "r"), "suffixes")
    discard(pairs)
    discard(ranks)
    return out


def later_copies(docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(z, d, t, runs): the maximal line runs, as sorted (a, b) of line numbers, that are later copies.

    Lines of a document in order, and documents by key, are one sequence. Its suffixes (those whose line is repeated at all)
    are ranked by their first line, then by 2, 4, 8 ... lines: a rank pair is counted, pairs that are alone leave, the others
    are sorted and numbered. Suffixes equal in m lines are an interval of common prefix m; two overlapping ranks of a power of
    two tell it for any m. Doubling ends at the fewest lines that hold least_words, as longer repeats are unions of such
    windows. Of an interval's windows the first in the sequence stays, and so do those that overlap it; the others are later
    copies, and joined they are the maximal runs.
    """
    all_lines = cut(lines(docs, key, text), "lines")
    first = _ranked(all_lines, ["h1", "h2"], "line-ids")
    active = all_lines.join(first, ["h1", "h2"]).select(*_PLACE, "words", "r").repartition(*_DOC).dropDuplicates(_PLACE)
    active = cut(active, "active")
    discard(all_lines)
    windows = cut(_windows(active, least_words), "windows")
    widest = windows.agg(F.max("m")).first()[0] or 0
    state, level, levels = active.select(*_PLACE, "r"), 0, []
    while True:
        levels.append(state.withColumn("level", F.lit(level)))
        if 2 ** (level + 1) > widest:
            break
        state, level = _doubled(state, 2**level), level + 1
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)
    at = [*_DOC, "level", "seq"]
    spans = windows.withColumn("level", F.floor(F.log2("m")).cast("int")).withColumn("seq", F.col("s"))
    spans = spans.join(ranks.withColumnRenamed("r", "r1"), at)
    spans = spans.withColumn("seq", (F.col("s") + F.col("m") - F.expr("shiftleft(1, level)")).cast("int"))
    spans = spans.join(ranks.withColumnRenamed("r", "r2"), at)
    spans = cut(spans.select(*_DOC, "s", "m", "r1", "r2"), "spans")
    place, run = F.struct(*_DOC, "s"), ["m", "r1", "r2"]
    of_same = spans.groupBy(run).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    of_same = cut(of_same, "intervals")  # written, so that the join can split a run with very many copies
    own = F.expr(" and ".join(f"{c} = first.{c}" for c in _DOC)) & (F.col("s") < F.col("first.s") + F.col("m"))
    copies = spans.join(of_same, run).where((place > F.col("first")) & ~own)
    gone = copies.select(*_DOC, F.explode(F.expr("sequence(s, s + m - 1)")).alias("seq")).distinct()
    island = F.col("seq") - F.row_number().over(Window.partitionBy(_DOC).orderBy("seq"))
    runs = gone.withColumn("g", island).groupBy(*_DOC, "g").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    return runs.groupBy(_DOC).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


_KEPT = (
    "transform(array(split({text}, r'" + SEAM + "')), l -> transform(array(filter(sequence(0, size(l) - 1), i -> l[i] rlike r'" + _WORD + "')), p -> "
    "array_join(flatten(transform(arrays_zip(concat(array(0), transform(_runs, x -> p[x.b] + 1)), concat(transform(_runs, x -> p[x.a]), array(size(l)))), "
    "z -> slice(l, z['0'] + 1, greatest(0, z['1'] - z['0'])))), ''))[0])[0]"
)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text less its later copies of line runs, and _runs, what was cut: (a, b) among the lines that have words.

    Lines are what newlines and seams part, so that a passage put into the middle of a line is a line of its own. They are
    compared by two chained 64-bit hashes, less the white space around them; those without a word never count and go with a
    run around them. The first copy is that of the least key (null before all), in it the first place, and what overlaps it
    stays. Every line that is cut is still there in an earlier place. Rows that share key and text are treated alike, as one;
    keys may be of any type that has an order. Texts without a cut, null and empty ones stay as they are; a text may become
    empty; an empty table gives none. Whole texts, however long, move once, to meet their cuts. A passage that begins or ends
    inside a line without a seam counts with its whole inner lines only. Names of docs that start with _runs are taken.
    """
    own = ["_runs_z", "_runs_d", "_runs_t"]
    cuts = cut(later_copies(docs, least_words, key, text), "cuts").toDF(*own, "_runs").hint("shuffle_hash")
    out = docs.withColumns(dict(zip(own, _keyed(docs, key, text), strict=True))).join(cuts, own, "left").drop(*own)
    kept = F.when(F.col("_runs").isNull(), F.col(text)).otherwise(F.expr(_KEPT.replace("{text}", f"`{text}`")))
    return out.withColumn(text, kept)
