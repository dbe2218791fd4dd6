"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.shared import cut, sized_join

#: Hex digits of a document's hash: LEVELS histograms of 16**DIGITS buckets each resolve all of them.
DIGITS, LEVELS = 3, 5
#: Sources up to which their table is broadcast.
SOURCE_ROWS = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _tags(seed: str, key: str, source: str, text: str) -> dict[str, Column]:
    """_size, _key (the source, null and all, as a string that isn't null) and _h."""
    return {
        "_size": word_count(text),
        "_key": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")),
        "_h": F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, DIGITS * LEVELS),
    }


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), most: int = 3) -> DataFrame:
    """(_key, source_size, target, whole, rest) of sources (_key, source_size).

    Sources in code-point order, null last, take weights in turn and share the sum of all sizes. A target stops at most times
    its source's size, and the excess is shared again by weight among those below, until none is above. In closed form: by
    rising most * size / weight, a source stops if what the earlier stops leave gives it more. One task orders the sources,
    a row each; whole copies of the source and a rest make up the target.
    """
    order = Window.orderBy((F.col("_key") == "n").cast("int"), "_key")
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", pick).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("w"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    of_all = Window.partitionBy()
    s = s.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cb"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("wb"), F.sum("source_size").over(of_all).alias("t"), F.sum("w").over(of_all).alias("ws"))
    s = s.withColumn("full", (F.col("t") - F.col("cb")) * F.col("w") > F.col("cap") * (F.col("ws") - F.col("wb")))
    s = s.select("*", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(of_all).alias("ck"), F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(of_all).alias("wk"))
    share = ((F.col("t") - F.col("ck")) * F.col("w")).cast("double") / (F.col("ws") - F.col("wk")).cast("double")
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return s.withColumn("whole", whole).select("_key", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def thresholds(tagged: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with at (a hash) and also (boolean): documents hashed below at are taken once more; those at it, if also.

    One histogram of sizes by source and the hash's next DIGITS finds the bucket in which a source's rest ends; the next is
    over that bucket's documents only. Documents that share a hash are taken together, as comes nearer to the rest.
    """
    edge, done = plan.select("_key", "rest", F.lit("").alias("at"), F.lit(0).cast("long").alias("base")), None
    for level in range(LEVELS):
        n = DIGITS * (level + 1)
        inside = sized_join(tagged, edge.select("_key", "at"), "_key", max_rows=SOURCE_ROWS).where(F.col("_h").startswith(F.col("at"))) if level else tagged
        bars = inside.groupBy("_key", F.substring("_h", 1, n).alias("b")).agg(F.sum("_size").alias("s"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        run = Window.partitionBy("_key").orderBy("b")
        bars = bars.join(edge.select("_key", "rest", "base"), "_key").withColumn("upto", F.col("base") + F.sum("s").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        first = bars.where("upto > rest").withColumn("i", F.row_number().over(run)).where("i = 1")
        edge = cut(first.select("_key", "rest", F.col("b").alias("at"), (F.col("upto") - F.col("s")).alias("base"), "s", "lo", "hi"), f"edge{level}")
        one = edge.where("lo = hi")
        done = one if done is None else done.unionByName(one)
        edge = edge.where("lo < hi")
        if edge.isEmpty():
            break
    done = done.select("_key", F.col("lo").alias("at"), (F.col("base") + F.col("s") - F.col("rest") < F.col("rest") - F.col("base")).alias("also"))
    return plan.join(done, "_key", "left")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), most: int = 3, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with _mix, a struct: size, source_size, target and times, how often the mix takes the whole document, 0 to most.

    Only (source, hash, size) is written and summed; the text is read twice and never shuffled, nor is anything sorted by
    document. Reruns agree, as hashes come from the key. Null sources are one source; null or empty texts have size 0; rows
    with one key are taken alike, those with a null key too; an empty table gives none; a very long text is only counted. Names
    of docs that start with _mix are taken.
    """
    tag = _tags(seed, key, source, text)
    slim = cut(docs.select(*(c.alias(n) for n, c in tag.items())), "sizes")
    sizes = cut(slim.groupBy("_key").agg(F.sum("_size").alias("source_size")), "sources")
    plan = cut(thresholds(slim, cut(targets(sizes, weights, most), "targets")), "plan")
    plan = cut(plan.select(F.col("_key").alias("_mix_key"), F.struct("source_size", "target", "whole", "rest", "at", "also").alias("_mix_plan")), "plan")
    out = docs.withColumns({"_mix_key": tag["_key"], "_mix_h": tag["_h"], "_mix_size": tag["_size"]})
    out = sized_join(out, plan, "_mix_key", max_rows=SOURCE_ROWS)
    h, p = F.col("_mix_h"), F.col("_mix_plan")
    extra = F.coalesce((h < p["at"]) | ((h == p["at"]) & p["also"]), F.lit(False)).cast("long")
    times = F.least(p["whole"] + F.when(p["rest"] > 0, extra).otherwise(0), F.lit(most)).cast("long")
    own = F.struct(F.col("_mix_size").alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), times.alias("times"))
    return out.withColumn("_mix", own).select(*docs.columns, "_mix")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    copies = F.expr("if(_mix.times > 0, sequence(1, cast(_mix.times as int)), cast(array() as array<int>))")
    return mix(docs, **options).withColumn("_mix_copy", F.explode(copies)).select(docs.columns)
