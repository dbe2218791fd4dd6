"""URL filters: host and path rules, then a ratio of character models, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.shared import cut, sized_join

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Longest context in characters.
ORDER = 4
#: What stands before a URL's first character.
_BEFORE = "\x01"
#: Weight of the shorter context's probability, in counts; the shortest of all is uniform over so many characters.
_PRIOR, _ALPHABET = 2.0, 256.0
#: First hex digits of a URL's MD5 by which it is held out of the counts, for calibration.
HELD_OUT = "012"
#: Scores are calibrated to 1 / BINS.
BINS = 100


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path; both empty for null or without ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    host = F.translate(after[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, host).otherwise(""), F.when(has, after[1]).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _places(rows: DataFrame) -> DataFrame:
    """A row for each character of url (one of null for none) with g, it and the ORDER characters before it."""
    codes = f"concat(array_repeat('{_BEFORE}', {ORDER}), coalesce(regexp_extract_all(url, '(?s).', 0), cast(array() as array<string>)))"
    each = rows.withColumn("_p", F.expr(codes)).withColumn("_n", F.size("_p") - ORDER)
    zipped = F.arrays_zip(*(F.slice("_p", F.lit(j + 1), F.col("_n")).alias(f"_z{j}") for j in range(ORDER + 1)))
    each = each.select(*rows.columns, F.inline_outer(zipped))
    return each.select(*rows.columns, F.concat(*(f"_z{j}" for j in range(ORDER + 1))).alias("g"))


def _last(n: int) -> Column:
    return F.substring("g", -n, n)


def counts(places: DataFrame) -> DataFrame:
    """(g, allow, block) of (g, verdict): how often each expression of ORDER + 1 characters is in URLs of each verdict, or in none of them."""
    kinds = (F.count_if(F.coalesce(F.col("verdict") == k, F.lit(False))).alias(k) for k in ("allow", "block"))
    return places.where("g is not null").groupBy("g").agg(*kinds)


def ratios(table: DataFrame) -> DataFrame:
    """(g, r) of counts: ln P(allow) - ln P(block) of g's last character, interpolated from no context to the longest.

    Counts of shorter expressions and of contexts are sums over the same table, which has every expression by itself and
    grows with the input.
    """
    seen = table.where("allow + block > 0")
    out = table.select("g")
    p = {k: F.lit(1 / _ALPHABET) for k in ("allow", "block")}
    for k in range(ORDER + 1):
        sums = lambda tag: [F.sum(x).alias(f"{tag}{x}{k}") for x in p]  # noqa: B023, E731
        out = out.join(seen.groupBy(_last(k + 1).alias("_own")).agg(*sums("g")), _last(k + 1) == F.col("_own"), "left").drop("_own")
        context = F.substring(_last(k + 1), 1, k)
        out = out.join(seen.groupBy(context.alias("_context")).agg(*sums("c")), context == F.col("_context"), "left").drop("_context")
        some = lambda tag, x: F.coalesce(F.col(f"{tag}{x}{k}"), F.lit(0))  # noqa: B023, E731
        p = {x: (some("g", x) + _PRIOR * p[x]) / (some("c", x) + _PRIOR) for x in p}
    return out.select("g", (F.log(p["allow"]) - F.log(p["block"])).alias("r"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row (at, error): the score from which a URL passes, and its error on held-out URLs.

    Of the gaps between bars of 1 / BINS, that at which the shares of held-out accepted URLs below it and of rejected ones
    above it have the least sum; of equal ones the widest, then the least. at is its middle, error half that sum. Without
    held-out URLs of both verdicts it is 0, and error null. Only a histogram is sorted.
    """
    bars = scored.where("held and score is not null").groupBy(F.floor(F.col("score") * BINS).alias("b"))
    bars = bars.agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("k"))
    whole, before = Window.partitionBy(), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bars = bars.unionByName(bars.agg((F.max("b") + 1).alias("b"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("k")).where("b is not null"))
    share = F.coalesce(F.sum("a").over(before), F.lit(0)) / F.sum("a").over(whole) + 1 - F.coalesce(F.sum("k").over(before), F.lit(0)) / F.sum("k").over(whole)
    both = (F.sum("a").over(whole) > 0) & (F.sum("k").over(whole) > 0)
    last = F.coalesce(F.lag("b").over(Window.orderBy("b")) + 1, F.col("b"))
    each = bars.select("b", last.alias("last"), F.when(both, share).alias("e")).where("e is not null")
    best = each.agg(F.min(F.struct(F.round("e", 9).alias("e"), (F.col("last") - F.col("b")).alias("gap"), "b", "last")).alias("x"))
    return best.select(F.coalesce((F.col("x.b") + F.col("x.last")) / (2 * BINS), F.lit(0.0)).alias("at"), (F.col("x.e") / 2).alias("error"))


def scored(base: DataFrame) -> DataFrame:
    """base (url, ruled, held and more) less url, with score: the mean log ratio over the url's characters, null if it has none.

    A URL's characters are rows of one task, whose sums are added up before they are shuffled, while the ratios of all
    expressions are few enough to be sent to every task.
    """
    learn = F.when(~F.col("held"), F.col("ruled")).alias("verdict")
    table = cut(counts(_places(base.select("url", learn))), "url-counts")
    shared = cut(ratios(table), "url-ratios")
    rest = [c for c in base.columns if c != "url"]
    each = _places(base.withColumn("_row", F.monotonically_increasing_id()))
    sums = sized_join(each, shared, "g", "left").groupBy("_row", *rest).agg(F.sum("r").alias("_r"), F.count("r").alias("_n"))
    return sums.select(*rest, F.when(F.col("_n") > 0, F.col("_r") / F.col("_n")).alias("score"))


def judge(pages: DataFrame, rules: tuple = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score): the longest fitting rule's verdict, else the method's.

    URLs that rules decide are the accepted and rejected examples. Those whose MD5 starts with a digit of HELD_OUT are kept
    out of the counts and calibrate the threshold instead; see threshold(). Every expression is counted by itself. Null or
    empty URLs, and all without a rule if there is no example at all, are allowed, the former with a null score. Very long
    URLs are read whole; repeated rows stay repeated and null keys stay; an empty table gives none; other columns of pages
    are left out, whatever their names.
    """
    base = pages.select(key, F.col(url).cast("string").alias("url"))
    host, path = host_path(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    held = F.col("ruled").isNotNull() & F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)
    base = base.withColumns({"rule": rule, "ruled": ruled}).withColumn("held", F.coalesce(held, F.lit(False)))
    done = cut(scored(base), "url-scores")
    own = F.when(F.col("score") < cut(threshold(done), "url-threshold").select("at").scalar(), "block").otherwise("allow")
    return done.select(key, "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
