import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsieve.functions import canonical, parse, text
from docsieve.functions.ids import dense_ids
from pyspark.sql import functions as F

STEMS = {"certify": "certifi", "certified": "certifi", "certifies": "certifi", "policies": "polici", "scaling": "scale", "scaled": "scale", "running": "run", "status": "status", "analysis": "analysis", "agreed": "agree", "bus": "bus", "tanned": "tan", "falling": "fall", "boxes": "boxe", "classes": "class", "sing": "sing", "rated": "rate"}
TEXTS = ["Rule 3.8 applies", "§3.8(d)(1)", "SWR 3.13", "rule-3-8", "Ordinance 2026-11, not 2026-04!", "", None, "the of and", "a" * 50, "*Bold* `code` [[Link|x]] #tag ~~gone~~", "x-y-z 1.2.3.4 LC-6655"]


def test_stems():
    assert {w: text.stem(w) for w in STEMS} == STEMS


def test_both_stemmers_agree(spark):
    heads = ["a", "be", "tr", "stop", "agr", "siz", "hop", "fly", "bl", "iz", "pass", "lov", "fall", "ss", "wax", "tabl", "queu", "y"]
    words = sorted({h + m + e for h in heads for m in ("", "at", "e", "pp", "y", "i") for e in ("", "s", "es", "ies", "sses", "ed", "eed", "ing", "us", "is", "y", "ys")})
    got = {r.w: r.term for r in text.tokens(spark.createDataFrame([(w, w) for w in words], "w string, t string").withColumnRenamed("w", "key"), "t").selectExpr("key w", "term").collect()}
    assert len(got) > 500 and got == {w: text.stem(w) for w in got}


def test_tokens_are_the_same_in_a_table(spark):
    assert text.tokenize("§3.8(d)(1)") == ["3.8", "3.8d1"] and text.tokenize("SWR 3.13") == ["swr", "13", "3.13"]
    rows = [(i, t) for i, t in enumerate([*TEXTS, " ".join(STEMS)])]
    got = {}
    for r in text.tokens(spark.createDataFrame(rows, "id int, t string"), "t").collect():
        got.setdefault(r.id, []).append(r.term)
    assert {i: sorted(got.get(i, [])) for i, _ in rows} == {i: sorted(text.tokenize(t)) for i, t in rows}


def test_filters_on_terms_stay_small(spark):
    df = text.tokens(spark.createDataFrame([(1, "running 2-3")], "id int, t string"), "t").where("term like 'r%'")
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 60_000 and df.count() == 1


def test_snippet_centres_on_the_terms():
    words = [f"w{i}" for i in range(200)]
    words[120], words[122] = "white", "rust"
    s = text.snippet(" ".join(words), {"white", "rust"})
    assert "white w121 rust" in s and s.startswith("… ") and s.endswith(" …") and len(s.split()) == 46


def test_slug_norm_round(spark):
    df = spark.createDataFrame([("  Hello,  Wörld! ", 0.0005), ("", 2.5), ("“Quoted”  ‘x’", 1.2345)], "t string, x double")
    got = df.select(text.slugify(F.col("t")), text.norm_loose(F.col("t")), text.rounded(F.col("x"), 3)).collect()
    assert [tuple(r) for r in got] == [("hello-w-rld", "hello, wörld!", 0.001), ("entity", "", 2.5), ("quoted-x", "\"quoted\" 'x'", 1.235)]


def test_front_matter(spark):
    note = "---\r\nTitle: One\ntags: [A, b]\ntitle: Two\nnot a pair\nAuthority: Controlled\n---\n# Head *x*\n#inline-Tag [[Beta Note|b]] [[Beta Note]] [[C#h]]\n- [ ] task\nTODO"
    fm, body = parse.front_matter(F.col("t"))
    df = spark.createDataFrame([(note,), ("# Only `head`",), ("plain",)], "t string").withColumn("fm", fm).withColumn("b", body)
    m = parse.metrics(F.col("b"))
    r, h, p = df.select("fm", "b", parse.title_of(F.col("fm"), F.col("b"), F.lit("file")).alias("title"), parse.tags_of(F.col("t"), F.col("fm")["tags"]).alias("tags"), parse.links_of(F.col("t")).alias("links"), parse.controlled_of(F.col("fm"), F.lit("x")).alias("c"), m["open_tasks"].alias("n"), m["has_markers"].alias("k")).collect()
    assert (r.title, r.tags, r.links, r.c, r.n, r.k) == ("Two", ["inline-tag", "a", "b"], ["Beta Note", "C"], True, 1, True)
    assert r.b.startswith("# Head") and (h.title, p.title, p.fm, p.c) == ("Only head", "file", {}, False)


def cut_by_hand(text):
    """Long text by index arithmetic, where parse uses one pattern."""
    parts = []
    while len(text) > 1600:
        ends = [i for i in range(600, 1401) if text.startswith("\n\n", i)] or [i for i in range(600, 1401) if text.startswith(". ", i)] or [1200]
        parts, text = [*parts, text[: ends[-1] + 1]], text[ends[-1] + 1 :]
    return [p.strip() for p in [*parts, text] if p.strip()]


def test_chunks(spark):
    long = "# H\n" + "Sentence number one is here. " * 200
    mixed = "".join("word " * (i % 90) + (". " if i % 3 else "\n\n") for i in range(300))
    bodies = ["intro\n# A\none\n## B\ntwo\n# C\n", "", long, "# A\none", None, "# T *x*\r\n### D\r\nd\r\nd2\r\n## `E`\ne\n# \n####### no\nf", mixed, "x" * 5000, "# only\n## heads"]
    got = {}
    for r in parse.chunks(spark.createDataFrame(list(enumerate(bodies)), "id int, body string")).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.heading, r.heading_path, r.text))
    assert got[0] == [("", [], "intro"), ("A", ["A"], "one"), ("B", ["A", "B"], "two")]
    assert got[1] == got[4] == [("", [], "")] and got[3] == [("A", ["A"], "one")]
    assert got[2][0][0] == "H · 1" and [t for _, _, t in got[2]] == cut_by_hand(long[4:].strip()) and len(got[2]) > 3
    assert got[5] == [("D", ["T x", "D"], "d\nd2"), ("E", ["T x", "E"], "e"), ("", [""], "####### no\nf")]
    assert [t for _, _, t in got[6]] == cut_by_hand(mixed.strip()) and len(got[6]) > 10
    assert len(got[7]) == 4 and got[8] == [("", [], "# only\n## heads")]


def test_dense_ids(spark):
    df = dense_ids(spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7), ["k"], "n")
    assert [r.n for r in df.orderBy("k").collect()] == list(range(1000))


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=3), max_leaves=8))
def test_canonical_json_is_stable(value):
    c = canonical.canonical_json(value)
    assert canonical.canonical_json(json.loads(c)) == c and json.loads(c) == value


@pytest.mark.parametrize("x,s", [(92.0, "92"), (1e21, "1e+21"), (0.5, "0.5"), (1e-7, "1e-7"), (0.000001, "0.000001"), (1.5e300, "1.5e+300"), (-0.25, "-0.25")])
def test_numbers_as_javascript_prints_them(x, s):
    assert canonical.canonical_json({"b": x, "a": [None]}) == '{"a":[null],"b":%s}' % s
