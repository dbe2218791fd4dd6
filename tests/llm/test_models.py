import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docsieve.llm import quality, toxicity
from tests.llm.conftest import ODD

WORDS = ["the", "river", "stone", "garden", "walks", "under", "quiet", "morning", "light", "house"]


def corpus(n, seed):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randrange(20, 120))]
        bad = rnd.random() < 0.25
        for _ in range(bad * rnd.randrange(2, 5)):
            words.insert(rnd.randrange(len(words)), "grubl" + rnd.choice("aeiou") + rnd.choice("xyzq"))
        grade = rnd.randrange(4)
        words += [rnd.choice(["!!!", "###"]) for _ in range(12 * (3 - grade))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), grade, "clash"))
    return rows, labels


@pytest.fixture(scope="module")
def labels_schema():
    return "doc_id bigint, toxic int, quality int, text string"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_documents(spark, docs, labels_schema):
    rows, labels = corpus(600, 1)
    df = docs([*rows, *((9000 + (i or 0), t) for i, t in ODD)])
    lab = spark.createDataFrame([*labels, (None, 1, 1, ""), (3, None, None, "")], labels_schema)
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, lab)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and 9002 in got
    test = [(got[i], t) for i, t, _, _ in labels if held(i)]
    assert np.mean([(s >= 0.5) == t for s, t in test]) > 0.95
    flipped = [(i, 1 - t if held(i) else t, q, x) for i, t, q, x in labels]
    again = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, spark.createDataFrame(flipped, labels_schema))).collect()}
    assert again == pytest.approx(got)  # held-out labels are never read


def test_toxicity_without_labels_or_rows(spark, docs, labels_schema):
    none = spark.createDataFrame([], labels_schema)
    df = docs(ODD)
    got = toxicity.score(df, toxicity.train(df, none)).collect()
    assert len(got) == len(ODD) and all(r.score < 0.5 for r in got)
    assert toxicity.score(docs([]), toxicity.train(docs([]), none)).count() == 0


def plain_model(texts):
    """An independent interpolated Kneser-Ney: dictionaries over (text, label), label None for texts that only share counts."""
    order, top, shared = toxicity.ORDER, {0: Counter(), 1: Counter()}, {}
    grams = set()
    for text, label in texts:
        line = " " * (order - 1) + "".join(map(chr, toxicity.fold_text(text)))
        for i in range(order, len(line) + 1):
            grams.add(line[i - order : i])
            if label is not None:
                top[label][line[i - order : i]] += 1
    longer = grams
    for k in range(order - 1, 0, -1):
        shared[k] = Counter(g[-k:] for g in longer)  # how many longer ones end with it
        longer = set(shared[k])

    def smooth(counts, g, back):
        of = [n for h, n in counts.items() if h[:-1] == g[:-1]]
        return (max(counts[g] - 0.75, 0) + 0.75 * len(of) * back) / sum(of) if of else back

    def p(g, label=None):
        if not g:
            return 1 / toxicity.ALPHABET
        return smooth(shared[len(g)] if label is None else top[label], g, p(g[1:]))

    return grams, p


SMALL = [(1, "abcab cabba abac"), (2, "bca bcb"), (3, "caab \U0001f600\U0001f600 x"), (4, "zzz \u4e2d\u6587 ab"), (6, "Abc!? abcab"), (None, "null b")]


def small(spark, docs):
    return docs(SMALL), spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, toxic int")


def test_kneser_ney_against_dictionaries(spark, docs):
    df, lab = small(spark, docs)
    model = toxicity.train(df, lab)
    counted = {i: i % 2 for i in range(1, 7) if zlib.crc32(str(i).encode()) % 5 >= 2}
    assert set(counted.values()) == {0, 1}
    grams, p = plain_model([(t, counted.get(i)) for i, t in SMALL])
    got = {r.g: r.r for r in model.ratios.collect()}
    assert set(got) == grams
    assert got == pytest.approx({g: np.log(p(g, 1) / p(g, 0)) for g in grams})
    assert any(abs(r) > 0.5 for r in got.values())
    letters = sorted({c for g in grams for c in g})
    for context in ("", "a", "ab", " ", "q"):
        own = [r.p for r in model.shared(spark.createDataFrame([((context + c).rjust(toxicity.ORDER - 1),) for c in letters], "s string")).collect()]
        assert len(own) == len(letters) and 0.2 < sum(own) <= 1 + 1e-9
    unseen = toxicity.ALPHABET - len(letters)
    assert sum(p(c) for c in letters) + unseen * p("\u0416") == pytest.approx(1)


def test_texts_that_join_their_ratios(spark, docs, monkeypatch):
    rows, labels = corpus(80, 4)
    df = docs([*rows, *ODD, (77, "\U0001f600 \u4e2d\u6587")])
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int, text string"))
    want = sorted((str(r.doc_id), r.score) for r in toxicity.score(df, model, seen=True).collect())
    other = sorted((str(r.doc_id), r.score) for r in toxicity.score(df, model).collect())
    monkeypatch.setattr(toxicity, "SENT_ROWS", 10)
    monkeypatch.setattr(toxicity, "CHUNK", 3_000)
    joined = sorted((str(r.doc_id), r.score) for r in toxicity.score(df, model, seen=True).collect())
    assert [k for k, _ in want] == [k for k, _ in joined] == [k for k, _ in other]
    assert [s for _, s in joined] == pytest.approx([s for _, s in want]) and [s for _, s in other] == pytest.approx([s for _, s in want])
    fresh = toxicity.score(docs([(1, "never seen \u03b1\u03b2\u03b3 before"), (2, None)]), model).collect()
    assert len(fresh) == 2 and all(0 <= r.score <= 1 for r in fresh)
    text_keys = df.selectExpr("cast(doc_id as string) doc_id", "text")
    assert toxicity.score(text_keys, model, seen=True).dtypes == [("doc_id", "string"), ("score", "double")]


def test_more_letters_than_an_alphabet_holds(monkeypatch):
    texts = ["abc abd", "\u4e2d\u6587 abc", "xyz abc \U0001f600"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0, None], pa.int32())], ["t", "l"])
    count = lambda: sum((Counter({(g, "t"): t, (g, "p"): p, (g, "n"): 1 * (not t and not p)}) for b in toxicity._count(iter([batch])) for g, t, p in zip(*(c.to_pylist() for c in b.columns), strict=True)), Counter())
    want = count()
    for letters in (6, 8, 9):
        monkeypatch.setattr(toxicity, "_LETTERS", letters)
        got = count()
        assert {k: v for k, v in got.items() if k[1] != "n"} == {k: v for k, v in want.items() if k[1] != "n"}
        assert {k[0] for k in got} == {k[0] for k in want}


def gradient_check(who, at, x, y, model):
    """The mean negative log-likelihood, spelled out text by text, at a fitted model."""
    total = 0.0
    for i, grade in enumerate(y):
        s = sum(model.weights[b] * v for w, b, v in zip(who, at, x, strict=True) if w == i)
        above = [1 / (1 + np.exp(-(s - c))) for c in model.cuts]
        k = model.grades.index(grade)
        total -= np.log((above[k - 1] if k else 1) - (above[k] if k < len(above) else 0))
    return total / len(y) + 0.5e-4 * sum(model.weights[b] ** 2 for b in set(at))


def test_ordinal_fit_is_a_minimum():
    rnd = np.random.default_rng(5)
    who, at, x = np.repeat(np.arange(40), 3), rnd.integers(0, 6, 120), rnd.random(120)
    y = rnd.integers(0, 3, 40)
    model = quality.fit(who, at, x, y, rounds=4000, rate=0.05)
    best = gradient_check(who, at, x, y, model)
    for _ in range(30):
        moved = quality.Ordinal(model.grades, model.weights.copy(), model.cuts + rnd.normal(0, 0.02, 2))
        moved.weights[:6] += rnd.normal(0, 0.05, 6)
        assert gradient_check(who, at, x, y, moved) >= best - 1e-6


def test_shapes_read_whole_words():
    assert quality.shape("A1" * 20) != quality.shape("A1" * 21) and quality.shape("Word") == quality.shape("Other")


def test_ordinal_grades(spark, docs, labels_schema):
    rows, labels = corpus(800, 2)
    df, lab = docs([*rows, *((9000 + (i or 0), t) for i, t in ODD)]), spark.createDataFrame(labels, labels_schema)
    model = quality.train(df, lab)
    assert model.grades == [0, 1, 2, 3] and list(model.cuts) == sorted(model.cuts)
    got = {r.doc_id: r for r in quality.score(df, model, at_least=2).collect()}
    test = [(got[i], g) for i, _, g, _ in labels if held(i)]
    assert np.corrcoef([r.expected_grade for r, _ in test], [g for _, g in test])[0, 1] > 0.9
    assert np.mean([(r.tail >= 0.5) == (g >= 2) for r, g in test]) > 0.9
    assert all(0 <= r.expected_grade <= 3 for r in got.values())


def test_ordinal_without_ratings(spark, docs, labels_schema):
    none = spark.createDataFrame([], labels_schema)
    got = quality.select(docs(ODD), none).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got)
    assert quality.select(docs([]), none).count() == 0
    one = spark.createDataFrame([(4, 0, 1, "")], labels_schema)
    assert {r.expected_grade for r in quality.select(docs(ODD), one).collect()} == {1.0}
