"""Quality by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docsieve.llm.labelled import with_label
from docsieve.shared import cut

#: Buckets of hashed words and word shapes, behind the FIXED features of a whole text.
BUCKETS, FIXED = 1 << 16, 2
#: Rated documents that a model is fitted on, at most.
SAMPLE_ROWS = 8_000
#: Tasks that make the sample's features.
FIT_TASKS = 24
#: Words whose weights a worker remembers before it forgets them all.
_REMEMBERED = 400_000
_RUNS = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


def shape(word: str) -> str:
    """Letters as a, or A if all are capitals, or Aa after a capital; digits as 0; a repeated sign as two."""
    letters = "A" if word.isupper() and len(word) > 1 else "Aa" if word[:1].isupper() else "a"
    for pattern, to in _RUNS:
        word = pattern.sub(letters if to == "a" else to, word)
    return word


def buckets(word: str) -> tuple[int, int]:
    return FIXED + zlib.crc32(word.lower().encode("utf-8", "replace")) % BUCKETS, FIXED + zlib.crc32(b"shape " + shape(word).encode("utf-8", "replace")) % BUCKETS


def whole(words: list[str]) -> tuple[float, float]:
    """The share of words that repeat the word before, and that of distinct words missing from what a text so long has."""
    n = len(words)
    return (10 * sum(a == b for a, b in zip(words, words[1:])) / n, 1 - (len(set(words)) / n) ** 0.5) if n else (0.0, 0.0)


def features(text: str | None) -> dict[int, float]:
    """Shared hashed-text features: frequencies of words and shapes, then those of the whole text."""
    words = (text or "").split()
    out = dict(enumerate(whole(words)))
    for w in words:
        for b in buckets(w):
            out[b] = out.get(b, 0.0) + 1 / len(words)
    return out


class Ordinal:
    """P(grade > k) = 1 / (1 + exp(threshold k - score)); one score, rising thresholds."""

    def __init__(self, grades: list[int], weights: np.ndarray, cuts: np.ndarray):
        self.grades, self.weights, self.cuts = grades, weights, cuts

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """For each score the probabilities of more than the first, second ... grade."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.cuts[None, :], -40, 40)))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(scores) @ np.diff(self.grades).astype(float)


def fit(who: np.ndarray, at: np.ndarray, x: np.ndarray, ratings: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> Ordinal:
    """By Adam on the mean negative log-likelihood; thresholds rise as their steps are exponentials.

    Text who[i] has the value x[i] of feature at[i]. Fewer than two grades: no thresholds, and every text is expected to have
    the one grade (0 if none).
    """
    grades = sorted({int(g) for g in ratings})
    if len(grades) < 2:
        return Ordinal(grades or [0], np.zeros(BUCKETS + FIXED), np.zeros(0))
    y = np.searchsorted(grades, ratings)
    used, at = np.unique(at, return_inverse=True)
    x, count = x.astype(float), len(ratings)
    k = len(grades) - 1
    share = np.clip([np.mean(y <= i) for i in range(k)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(used)), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, cuts = p[: len(used)], p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))])
        s = np.bincount(who, x * w[at], count)
        edge = np.concatenate([[np.inf], -cuts, [-np.inf]])
        up, low = (1 / (1 + np.exp(-np.clip(s + edge[y + i], -40, 40))) for i in (0, 1))
        gap = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / gap / count, low * (1 - low) / gap / count
        to_cut = np.bincount(y, du, k + 1)[1:] - np.bincount(y, dl, k + 1)[:-1]
        steps = np.cumsum(to_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, x * (dl - du)[who], len(used)) + decay * w, [steps[0]], steps[1:] * np.exp(p[len(used) + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights = np.zeros(BUCKETS + FIXED)
    weights[used] = p[: len(used)]
    return Ordinal(grades, weights, p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = SAMPLE_ROWS) -> Ordinal:
    """Fits on most rated documents at most, the first by hash of those not in fold 0; their features go to the driver.

    Null keys and labels rate nothing; of several labels of a key the largest counts. An empty table fits no thresholds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32())), batch.column(1)], ["b", "v", "y"])

    sample = with_label(docs, labels, label, key, text, "inner", most).orderBy(F.xxhash64(key), key, F.xxhash64("_text")).limit(most)
    sample = cut(sample.select("_text", "_label"), "rated").repartition(FIT_TASKS)
    got = sample.mapInArrow(run, "b array<int>, v array<float>, y int").toArrow()
    flat, y = got.combine_chunks(), got["y"].to_numpy()
    lists = [c for name in ("b", "v") for c in flat[name].chunks]
    if not len(y):
        return fit(np.empty(0, int), np.empty(0, int), np.empty(0), y)
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in flat["b"].chunks])
    at, x = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in half]) for half in (lists[: len(lists) // 2], lists[len(lists) // 2 :]))
    return fit(np.repeat(np.arange(len(y)), sizes), at, x, y)


def scored(docs: DataFrame, model: Ordinal, at_least: int | None = None, text: str = "text", names: tuple[str, str] = ("expected_grade", "tail")) -> DataFrame:
    """docs with two more columns, so that a decision stays with its row whatever the keys are; see score()."""
    shared = docs.sparkSession.sparkContext.broadcast((model.grades, model.weights, model.cuts))
    which = len([g for g in model.grades if g < (at_least if at_least is not None else (model.grades[1:] or [model.grades[0]])[0])]) - 1
    place, fields = docs.columns.index(text), [*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        known: dict[str, float] = {}
        for batch in batches:
            s = np.zeros(len(batch))
            for i, raw in enumerate(batch.column(place)):
                if not (words := str(raw.as_py() or "").split()):
                    continue
                if len(known) > _REMEMBERED:
                    known.clear()
                for w in set(words).difference(known):
                    a, b = buckets(w)
                    known[w] = own.weights[a] + own.weights[b]
                s[i] = sum(map(known.__getitem__, words)) / len(words) + float(np.dot(whole(words), own.weights[:FIXED]))
            tail = own.tails(s)[:, which] if 0 <= which < len(own.cuts) else np.full(len(batch), 1.0 if which < 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.expected(s)), pa.array(tail)], [f.name for f in fields])

    return docs.mapInArrow(run, StructType(fields))


def score(docs: DataFrame, model: Ordinal, at_least: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected_grade, tail): tail is the probability of grade at_least (default: the second lowest) or better.

    Null and empty texts have no features and get what the thresholds alone give. Very long texts are scored whole, a batch of
    rows in a worker. Repeated rows stay repeated and get the same score, as do rows with a null key; an empty table gives
    none; other columns of docs are left out.
    """
    return scored(docs.select(F.col(key), F.col(text).cast("string").alias("_text")), model, at_least, "_text").drop("_text")


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """(doc_id, expected_grade, tail, kept) of every row: kept if the tail probability is at least least."""
    return score(docs, train(docs, labels, **options)).withColumn("kept", F.col("tail") >= least)


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns, whose own text has a tail probability of at least least.

    Each row is judged by its text, so rows that share a key, or have none, are judged apart. An empty table gives none. A
    column of docs may have any name but _quality_grade and _quality_tail.
    """
    names = ("_quality_grade", "_quality_tail")
    return scored(docs, train(docs, labels, **options), names=names).where(F.col(names[1]) >= least).select(docs.columns)
