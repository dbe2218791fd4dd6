"""Toxicity by class-conditional Kneser-Ney models over characters that back off to shared counts."""

from __future__ import annotations

import io
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.labelled import fold, with_label
from docsieve.shared import cut, cut_in_buckets

#: Characters of an expression.
ORDER = 5
DISCOUNT = 0.75
#: Below single characters all are as likely as one of so many.
ALPHABET = 4096
#: Documents whose scores calibrate the ratio, at most.
CALIBRATION_ROWS = 20_000
#: Characters over which the ratio is averaged: the worst stretch of each length counts beside the whole text's mean.
WINDOWS = (8, 16, 48)
#: Expressions up to which their ratios are sent to all tasks, some 20 bytes each; beyond it texts meet theirs in a join.
SENT_ROWS = 8_000_000
#: Bytes of a chunk of texts in that join.
CHUNK = 16_000_000
#: Characters that are laid out at once, and those that are looked up at once, which caches hold.
_AT_ONCE, _BLOCK = 2_000_000, 1 << 16
#: Letters of a task's own alphabet, so that five of them fit a long; distinct expressions that a task gathers before it adds them up.
_LETTERS, _PENDING = 6_200, 4_000_000
#: Unicode categories whose characters count.
_KEPT = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Nd", "Nl", "No", "So"))
#: What the code points of an expression are multiplied by for its 64-bit key in a lookup.
_MIX = np.random.default_rng(42).integers(0, 2**63, ORDER, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """Code points that count: letters, marks, digits and pictures of any script."""
    return np.fromiter((unicodedata.category(chr(i)) in _KEPT for i in range(0x110000)), bool, 0x110000)


def fold_text(text: str | None) -> np.ndarray:
    """Code points in lower case, every run of white space, signs and controls as one space, and a space at either end."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), np.uint32)
    word = _kept()[codes]
    return np.where(word, codes, np.uint32(32))[np.concatenate(([True], word[1:] | word[:-1]))]


def _lay(texts: list, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with gaps of spaces before each and at the end; where each starts and ends."""
    parts, starts, ends, at, space = [], [], [], 0, np.full(gap, 32, np.uint32)
    for text in texts:
        codes = fold_text(text)
        parts += [space, codes]
        starts.append(at + gap)
        at += gap + len(codes)
        ends.append(at)
    parts.append(space)
    return np.concatenate(parts), np.array(starts, np.int64), np.array(ends, np.int64)


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose first column, the text, has about _AT_ONCE bytes."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(0)], np.int64) + 60
        part = np.cumsum(sizes) // _AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each is there."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _strings(codes: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    whole, n = np.ascontiguousarray(codes, np.uint32).tobytes().decode("utf-32-le"), codes.shape[1]
    return [whole[i : i + n] for i in range(0, len(whole), n)]


class _Alphabet:
    """Numbers for the letters that a task meets, by which expressions are packed and unpacked without loss."""

    def __init__(self):
        self.number = np.full(0x110000, -1, np.int64)
        self.letters = np.empty(0, np.uint32)

    def takes(self, codes: np.ndarray) -> bool:
        """Adds the letters of codes, if there is room for them."""
        there = np.zeros(0x110000, bool)
        there[codes] = True
        new = np.flatnonzero(there & (self.number < 0))
        if len(self.letters) + len(new) > _LETTERS:
            return False
        self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
        self.letters = np.concatenate([self.letters, new.astype(np.uint32)])
        return True

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """At each place the last ORDER letters, the latest in the last digit."""
        x = self.number[codes]
        out = x.copy()
        for j in range(1, ORDER):
            out[j:] += x[:-j] * _LETTERS**j
        return out

    def unpacked(self, grams: np.ndarray) -> list[str]:
        return _strings(np.stack([self.letters[grams // _LETTERS**j % _LETTERS] for j in range(ORDER - 1, -1, -1)], axis=1)) if len(grams) else []


def _merged(parts: list) -> list:
    """One (grams, toxic, plain) of several."""
    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [(grams, *(np.bincount(where, np.concatenate([p[i] for p in parts]), len(grams)).astype(np.int64) for i in (1, 2)))]


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """(code points, places of expressions, kind) of the texts without a label (None), plain (0) and toxic (1) of (text, label)."""
    labels = batch.column(1).to_pylist()
    for kind in (None, 0, 1):
        some = [t.as_py() for t, x in zip(batch.column(0), labels, strict=True) if (None if x is None else int(x > 0)) == kind]
        if some:
            codes, starts, ends = _lay(some, ORDER - 1)
            yield codes, _inside(len(codes), starts, ends), kind


def _batch(grams: list[str], toxic: np.ndarray, plain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(grams), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + 100_000]), pa.array(toxic[at : at + 100_000]), pa.array(plain[at : at + 100_000])], ["g", "toxic", "plain"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, toxic, plain) of (text, label): expressions of all texts, with their counts in labelled ones; once a task each, but for many letters."""
    own, parts = _Alphabet(), []
    for batch in _slices(batches):
        for codes, inside, kind in _counted(batch):
            if not own.takes(codes):  # a new alphabet for what follows
                for grams, toxic, plain in _merged(parts) if parts else []:
                    yield from _batch(own.unpacked(grams), toxic, plain)
                own, parts = _Alphabet(), []
            if own.takes(codes):
                grams, n = _runs(own.packed(codes)[inside])
                none = np.zeros(len(grams), np.int64)
                parts.append((grams, n if kind else none, n if kind == 0 else none))
            else:  # more letters than fit: rows are compared as they are
                at = np.flatnonzero(inside)
                rows, n = np.unique(np.stack([codes[at - j] for j in range(ORDER - 1, -1, -1)], axis=1), axis=0, return_counts=True)
                none = np.zeros(len(n), np.int64)
                yield from _batch(_strings(rows), n if kind else none, n if kind == 0 else none)
        if sum(len(p[0]) for p in parts) > _PENDING:
            parts = _merged(parts)
    for grams, toxic, plain in _merged(parts) if parts else []:
        yield from _batch(own.unpacked(grams), toxic, plain)


def expressions(rows: DataFrame) -> DataFrame:
    """(g, toxic, plain) summed over all rows (_text, _label): every expression of the rows, spelled out."""
    part = rows.select("_text", "_label").mapInArrow(_count, "g string, toxic bigint, plain bigint")
    return part.groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _smoothed(own: str, total: str, types: str, back: str) -> Column:
    """Interpolated Kneser-Ney; a context that was never seen leaves all to the shorter one."""
    seen = (F.greatest(F.coalesce(F.col(own), F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(types) * F.col(back)) / F.col(total)
    return F.when(F.coalesce(F.col(total), F.lit(0)) > 0, seen).otherwise(F.col(back))


@dataclass
class Model:
    """Counts by expression in written tables that grow with the corpus; ratios of the corpus's own expressions; the calibration."""

    grams: DataFrame
    levels: dict[int, DataFrame]
    ratios: DataFrame | None = None
    center: np.ndarray = field(default_factory=lambda: np.zeros(len(WINDOWS) + 2))
    spread: np.ndarray = field(default_factory=lambda: np.ones(len(WINDOWS) + 2))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(WINDOWS) + 3))

    def shared(self, wanted: DataFrame) -> DataFrame:
        """(s, p): P of the last character of each distinct s (ORDER - 1 characters) of wanted after those before it, from shared counts."""
        need = {ORDER - 1: wanted}
        for k in range(ORDER - 2, 0, -1):
            need[k] = need[k + 1].select(F.substring("s", -k, k).alias("s")).distinct()
        below = None
        for k in range(1, ORDER):
            level = self.levels[k]
            context = level.groupBy(F.substring("s", 1, k - 1).alias("c")).agg(F.sum("a").alias("n"), F.count(F.lit(1)).alias("t"))
            each = need[k].join(level, "s", "left").withColumn("c", F.substring("s", 1, k - 1)).join(context, "c", "left")
            if below is None:
                each = each.withColumn("back", F.lit(1 / ALPHABET))
            else:
                each = each.withColumn("b", F.substring("s", -(k - 1), k - 1)).join(below.select(F.col("s").alias("b"), F.col("p").alias("back")), "b")
            below = cut(each.select("s", _smoothed("a", "n", "t", "back").alias("p")), f"shared{k}")
        return below

    def ratio(self, wanted: DataFrame) -> DataFrame:
        """(g, r): ln P(toxic) - ln P(plain) of the last character of each distinct g of wanted after those before it."""
        kinds = ("toxic", "plain")
        context = F.substring("g", 1, ORDER - 1)
        sums = [x for k in kinds for x in (F.sum(k).alias(f"n_{k}"), F.count_if(F.col(k) > 0).alias(f"t_{k}"))]
        of_context = self.grams.where("toxic + plain > 0").groupBy(context.alias("c")).agg(*sums)
        back = self.shared(wanted.select(F.substring("g", -(ORDER - 1), ORDER - 1).alias("s")).distinct())
        each = wanted.join(self.grams, "g", "left").withColumns({"c": context, "s": F.substring("g", -(ORDER - 1), ORDER - 1)})
        each = each.join(of_context, "c", "left").join(back, "s")
        p = [_smoothed(k, f"n_{k}", f"t_{k}", "p") for k in kinds]
        return each.select("g", (F.log(F.greatest(p[0], F.lit(1e-12))) - F.log(F.greatest(p[1], F.lit(1e-12)))).alias("r"))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic weights of the features by Newton's method; without both classes, the share of toxic ones."""
        if len(x):
            self.center, self.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        share = float(y.mean()) if len(y) else 0.0
        self.weights = np.zeros(len(self.center) + 1)
        self.weights[0] = np.log((share + 1e-6) / (1 - share + 1e-6))
        if not 0 < share < 1:
            return
        z = np.concatenate([np.ones((len(x), 1)), (x - self.center) / self.spread], axis=1)
        ridge = np.diag([1e-6] + [0.01] * (z.shape[1] - 1)) * len(x) ** 0.5
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(z.shape[1]), z.T @ (y - p) - ridge @ self.weights)
            self.weights += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break

    def probability(self, features: str) -> Column:
        z = F.lit(float(self.weights[0]))
        for i, (w, c, s) in enumerate(zip(self.weights[1:], self.center, self.spread, strict=True)):
            z = z + F.lit(float(w / s)) * (F.col(features)[i] - F.lit(float(c)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _offset(strings: pa.Array, i: int) -> int:
    """Where the i-th string starts in the bytes of an array of strings."""
    wide = pa.types.is_large_string(strings.type)
    return int(np.frombuffer(strings.buffers()[1], np.int64 if wide else np.int32)[strings.offset + i])


class Lookup:
    """Ratios by expression: keys of 64 bits in order, none twice, and where those with each beginning start."""

    def __init__(self, grams: pa.Array, ratios: np.ndarray):
        whole = b"".join(p.buffers()[2].to_pybytes()[_offset(p, 0) : _offset(p, len(p))] for p in (grams.chunks if isinstance(grams, pa.ChunkedArray) else [grams]) if len(p))
        codes = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        keys = self.keys(codes)
        order = np.argsort(keys, kind="stable")
        self.sorted, self.ratios = np.append(keys[order], np.uint64(2**64 - 1)), np.append(np.asarray(ratios, np.float32)[order], np.float32(0))
        if len(codes) and (self.sorted[1:-1] == self.sorted[:-2]).any():
            raise ValueError("two expressions have one key")
        self.shift = np.uint64(64 - max(8, int(len(codes) + 1).bit_length() + 1))
        self.first = np.searchsorted(self.sorted[:-1], np.arange(1 << int(64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    @staticmethod
    def keys(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * _MIX[None, :]).sum(axis=1, dtype=np.uint64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The ratio at each place of laid-out code points from ORDER - 1 on; every expression there is known, or it fails."""
        out = np.zeros(len(codes), np.float32)
        for at in range(ORDER - 1, len(codes), _BLOCK):
            part = codes[at - ORDER + 1 : at + _BLOCK].astype(np.uint64)
            n = len(part) - ORDER + 1
            key = part[:n] * _MIX[0]
            for j in range(1, ORDER):
                key += part[j : j + n] * _MIX[j]
            where = self.first[(key >> self.shift).astype(np.int64)]
            todo = np.flatnonzero(self.sorted[where] != key)
            while len(todo):
                where[todo] += 1
                if (where[todo] >= len(self.sorted)).any() or (self.sorted[where[todo]] > key[todo]).any():
                    raise LookupError("an expression that the model wasn't asked for")
                todo = todo[self.sorted[where[todo]] != key[todo]]
            out[at : at + _BLOCK] = self.ratios[where]
        return out

    def features(self, texts: list) -> np.ndarray:
        """Of each text: mean ratio, the worst stretch of each window's length, ln(1 + length). The first place has no ratio."""
        gap = max(WINDOWS)
        codes, starts, ends = _lay(texts, gap)
        within = _inside(len(codes), starts, ends)
        within[starts] = False
        ratio = np.zeros(len(codes), np.float32)
        # gaps aren't expressions of any text, so runs of texts are looked up with four spaces before each
        for a, b in zip(starts, ends, strict=True):
            ratio[a - ORDER + 1 : b] = self.of(codes[a - ORDER + 1 : b])
        ratio[~within] = 0
        run = np.concatenate(([0.0], np.cumsum(ratio, dtype=float)))
        n = ends - starts
        out = [(run[ends] - run[starts]) / n]
        for w in WINDOWS:
            worst = (run[w:] - run[:-w]) / w
            out.append(np.maximum.reduceat(np.append(worst, np.zeros(w)), np.stack([starts, ends], axis=1).ravel())[::2])
        return np.stack([*out, np.log1p(n)], axis=1)


def _scored_by(lookup: Lookup, batch: pa.RecordBatch) -> pa.RecordBatch:
    x = lookup.features(batch.column(0).to_pylist())
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([*batch.columns[1:], flat], [*batch.schema.names[1:], "_x"])


def features(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """rows with _x, the features, in place of _text, the first column. ratios (g, r) has every expression of the texts.

    Up to SENT_ROWS expressions are sent to all tasks. Beyond it texts are written in chunks, in buckets by chunk; each
    chunk's distinct expressions are joined to their ratios, which then move to the chunks: texts don't move.
    """
    rest = rows.drop("_text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    if ratios.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        got = ratios.select("g", "r").toArrow()
        shared = rows.sparkSession.sparkContext.broadcast(Lookup(got["g"], got["r"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                yield _scored_by(shared.value, batch)

        return rows.mapInArrow(run, f"{kinds}, _x array<double>")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _slices(batches):
            held.append(batch)
            size += batch.column(0).nbytes
            if size >= CHUNK:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([out.getvalue()], pa.binary())], ["_chunk", "_rows"])

    def opened(blob: pa.Scalar) -> pa.RecordBatch:
        return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                texts = opened(batch.column(1)[i]).column(0)
                part = pa.RecordBatch.from_arrays([texts, pa.nulls(len(texts), pa.int32())], ["_text", "_label"])
                grams = list(set().union(*(out.column(0).to_pylist() for out in _count(iter([part])))))
                for at in range(0, len(grams), 100_000):
                    some = pa.array(grams[at : at + 100_000], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch.column(0)[i].as_py(), np.int64)), some], ["_chunk", "g"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                pairs = batch.column(1)[i].values
                lookup = Lookup(pairs.field("g"), pairs.field("r").to_numpy(zero_copy_only=False))
                for one in _slices(iter([opened(batch.column(0)[i])])):
                    yield _scored_by(lookup, one)

    texts = cut_in_buckets(rows.mapInArrow(chunks, "_chunk bigint, _rows binary"), "_chunk", "chunks")
    need = texts.mapInArrow(named, "_chunk bigint, g string")
    own = need.join(ratios.select("g", F.col("r").cast("float").alias("r")), "g").groupBy("_chunk").agg(F.collect_list(F.struct("g", "r")).alias("_ratios"))
    return texts.join(own, "_chunk").select("_rows", "_ratios").mapInArrow(joined, f"{kinds}, _x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Class counts come from all labelled rows of folds 2 to 4, shared counts from all of docs, calibration from fold 1.

    Fold 0 is held out: its labels are never read. Each task adds up its expressions; sums then meet by expression, in tables
    that grow with the corpus and lose none. Calibration reads CALIBRATION_ROWS labelled rows at most, the first by a hash of
    the key. An empty table, or one without labels, gives a model that finds nothing toxic.
    """
    rows = with_label(docs, labels, label, key, text)
    rows = rows.withColumn("_label", F.when(F.col("_fold") >= 2, F.col("_label")))
    grams = cut(expressions(rows), "expressions")
    levels, longer = {}, grams.select(F.col("g").alias("s"))
    for k in range(ORDER - 1, 0, -1):
        levels[k] = longer = cut(longer.groupBy(F.substring("s", -k, k).alias("s")).agg(F.count(F.lit(1)).alias("a")), f"level{k}")
    model = Model(grams, levels)
    model.ratios = cut(model.ratio(grams.select("g")), "ratios")
    of_fold = labels.where(fold(key) == 1)
    sample = with_label(docs, of_fold, label, key, text, "inner", CALIBRATION_ROWS).where("_fold = 1").select("_text", key, "_label")
    found = features(sample, model.ratios).orderBy(F.xxhash64(key), key, "_x").limit(CALIBRATION_ROWS).select("_x", "_label").toArrow()
    x = np.array(found["_x"].to_pylist(), float).reshape(-1, len(WINDOWS) + 2)
    model.calibrate(x, (found["_label"].to_numpy() > 0).astype(float))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", seen: bool = False) -> DataFrame:
    """(key, score): how likely each whole text is toxic, 0 to 1. Nothing but the text counts.

    seen: docs are among those that the model was trained on, so its ratios are at hand; else they are made for the
    expressions of docs. Null and empty texts get what the calibration gives a text of no ratio at all. Repeated rows stay
    repeated, keys keep their type and may be null, other columns are left out; an empty table gives none. A very long text is
    laid out whole in one worker, in some 40 bytes a character.
    """
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(key))
    ratios = model.ratios if seen else cut(model.ratio(expressions(rows.withColumn("_label", F.lit(None).cast("int"))).select("g")), "ratios")
    return features(rows, ratios).select(key, model.probability("_x").alias("score"))
