"""Media columns: chroma fingerprints of audio, their alignment by offset histograms and bit errors."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.shared import cut

#: Samples a second that are analysed; samples of a frame and between frames; frames that one integer looks at.
RATE, FRAME, HOP, SPAN = 5512, 2048, 682, 16
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: (kind, first pitch class, pitch classes, frames): sums of two parts of a box are compared.
FILTERS = (
    ("tone", 0, 4, 16), ("tone", 4, 4, 12), ("tone", 8, 4, 16), ("tone", 2, 8, 8), ("time", 0, 3, 16), ("time", 3, 3, 8), ("time", 6, 3, 16), ("time", 9, 3, 8),
    ("check", 0, 6, 16), ("check", 6, 6, 16), ("check", 3, 6, 8), ("band", 0, 6, 16), ("band", 6, 6, 8), ("band", 3, 9, 12), ("pulse", 0, 6, 15), ("pulse", 6, 6, 15),
)
#: The middle of four levels on either side of even, as the logarithm of the parts' ratio.
LEVEL = 0.15
#: Integers of the queries that are sent to all tasks at once, 16 MB; integers of a block of prints.
GROUP, _BLOCK = 4_000_000, 1 << 15
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def read_wav(raw: bytes | None) -> tuple[np.ndarray, int]:
    """Samples, mixed to one channel, and their rate; none for null, empty or broken files."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as f:
            width, channels, rate, data = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
        if width == 1:
            x = np.frombuffer(data, np.uint8).astype(float) - 128
        elif width == 3:  # as the upper bytes of 32 bits
            wide = np.zeros((len(data) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
            x = wide.view("<i4").ravel() / 256.0
        else:
            x = np.frombuffer(data[: len(data) // width * width], {2: "<i2", 4: "<i4"}[width]).astype(float)
        return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate
    except (wave.Error, EOFError, KeyError, ValueError):
        return np.empty(0), RATE


def broken(raw: bytes | None) -> bool:
    """Whether there are bytes that read_wav() can't decode."""
    return bool(raw) and not len(read_wav(raw)[0]) and not _opens(raw)


def _opens(raw: bytes) -> bool:
    try:
        with wave.open(io.BytesIO(raw)) as f:
            return f.getsampwidth() in (1, 2, 3, 4)
    except (wave.Error, EOFError):
        return False


def _resampled(x: np.ndarray, rate: int) -> np.ndarray:
    if rate == RATE or not len(x):
        return x
    if rate > RATE:  # a moving mean keeps most of what can't be represented out
        n = max(1, round(rate / RATE))
        x = np.convolve(x, np.ones(n) / n, "same")
    return np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


def _pitch_classes() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = (hz >= 28) & (hz <= 2600)
    out = np.zeros((len(hz), 12))
    out[np.flatnonzero(used), np.mod(np.round(12 * np.log2(hz[used] / 27.5)), 12).astype(int)] = 1
    return out


_CLASSES, _HANN = _pitch_classes(), np.hanning(FRAME)


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames by 12 pitch classes: energy, smoothed over five frames, each frame of length one, or zero if near silent."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    out = np.empty((n, 12))
    for at in range(0, n, 256):
        frames = np.stack([x[i * HOP : i * HOP + FRAME] for i in range(at, min(n, at + 256))]) * _HANN
        out[at : at + 256] = (np.abs(np.fft.rfft(frames)) ** 2) @ _CLASSES
    padded = np.pad(out, ((2, 2), (0, 0)), "edge")
    out = sum(w * padded[i : i + n] for i, w in enumerate(_SMOOTH))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-3, out / np.maximum(size, 1e-12), 0.0)


def _parts(box: Callable, kind: str, y: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The two sums a filter compares; box(x0, x1, y0, y1) has a sum for each place."""
    whole = box(0, w, y, y + h)
    if kind == "tone":
        a = box(0, w, y, y + h // 2)
    elif kind == "time":
        a = box(0, w // 2, y, y + h)
    elif kind == "check":
        a = box(0, w // 2, y, y + h // 2) + box(w // 2, w, y + h // 2, y + h)
    elif kind == "band":
        return 2 * box(0, w, y + h // 3, y + 2 * h // 3), whole - box(0, w, y + h // 3, y + 2 * h // 3)
    else:
        return 2 * box(w // 3, 2 * w // 3, y, y + h), whole - box(w // 3, 2 * w // 3, y, y + h)
    return a, whole - a


def fingerprint(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Packed 32-bit integers, one a frame from which SPAN frames follow: two Gray bits of each of 16 filters."""
    image = chroma(_resampled(np.asarray(x, float), rate))
    n = len(image) - SPAN + 1
    if n < 1:
        return np.empty(0, np.int32)
    sums = np.zeros((len(image) + 1, 13))
    sums[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    box = lambda x0, x1, y0, y1: sums[x1 : x1 + n, y1] - sums[x0 : x0 + n, y1] - sums[x1 : x1 + n, y0] + sums[x0 : x0 + n, y0]
    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        a, b = _parts(box, kind, y, h, w)
        value = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        out = (out << np.uint32(2)) | _GRAY[np.digitize(value, (-LEVEL, 0.0, LEVEL))]
    return out.view(np.int32)


def fingerprints(rows: DataFrame, key: str, media: str, decode: Callable = read_wav) -> DataFrame:
    """(key, print): array of integers of the media column, which decode turns into (samples, rate); WAV unless told otherwise.

    What is null, empty, shorter than SPAN frames or not decodable (compressed, floating-point or broken WAV) has an empty
    print; broken() tells those apart. A recording is held whole by one worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                out = [fingerprint(*decode(x.as_py())).tolist() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int32()))], [key, "print"])

    kept = rows.select(F.col(key), F.col(media).alias("_media"))
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, print array<int>")


def _blocks(ids: list, prints: pa.ListArray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, sizes, integers, padded with zeros) in parts of about _BLOCK integers, of like sizes."""
    flat, edge = prints.flatten().to_numpy(), prints.offsets.to_numpy()
    edge = edge - edge[0]
    sizes, at = np.diff(edge), 0
    order = np.argsort(sizes, kind="stable")
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * sizes[order[end]] <= _BLOCK:
            end += 1
        some = order[at:end]
        wide = np.zeros((len(some), sizes[some[-1]]), np.int32)
        for row, i in zip(wide, some, strict=True):
            row[: sizes[i]] = flat[edge[i] : edge[i + 1]]
        yield [ids[i] for i in some], sizes[some], wide
        at = end


def _signs(sizes: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Bits as 1 and -1, 32 columns an integer; 0 beyond a print's end."""
    bits = np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    bits[np.repeat(np.arange(wide.shape[1])[None, :] >= sizes[:, None], 32, axis=1)] = 0
    return bits


def compared(asked: tuple, other: tuple, least_overlap: int, most_error: float) -> list[tuple]:
    """(i, j, offset, agreeing bits, bit error) of the pairs of two blocks that match, each by its best offset.

    An offset's place in the histogram is how many bits of the integers that it lays over each other agree. A matrix product
    of the signs, which counts agreeing bits less differing ones, gives it for all pairs at once, for every offset.
    """
    (_, n, a), (_, m, b) = asked, other
    x, y = _signs(n, a), _signs(m, b)
    found = []
    for offset in range(least_overlap - b.shape[1], a.shape[1] - least_overlap + 1):
        p, q = max(0, offset), max(0, -offset)
        w = min(a.shape[1] - p, b.shape[1] - q)
        overlap = np.minimum((n - p)[:, None], (m - q)[None, :])
        total = x[:, 32 * p : 32 * (p + w)] @ y[:, 32 * q : 32 * (q + w)].T
        i, j = np.nonzero((total >= 32 * (1 - 2 * most_error) * overlap - 1e-3) & (overlap >= least_overlap))
        bits = 32 * overlap[i, j].astype(np.int64)
        wrong = (bits - np.rint(total[i, j]).astype(np.int64)) // 2
        found.append((i, j, np.full(len(i), offset), bits - wrong, wrong / bits))
    if not found:
        return []
    i, j, offset, agree, error = map(np.concatenate, zip(*found, strict=True))
    keep = error <= most_error
    order = np.lexsort((offset, error, j, i))
    order = order[keep[order]]
    first = np.concatenate(([True], (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0))) if len(order) else np.zeros(0, bool)
    return [(int(i[k]), int(j[k]), int(offset[k]), int(agree[k]), float(error[k])) for k in order[first]]


def _searched(classes: DataFrame, asked: list, least_overlap: int, most_error: float) -> DataFrame:
    """(query_id, class_id, offset, votes, bit_error) of classes against a group of queries, which all tasks hold."""
    kind = classes.schema["class_id"].dataType.simpleString()
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for other in _blocks(batch.column(0).to_pylist(), batch.column(1)):
                out = [(q[0][i], other[0][j], *rest) for q in shared.value for i, j, *rest in compared(q, other, least_overlap, most_error) if q[0][i] != other[0][j]]
                if out:
                    ids = batch.schema.field(0).type
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], ids), pa.array(cols[1], ids), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())], ["query_id", "class_id", "offset", "votes", "bit_error"])

    return classes.select("class_id", "print").mapInArrow(run, f"query_id {kind}, class_id {kind}, offset int, votes bigint, bit_error double")


def align(prints: DataFrame, key: str, every: int = 50, least_overlap: int = 16, most_error: float = 0.2) -> DataFrame:
    """A row for each recording (key, class_id, n, match and what follows null), then one for each match of a query class.

    Recordings of one print are a class, named by its least key. Queries are the classes with a key divisible by every; they
    are searched in all classes. For each pair the bits that agree are counted at every offset at which at least
    least_overlap integers lie over each other: the pair's histogram of offsets. It matches if at some offset at most
    most_error of the bits are in error, and the offset of least errors (of equal ones the least) is given. Nothing is looked
    up by a key that an error could change, so no match is missed. Matches are (key: the query's class, class_id, match_id:
    the other class, offset, votes: agreeing bits, bit_error).

    Silent or short recordings, whose print is null or empty, form one class without matches. Recordings without a key are in
    a class but name none; a class of nothing else has a null class_id and isn't searched. Keys that aren't numbers ask
    nothing. Repeated rows stay repeated; an empty table gives none; other columns are left out. Queries go to the tasks in
    groups of about GROUP integers, by hash, a pass over the classes for each; no pair is a row of any table unless it matches.
    """
    digest = F.sha2(F.concat_ws(",", F.coalesce("print", F.array().cast("array<int>")).cast("array<string>")), 256)
    own = cut(prints.select(F.col(key).alias("_id"), "print", digest.alias("_h")), "prints")
    asks = F.coalesce(F.col("_id").try_cast("long") % every == 0, F.lit(False)).cast("int")
    classes = own.groupBy("_h").agg(F.min("_id").alias("class_id"), F.max(asks).alias("asks"), F.first("print").alias("print"))
    classes = cut(classes.where("class_id is not null"), "classes")
    able = classes.where(F.size("print") >= least_overlap)
    asked = able.where("asks = 1")
    groups = -(-(asked.agg(F.sum(F.size("print"))).first()[0] or 0) // GROUP)
    null = lambda kind: F.lit(None).cast(kind)
    out = own.join(classes.select("_h", "class_id"), "_h", "left")
    out = out.select(F.col("_id").alias(key), "class_id", F.coalesce(F.size("print"), F.lit(0)).alias("n"), null(classes.schema["class_id"].dataType).alias("match_id"), null("int").alias("offset"), null("bigint").alias("votes"), null("double").alias("bit_error"))
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64("class_id"), F.lit(groups)) == g).select("class_id", "print").toArrow().combine_chunks()
        blocks = [x for part in some.to_batches() for x in _blocks(part.column(0).to_pylist(), part.column(1))]
        found = cut(_searched(able, blocks, least_overlap, most_error), f"matches{g}")
        out = out.unionByName(found.select(F.col("query_id").alias(key), F.col("query_id").alias("class_id"), null("int").alias("n"), F.col("class_id").alias("match_id"), "offset", "votes", "bit_error"))
    return out


def played(vector: list[float] | None, note_s: float = 0.1) -> tuple[np.ndarray, int]:
    """A vector as a recording: a note for each component, two octaves about 440 Hz by its place between -0.5 and 0.5.

    It stands in for media where a table has none; vectors that are close sound alike.
    """
    if not vector:
        return np.empty(0), RATE
    v = np.nan_to_num(np.asarray(vector, float))
    hz = 440 * 2 ** np.clip(2 * v, -1.5, 1.5)
    phase = 2 * np.pi * np.cumsum(np.repeat(hz, round(note_s * RATE))) / RATE
    return np.sin(phase) + 0.3 * np.sin(2 * phase), RATE
