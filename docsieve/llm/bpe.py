"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import public_tokenizers

#: Texts beyond this many characters are encoded in pieces that end at safe boundaries.
PIECE = 50_000
#: Where a match of the pattern always ends: after a letter or digit, before a space. No match spans it, and no
#: look-ahead of an earlier match sees past it, as the character before it isn't white space.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?= )")
#: White space of this length is a match of its own, but for the last character if something follows. The library's
#: matcher overflows its stack on about a million of them, so they are taken out beforehand.
WHITE = 1_000
_WHITE = regex.compile(rf"\p{{White_Space}}{{{WHITE},}}+")
#: Output rows are flushed at this many ids or bytes.
_FLUSH = 2_000_000


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cuts(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while end - at > size:
        cut = _SAFE.search(text, at + size, end)
        if not cut or cut.start() >= end:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < end:
        yield text[at:end]


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """(part, whole) of text, in order: parts cut at the first safe boundary from size characters on, and long white space, each one match."""
    at = 0
    for white in _WHITE.finditer(text):
        end = white.end() if white.end() == len(text) else white.end() - 1
        yield from ((part, False) for part in _cuts(text, at, white.start(), size))
        yield text[white.start() : end], True
        at = end
    yield from ((part, False) for part in _cuts(text, at, len(text), size))


def encode_text(enc, text: str | None, size: int = PIECE) -> list[int]:
    """Ids of a text. Only the default pattern is known to end at pieces() as it should: with another, texts go in whole."""
    if not text:
        return []
    if len(text) <= size or enc._pat_str != public_tokenizers.PATTERN:
        return enc.encode_ordinary(text)
    return [i for part, whole in pieces(text, size) for i in (enc._encode_single_piece(part.encode()) if whole else enc.encode_ordinary(part))]


def decode_ids(enc, ids: list[int]) -> bytes:
    """The raw bytes of ids; they need not be whole UTF-8."""
    return enc.decode_bytes(ids)


def _files(rank_file: str | None, pattern: str | None) -> tuple[str, str]:
    """Asked in the task: the default file has a path of its own on each machine."""
    return rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _mapper(rank_file: str | None, pattern: str | None, key: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(*_files(rank_file, pattern))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            done, out, held = 0, [], 0
            for i in range(len(texts)):
                ids = encode_text(enc, texts[i].as_py())
                if kind == "ids":
                    out.append(ids)
                else:
                    raw = decode_ids(enc, ids)
                    out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
                held += len(ids) if kind == "ids" else 200
                if held >= _FLUSH:
                    yield pack(keys.slice(done, i + 1 - done), out)
                    done, out, held = i + 1, [], 0
            if out:
                yield pack(keys.slice(done), out)

    def pack(keys, out):
        if kind == "ids":
            return pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.list_(pa.int32()))], [key, "n_tokens", "ids"])
        n, a, b = zip(*out)
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _run(docs: DataFrame, kind: str, columns: str, rank_file, pattern, key, text) -> DataFrame:
    kept = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return kept.mapInArrow(_mapper(rank_file, pattern, key, kind), f"`{key}` {kept.schema[key].dataType.simpleString()}, {columns}")


def encode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): each whole text's ids, every match of pattern merged by itself, without special tokens.

    A null or empty text gives no ids. Repeated rows stay repeated, an empty table gives none, other columns are left out.
    A text may be of any length, a single match of millions of characters too. Columns of docs named n_tokens or ids don't
    clash, as they are left out. No shuffle; a worker holds one batch of texts and a flush of ids.
    """
    return _run(docs, "ids", "n_tokens bigint, ids array<int>", rank_file, pattern, key, text)


def digest(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): as encode(), then decoded again, in digests that move little."""
    return _run(docs, "digest", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", rank_file, pattern, key, text)


def decode(tokens: DataFrame, rank_file: str | None = None, pattern: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the ids' raw bytes, binary as ids can end inside a character. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(*_files(rank_file, pattern))
        for batch in batches:
            raw = [decode_ids(enc, x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [key, "decoded"])

    kept = tokens.select(F.col(key), F.col(ids).alias("_ids"))
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, decoded binary")
