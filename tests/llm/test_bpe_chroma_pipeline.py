import hashlib
import io
import random
import wave

import numpy as np
import pytest
import regex

from docsieve.llm import bpe, chroma
from tests.llm.conftest import ODD


def test_round_trip_and_digests(spark, docs):
    rows = [*ODD, (10, "It's 12345 tests,\u00a0don't\u2003you  think?\n\n  \r\n end  "), (11, "<|endoftext|> \u0301\ud7ff \u4e2d\u6587 \U0001f468\u200d\U0001f469")]
    df = docs(rows)
    enc = bpe.encoding(*bpe._files(None, None))
    expected = sorted((str(i), enc.encode_ordinary(t or "")) for i, t in rows)
    ids = bpe.encode(df)
    assert sorted((str(r.doc_id), r.ids) for r in ids.collect()) == expected
    back = sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode(ids).collect())
    assert back == sorted((str(i), (t or "").encode()) for i, t in rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(df).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((str(i), len(e := enc.encode_ordinary(t or "")), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())) for i, t in rows)
    assert bpe.digest(docs([])).count() == 0 and bpe.decode(bpe.encode(docs([]))).count() == 0


def test_pieces_change_nothing(monkeypatch):
    enc = bpe.encoding(*bpe._files(None, None))
    rnd = random.Random(1)
    for white in (2, 3, 1000):
        monkeypatch.setattr(bpe, "_WHITE", regex.compile(rf"\p{{White_Space}}{{{white},}}+"))
        for _ in range(200):
            text = "".join(rnd.choice(["a", "B", "9", " ", "  ", "\n", "\n\n\n", "   ", "\x85", "'s", "'", "\u00a0", "\x1c", "\u2003", "-", "é", "\u4e2d", "\u0301", "don't "]) for _ in range(rnd.randrange(80)))
            for size in (1, 7, 20):
                assert "".join(p for p, _ in bpe.pieces(text, size)) == text
                assert bpe.encode_text(enc, text, size) == enc.encode_ordinary(text)


def test_texts_of_millions(spark, docs):
    rows = [(1, " " * 2_000_000), (2, "x" + "\n" * 2_000_000 + "y"), (3, "a" * 2_000_000), (4, "\u4e2d" * 1_000_000), (5, "\t \n" * 700_000 + "end"), (6, "\U0001f600" * 300_000)]
    got = {r.doc_id: r for r in bpe.digest(docs(rows)).collect()}
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert got[1].n_tokens == len(bpe.encoding(*bpe._files(None, None))._encode_single_piece(b" " * 2_000_000))


def tune(seed, seconds=9.0, rate=11025):
    rnd = np.random.default_rng(seed)
    hz = np.repeat(220 * 2 ** (rnd.integers(0, 24, int(seconds * 4)) / 12), rate // 4)
    return np.sin(2 * np.pi * np.cumsum(hz) / rate)


def wav(x, rate=11025):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 20000).astype("<i2").tobytes())
    return out.getvalue()


def test_alignment_against_all_pairs(spark):
    rnd = np.random.default_rng(7)
    tunes = [tune(s) for s in range(12)]
    shift = 3 * chroma.HOP * 2
    rows = [(50 * i, wav(t)) for i, t in enumerate(tunes)]
    rows += [(1001 + 2 * i, wav(t + rnd.normal(0, 0.05, len(t)))) for i, t in enumerate(tunes)]
    rows += [(2001 + 2 * i, wav(t[shift:])) for i, t in enumerate(tunes)]
    rows += [(3001, rows[0][1]), (3003, None), (3005, b""), (3007, b"broken"), (3009, wav(np.zeros(20000))), (3011, wav(tunes[0][:3000])), (None, wav(tunes[1]))]
    df = spark.createDataFrame(rows, "id long, media binary")
    prints = chroma.fingerprints(df, "id", "media")
    assert prints.count() == len(rows)
    out = chroma.align(prints, "id").collect()
    members = [r for r in out if r.n is not None]
    assert len(members) == len(rows)
    by_id = {r.id: tuple(r["print"]) for r in prints.collect() if r.id is not None}
    cls = {r.id: r.class_id for r in members}
    assert all((by_id[a] == by_id[b]) == (cls[a] == cls[b]) for a in by_id for b in by_id)
    reps = {c: by_id[c] for c in set(cls.values()) if c is not None and c in by_id}
    asked = {cls[i] for i in by_id if i % 50 == 0}

    def best(a, b):
        found = 1.0
        for off in range(-len(b) + 16, len(a) - 15):
            x, y = max(0, off), max(0, -off)
            n = min(len(a) - x, len(b) - y)
            if n >= 16:
                found = min(found, sum(bin((p ^ q) & 0xFFFFFFFF).count("1") for p, q in zip(a[x : x + n], b[y : y + n], strict=True)) / 32 / n)
        return found

    exact = {(a, b) for a in asked for b in reps if a != b and reps[a] and reps[b] and best(reps[a], reps[b]) <= 0.2}
    got = {(r.class_id, r.match_id): r for r in out if r.match_id is not None}
    assert set(got) <= exact and len(got) >= 0.9 * len(exact) and len(exact) >= 20
    assert sum(got[50 * i, 2001 + 2 * i].offset == 3 for i in range(12) if (50 * i, 2001 + 2 * i) in got) >= 10
    assert chroma.align(prints.limit(0), "id").count() == 0


def test_played_vectors_that_are_close_sound_alike():
    rnd = np.random.default_rng(3)
    v = rnd.normal(0, 0.125, 64)
    a, b, c = (chroma.fingerprint(*chroma.played(list(x))) for x in (v, v + rnd.normal(0, 0.002, 64), rnd.normal(0, 0.125, 64)))
    error = lambda p, q: np.mean([bin(int(x) & 0xFFFFFFFF).count("1") for x in p ^ q]) / 32
    assert error(a, b) < 0.2 < error(a, c)
    assert len(chroma.fingerprint(*chroma.played(None))) == 0


@pytest.fixture
def corpus_dir(spark, tmp_path):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("bdkmnrst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4)))
    passage = " ".join(word() for _ in range(60))
    docs, labels = [], []
    for i in range(160):
        junk = i % 5 == 4
        body = " ".join(word() + rnd.choice(["%%%", "###"]) * junk for _ in range(150))
        docs.append((i, body + (f"\n{passage}" if i % 10 == 1 else ""), "en", f"src{i % 3}", 0))
        labels.append((i, int(not junk), 0))
    docs += [(500, docs[0][1].replace(" ", "  "), "en", "src1", 0), (501, docs[1][1], "en", None, 0), (502, None, None, None, None)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, passage


def test_pipeline_stages(spark, corpus_dir):
    import corpus_pipeline as p

    d, passage = corpus_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "lines", "near-duplicates", "mixing", "tokens"] and p.ORACLE_SQL is None
    kept = {}
    for name, f in p.STAGES:
        out = f(spark, docs, d)
        if name != names[-1]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = docs.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert {i for i in range(160) if i % 5 != 4} <= ids["quality"] and not any(i % 5 == 4 and i < 160 for i in ids["quality"])
    assert sum(passage in (r.text or "") for r in kept["lines"]) == 1
    assert 0 in ids["near-duplicates"] and 500 not in ids["near-duplicates"]
    assert ids["mixing"] <= ids["near-duplicates"] and ids["tokens"] == ids["mixing"]
    assert len(kept["tokens"]) == len(kept["mixing"])
    whole = sorted((r.doc_id, tuple(r.ids)) for r in p.run(spark, d).collect())
    assert whole == sorted((r.doc_id, tuple(r.ids)) for r in kept["tokens"])


def test_alignment_finds_what_brute_force_finds(spark):
    """Prints with bits in error everywhere, the sign's too; no integer within one bit of its counterpart."""
    rnd = np.random.default_rng(11)
    rows = []
    for i in range(30):
        a = rnd.integers(0, 2**32, 34, np.uint64).astype(np.uint32)
        flips = np.array([np.uint32(1 << 31) | np.uint32(1 << int(j)) for j in rnd.integers(16, 31, 34)], np.uint32) | np.uint32(0b1)
        rows += [(50 * i, a.view(np.int32).tolist()), (5001 + 2 * i, (a ^ flips)[3:].view(np.int32).tolist())]
    out = chroma.align(spark.createDataFrame(rows, "id long, print array<int>"), "id").where("match_id is not null").collect()
    assert {(r.class_id, r.match_id): (r.offset, r.bit_error) for r in out} == {(50 * i, 5001 + 2 * i): (3, 3 / 32) for i in range(30)}


def test_samples_of_three_bytes():
    values = [0, 1, -1, 8388607, -8388608, 123456, -654321]
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(3), f.setframerate(8000)
        f.writeframes(b"".join(v.to_bytes(3, "little", signed=True) for v in values))
    x, rate = chroma.read_wav(out.getvalue())
    assert x.tolist() == values and rate == 8000


def plain_print(x, rate):
    """The definition without integral images: every filter sums its boxes cell by cell."""
    image = chroma.chroma(chroma._resampled(x, rate))
    out = []
    for t in range(len(image) - chroma.SPAN + 1):
        value = 0
        for kind, y, h, w in chroma.FILTERS:
            part = {True: 0.0, False: 0.0}
            for i in range(w):
                for j in range(h):
                    a = {"tone": j < h // 2, "time": i < w // 2, "check": (i < w // 2) == (j < h // 2), "band": h // 3 <= j < 2 * h // 3, "pulse": w // 3 <= i < 2 * w // 3}[kind]
                    part[a] += image[t + i, y + j] * (2 if a and kind in ("band", "pulse") else 1)
            level = np.log((1 + part[True]) / (1 + part[False]))
            value = value << 2 | [0, 1, 3, 2][sum(level >= e for e in (-chroma.LEVEL, 0.0, chroma.LEVEL))]
        out.append(value)
    return np.array(out, np.uint32)


def test_fingerprint_against_plain_sums():
    for seed in range(3):
        x = tune(seed, 4.0) + np.random.default_rng(seed).normal(0, 0.1, 4 * 11025 - 4 * 11025 % 4)[: len(tune(seed, 4.0))]
        got, want = chroma.fingerprint(x, 11025).view(np.uint32), plain_print(x, 11025)
        assert len(got) == len(want) > 5
        assert np.bitwise_count(got ^ want).sum() <= 0.001 * 32 * len(got)  # a sum on the edge of two levels may round either way


def brute(prints, least=16, most=0.2):
    """(query, other): (offset, error) over all offsets."""
    out = {}
    for q, a in prints.items():
        for c, b in prints.items():
            if q % 50 or q == c:
                continue
            best = None
            for off in range(least - len(b), len(a) - least + 1):
                x, y = max(0, off), max(0, -off)
                n = min(len(a) - x, len(b) - y)
                if n >= least:
                    e = int(np.bitwise_count(a[x : x + n] ^ b[y : y + n]).sum()) / (32 * n)
                    if e <= most and (best is None or (e, off) < (best[1], best[0])):
                        best = off, e
            if best:
                out[q, c] = best
    return out


def test_alignment_is_whole_on_prints_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(chroma, "_BLOCK", 200)
    monkeypatch.setattr(chroma, "GROUP", 300)
    rnd = np.random.default_rng(3)
    base = [rnd.integers(0, 2**32, int(n), np.uint64).astype(np.uint32) for n in rnd.integers(16, 90, 25)]
    prints = {}
    for i, a in enumerate(base):
        prints[50 * i] = a
        cut_ = a[int(rnd.integers(0, max(1, len(a) - 16))) :]
        noise = (rnd.random((len(cut_), 32)) < rnd.uniform(0.1, 0.24)).astype(np.uint32) @ (np.uint32(1) << np.arange(32, dtype=np.uint32))
        prints[9001 + 2 * i] = cut_ ^ noise.astype(np.uint32)
    prints |= {7001: base[0][:10], 7003: base[1][:0]}
    rows = [(i, a.view(np.int32).tolist()) for i, a in prints.items()]
    out = chroma.align(spark.createDataFrame([*rows, (None, rows[0][1]), (7005, None), rows[0]], "id long, print array<int>"), "id").collect()
    got = {(r.id, r.match_id): (r.offset, r.bit_error) for r in out if r.match_id is not None}
    assert got == brute(prints) and len(got) > 8
    assert sum(r.n is not None for r in out) == len(rows) + 3
    empty = spark.createDataFrame([], "id long, print array<int>")
    assert chroma.align(empty, "id").count() == 0
    named = spark.createDataFrame([(f"k{i}", p) for i, p in rows], "id string, print array<int>")
    assert chroma.align(named, "id").where("match_id is not null").count() == 0


def test_recall_on_the_registered_table(spark):
    """All matches that a search over all offsets finds among the played vectors of sf0.001 are found, and no other."""
    d = "/root/testdata/sf0.001"
    prints = {r.vec_id: chroma.fingerprint(*chroma.played(r.embedding)).view(np.uint32) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i].tobytes(), i)
    of_class = {min(i for i in prints if prints[i].tobytes() == b): np.frombuffer(b, np.uint32) for b in first}
    from docsieve.llm import queries

    got = {(r.class_id, r.match_id): (r.offset, r.bit_error) for r in queries.op4_chroma(spark, d).where("match_id is not null").collect()}
    assert got == brute(of_class)


def test_undecodable_is_told_from_empty():
    assert chroma.broken(b"RIFFnothing") and not chroma.broken(b"") and not chroma.broken(None) and not chroma.broken(wav(np.zeros(100))) and not chroma.broken(wav(np.zeros(0)))
