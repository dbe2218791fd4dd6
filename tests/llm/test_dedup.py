import hashlib
import random
import unicodedata
from collections import defaultdict

import pytest
import xxhash

from docsieve.llm import lineruns, recipes, simhash
from tests.llm.conftest import ODD

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_duplicates_against_a_dict(docs):
    rnd = random.Random(1)
    long = [" ".join(rnd.choice(["bed", "Kern", "non", "word", "hot"]) for _ in range(3000)) for _ in range(3)]
    rows = ODD + [(20 + i, long[i % 3]) for i in range(9)] + [(40, long[0][:-1] + "x"), (41, "x" + long[0])]
    for chars in (64, 1):  # one hex digit: most digests are of several chunks
        got = recipes.exact_duplicates(docs(rows), key_chars=chars).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[(t or "").translate(UP)].append(i)
        expected = []
        for i, t in rows:
            n = (t or "").translate(UP)
            keep = max((x for x in groups[n] if x is not None), default=None)
            expected.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert recipes.exact_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("script", ["words", "chinese", "russian", "digits", "code", "hindi", "pictures"])
def test_chunks_are_found_again_after_an_insertion(spark, script):
    rnd = random.Random(2)
    made = {
        "words": lambda: rnd.choice(["the ", "re", "ment ", "een", "sum", "er", "ble", "un ", "of ", "ede"]), "chinese": lambda: chr(rnd.randrange(0x4E00, 0x9FA0)), "russian": lambda: chr(rnd.randrange(0x430, 0x450)) + " " * (rnd.random() < 0.2),
        "digits": lambda: rnd.choice("0123456789"), "code": lambda: rnd.choice(["x = y[5];\n", "if (a == b) {", "}\n", "return -1;"]) + str(rnd.randrange(99)), "hindi": lambda: chr(rnd.randrange(0x905, 0x93A)), "pictures": lambda: chr(rnd.randrange(0x1F600, 0x1F650)),
    }[script]
    text = "".join(made() for _ in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "\u65b0new" + text)], "doc_id long, text string")
    a, b = (set(map(bytes, r.recipe)) for r in recipes.recipes(df).collect())
    assert len(a & b) > 0.6 * len(a) and len(a) > 10


def brute_fingerprint(text):
    words = (text or "").translate(UP).encode().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_against_all_pairs(docs):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [r for r in ODD if r[0] not in (7, 8)] + [(7, "word " * 300)]
    for i in range(12):
        base = [rnd.choice(words) for _ in range(300)]
        for j in range(5):
            rows.append((100 + 10 * i + j, " ".join(base)))
            base = list(base)
            base[rnd.randrange(300)] = "changed"
    got = simhash.near_duplicates(docs(rows)).collect()
    assert sorted(map(repr, ((r.doc_id, r.fp % 2**64, r.component_id) for r in got))) == sorted(map(repr, brute_components(rows)))
    assert len({r.component_id for r in got}) < len({r.fp for r in got})
    assert simhash.near_duplicates(docs([])).count() == 0


def test_ball_links_every_distance(spark):
    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(30)]
    for f in list(fps):
        fps += [f ^ 1 << rnd.randrange(64), f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64), f ^ 7 << rnd.randrange(60)]
    signed = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    for distance in (0, 1, 2):
        from docsieve.operators.components import connected_components

        got = {r.a: r.b for r in connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)).collect()}
        for a in signed:
            for b in signed:
                if bin((a ^ b) % 2**64).count("1") <= distance:
                    assert got.get(a, a) == got.get(b, b)
        assert all(any(0 < bin((a ^ b) % 2**64).count("1") <= distance for b in signed) for a in got)


def upper(c):
    return unicodedata.category(c) == "Lu"


def lower(c):
    return unicodedata.category(c) == "Ll"


def parts(text):
    """Cut behind newlines and at seams, told character by character."""
    out, start = [], 0
    for i in range(1, len(text)):
        seam = text[i - 1] == "\n"
        if text[i - 1] in " \t":
            j = i - 1
            while j > 0 and text[j - 1] not in " \t\n":
                j -= 1
            last = text[j : i - 1]
            if last and j > 0:
                ends = last[-1] in ".!?"
                before = text[j - 2] if j > 1 else " "
                if upper(text[i]) and not ends and len(last) <= 62 and (lower(last[0]) or last == "|" or upper(last[0]) and before in ".!?"):
                    seam = True
                if (lower(text[i]) or text[i] == "|") and ends and len(last) <= 61 and (before not in " \t\n.!?" or upper(last[0])):
                    seam = True
        if seam:
            out.append(text[start:i])
            start = i
    return [*out, text[start:]]


def brute_runs(rows, least):
    """Every run of every length is compared: lines of runs of least words or more that are there before, without overlap."""
    rows = sorted(set(rows), key=lambda r: -(2**63) if r[0] is None else r[0])
    seqs = [(d, t, [(i, x.strip()) for i, x in enumerate(parts(t)) if x.split()]) for d, t in rows if t is not None]
    first, gone = {}, defaultdict(set)
    for n, (_, _, lines) in enumerate(seqs):
        words = [len(x.split()) for _, x in lines]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                fewest = sum(words[s:e]) >= least and (sum(words[s + 1 : e]) < least or sum(words[s : e - 1]) < least)
                if fewest:
                    m, at = first.setdefault(tuple(x for _, x in lines[s:e]), (n, s))
                    if (m, at) != (n, s) and not (m == n and s < at + e - s):
                        gone[n] |= set(range(s, e))
    out = {(d, t): t for d, t in rows}
    for n, cut in gone.items():
        d, t, lines = seqs[n]
        drop = set()
        for s in cut:
            drop |= set(range(lines[s][0], lines[s + 1][0] if s + 1 in cut else lines[s][0] + 1))
        out[d, t] = "".join(x for i, x in enumerate(parts(t)) if i not in drop)
    return out


def test_line_runs_against_all_runs(docs):
    rnd = random.Random(5)
    pool = [" ".join(f"{c}{rnd.randrange(99)}" for _ in range(rnd.choice([1, 2, 5, 9]))) for c in "abcdefgh"]
    rows = [r for r in ODD if r[0] not in (7, 8)] + [(7, "word " * 100), (8, "word " * 100)]
    for i in range(40):
        rows.append((10 + i, rnd.choice(["\n", "\n", ". ", " End of it. go on ", " | ", " Yes. no ", ". Now Some "]).join(rnd.choice([*pool, "", "  ", "Big start of it. then"]) for _ in range(rnd.randrange(1, 25)))))
    rows += [(60, rows[-1][1]), (61, rows[-2][1] + "\n" + rows[-3][1]), (62, "one two three four five\n" * 40)]
    for least in (1, 12, 50):
        expected = brute_runs(rows, least)
        got = lineruns.dedup_lines(docs(rows), least).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text in {v for (d, _), v in expected.items() if d == r.doc_id}, (least, r.doc_id)
        assert sorted(str(r.text) for r in got) == sorted(str(expected[x]) for x in rows)
        assert {r.blob for r in got} == {7}
    assert {r.doc_id: r.text for r in got}[62] == "one two three four five\n" * 10  # a whole copy stays
    assert lineruns.dedup_lines(docs([])).count() == 0


def test_passages_inside_lines_go_but_once(spark, docs):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(13) for _ in range(4))
    host = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = [(i, f"Start {h[:149]} {passage} {h[150:]}" if i % 2 else f"{h}\n{passage}\n{h[::-1]}") for i, h in enumerate(host)]
    keyed = docs(rows).selectExpr("concat('key', lpad(doc_id, 3, '0')) doc_id", "text", "lang d", "source t")
    got = {r.doc_id: r.text for r in lineruns.dedup_lines(keyed).collect()}
    assert sum(passage in t for t in got.values()) == 1 and passage in got["key000"]
    assert all(got[f"key{i:03}"].replace(" ", "").replace("\n", "") == t.replace(passage, "").replace(" ", "").replace("\n", "") for i, t in rows if i)


def test_near_copies_of_the_stage_against_all_pairs(spark, docs):
    from docsieve.llm import nearcopies

    rnd = random.Random(5)
    rows = []
    for g in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for c in range(6):
            other = list(words)
            for at in rnd.sample(range(120), c):
                other[at] = f"x{g}_{c}_{at}"
            rows.append((100 * g + c, " ".join(other)))
    rows += [(5000, "short text"), (5001, "Short  text"), (5002, None), (5003, ""), (7, "one id"), (7, "two texts of it"), (5004, "one id"), (None, "no id here"), (None, "no id here"), (None, "short text")]
    sets = [frozenset(nearcopies.shingles((t or "").encode()).tolist()) for _, t in rows]
    near = [[a == b or bool(a | b) and len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if near[i][j]) for i in range(len(rows))]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i][0])
    expected = sorted((min((x for x in g if x is not None), default=-1) for g in groups.values()))
    got = nearcopies.survivors(docs(rows)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == expected and len(groups) < len(rows) - 24
    assert ("two texts of it" in {r.text for r in got}) and nearcopies.survivors(docs([])).count() == 0


def test_near_copies_that_no_band_joins_meet_by_ball_hashing(docs):
    from docsieve.llm import nearcopies

    rows = []
    for seed in (17357, 65216, 110525, 130841):
        rnd = random.Random(seed)
        words = [f"w{rnd.randrange(5000)}" for _ in range(13)]
        rows += [(seed, " ".join(words)), (seed + 1, " ".join([*words[:-1], "other"])), (seed + 2, " ".join(words[::-1]))]
        a, b = (nearcopies.shingles(t.encode()) for _, t in rows[-3:-1])
        assert len(set(a) & set(b)) / len(set(a) | set(b)) == 0.8 and not (nearcopies.bands(a) == nearcopies.bands(b)).any()
    assert sorted(r.doc_id for r in nearcopies.survivors(docs(rows)).collect()) == sorted(i for n, (i, _) in enumerate(rows) if n % 3 != 1)


def test_balls_of_blocks_meet_at_every_distance(spark):
    rnd = random.Random(8)
    fps = {}
    for i in range(200):
        fps[3 * i] = rnd.getrandbits(64)
        for n, bits in enumerate((rnd.randrange(9), 63)):
            fps[3 * i + 1 + n] = fps[3 * i] ^ sum(1 << x for x in rnd.sample(range(64), bits))
    prints = spark.createDataFrame([(v, f - 2**64 if f >= 2**63 else f) for v, f in fps.items()], "v long, fp long")
    for distance in (0, 1, 2, 3, 4, 5, 6, 8):
        buckets = defaultdict(set)
        for r in simhash.meetings(prints, distance).collect():
            buckets[r.k].add(r.v)
        assert all(len(b) > 1 for b in buckets.values())
        met = {(a, b) for x in buckets.values() for a in x for b in x if a < b}
        near = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= distance}
        assert near <= met and (distance == 0 or len(near) > 10)
