import pytest

from docsieve.operators import audit, search
from docsieve.operators.index import Index
from tests.vaults import DAY, NOW, F, build, by, records

STRUCTURE = {
    "policies/alpha.md": "---\ntitle: Alpha Policy\nauthority: controlled\ntags: [security, controlled]\n---\nIntro #inline-tag [[Beta Note]]\n## Purpose\nWhy it is so.\n## Scope\nWhere it applies.",
    "notes/beta.md": "# Beta Note\nSee [[alpha]] for the rule.",
    "controlled-dir/gamma.md": "Gamma stands alone here with no link at all to any other note in the vault.",
}


@pytest.fixture(scope="module")
def structure(spark):
    return build(spark, STRUCTURE, folders=("controlled-dir",))


def test_index_structure(structure, tmp_path, spark):
    notes = by(structure.notes, "rel")
    a, b, g = (notes[k] for k in STRUCTURE)
    assert a.outlinks == ["Beta Note"] and set(a.tags) == {"inline-tag", "security", "controlled"} and (a.title, a.folder) == ("Alpha Policy", "policies")
    assert (a.controlled, b.controlled, g.controlled) == (True, False, True) and (a.inbound, b.inbound, g.inbound) == (1, 1, 0)
    chunks = structure.chunks.orderBy("chunk_id").collect()
    assert [c.chunk_id for c in chunks] == list(range(len(chunks))) and {"Purpose", "Scope"} <= {c.heading for c in chunks}
    structure.write(f"file://{tmp_path}/ix")
    again = Index.read(spark, f"file://{tmp_path}/ix")
    assert search.search(again, "scope")["hits"] == search.search(structure, "scope")["hits"] != []


@pytest.fixture(scope="module")
def topics(spark):
    files = {
        "k8s.md": "# Kubernetes scaling\nScaling clusters needs pods and nodes. The deployment was scaled twice.",
        "pasta.md": "# Pasta\nBoil water, add salt. Kubernetes is not pasta.",
        "budget.md": "# Budget\nThe white rust fungus. Rust on white walls is another thing entirely.",
        "phrase.md": "# Fungus\nThere is white rust on the leaves of the plants.",
        "scatter.md": "# Walls\nWhite walls. Old rust. White paint and rust and white rust-proofing of white rust free rust.",
        "rule38.md": "# Rules\nRule 3.8 governs the prosecutor.",
        "rule39.md": "# Rules again\nRule 3.9 governs the advocate.",
        "ord.md": "# Ordinance 2026-04\nOrdinance 2026-04 sets the cap at 90 days in 2026.",
        "minutes.md": "# Minutes of 2026-03\nIn 2026 the council took up the ordinance again.",
    }
    return build(spark, files, mtimes={"k8s.md": NOW - 400 * DAY})


def test_ranking(topics):
    first = lambda q: search.search(topics, q)["hits"][0]["note"]
    assert first("kubernetes scaling") == "k8s.md"
    assert first("pasta water") == "pasta.md"
    assert first("Rule 3.8") == "rule38.md" and first("Rule 3.9") == "rule39.md"
    assert first("the white rust") in ("phrase.md", "budget.md", "scatter.md")
    hits = search.search(topics, "white rust", k=2, per_note=1)["hits"]
    assert len(hits) == 2 and len({h["note"] for h in hits}) == 2 and hits[0]["coverage"] == "2/2"


def test_gate_refuses_what_the_corpus_lacks(topics):
    assert search.search(topics, "zenith corporation balfour rule", strictness=0.7)["weak"]
    good = search.search(topics, "certified clusters scaled", strictness=0.5)
    assert search.search(topics, "scaled clusters", strictness=0.7)["confidence"] > 0.6 and good["mode"] == "lexical"
    real, fake = (search.search(topics, f"ordinance {x}", strictness=0.75) for x in ("2026-04", "2026-11"))
    assert not real["weak"] and fake["weak"] and real["confidence"] - fake["confidence"] > 0.2
    assert search.search(topics, "the of and") == {"hits": [], "confidence": 0.0, "weak": True, "info_share": 0.0, "qterms": [], "mode": "lexical"}


def test_phrases_and_clock(spark, topics):
    assert search.phrases("the white rust of leaves") == ["white rust", "rust leaves"] or search.phrases("the white rust of leaves") == ["white rust", "rust leaves"]
    df = spark.createDataFrame([("white rust and old rust",), ("rust white",)], "t string").select(search.phrase_boost(F.col("t"), ["white rust", "old rust"]))
    assert [r[0] for r in df.collect()] == [2.5, 1.0]
    score = lambda now: [h["score"] for h in search.search(topics, "kubernetes", now_ms=now)["hits"]]
    assert score(None) == score(None) and score(NOW) != score(NOW - 400 * DAY)


def test_hybrid_gate(spark, topics):
    constant = lambda x: topics.chunks.select("chunk_id", F.lit(x).alias("sem"))
    assert search.search(topics, "widget", semantic=constant(0.2))["weak"]
    assert not search.search(topics, "widget", semantic=constant(0.75))["weak"]
    out = search.search(topics, "kubernetes scaling", semantic=constant(0.75))
    assert out["mode"] == "hybrid" and not out["weak"] and out["hits"][0]["sem"] == 0.75 and out["confidence"] <= 1


AUDIT = {"orphan.md": "Nothing links to this one and it links to nothing, though it has words enough in it.", "hasbroken.md": "[[Ghost Note]] and more words so that this isn't a stub at all, really it is not.", "dup-a.md": "---\ntitle: Shared Title\n---\ntwelve words are needed here so that this one is no stub [[dup-b]]", "dup-b.md": "---\ntitle: Shared Title\n---\ntwelve words are needed here so that this other is no stub [[dup-a]]", "stub.md": "short #tag"}


def test_audit(spark):
    ix = build(spark, AUDIT)
    found = {k: v.collect() for k, v in audit.findings(ix.notes, ix.names, NOW).items()}
    assert [(r["from"], r.link) for r in found["broken_links"]] == [("hasbroken.md", "Ghost Note")]
    assert [(r.title, r.notes) for r in found["duplicate_titles"]] == [("shared title", ["dup-a.md", "dup-b.md"])]
    assert {r.note for r in found["orphans"]} == {"orphan.md", "stub.md"} and {r.note for r in found["stubs"]} == {"stub.md"}
    assert {r.note for r in found["untagged"]} == set(AUDIT) - {"stub.md"} and not found["stale"]
    assert {r.kind: r.n for r in audit.counts(audit.findings(ix.notes, ix.names, NOW)).collect()} == {k: len(v) for k, v in found.items()}


FM = "---\ntags: [a]\n---\n"
CLEAN = {"a.md": f"---\ntags: [a]\nauthority: controlled\n---\n[[b]] and many more words that make this a proper note of some length", "b.md": f"{FM}[[c]] and many more words that make this a proper note of some length", "c.md": f"{FM}[[a]] and many more words that make this a proper note of some length"}


def test_clean_report_is_a_hundred(spark):
    ix = build(spark, CLEAN)
    r = audit.report(ix, NOW)
    assert (r["integrity_score"], r["grade"], r["controlled_coverage"]) == (100, "A", {"controlled": 1, "total": 3})
    assert audit.report(ix, NOW)["report_sha256"] == r["report_sha256"] != audit.report(ix, NOW, vault="x")["report_sha256"]


def test_penalties_and_caps(spark):
    files = CLEAN | {"x.md": f"{FM}[[Ghost]] words words words words words words words words words words words words", "old.md": f"{FM}TODO words words words words words words words words words words words", "d1.md": "---\ntitle: Same\n---\n#t [[a]] words", "d2.md": "---\ntitle: Same\n---\n#t [[a]] words"}
    ix = build(spark, files, mtimes={"old.md": NOW - 400 * DAY})
    p = audit.report(ix, NOW)["penalties"]
    assert (p["broken_links"], p["duplicate_titles"], p["stale"], p["orphans"]) == (6, 3, 4, 2)
    pair = {"both_controlled": True, "relation": "contradict"}
    assert audit.report(ix, NOW, pairs=[pair, pair | {"both_controlled": False}], adjudicated=True)["penalties"]["contradictions"] == 23
    assert audit.report(ix, NOW, pairs=[{"both_controlled": False}] * 30)["penalties"]["contradictions"] == 10


def test_raw_archives_have_no_orphan_penalty(spark):
    raw = build(spark, {f"n{i}.md": f"note number {i} with words" for i in range(10)})
    r = audit.report(raw, NOW)
    assert r["raw_archive"] and r["penalties"]["orphans"] == 0
    curated = build(spark, {f"n{i}.md": f"---\nowner: x\n---\nnote number {i}" for i in range(10)})
    assert not audit.report(curated, NOW)["raw_archive"]


def test_drift_and_events(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "kind string, item_key string")
    a, b = make(("broken_links", "a->x"), ("orphans", "o.md")), make(("broken_links", "a->x"), ("broken_links", "b->y"), ("stale", "s.md"), ("confirmed", "p <> q"), ("stubs", "z.md"))
    changes = audit.drift(a, b)
    assert {(r.change, r.item_key) for r in changes.collect()} == {("new", "b->y"), ("new", "s.md"), ("new", "p <> q"), ("new", "z.md"), ("resolved", "o.md")}
    assert {(r.severity, r.type) for r in audit.events(changes, 100, 85).collect()} == {("high", "new_contradiction"), ("medium", "new_broken_link"), ("low", "newly_stale"), ("medium", "score_drop")}
    assert audit.events(changes, 100, 96).where("type = 'score_drop'").count() == 0 and audit.events(changes, None, 50).count() == 0


def test_derived_cards_are_never_findings(spark):
    ix = build(spark, {"cards/arr.md": "one", "governed/metric.md": "two"})
    assert {r.note for r in audit.orphans(ix.notes).collect()} == {"governed/metric.md"}
    assert records(spark, {"cards/arr.md": "one"}).count() == 1
