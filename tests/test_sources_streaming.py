import io
import json
import time
import zipfile
import zlib

import pytest

from docsieve.operators.ledger import Ledger, verify
from docsieve.sources import extract, transcripts, vault, wiki
from docsieve.streaming import watch
from tests.vaults import F


W = 'xmlns:w="urn:w"'


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:p><w:t>{text}</w:t><w:tab/><w:t>B &amp; C</w:t></w:p><w:p><w:t>Next</w:t></w:p></w:document>")
    return out.getvalue()


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("_", "/") + ".xml", xml)
    return out.getvalue()


def pdf(text, flate=True):
    stream = f"BT /F1 12 Tf ({text}) Tj ET".encode("latin-1")
    body = zlib.compress(stream) if flate else stream
    return b"%PDF-1.4\n1 0 obj << /Length " + str(len(body)).encode() + (b" /Filter /FlateDecode" if flate else b"") + b" >> stream\n" + body + b"\nendstream endobj\n%%EOF"


def test_extractors():
    assert extract.extract(docx("Alpha"), ".docx") == {"text": "Alpha\tB & C\nNext", "ok": True, "note": ""}
    slides = office(ppt_slides_slide10=f"<a {W}><w:p><w:t>ten</w:t></w:p></a>", ppt_slides_slide2=f"<a {W}><w:p><w:t>two</w:t></w:p></a>")
    assert extract.extract(slides, ".pptx")["text"] == "two\n\nten"
    sheet = office(xl_sharedStrings=f"<a {W}><w:si><w:t>shared</w:t></w:si></a>", xl_worksheets_sheet1=f"<a {W}><w:t>inline</w:t></a>")
    assert extract.extract(sheet, ".xlsx")["text"].split() == ["shared", "inline"]
    rtf = rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x;}Hello\par W\'f6rld \{ok\}}"
    assert extract.extract(rtf, ".rtf")["text"] == "Hello\nWörld {ok}"
    for flate in (True, False):
        assert extract.extract(pdf("A readable line of text"), ".pdf")["text"] == "A readable line of text"
    assert not extract.extract(pdf("ab"), ".pdf")["ok"] and not extract.extract(b"%PDF nothing", ".pdf")["ok"]
    assert extract.readable(" ".join("abcdefghijklmnopqrstuvwxyz")) == "letters without words"
    for ext in (".docx", ".xlsx", ".pptx"):
        assert not extract.extract(b"broken", ext)["ok"]
    assert not extract.extract(b"", ".zip")["ok"] and not extract.extract(None, ".pdf")["ok"]


def slow(raw, ext):
    time.sleep(30)


def test_scan_extract_and_time_limit(spark, tmp_path):
    for d in ("sub", "node_modules", ".hidden"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "in.md").write_text(f"# In {d}")
    (tmp_path / "UP.MD").write_text("---\ntitle: Upper\n---\nbody")
    (tmp_path / "a.docx").write_bytes(docx("Office text"))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing in it")
    root = f"file://{tmp_path}"
    exts = (".md", ".docx", ".pdf")
    rows = {r.rel: r for r in vault.records(spark, root, exts).collect()}
    assert set(rows) == {"sub/in.md", "UP.MD", "a.docx", "bad.pdf"}
    assert rows["UP.MD"].title == "Upper" and rows["a.docx"].body.startswith("Office text") and "not extractable" in rows["bad.pdf"].body
    late = {r.rel: r for r in vault.records(spark, root, exts, timeout_ms=300, fn=slow).collect()}
    assert late["bad.pdf"].timed_out and "EXTRACT_TIMEOUT" in late["bad.pdf"].body and not late["UP.MD"].timed_out
    ocr = {r.rel: r for r in vault.records(spark, root, exts, ocr=lambda raw: "read by eye").collect()}
    assert ocr["bad.pdf"].body == "read by eye"


def test_documents_and_changes(spark):
    raw = spark.createDataFrame([("k.md", "hello", None, "T1"), (None, None, None, None), ("p", "see [[X]] #tag", ["y"], "P")], "key string, body string, tags array<string>, title string")
    docs = vault.documents(raw, "src", 7)
    a, b, p = docs.collect()
    assert (a.id, a.content_hash, a.updated_at, a.tags) == ("src:k.md", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824", 7, [])
    assert (b.title, b.body, b.metadata) == ("Untitled", "", {})
    r = {x.rel: x for x in vault.document_records(docs).collect()}
    assert r["k.md"].name == "k" and r["p"].tags == ["y", "tag"] and r["p"].outlinks == ["X"] and r["p"].name == "P"
    edited = docs.withColumn("content_hash", F.when(F.col("key") == "p", "x").otherwise(F.col("content_hash")))
    assert [x.key for x in vault.changed(docs, edited).collect()] == ["p"] and vault.changed(docs.limit(0), docs).count() == 3
    src, dst = spark.createDataFrame([("a/b.md", 5), ("c.md", 5), ("d.md", 5)], "rel string, mtime_ms long"), spark.createDataFrame([("a__b.md", 4), ("c.md", 5)], "name string, mtime_ms long")
    assert {x.rel for x in vault.stale_copies(src, dst).collect()} == {"a/b.md", "d.md"}


def test_connectors(spark, tmp_path):
    (tmp_path / "n.md").write_text("# N\ntext")
    reg = vault.Connectors()
    reg.register("folder", lambda **o: vault.FolderConnector(spark, **o))
    reg.register("broken", lambda **o: object())
    c = reg.get("folder", folder=f"file://{tmp_path}")
    assert c.healthcheck() == {"ok": True, "detail": "1 files"} and c.documents().first().title == "N"
    assert not vault.FolderConnector(spark, "file:///no/such").healthcheck()["ok"]
    for name, error in (("broken", TypeError), ("none", KeyError)):
        with pytest.raises(error):
            reg.get(name)


PAGES = {str(i): {"id": str(i), "status": "current", "title": f"Page {i}", "spaceId": "9", "version": {"number": i, "createdAt": "2026-01-02T03:04:05.000Z", "authorId": "u"}, "body": {"storage": {"value": f"<h2>Head</h2><p>See <ac:link><ri:page ri:content-title=\"Other\"/></ac:link> &amp; more</p><ul><li>one</li></ul>"}}, "_links": {"webui": f"/p/{i}"}} for i in range(1, 4)}


def recorded(url, headers):
    assert headers["Authorization"].startswith("Basic ")
    if "/labels" in url:
        return {"results": [{"name": "Policy"}] if "/1/" in url else []}
    if "/spaces" in url:
        return {"results": [{"id": 9}]}
    if "cursor" in url:
        return {"results": [PAGES["3"]]}
    return {"results": [PAGES["1"], PAGES["2"]], "_links": {"next": "/wiki/api/v2/pages?cursor=x"}}


def test_wiki_pages(spark):
    options = {"base_url": "https://example.org/", "email": "e", "token": "t", "space_keys": "A"}
    con = wiki.WikiConnector(spark, recorded, **options)
    docs = {d.key: d for d in con.documents().collect()}
    assert set(docs) == {"1", "2", "3"} and docs["1"].controlled and not docs["2"].controlled and docs["1"].tags == ["policy"]
    assert docs["3"].links == ["Other"] and docs["3"].body == "## Head\n\nSee [[Other]] & more\n\n- one" and docs["3"].uri == "https://example.org/wiki/p/3" and docs["2"].version == "2"
    assert con.healthcheck()["ok"] and "missing" in wiki.WikiConnector(spark, recorded, base_url="x").healthcheck()["detail"]


def test_storage_text():
    t = extract.storage_to_text
    assert t("<p>a &lt;b&gt; &#233;&#xe9;</p><hr/><table><tr><td>x</td><td>y</td></tr></table>") == "a <b> éé\n\n---\n\nx | y |"
    assert t("<!-- c --><![CDATA[code]]><ac:link><ac:plain>body</ac:plain></ac:link> years </strong>.") == "code body years."
    assert t(None) == "" and extract.decode_entities("&amp;lt;") == "&lt;"


def test_transcripts(spark, tmp_path):
    lines = [{"timestamp": "2026-01-02T00:00:00Z", "message": {"role": "user", "content": "<tag> skip as title"}}, {"message": {"role": "user", "content": "What is it?"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "It is"}, {"type": "tool", "x": 1}, {"type": "text", "text": "this."}]}}, {"message": {"role": "system", "content": "no"}}, {"message": {"role": "user", "content": "[Request interrupted by user]"}}]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json")
    r = transcripts.session_logs(spark, f"file://{tmp_path}/s1.jsonl").first()
    assert (r.id, r.date, r.title, r.n_turns) == ("s1", "2026-01-02", "What is it?", 3) and r.body.endswith("**assistant:** It is\n\nthis.")
    chat = [{"id": "c1", "title": "T", "create_time": 1.7e9, "mapping": {"b": {"message": {"create_time": 2.0, "author": {"role": "assistant"}, "content": {"parts": ["second"]}}}, "a": {"message": {"create_time": 1.0, "author": {"role": "user"}, "content": {"parts": ["first", ""]}}}, "r": {"message": None}}}]
    (tmp_path / "conversations1.json").write_text(json.dumps(chat))
    c = transcripts.chat_exports(spark, f"file://{tmp_path}/conversations1.json").first()
    assert c.body == "**user:** first\n\n**assistant:** second" and c.date == "2023-11-14"
    (tmp_path / "turn1.jsonl").write_text('{"ts":"t","kind":"k","response_text":"x"}\n{"payload":{"a":1}}\n{}')
    assert [(t.role, t.text) for t in transcripts.turn_logs(spark, f"file://{tmp_path}/turn1.jsonl").orderBy("line").collect()] == [("k", "x"), (None, '{"a":1}')]
    rows = spark.createDataFrame([("2026-01-01",), ("2026-02-01",)], "date string")
    assert transcripts.since(rows, "2026-01-15").count() == 1 and transcripts.since(rows, None).count() == 2


def test_reindexing_follows_changes(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.md").write_text("one")
    runs = []

    def rebuild(should_abort):
        runs.append(should_abort())
        if len(runs) == 2:
            raise RuntimeError("lost")

    r = watch.Reindexer(spark, f"file://{tmp_path}/v", rebuild)
    assert r.step() and not r.step() and len(runs) == 1
    (tmp_path / "v" / "b.md").write_text("two")
    assert r.step() and r.failures == ["lost"] and r.step() and not r.step() and len(runs) == 3
    q = r.start(f"file://{tmp_path}/cp", "200 milliseconds")
    try:
        (tmp_path / "v" / "c.md").write_text("three")
        end = time.time() + 40
        while len(runs) < 4 and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert len(runs) >= 4


def test_surveillance_cycles(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame([("broken_links", r) for r in rows], "kind string, item_key string")
    states = iter([(make("a"), 100), (make("a"), 100), (make("a", "b"), 80)])
    led, got = Ledger(spark, f"file://{tmp_path}/l.jsonl", now=lambda: "t"), []
    fail = watch.webhook_sink("http://x", lambda url, body: 1 / 0)
    s = watch.Surveillance(spark, f"file://{tmp_path}/state", lambda: next(states), [got.extend, fail, watch.file_sink(str(tmp_path / "out.jsonl"))], led, "v")
    assert [s.cycle()["events"] for _ in range(3)] == [0, 0, 2]
    assert {e["type"] for e in got} == {"new_broken_link", "score_drop"} and len((tmp_path / "out.jsonl").read_text().splitlines()) == 2
    assert led.entries().count() == 3 and verify(led.entries()).first().ok


def test_versions_show_whole_ones_only(spark, tmp_path):
    v = watch.Versions(spark, f"file://{tmp_path}/t")
    assert v.latest() is None
    v.write(lambda p: spark.range(1).write.parquet(p + "/x"))
    with pytest.raises(ZeroDivisionError):
        v.write(lambda p: 1 / 0)
    assert v.latest().endswith("/1") and v.write(lambda p: None).endswith("/2")


def test_streams_are_sealed_once(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(i, "k") for i in range(5)], "id long, kind string").coalesce(1).write.parquet(src)
    led = Ledger(spark, f"file://{tmp_path}/l.jsonl", now=lambda: "t")
    for _ in range(2):
        q = watch.sealed(spark.readStream.schema("id long, kind string").parquet(src), led, "row", f"file://{tmp_path}/cp", ["id"])
        q.awaitTermination(60)
    assert led.entries().count() == 5 and verify(led.entries()).first().ok


def test_event_time_windows_on_a_stream(spark, tmp_path):
    df = spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id*10,0) ts, 'a' event_type, 1 user_id, 2.0D value from range(12)")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    assert {r.n for r in watch.tumbling(df).collect()} == {6} and watch.sessions(df, "5 minutes").count() == 12 and watch.sessions(df).count() == 1
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    q = watch.tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("windows").count() >= 1
