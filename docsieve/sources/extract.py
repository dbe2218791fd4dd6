"""Text out of office files, RTF and PDF, bounded in time and honest about failure."""

from __future__ import annotations

import html
import io
import multiprocessing as mp
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY = (".docx", ".pptx", ".xlsx", ".pdf", ".rtf")
TIMEOUT_MS = 30_000


def tidy(text: str) -> str:
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _runs(xml: bytes, block: str) -> str:
    """Text of an office part: tabs, breaks and a newline after each block element."""
    out = []

    def walk(e):
        name = _local(e.tag)
        if name == "tab":
            out.append("\t")
        elif name == "br":
            out.append("\n")
        elif name == "t":
            out.append(e.text or "")
        for child in e:
            walk(child)
        if name == block:
            out.append("\n")

    walk(ET.fromstring(xml))
    return "".join(out)


def docx(z: zipfile.ZipFile) -> str:
    return _runs(z.read("word/document.xml"), "p")


def pptx(z: zipfile.ZipFile) -> str:
    slides = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)]
    return "\n\n".join(_runs(z.read(n), "p").strip() for n in sorted(slides, key=lambda n: int(re.search("[0-9]+", n)[0])))


def xlsx(z: zipfile.ZipFile) -> str:
    """Shared strings, then inline ones sheet by sheet; rows and cells aren't told apart."""
    names = set(z.namelist())
    out = [_runs(z.read("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
    for n in sorted(x for x in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", x)):
        out += [t.text or "" for t in ET.fromstring(z.read(n)).iter() if _local(t.tag) == "t"]
    return "\n".join(out)


_SKIPPED = ("fonttbl", "colortbl", "stylesheet", "info", "*")


def rtf(raw: bytes) -> str:
    text, out, at, skip, depth = raw.decode("latin-1"), [], 0, [], 0
    token = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?[0-9]+)? ?|\\(.)|([{}])|([^\\{}]+)", re.S)
    for m in token.finditer(text):
        at = m.end()
        if m[5] == "{":
            depth += 1
            if re.match(r"\\(?:\*|(?:fonttbl|colortbl|stylesheet|info)\b)", text[at : at + 14]):
                skip.append(depth)
        elif m[5] == "}":
            if skip and skip[-1] == depth:
                skip.pop()
            depth -= 1
        elif not skip:
            if m[1]:
                out.append(bytes([int(m[1], 16)]).decode("cp1252", "replace"))
            elif m[2]:
                if m[2] == "u" and m[3]:
                    out.append(chr(int(m[3]) % 65536))
                out.append({"par": "\n", "line": "\n", "tab": "\t"}.get(m[2], ""))
            elif m[4]:
                out.append(m[4] if m[4] in "\\{}" else "")
            else:
                out.append((m[6] or "").replace("\r", "").replace("\n", ""))
    return "".join(out)


def _cmap(stream: str) -> dict[int, str]:
    out: dict[int, str] = {}
    wide = lambda h: bytes.fromhex(h if len(h) % 4 == 0 else h.zfill(4)).decode("utf-16-be", "replace")
    for block in re.findall(r"beginbfchar(.*?)endbfchar", stream, re.S):
        out |= {int(a, 16): wide(b) for a, b in re.findall(r"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>", block)}
    for block in re.findall(r"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, c in re.findall(r"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>", block):
            lo, hi = int(a, 16), min(int(b, 16), int(a, 16) + 65535)
            out |= {i: chr(int(c, 16) + i - lo) for i in range(lo, hi + 1) if int(c, 16) + i - lo < 0x110000}
    return out


def _literal(s: str) -> str:
    back = {"n": "\n", "r": "\r", "t": "\t", "b": "", "f": ""}
    return re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else back.get(m[1], m[1]), s, flags=re.S)


#: Bytes that a PDF's stream may unpack to; beyond it the file is given up with a note, never cut.
LARGEST_STREAM = 256_000_000


def pdf(raw: bytes) -> str:
    """Text operators of all content streams, through the ToUnicode maps of their fonts where there are any."""
    objects = {int(n): body for n, body in re.findall(rb"(?<![0-9])([0-9]+)\s+[0-9]+\s+obj(.*?)endobj", raw, re.S)}

    def stream(body: bytes) -> str | None:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return None
        data = m[1]
        if b"FlateDecode" in body[: m.start()]:
            try:
                z = zlib.decompressobj()
                data = z.decompress(data, LARGEST_STREAM)
                if z.unconsumed_tail:
                    raise ValueError(f"a stream of more than {LARGEST_STREAM} bytes")
            except zlib.error:
                return None
        return data.decode("latin-1")

    maps = {}
    for n, body in objects.items():
        if (m := re.search(rb"/ToUnicode\s+([0-9]+)\s+[0-9]+\s+R", body)) and (s := stream(objects.get(int(m[1]), b""))):
            maps[n] = _cmap(s)
    fonts = {}
    for body in objects.values():
        for name, n in re.findall(rb"/([A-Za-z0-9_.+-]+)\s+([0-9]+)\s+[0-9]+\s+R", body):
            if int(n) in maps:
                fonts[name.decode("latin-1")] = maps[int(n)]
    out = []
    for body in objects.values():
        s = stream(body)
        if not s or "BT" not in s:
            continue
        font: dict[int, str] = {}

        def decoded(part: str) -> str:
            if part[0] == "<":
                h = re.sub(r"\s", "", part[1:-1])
                codes = [int(h[i : i + 4], 16) for i in range(0, len(h) - 3, 4)] if font else list(bytes.fromhex(h + "0" * (len(h) % 2)))
            else:
                codes = [ord(c) for c in _literal(part[1:-1])]
            return "".join(font.get(c, chr(c) if not font or c < 256 else "") for c in codes)

        text = r"\((?:[^()\\]|\\.)*\)|<[0-9a-fA-F\s]*>"
        for m in re.finditer(rf"/([A-Za-z0-9_.+-]+)\s+[-0-9.]+\s+Tf|\[((?:{text}|[^\]])*)\]\s*TJ|({text})\s*(?:Tj|'|\")|\b(Td|TD|T\*|ET)\b", s, re.S):
            if m[1]:
                font = fonts.get(m[1], {})
            elif m[2] is not None:
                out += [decoded(p) for p in re.findall(text, m[2], re.S)]
            elif m[3]:
                out.append(decoded(m[3]))
            else:
                out.append(" ")
    return "".join(out)


def readable(text: str) -> str | None:
    """What speaks against text from a PDF, or None."""
    solid = re.sub(r"\s", "", text)
    if len(solid) < 8 or sum(c.isprintable() for c in text.replace("\n", " ")) < 0.7 * len(text):
        return "no readable text"
    words = text.split()
    if len(words) > 20 and sum(len(w) == 1 for w in words) > 0.45 * len(words):
        return "letters without words"
    return None


def extract(raw: bytes | None, ext: str) -> dict:
    """text, ok, note; never raises."""
    try:
        if ext in (".docx", ".pptx", ".xlsx"):
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                text = {".docx": docx, ".pptx": pptx, ".xlsx": xlsx}[ext](z)
        elif ext in (".rtf", ".pdf"):
            text = (rtf if ext == ".rtf" else pdf)(raw or b"")
        else:
            return {"text": "", "ok": False, "note": f"unsupported {ext}"}
        text = tidy(text)
        why = readable(text) if ext == ".pdf" else None if text else "empty"
        return {"text": "" if why else text, "ok": why is None, "note": why or ""}
    except Exception as e:  # noqa: BLE001  any broken file is a result
        return {"text": "", "ok": False, "note": f"{type(e).__name__}: {e}"[:200]}


def _child(pipe, fn: Callable, raw: bytes, ext: str) -> None:
    pipe.send(fn(raw, ext))


def bounded(raw: bytes, ext: str, timeout_ms: int = TIMEOUT_MS, fn: Callable = extract) -> dict:
    """extract() in a process of its own, which is killed after timeout_ms."""
    here, there = mp.get_context("fork").Pipe(False)
    p = mp.get_context("fork").Process(target=_child, args=(there, fn, raw, ext), daemon=True)
    p.start()
    there.close()
    try:
        if here.poll(timeout_ms / 1000):
            return here.recv() | {"timed_out": False}
        return {"text": "", "ok": False, "note": f"EXTRACT_TIMEOUT after {timeout_ms}ms ({ext})", "timed_out": True}
    except EOFError:
        return {"text": "", "ok": False, "note": "extractor died", "timed_out": False}
    finally:
        p.kill()
        p.join()


#: Pages that are read by sight at most.
OCR_PAGES = 20


def ocr_note(pages: int) -> str:
    """What a text read by sight says of itself, its cut included."""
    return f"ocr: first {OCR_PAGES} of {pages} pages" if pages > OCR_PAGES else "ocr"


def ocr_key(path: Column, mtime_ms: Column, size: Column) -> Column:
    """A file's identity in a cache of such texts: another time or size is another file."""
    return F.sha1(F.concat_ws(":", path, mtime_ms.cast("string"), size.cast("string")))


def with_cached_ocr(files: DataFrame, cache: str, ocr: Callable[[bytes], str], timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """extracted() of files (path, mtime_ms, ext, content ...), by sight only where the Parquet table at cache hasn't the text yet, which it then has."""
    from docsieve.shared import _path, cut

    spark = files.sparkSession
    keyed = files.withColumn("_key", ocr_key(F.col("path"), F.col("mtime_ms"), F.length("content")))
    fs, at = _path(spark, cache)
    known = spark.read.schema("_key string, _seen string, _how string").parquet(cache) if fs.exists(at) else spark.createDataFrame([], "_key string, _seen string, _how string")
    old = keyed.join(known.dropDuplicates(["_key"]), "_key").drop("content").select(*[c for c in files.columns if c != "content"], F.col("_seen").alias("text"), F.lit(True).alias("ok"), F.col("_how").alias("note"), F.lit(False).alias("timed_out"))
    old = cut(old, "ocr-known")
    new = cut(extracted(keyed.join(known.select("_key"), "_key", "left_anti"), timeout_ms, ocr=ocr), "ocr-new")
    new.where("ok and note like 'ocr%'").select("_key", F.col("text").alias("_seen"), F.col("note").alias("_how")).write.mode("append").parquet(cache)
    return old.unionByName(new.drop("_key"))


def extracted(files: DataFrame, timeout_ms: int = TIMEOUT_MS, fn: Callable = extract, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """files (ext, content ...) with text, ok, note, timed_out in place of content. ocr gets PDFs without text, unless time ran out."""
    rest = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                ext, raw = b.column("ext")[i].as_py(), b.column("content")[i].as_py() or b""
                r = bounded(raw, ext, timeout_ms, fn)
                if ocr and ext == ".pdf" and not r["ok"] and not r["timed_out"]:
                    try:
                        if text := tidy(ocr(raw)):
                            r |= {"text": text, "ok": True, "note": ocr_note(len(re.findall(rb"/Type\s*/Page\b", raw)))}
                    except Exception as e:  # noqa: BLE001
                        r["note"] += f"; ocr: {e}"[:100]
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in rest), *(pa.array([r[k]]) for k in ("text", "ok", "note", "timed_out"))], [*rest, "text", "ok", "note", "timed_out"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(rest).schema)
    return files.mapInArrow(run, f"{fields}, text string, ok boolean, note string, timed_out boolean")


def decode_entities(text: str) -> str:
    """Named, decimal and hexadecimal, once."""
    return html.unescape(text)


def storage_to_text(xhtml: str | None) -> str:
    """A wiki's storage format: page links as [[Title]], headings, lists, paragraphs, table cells, the rest stripped."""
    flat = lambda s: re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", s)).strip()
    s = re.sub(r"<!--.*?-->", "", (xhtml or "").replace("\r\n", "\n"), flags=re.S)
    s = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", s, flags=re.S)

    def link(m):
        title = re.search(r'ri:content-title="([^"]*)"', m[1])
        return f" [[{title[1].strip()}]] " if title else f" {flat(m[1])} " if flat(m[1]) else ""

    s = re.sub(r"<ac:link\b[^>]*>(.*?)</ac:link>", link, s, flags=re.S)
    s = re.sub(r"<h([1-6])\b[^>]*>(.*?)</h\1>", lambda m: f"\n\n{'#' * int(m[1])} {flat(m[2])}\n\n", s, flags=re.S)
    s = re.sub(r"<li\b[^>]*>(.*?)</li>", lambda m: f"\n- {flat(m[1])}", s, flags=re.S)
    s = re.sub(r"</[uo]l>", "\n", s)
    s = re.sub(r"<p\b[^>]*>(.*?)</p>", lambda m: f"\n\n{flat(m[1])}\n\n", s, flags=re.S)
    s = re.sub(r"<hr\s*/?>", "\n\n---\n\n", re.sub(r"<br\s*/?>", "\n", s))
    s = decode_entities(re.sub(r"<[^>]+>", "", re.sub(r"</tr>", "\n", re.sub(r"</t[dh]>", " | ", s))))
    lines = [re.sub(r" +([.,;:!?])", r"\1", re.sub(r"[ \t]+", " ", x)).rstrip() for x in s.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


#: storage_to_text over a column.
storage_text = F.udf(storage_to_text, T.StringType(), useArrow=True)


def html_text(page: str) -> str:
    """SQL for readable text of HTML in the column page: no comments, scripts or styles, blocks as lines, common entities decoded last."""
    steps = (
        (r"(?s)<!--.*?-->", ""), (r"(?is)<(script|style)\\b.*?</\\1>", ""), (r"(?is)</(p|h[1-6]|li|ul|ol|tr|div|title)>|<br\\s*/?>", "\\n"),
        (r"(?s)<[^>]+>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"),
        (r"[ \\t]+", " "), (r" ?\\n[ \\n]*", "\\n"), (r"^[ \\n]+|[ \\n]+$", ""),
    )
    for a, b in steps:
        page = f"regexp_replace({page}, '{a}', '{b}')"
    return page
