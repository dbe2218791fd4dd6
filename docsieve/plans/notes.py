"""Registered queries over notes that are put together from documents: front matter, links, chains, signatures, citations."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docsieve.functions import parse
from docsieve.functions.canonical import canonical
from docsieve.functions.ids import dense_ids
from docsieve.functions.text import rounded
from docsieve.operators import citations, search, shelf, vectors
from docsieve.plans import catalog, corpus
from docsieve.plans.catalog import query
from docsieve.session import table
from docsieve.sources import vault

#: A note of a document, in words that both engines know: front matter on three of four, headings, tags, links, tasks, the text.
NOTE = """concat(case when doc_id % 4 = 1 then '' else concat('---', chr(10), 'Title: Note ', cast(doc_id as string), case when doc_id % 5 = 0 then ' `code`' else '' end, chr(10), 'tags: [', lang, ', S-', source, ', x]', chr(10),
 'AUTHORITY: ', case when doc_id % 3 = 0 then 'Controlled' else 'reference' end, chr(10), 'not a pair', chr(10), case when doc_id % 6 = 0 then concat('title: Second  ', cast(doc_id as string), chr(10)) else '' end, 'status:', case when doc_id % 11 = 0 then ' controlled' else '' end, chr(10), '---', chr(10)) end,
 case when doc_id % 2 = 0 then concat('# Head *', cast(doc_id as string), '*', chr(10)) else '' end, '#Tag-', lang, ' and #a/b [[Doc ', cast(doc_id % 50 as string), '|alias]] [[ Doc ', cast(doc_id % 7 as string), '#sec]] [[Doc ', cast(doc_id % 50 as string), ']]', chr(10), '- [ ] open', chr(10), '  * [ ]  two', chr(10), '- [x] done', chr(10), coalesce(text, ''))"""
_NOTES = f"""n as (select doc_id, lang, source, {NOTE} note from documents where lang is not null and source is not null),
f as (select *, list_filter(string_split(regexp_extract(note, '(?s)^---\\n(.*?)\\n---\\n', 1), chr(10)), lambda x: regexp_matches(x, '^[A-Za-z0-9_-]+:')) kv, regexp_replace(note, '(?s)^---\\n.*?\\n---\\n', '') body from n)"""


def _fm(key: str) -> str:
    return rf"list_last(list_transform(list_filter(kv, lambda x: lower(regexp_extract(x, '^([A-Za-z0-9_-]+):', 1)) = '{key}'), lambda x: trim(regexp_extract(x, '^[A-Za-z0-9_-]+:\s*(.*)$', 1))))"


def _notes(spark, d):
    rows = table(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", F.expr(NOTE).alias("note"))
    fm, body = parse.front_matter(F.col("note"))
    return rows.withColumn("fm", fm).withColumn("body", body)


@query(f"with {_NOTES} select doc_id, {_fm('title')} title, {_fm('tags')} tags, {_fm('authority')} authority, {_fm('status')} status, sha256(body) body_sha256 from f")
def note_front_matter(spark, d):
    return _notes(spark, d).select("doc_id", *(F.col("fm")[k].alias(k) for k in ("title", "tags", "authority", "status")), F.sha2("body", 256).alias("body_sha256"))


@query(rf"with {_NOTES} select doc_id, trim(regexp_replace(coalesce(nullif({_fm('title')}, ''), nullif(regexp_extract(body, '(?m)^#\s+(.+)$', 1), ''), 'doc' || doc_id), '[#*`]', '', 'g')) title from f")
def note_titles(spark, d):
    return _notes(spark, d).select("doc_id", parse.title_of(F.col("fm"), F.col("body"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("title"))


@query(
    rf"""with {_NOTES}, t as (select doc_id, list_transform(regexp_extract_all(note, '(?:^|\s)#([A-Za-z0-9][A-Za-z0-9/_-]+)', 1), lambda x: lower(x)) a, list_transform(list_filter(regexp_split_to_array(regexp_replace(coalesce({_fm('tags')}, ''), '[\[\]]', '', 'g'), '[,\s]+'), lambda x: x <> ''), lambda x: lower(x)) b from f),
e as (select doc_id, unnest(list_concat(a, b)) tag from t) select doc_id, string_agg(distinct tag, ' ' order by tag) tags from e group by doc_id"""
)
def note_tags(spark, d):
    return _notes(spark, d).select("doc_id", F.array_join(F.array_sort(parse.tags_of(F.col("note"), F.col("fm")["tags"])), " ").alias("tags"))


@query(rf"with {_NOTES}, l as (select distinct doc_id, trim(unnest(regexp_extract_all(note, '\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]', 1))) link from f) select doc_id, count(*) n_links, string_agg(link, ',' order by link) links from l group by doc_id")
def note_links(spark, d):
    links = parse.links_of(F.col("note"))
    return _notes(spark, d).select("doc_id", F.size(links).cast("long").alias("n_links"), F.array_join(F.array_sort(links), ",").alias("links"))


@query(f"with {_NOTES} select doc_id, coalesce(lower({_fm('authority')}) = 'controlled', false) or coalesce(lower({_fm('status')}) = 'controlled', false) or source = 'src3' controlled from f")
def note_controlled(spark, d):
    rows = _notes(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("doc_id", parse.controlled_of(F.col("fm"), F.col("source"), ("src3",)).alias("controlled"))


@query(
    rf"""with {_NOTES} select doc_id, len(regexp_extract_all(body, '[^\t\n\x0b\f\r ]+'))::int word_count, len(regexp_extract_all(body, '(?m)^\s*[-*]\s+\[ \]'))::int open_tasks, regexp_matches(body, '\b(TODO|FIXME|XXX|DRAFT|WIP)\b|\?\?\?') has_markers,
 len(regexp_extract_all(body, '[^\t\n\x0b\f\r ]+')) < 12 stub from f"""
)
def note_metrics(spark, d):
    return _notes(spark, d).select("doc_id", *(c.alias(n) for n, c in parse.metrics(F.col("body")).items()))


_SEALS = """e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - 1 seq, '{"event":' || event_id || ',"user":' || user_id || '}' payload from events),
c as (select user_id, seq, event_type, payload, repeat('0', 64) prev, sha256(seq || '|' || repeat('0', 64) || '|' || event_type || '|' || payload) h from e where seq = 0
 union all select e.user_id, e.seq, e.event_type, e.payload, c.h, sha256(e.seq || '|' || c.h || '|' || e.event_type || '|' || e.payload) from c join e on e.user_id = c.user_id and e.seq = c.seq + 1)"""


@query(f"with recursive {_SEALS} select user_id, seq, prev prev_hash, h entry_hash from c")
def ledger_seals(spark, d):
    return catalog._chains(spark, d).select("user_id", "seq", "prev_hash", "entry_hash")


#: The verdicts of catalog.ledger_chain_verify, by sealing anew what was tampered with.
catalog.ORACLE["ledger_chain_verify"] = f"""with recursive {_SEALS}, t as (select *, case when user_id % 5 = 0 and seq = 1 then '{{}}' else payload end seen from c),
b as (select user_id, count(*) n, min(seq) filter (h <> sha256(seq || '|' || prev || '|' || event_type || '|' || seen)) at_seq from t group by user_id)
select user_id, at_seq is null ok, n as count, at_seq::int broken_at, case when at_seq is not null then 'entry_hash mismatch' end reason from b"""


@query("""select event_id, sha256('{"a":{"k":{"k":' || regexp_extract(props, '[0-9]+') || '},"z":[' || event_id || ',null,"é\\n"]},"b":' || case when value = floor(value) then value::bigint::varchar else value::varchar end || '}') canonical_sha256 from events""")
def canonical_events(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit('{"b": '), F.col("value").cast("string"), F.lit(', "a": {"z": ['), F.col("event_id").cast("string"), F.lit(', null, "\\u00e9\\n"], "k": '), F.col("props"), F.lit("}}"))
    return e.select("event_id", F.sha2(canonical(text), 256).alias("canonical_sha256"))


@query("select doc_id, row_number() over (order by source, doc_id) - 1 n from documents")
def dense_numbers(spark, d):
    return dense_ids(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"], "n").select("doc_id", "n")


_INDEX = vectors.VectorIndex(64, 6, 3, 7)
_PLANES = json.dumps([[[float(x) for x in plane] for plane in planes] for planes in _INDEX.planes])


@query(
    f"""with p as (select unnest(range(0, {_INDEX.tables})) t, {_PLANES}::double[][][] planes)
select vec_id, t::int t, list_sum(list_transform(range(1, {_INDEX.bits + 1}), lambda i: case when list_dot_product(embedding::double[], planes[t + 1][i]) >= 0 then (1 << ({_INDEX.bits} - i)) else 0 end))::bigint sig from embeddings, p where embedding is not null"""
)
def lsh_signatures(spark, d):
    rows = table(spark, d, "embeddings").where("embedding is not null")
    return _INDEX.signatures(rows).select(F.col("id").alias("vec_id"), "t", "sig")


#: Every sentence of a document cites one note, and every third document a range.
_ANSWER = "case when doc_id % 3 = 0 then replace(text, '. ', concat(' [', cast(doc_id % 7 as string), ']. ')) when doc_id % 3 = 1 then concat(text, ' So [1, ', cast(doc_id % 5 as string), '-', cast(doc_id % 9 as string), '].') else text end"
_GROUP = r"\[([0-9][0-9\s,]*(?:[-‐‑‒–—−][0-9\s,]*)?)\]"
_SPAN = r"^([0-9]+)\s*[-‐‑‒–—−]\s*([0-9]+)$"


@query(
    rf"""with ans as (select doc_id, {_ANSWER} answer from documents where text is not null), grp as (select doc_id, unnest(regexp_extract_all(answer, '{_GROUP}', 1)) g from ans),
part as (select doc_id, trim(unnest(string_split(g, ','))) p from grp), rng as (select doc_id, p, regexp_extract(p, '{_SPAN}', 1) lo, regexp_extract(p, '{_SPAN}', 2) hi from part),
one as (select doc_id, unnest(case when lo = '' then case when regexp_matches(p, '^[0-9]+$') then [p::bigint] else [] end when lo::bigint <= hi::bigint and hi::bigint - lo::bigint < {citations.WIDEST} then range(lo::bigint, hi::bigint + 1) else [-1] end) n from rng),
cit as (select doc_id, string_agg(distinct n::varchar, ',' order by n::varchar) cited, count(distinct n) filter (n between 1 and 4) v, count(distinct n) filter (not n between 1 and 4) x from one group by doc_id),
s as (select doc_id, unnest(string_split(regexp_replace(answer, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1))) s from ans),
u as (select doc_id, count(*) filter (trim(s) <> '' and len(regexp_extract_all(s, '{_GROUP}', 1)) = 0) uncited from s group by doc_id)
select ans.doc_id, coalesce(cited, '') cited, uncited::int uncited, case when coalesce(v, 0) >= 1 and coalesce(x, 0) = 0 then 'GROUNDED' else 'REFUSED_CITATION_CHECK' end verdict from ans join u using (doc_id) left join cit using (doc_id)"""
)
def document_citations(spark, d):
    """Documents as answers to four notes."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.expr(_ANSWER).alias("answer")).withColumn("c", citations.cited_column(F.col("answer")))
    ok = F.size(F.filter("c", lambda n: n.between(1, 4)))
    verdict = citations.verdict_column(F.lit(False), ok, F.size("c") - ok)
    return rows.select("doc_id", F.array_join(F.array_sort(F.transform("c", lambda n: n.cast("string"))), ",").alias("cited"), citations.uncited_column(F.col("answer")).alias("uncited"), verdict.alias("verdict"))


@query("with s as (select source || '/' || doc_id || '.md' rel, doc_id from documents) select rel, replace(rel, '/', '__') as name from s where doc_id % 3 = 0 or doc_id % 5 = 0")
def mirror_plan(spark, d):
    """A mirror that lacks every third note, and has every fifth older."""
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    own = table(spark, d, "documents").where("source is not null").select(rel.alias("rel"), F.lit(100).alias("mtime_ms"), "doc_id")
    there = own.where("doc_id % 3 <> 0").select(F.replace("rel", F.lit("/"), F.lit("__")).alias("name"), F.when(F.col("doc_id") % 5 == 0, 99).otherwise(100).alias("mtime_ms"))
    return vault.stale_copies(own.select("rel", "mtime_ms"), there)


@query("select doc_id, sha1('model-x ' || left(coalesce(text, ''), 2000)) key from documents")
def embedding_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", vectors.embedding_key("model-x", F.substring(F.coalesce("text", F.lit("")), 1, 2000)).alias("key"))


@query(
    r"""with w as (select doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(left(coalesce(text, ''), 60), '[-_]', ' ', 'g'), '(?i)\.[a-z]+$', ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) p, generate_subscripts(regexp_extract_all(regexp_replace(regexp_replace(left(coalesce(text, ''), 60), '[-_]', ' ', 'g'), '(?i)\.[a-z]+$', ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), 1) i from documents)
select doc_id, coalesce(label, '') label from documents left join (select doc_id, string_agg(case when regexp_matches(p, '^[A-Za-z0-9_]') then upper(left(p, 1)) || substr(p, 2) else p end, '' order by i) label from w group by doc_id) using (doc_id)"""
)
def titleized(spark, d):
    return table(spark, d, "documents").select("doc_id", shelf.titleized(F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("label"))


@query(f"{catalog._CHUNK}, {catalog._boost_sql('license of apache edoution')} select rel note, floor(score * 1000 + 0.5) / 1000 score, m || '/3' coverage from ran order by score desc, first desc, doc_id limit 8")
def search_hits(spark, d):
    """The whole search, hits as a table."""
    hits = search.search(corpus.index(spark, d), "license of apache edoution")["hits"]
    return spark.createDataFrame([(h["note"], float(h["score"]), h["coverage"]) for h in hits], "note string, score double, coverage string").select("note", rounded(F.col("score"), 3).alias("score"), "coverage")
