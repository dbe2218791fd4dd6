"""DuckDB SQL that gives the same rows as the registered queries, written from their contracts."""

from __future__ import annotations

from docsieve.llm import urls

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _kinds() -> str:
    any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + f"|{any_case('api')}_?{any_case('key')}"
    assign = f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [("assign", assign), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}"), ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"), ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")]
    keep = lambda k, re: f"length(regexp_extract(m[i], '{re}', 2)) >= 6" if k == "assign" else "true"
    return " union all ".join(
        f"select rn, '{k}' kind, {n} ord, m[i] hit, coalesce(list_sum(list_transform(g[1:i], lambda v: length(v))), 0)::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda v: length(v))), 0)::bigint a "
        f"from (select rn, m, g, unnest(range(1, len(m) + 1)) i from (select rn, regexp_extract_all(x, '{re}') m, string_split_regex(x, '{re}') g from t) where len(m) > 0) where {keep(k, re)}"
        for n, (k, re) in enumerate(kinds)
    )


def op2() -> str:
    span = "kind || ':' || a || ':' || (a + length(hit))"
    return f"""
with t as (select row_number() over () rn, doc_id, coalesce(text, '') x from documents), s as ({_kinds()}),
f as (select rn, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
 string_agg({span}, ',' order by a, ord) filter (ord < 3) b, string_agg({span}, ',' order by a, ord) spans from s group by rn)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans
from t left join f using (rn)"""


OP3 = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') n from documents),
g as (select n, max(doc_id) keep_id, count(*) group_size from t group by n)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t.n) text_sha256 from t join g using (n)"""

OP5 = r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15) h from documents),
s as (select source, sum(size)::bigint source_size, ([5, 2, 1])[1 + (row_number() over (order by source nulls last) - 1) % 3] w from d group by source),
r as (select 0 round, source, source_size, w, false as full_, (select sum(source_size) from s) * w / (select sum(w) from s)::double as target from s
 union all
 select round + 1, source, source_size, w, target > 3 * source_size or full_, case when target > 3 * source_size or full_ then 3.0 * source_size
  else ((sum(source_size) over () - sum(case when target > 3 * source_size or full_ then 3 * source_size else 0 end) over ()) * w)::double / (sum(case when target > 3 * source_size or full_ then 0 else w end) over ())::double end
 from r where round < (select count(*) from s)),
p as (select source, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end whole from r where round = (select count(*) from s)),
q as (select *, target - whole * source_size as rest from p),
h as (select source, h, sum(size) g, sum(sum(size)) over (partition by source order by h) upto from d group by source, h),
e as (select h.source, h.h, rest > 0 and (upto <= rest or (upto - g <= rest and upto - rest < rest - (upto - g))) as extra from h join q on h.source is not distinct from q.source)
select d.doc_id, d.size, q.source_size, q.target, (d.size * least(3, whole + extra::int))::bigint taken
from d join q on d.source is not distinct from q.source join e on d.source is not distinct from e.source and d.h = e.h"""


def op8() -> str:
    fits = " union all ".join(f"select page_id, rn, '{h}{p}' rule, '{v}' verdict from u where (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for v, h, p in urls.RULES)
    width, orders = urls.ORDER + 1, range(urls.ORDER + 1)
    own = lambda k: f"right(g, {k + 1})"
    context = lambda k: f"left(right(g, {k + 1}), {k})"
    tables = ", ".join(f"{t}{k} as materialized (select {f(k)} x, sum(allow) allow, sum(block) block from w group by 1)" for k in orders for t, f in (("n", own), ("m", context)))
    joins = " ".join(f"left join {t}{k} on {t}{k}.x = {f(k)}" for k in orders for t, f in (("n", own), ("m", context)))

    def p(kind):
        out = f"{1 / urls._ALPHABET!r}::double"
        for k in orders:
            out = f"((coalesce(n{k}.{kind}, 0) + {urls._PRIOR} * {out}) / (coalesce(m{k}.{kind}, 0) + {urls._PRIOR}))"
        return out

    return rf"""
with u as (select row_number() over () rn, page_id, url, substr(md5(url), 1, 1) in ({', '.join(f"'{d}'" for d in urls.HELD_OUT)}) held, case when contains(url, '://') then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UP}', '{_LOW}') else '' end host,
 case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) else '' end path from pages),
f as (select rn, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict from ({fits}) group by rn),
c as materialized (select rn, case when not held then verdict end verdict, substr(repeat(chr({ord(urls._BEFORE)}), {urls.ORDER}) || url, i, {width}) g from (select rn, url, verdict, held, unnest(range(1, length(url) + 1)) i from u left join f using (rn))),
w as materialized (select g, count(*) filter (verdict = 'allow') allow, count(*) filter (verdict = 'block') block from c group by g), {tables},
r as materialized (select g, ln({p('allow')}) - ln({p('block')}) r from (select g from w) q {joins}),
s as (select rn, avg(r) score from c join r using (g) group by rn),
b as (select floor(score * {urls.BINS})::bigint b, count(*) filter (verdict = 'allow') a, count(*) filter (verdict = 'block') k from s join f using (rn) join u using (rn) where held group by 1),
e as (select b, coalesce(lag(b) over (order by b) + 1, b) prior, (coalesce(sum(a) over (order by b rows between unbounded preceding and 1 preceding), 0) / nullif(sum(a) over (), 0))::double + 1 - (coalesce(sum(k) over (order by b rows between unbounded preceding and 1 preceding), 0) / nullif(sum(k) over (), 0))::double e
 from (select * from b union all select max(b) + 1, 0, 0 from b having count(*) > 0)),
t as (select coalesce((select (b + prior) / {2 * urls.BINS}.0 from e where e is not null order by round(e, 9), prior - b, b limit 1), 0) edge)
select page_id, host, path, rule, coalesce(verdict, case when score < edge then 'block' else 'allow' end) verdict from u left join f using (rn) left join s using (rn) cross join t"""


def op10(least: int = 50) -> str:
    """From the definition: words and single white space as tokens, seams by the tokens before them, windows by their whole text."""
    word, sep = r"[^\x20\x09-\x0D]", r"\A[ \t\n]\z"
    seam = r"""t1 in (' ', chr(9)) and regexp_matches(t3, '\A[ \t\n]\z') and
 ((regexp_matches(tok, '\A\p{Lu}') and not regexp_matches(t2, '[.!?]\z') and length(t2) <= 62
   and (regexp_matches(t2, '\A\p{Ll}') or t2 = '|' or (regexp_matches(t2, '\A\p{Lu}') and regexp_matches(t4, '[.!?]\z'))))
  or (regexp_matches(tok, '\A[\p{Ll}|]') and regexp_matches(t2, '[.!?]\z') and length(t2) <= 61 and (regexp_matches(t4, '[^ \t\n.!?]\z') or regexp_matches(t2, '\A\p{Lu}'))))"""
    back = ", ".join(f"lag(tok, {i}) over w t{i}" for i in (1, 2, 3, 4))
    return rf"""
with r as (select row_number() over () rn, doc_id, text from documents),
tk as (select rn, unnest(tk) tok, generate_subscripts(tk, 1) j from (select rn, regexp_extract_all(text, '[^ \t\n]+|[ \t\n]') tk from r where text is not null)),
tb as (select rn, j, tok, {back} from tk window w as (partition by rn order by j)),
tc as (select rn, j, tok, sum(case when t1 = chr(10) or (not regexp_matches(t2, '{sep}') and {seam}) then 1 else 0 end) over (partition by rn order by j) piece from tb),
tp as (select rn, piece, string_agg(tok, '' order by j) x from tc group by rn, piece),
pl as (select rn, list(x order by piece) l from tp group by rn),
x as (select rn, doc_id, text, l, list_filter(range(len(l)), lambda i: regexp_matches(l[i + 1], '{word}')) p from r join pl using (rn)),
w as (select rn, doc_id, text, list_transform(p, lambda i: regexp_replace(regexp_replace(l[i + 1], '\A[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+\z', '')) q, list_transform(p, lambda i: len(regexp_extract_all(l[i + 1], '{word}+'))) n from x),
b as (select rn, doc_id, q, n, unnest(range(1, len(q) + 1)) s from w),
k as (select rn, doc_id, q, n, s, unnest(range(1, least({least}, greatest(s, len(q) - s + 1)) + 1)) m from b),
v as (select distinct rn, doc_id, s, m, array_to_string(q[s:s + m - 1], chr(10)) c from k where s + m - 1 <= len(q) and list_sum(n[s:s + m - 1]) >= {least} and coalesce(list_sum(n[s:s + m - 2]), 0) < {least}
 union select distinct rn, doc_id, s - m + 1, m, array_to_string(q[s - m + 1:s], chr(10)) from k where s - m + 1 >= 1 and list_sum(n[s - m + 1:s]) >= {least} and coalesce(list_sum(n[s - m + 2:s]), 0) < {least}),
f as (select rn, s, m from (select rn, s, m, row_number() over o i, first_value(rn) over o first_rn, first_value(s) over o first_s from v window o as (partition by c, m order by doc_id nulls first, s)) where i > 1 and not (rn = first_rn and s < first_s + m)),
g as (select distinct rn, unnest(range(s, s + m)) s from f),
o as (select rn, min(s) - 1 a, max(s) - 1 b from (select rn, s, s - row_number() over (partition by rn order by s) i from g) group by rn, i),
z as (select rn, sum(b - a + 1)::bigint n_cut, string_agg(a || '-' || b, ',' order by a) runs, list(a order by a) aa, list(b order by a) bb from o group by rn),
y as (select rn, n_cut, runs, array_to_string(list_transform(list_filter(range(len(l)), lambda i: not list_bool_or(list_transform(range(len(aa)), lambda j: i between p[aa[j + 1] + 1] and p[bb[j + 1] + 1]))), lambda i: l[i + 1]), '') kept from z join x using (rn))
select doc_id, coalesce(n_cut, 0) n_cut, coalesce(runs, '') runs, sha256(case when n_cut is null then coalesce(text, '') else kept end) kept_sha256 from r left join y using (rn)"""


ORACLE = {"op2_secrets": op2(), "op3_exact_dedup": OP3, "op5_mixing": OP5, "op8_url_filter": op8(), "op10_line_dedup": op10()}
