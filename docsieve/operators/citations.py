"""Citations of an answer: parsed, checked against the contexts, turned into a verdict and a sealed receipt."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.canonical import canonical_json, sha256

DASHES = "-‐‑‒–—−"
GROUP = rf"\[([0-9][0-9\s,]*(?:[{DASHES}][0-9\s,]*)?)\]"
_RANGE = re.compile(rf"^([0-9]+)\s*[{DASHES}]\s*([0-9]+)$")
WIDEST = 64
INVALID = -1
REFUSAL = re.compile(r"^not in your vault\.?$", re.I)


def parse(text: str | None, contexts: int | None = None) -> tuple[list[int], list[dict]]:
    """Numbers cited, sorted, and the ranges that name nothing: reversed or wider than the contexts; those are never expanded."""
    widest = contexts if contexts is not None and contexts >= 0 else WIDEST
    numbers, invalid = set(), []
    for group in re.findall(GROUP, text or ""):
        for part in filter(None, (p.strip() for p in group.split(","))):
            if m := _RANGE.match(part):
                lo, hi = int(m[1]), int(m[2])
                if lo > hi or hi - lo + 1 > widest:
                    invalid.append({"text": part, "lo": lo, "hi": hi, "reason": "reversed" if lo > hi else "too_wide"})
                else:
                    numbers |= set(range(lo, hi + 1))
            else:
                numbers |= {int(p) for p in part.split() if re.fullmatch("[0-9]+", p)}
    return sorted(numbers), invalid


def cited(text: str | None, contexts: int | None = None) -> list[int]:
    numbers, invalid = parse(text, contexts)
    return [INVALID] * bool(invalid) + numbers


def uncited_sentences(text: str | None, contexts: int | None = None) -> int:
    return sum(not cited(s, contexts) for s in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", text or ""))))


def cited_column(text: Column, widest: Column | int = WIDEST) -> Column:
    """cited() as an expression: groups, their segments, guarded ranges, then single numbers; distinct and sorted."""
    groups = F.regexp_extract_all(text, F.lit(GROUP), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))))
    span = rf"^([0-9]+)\s*[{DASHES}]\s*([0-9]+)$"
    number = lambda p, i: F.expr("null").cast("long") if i is None else F.regexp_extract(p, span, i).try_cast("bigint")
    wide = F.lit(widest) if isinstance(widest, int) else widest

    def numbers(p: Column) -> Column:
        lo, hi = number(p, 1), number(p, 2)
        good = lo.isNotNull() & hi.isNotNull() & (lo <= hi) & (hi - lo + 1 <= wide)
        ranged = F.when(good, F.sequence(F.when(good, lo).otherwise(0), F.when(good, hi).otherwise(0))).otherwise(F.array(F.lit(INVALID).cast("long")))
        single = F.transform(F.filter(F.split(p, r"\s+"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.try_cast("bigint"))
        return F.when(p.rlike(span), ranged).otherwise(single)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(parts, F.array().cast("array<string>")), numbers))))


def uncited_column(text: Column) -> Column:
    sentences = F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")
    return F.size(F.filter(sentences, lambda s: F.size(cited_column(s)) == 0))


def resolved(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(answer_id, n, known) of answers (answer_id, cited) and contexts (answer_id, n): a semi-join's and an anti-join's rows in one."""
    each = answers.select("answer_id", F.explode("cited").alias("n"))
    known = contexts.select("answer_id", "n").distinct().withColumn("known", F.lit(True))
    return each.join(known, ["answer_id", "n"], "left").fillna({"known": False})


def verdict_column(refused: Column, valid: Column, dangling: Column) -> Column:
    return F.when(refused, "REFUSED_UNGROUNDED").when((valid >= 1) & (dangling == 0), "GROUNDED").otherwise("REFUSED_CITATION_CHECK")


def verdict(refused: bool, valid: list[int], dangling: list[int]) -> str:
    return "REFUSED_UNGROUNDED" if refused else "GROUNDED" if valid and not dangling else "REFUSED_CITATION_CHECK"


def answer_prompt(query: str, contexts: list[dict]) -> list[dict]:
    block = "\n\n".join(f"[{c['n']}] {c['note']}" + (f" › {c['heading']}" if c.get("heading") else "") + f"\n{c['text']}" for c in contexts)
    rules = "Use the numbered notes alone. End each factual sentence with the number of its note in brackets, one number a bracket. Should the notes lack the answer, say only: Not in your vault."
    return [{"role": "system", "content": rules}, {"role": "user", "content": f"NOTES\n{block}\n\nQUESTION\n{query}"}]


def contexts_of(hits: list[dict], most: int = 6, longest: int = 1200) -> list[dict]:
    return [{"n": i, "note": h["note"], "heading": h["heading"], "text": (h["text"] or "")[:longest], "id": h["id"]} for i, h in enumerate(hits[:most], 1)]


def grounded(query: str, contexts: list[dict], chat: Callable[[list[dict]], str]) -> dict:
    """The model's answer and what its citations resolve to. Refusals ground nothing."""
    answer = chat(answer_prompt(query, contexts))
    refused = bool(REFUSAL.match(answer.strip()))
    numbers, known = cited(answer, len(contexts)), {c["n"]: c for c in contexts}
    valid, dangling = [n for n in numbers if n in known], [n for n in numbers if n not in known]
    return {
        "answer": answer, "refused": refused, "grounded": not refused and bool(valid) and not dangling, "cited": numbers, "valid": valid, "dangling": dangling,
        "citations": [{k: known[n].get(k) for k in ("n", "note", "heading", "id", "text")} for n in valid],
        "invalid_citations": parse(answer, len(contexts))[1], "uncited_sentences": 0 if refused else uncited_sentences(answer, len(contexts)),
    }


def receipt(question: str, found: dict, answer: dict | None, controlled: dict[str, bool], at: str) -> dict:
    """What was asked, found, cited and sealed; sources carry the hash of their whole passage, by chunk."""
    refused = answer is None or answer["refused"]
    texts = {h["id"]: h for h in found["hits"]}
    sources = [{"n": c["n"], "note": c["note"], "heading": c["heading"] or None, "content_sha256": sha256(texts.get(c["id"], c)["text"] or ""), "controlled": bool(controlled.get(c["note"]))} for c in (answer or {}).get("citations", [])]
    get = lambda k, default: (answer or {}).get(k, default)
    out = {
        "kind": "answer", "verdict": verdict(refused, get("valid", []), get("dangling", [])), "search_mode": found["mode"], "question": question, "answer": get("answer", None), "confidence": found["confidence"],
        "cited": get("cited", []), "dangling_citations": get("dangling", []), "invalid_citations": get("invalid_citations", []), "sources": sources, "uncited_sentences": get("uncited_sentences", 0),
        "all_sources_controlled": bool(sources) and all(s["controlled"] for s in sources), "uncontrolled_source_warning": not refused and any(not s["controlled"] for s in sources),
        "retrieved_considered": [{"note": h["note"], "heading": h["heading"] or None, "score": h["score"]} for h in found["hits"][:8]], "at": at,
    }
    return out | {"receipt_sha256": sha256(canonical_json(out))}


def recheck(payload: dict) -> dict:
    """A stored receipt by today's rules: numbered sources map exactly, older ones to the first single numbers."""
    answer, sources = payload.get("answer") or "", payload.get("sources") or []
    numbers = cited(answer)
    if sources and isinstance(sources[0].get("n"), (int, float)):
        backed = {s["n"] for s in sources if isinstance(s.get("n"), (int, float))}
    else:
        backed = set(sorted({int(n) for n in re.findall(r"\[([0-9]+)\]", answer)})[: len(sources)])
    valid, dangling = [n for n in numbers if n in backed], [n for n in numbers if n not in backed]
    old = payload.get("verdict", "UNKNOWN")
    new = verdict(old == "REFUSED_UNGROUNDED", valid, dangling)
    count = payload.get("uncited_sentences")
    return {"old_verdict": old, "new_verdict": new, "changed": new != old, "cited": numbers, "valid": valid, "dangling_citations": dangling, "invalid_citations": parse(answer)[1], "uncited_sentences": count if isinstance(count, int) else uncited_sentences(answer)}
