"""Canonical JSON and digests: keys sorted at all depths, compact, numbers as JavaScript prints them."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(x: float) -> str:
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, exponent = (f"{x!r}".lower().split("e") + ["0"])[:2] if "e" in f"{x!r}".lower() else (repr(x), "")
    if not exponent:
        return digits
    e = int(exponent)
    if -7 < e < 0:
        return f"{x:.{len(digits.replace('-', '').replace('.', '')) - 1 - e}f}"
    return f"{digits.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical_json(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: A JSON string in, its canonical form out; null for what isn't JSON.
@F.udf(T.StringType(), useArrow=True)
def canonical(text):
    try:
        return canonical_json(json.loads(text))
    except (TypeError, ValueError):
        return None
