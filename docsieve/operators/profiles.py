"""Editions of one engine (words, strictness, card guidance) and roles that may use it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    name: str
    strictness: float | None = None
    terms: dict = field(default_factory=dict)
    cards: dict = field(default_factory=dict)


def _words(vault: str, receipt: str | None = None, note: str | None = None) -> dict:
    plural = lambda w: f"{w}s"
    out = {"vault": vault, "vaults": plural(vault)}
    out |= {"receipt": receipt, "receipts": plural(receipt)} if receipt else {}
    return out | ({"note": note, "notes": plural(note)} if note else {})


PROFILES = {
    p.name: p
    for p in (
        Profile("personal", None, {}, {"default": "Identity, relations, decisions, present status."}),
        Profile("bank", 0.6, _words("controlled corpus"), {"default": "Owners, effective dates, approvals, controls.", "policy": "What it asks, of whom, from when, with which exceptions.", "vendor": "Services, contract dates, risk tier, open findings."}),
        Profile("data", 0.65, _words("doc corpus", "provenance receipt", "doc"), {"default": "Definitions, formulas, owners, dates, systems.", "metric": "Each source's own definition, formula, filters, owner.", "glossary": "Definitions, who gave them and when, synonyms.", "source": "Contents, refresh, owner, known flaws."}),
        Profile("civic", 0.75, _words("public record", "record cite", "record"), {"default": "Adopted actions, dates, votes, bodies.", "ordinance": "Number, sections changed, adoption, vote.", "action": "The motion, movers, vote by name.", "official": "Name, office, terms, appointments."}),
        Profile("energy", 0.75, _words("controlled document set", "audit receipt", "document"), {"default": "Tags, limits with units, revisions.", "procedure": "Identity, revision, limits, duties.", "moc": "What changed, why, approvals.", "equipment": "Tag, service, design limits, inspections.", "lease": "Parties, terms, royalties, obligations."}),
        Profile("law", 0.7, _words("matter file", "pin cite", "document"), {"default": "Identity, roles, dated events.", "witness": "Name, role, testimony with dates.", "issue": "Positions, by whom, on what authority.", "matter": "Parties, claims, deadlines, posture."}),
    )
}
DEFAULT_STRICTNESS = 0.5


def profile(name: str | None) -> Profile:
    return PROFILES.get(name or "", PROFILES["personal"])


def guidance(name: str | None, kind: str | None = None) -> str:
    cards = profile(name).cards
    return cards.get(kind or "default", cards["default"])


def strictness(name: str | None, chosen: float | None = None) -> float:
    """The chosen one, unless it is none or the default: then the profile's."""
    own = profile(name).strictness
    return own if own is not None and chosen in (None, DEFAULT_STRICTNESS) else chosen if chosen is not None else DEFAULT_STRICTNESS


RANK = {"viewer": 1, "analyst": 2, "admin": 3}
PERMISSIONS = {**dict.fromkeys(("search", "ask", "report_read", "verify"), "viewer"), **dict.fromkeys(("integrity", "adjudicate", "surveillance", "audit"), "analyst"), **dict.fromkeys(("reindex", "manage", "connectors"), "admin")}


def parse_keys(spec: str) -> dict[str, tuple[str, str]]:
    """key:role:name, comma-separated -> key to (name, role); unknown roles are viewers."""
    out = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        key, role, name = ([x.strip() for x in part.split(":")] + ["", ""])[:3]
        if key:
            out[key] = (name or key[:6], role if role in RANK else "viewer")
    return out


def allowed(role: str | None, permission: str | None, keys: dict) -> bool:
    """Without keys everything is open; a permission that isn't known is closed."""
    return not keys or permission is None or (RANK.get(role or "", 0) >= RANK[PERMISSIONS[permission]] if permission in PERMISSIONS else False)


def authenticate(headers: dict, keys: dict, verify_bearer=None) -> tuple[str, str] | None:
    low = {k.lower(): v for k, v in headers.items()}
    bearer = low.get("authorization", "").removeprefix("Bearer ").strip()
    token = low.get("x-api-key") or bearer
    return keys.get(token) or (verify_bearer(bearer) if verify_bearer and bearer else None)
