"""Narration under a numeric guard: a text that states a number the evidence lacks is discarded whole."""

from __future__ import annotations

import re
from collections.abc import Callable

from plumbline.plans.brief import passages

_NUMBER = re.compile(r"(?<![\w.])[-+]?\$?(\d[\d,]*\.?\d*|\.\d+)(?:e([-+]?\d+))?\s?(%|[KMBkmb]\b)?")
_SCALE = {"k": 1e3, "m": 1e6, "b": 1e9}
TOLERANCE = 0.02


def extract_numbers(text: str) -> list[float]:
    return [float(m[1].replace(",", "")) * 10 ** int(m[2] or 0) * _SCALE.get((m[3] or "").lower(), 1) for m in _NUMBER.finditer(text)]


def is_allowed(value: float, allowed: list[float]) -> bool:
    """Within 2 % of an allowed number, of a hundredth or of a hundred times it, or equal when rounded."""
    return any(abs(value - abs(a) * f) <= TOLERANCE * abs(a * f) or value == round(abs(a) * f) for a in allowed for f in (1, 0.01, 100))


def allowed_numbers(*sources) -> list[float]:
    """Numbers in nested values and texts, and 0 to 12."""
    out = [float(i) for i in range(13)]
    for s in sources:
        if isinstance(s, dict):
            out += allowed_numbers(*s.values())[13:]
        elif isinstance(s, (list, tuple)):
            out += allowed_numbers(*s)[13:]
        elif isinstance(s, str):
            out += extract_numbers(s)
        elif isinstance(s, (int, float)) and not isinstance(s, bool):
            out.append(float(s))
    return out


def verify(text: str, allowed: list[float]) -> list[float]:
    return [v for v in extract_numbers(text) if not is_allowed(v, allowed)]


RULES = (
    "State no number that is not in this payload.",
    "Notes lie near the period; never say that one caused the finding.",
    "Say so if the evidence is descriptive or of limited power.",
    "Keep every caveat.",
    "Two or three sentences.",
)


def payload(card: dict, brief: dict | None = None, context: list[dict] = ()) -> dict:
    """What a writer may see: the finding with its evidence, the passages of a brief that speak of it, the notes, the rules."""
    evidence = card.get("evidence") or {}
    subjects = {card.get("measure"), card.get("dimension"), *(evidence.get(k) for k in ("dim", "dim_b", "value", "value_b"))} - {None}
    cited = [x for x in (passages(brief) if brief else []) if x["kind"] == "gotcha" or subjects & set(x["subjects"])]
    audit = card.get("audit") or {}
    return {
        "finding": {k: card.get(k) for k in ("analysis", "measure", "dimension", "grain", "period", "summary")} | {"evidence": {k: evidence.get(k) for k in ("test", "statistic", "p", "q", "n", "low_power")} if evidence else None, "search": {k: audit.get(k) for k in ("tests", "survived", "q_limit")} if audit else None},
        "passages": cited[:6], "notes": [{k: h.get(k) for k in ("id", "dates", "text", "score")} for h in context], "rules": list(RULES), "allowed_numbers": allowed_numbers(card, list(context)),
    }


def narrate(card: dict, context: list[dict] = (), writer: Callable[[dict], str] | None = None, brief: dict | None = None) -> dict:
    """The writer's text if each of its numbers is in evidence, else the card's own summary and why."""
    own = {"text": card.get("summary", ""), "source": "template", "reason": None}
    if writer is None:
        return own
    try:
        text = writer(payload(card, brief, list(context)))
    except Exception as e:  # a failing writer must not lose the finding
        return own | {"reason": f"writer failed: {type(e).__name__}"}
    wrong = verify(text, allowed_numbers(card, list(context)))
    return own | {"reason": f"numbers without evidence: {wrong}"} if wrong else {"text": text, "source": "writer", "reason": None}
