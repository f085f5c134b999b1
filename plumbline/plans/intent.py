"""Questions to intents, by fixed patterns; what was assumed is recorded."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.operators.profile import Profile

# The words that name an analysis, a grain or a shape; the first that matches decides.
ANALYSES = (
    ("scan", r"\b(scan|survey|overview|anything (interesting|notable)|what stands out|explore|surpris)"),
    ("forecast", r"\b(forecast|predict|project|next (month|quarter|year|period|\d)|what happens next|expected)"),
    ("explain", r"\b(explain|decompos|attribut|contribut|mix shift|composition|simpson|break ?down the (change|move|drop|drift))"),
    ("correlate", r"\b(correlat|relationship|move together|co.?move|linked|associated|odd one|outlier)"),
    ("deepdive", r"\b(deep ?dive|profile|every (member|value)|all (members|values)|full analysis|break down)"),
    ("drill", r"\b(why|reason|cause|diagnos|root|drop|decline|fell|fall|worse|spike|surge|anomal|drill|localiz|localis|where)"),
)
GRAIN_WORDS = (
    ("day", r"\b(daily|day|days|by day)\b"),
    ("week", r"\b(weekly|week|weeks|wow)\b"),
    ("quarter", r"\b(quarterly|quarter|quarters|qoq|q[1-4])\b"),
    ("year", r"\b(yearly|annual|annually|year|years|yoy)\b"),
    ("month", r"\b(monthly|month|months|mom)\b"),
)
SHAPES = (
    ("trend", r"\btrend|over time|history|by (month|quarter|year|week|day)\b"),
    ("topk", r"\btop|bottom|best|worst|rank|highest|lowest\b"),
    ("total", r"\btotal|overall|sum|grand|how much|how many\b"),
)
MONEY_WORDS = r"\b(sales|revenue|gmv|turnover|top ?line|bookings)\b"
MONEY_COLUMNS = r"revenue|sales|gmv|amount|value|total|price"
LOWEST_WORDS = r"\b(bottom|worst|lowest)\b"


def _first(table, text: str) -> str | None:
    return next((name for name, pattern in table if re.search(pattern, text)), None)


def match_column(text: str, columns: list[str]) -> str | None:
    """The longest column name that the text holds, with separators read as spaces."""
    plain = {c: re.sub(r"[_\-.]+", " ", c.lower()).strip() for c in columns}
    held = [c for c in columns if plain[c] and (plain[c] in text or c.lower() in text)]
    return max(held, key=lambda c: len(plain[c]), default=None)


def match_member(text: str, p: Profile) -> tuple[str, str] | None:
    """(dimension, member) of the longest member named as a word, of three letters or more."""
    found = [(d, m) for d, ms in p.members.items() for m in ms if len(m) >= 3 and re.search(rf"\b{re.escape(m.lower())}\b", text)]
    return max(found, key=lambda f: len(f[1]), default=None)


#: Analyses that need a dimension.
DIVIDED = ("drill", "deepdive", "explain")


def measure_named(text: str, p: Profile) -> bool:
    """Whether a text names a measure, by its column or by a word for money, and not merely leaves one to be assumed."""
    return _named_measure(text, p) is not None


def _named_measure(text: str, p: Profile) -> str | None:
    names = p.measure_names()
    return match_column(text, names) or (next((m for m in names if re.search(MONEY_COLUMNS, m, re.I)), None) if re.search(MONEY_WORDS, text) else None)


def _resolve_measure(text: str, p: Profile) -> tuple[str | None, list[str]]:
    """(measure, the options it was assumed from, if none was named)."""
    names = p.measure_names()
    named = _named_measure(text, p)
    return (named, []) if named else (names[0], names if len(names) > 1 else []) if names else (None, [])


def _resolve_dimension(text: str, p: Profile, analysis: str | None) -> tuple[str | None, list[str]]:
    names = p.dim_names()
    named = match_column(text, names) or (match_member(text, p) or (None,))[0]
    if named or analysis not in DIVIDED or not names:
        return named, []
    return names[0], names if len(names) > 1 else []


def _number(text: str, word: str, most: int, default: int) -> int:
    found = re.search(rf"\b{word}\s+(\d{{1,2}})\b", text)
    return min(most, int(found[1])) if found else default


def parse_intent(question: str, p: Profile) -> dict:
    """Each slot is resolved on its own from the text and the profile; slots that were assumed are listed as unresolved."""
    text = f" {question.lower().strip()} "
    analysis = _first(ANALYSES, text)
    slots = {"measure": _resolve_measure(text, p), "dimension": _resolve_dimension(text, p, analysis)}
    measure, dimension = (slots[name][0] for name in slots)
    hit = match_member(text, p)
    plain = _first(SHAPES, text) or ("breakdown" if dimension else "trend")
    return {
        "question": question, "analysis": analysis, "shape": "analysis" if analysis else plain, "measure": measure, "explicit": measure is not None and measure_named(text, p), "dimension": dimension, "member": hit[1] if hit and hit[0] == dimension else None,
        "grain": _first(GRAIN_WORDS, text) or "month", "k": _number(text, "top", 20, 5), "horizon": _number(text, "next", 12, 3), "ascending": bool(re.search(LOWEST_WORDS, text)), "period": None,
        "unresolved": [{"field": name, "options": options, "chose": chosen} for name, (chosen, options) in slots.items() if options],
    }


def read_questions(questions: DataFrame, p: Profile) -> DataFrame:
    """(id, question) -> id and the slots of each question; the profile, which is small, goes with the tasks.

    Questions are dealt to all cores, however few splits they come in, and of a batch each different one is read once.
    """
    slots = {"analysis": pa.string(), "shape": pa.string(), "measure": pa.string(), "explicit": pa.bool_(), "dimension": pa.string(), "member": pa.string(), "grain": pa.string(), "k": pa.int32(), "horizon": pa.int32(), "ascending": pa.bool_()}
    sql = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int"}

    def run(batches):
        for b in batches:
            asked = pa.array([q or "" for q in b.column(1).to_pylist()], pa.string()).dictionary_encode()
            read = [parse_intent(q, p) for q in asked.dictionary.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[name] for r in read], kind).take(asked.indices) for name, kind in slots.items()]], names=["id", *slots])

    dealt = questions.select("id", "question").repartition(questions.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"id {questions.schema['id'].dataType.simpleString()}, " + ", ".join(f"{name} {sql[kind]}" for name, kind in slots.items()))


def suggestions(p: Profile) -> list[dict]:
    """Questions that the columns at hand can answer, one for each analysis and one lookup."""
    measures, dims = p.measure_names(), p.dim_names()
    if not measures:
        return []
    m = measures[0]
    offers = [("Does anything stand out? Scan", "scan"), (f"Forecast {m} for the next 3 periods", "forecast")]
    if dims:
        offers += [(f"{m} by {dims[0]}", None), (f"Why did {m} drop?", "drill"), (f"Deep dive into {m} by {dims[0]}", "deepdive"), (f"Explain the change in {m}", "explain")]
    if len(measures) > 1:
        offers.append((f"What correlates with {m}?", "correlate"))
    order = [None, *(name for name, _ in ANALYSES)]
    return [{"text": text, "analysis": analysis} for text, analysis in sorted(offers, key=lambda o: order.index(o[1]))]
