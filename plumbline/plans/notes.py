"""Context notes: chunks of texts with dates and subjects, matched to periods by an interval join."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.textdates import date_spans
from plumbline.functions.timeaxis import period_range
from plumbline.operators.joins import dated_matches, mentions

# Scores of a note for subjects and terms, with caps and the floor.
PER_SUBJECT, SUBJECT_CAP, PER_TERM, TERM_CAP, LEAST, LIMIT = 40, 80, 3, 15, 20, 4
def chunk(text: str) -> list[dict]:
    """Bullets and paragraphs, each under its last heading."""
    out, heading, held = [], "", []

    def close() -> None:
        if held:
            out.append({"heading": heading, "text": " ".join(held)})
            held.clear()

    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("#"):
            close()
            heading = s.lstrip("# ") if s.startswith("#") else heading
        elif re.match(r"([-*+]|\d+[.)])\s+", s):
            close()
            held.append(re.sub(r"^([-*+]|\d+[.)])\s+", "", s))
        else:
            held.append(s)
    close()
    return out


def index_notes(spark: SparkSession, text: str, subjects: list[str] = ()) -> DataFrame:
    """(id, heading, text, dates, subjects, terms) of a document's chunks; a document is read whole, so it is small."""
    rows = [(i, c["heading"], c["text"]) for i, c in enumerate(chunk(text))]
    return index_chunks(spark.createDataFrame(rows, "id int, heading string, text string"), spark.createDataFrame([(s,) for s in subjects], "name string"))


def index_chunks(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(id, heading, text) and (name) -> chunks with their dates, the names they mention and their terms."""
    whole = F.concat_ws(" ", "heading", "text")
    named = mentions(chunks.select("id", whole.alias("text")), names).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("subjects"))
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit("[a-z0-9]{3,}"), F.lit(0))))
    out = chunks.select("id", "heading", "text", date_spans(whole).alias("dates"), terms.alias("terms")).join(named, "id", "left")
    return out.select("id", "heading", "text", "dates", F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"), "terms")


def retrieve(notes: DataFrame, period: str, grain: str, subjects: list[str] = (), question: str = "", limit: int = LIMIT) -> DataFrame:
    """The best notes for a period, with score and why.  A note whose dates all lie elsewhere is rejected."""
    start, end = period_range(period, grain)
    asked = F.array(*[F.lit(s) for s in subjects]).cast("array<string>")
    words = F.array(*[F.lit(w) for w in sorted(set(re.findall(r"[a-z0-9]{3,}", question.lower())))]).cast("array<string>")
    when = dated_matches(notes.sparkSession.createDataFrame([(start, end)], "start date, end date"), notes).select("id", F.col("score").alias("near"))
    scored = notes.join(when, "id", "left").withColumn("aligned", F.coalesce("near", F.when(F.size("dates") == 0, 0))).where("aligned IS NOT NULL").drop("near")
    score = F.col("aligned") + F.least(F.lit(SUBJECT_CAP), F.size(F.array_intersect("subjects", asked)) * PER_SUBJECT) + F.least(F.lit(TERM_CAP), F.size(F.array_intersect("terms", words)) * PER_TERM)
    return scored.withColumn("score", score).where(F.col("score") >= LEAST).orderBy(F.desc("score"), "id").limit(limit)


def context_sentence(hits: list[dict], period: str) -> str:
    return f"Notes near {period} mention: {hits[0]['text']} (from the notes; not shown to be the cause)." if hits else ""
