"""Hash-chained decision records."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import Profile


def canonical(value) -> str:
    """JSON with sorted keys and numbers to 12 significant digits."""

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.12g}")
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), default=str, ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def fingerprint(df: DataFrame, p: Profile) -> dict:
    """Hashes of content and structure.  Rows have no order on a cluster, so the content hash adds up row hashes; it is not
    the hash of a file's text."""
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]).cast("decimal(38,0)")
    s = df.agg(F.count("*").alias("n"), F.sum(row).alias("a"), F.sum(F.abs(row) % 1000003 * (row % 998244353)).alias("b")).first()
    return {"rows": s["n"], "content": digest([s["n"], str(s["a"]), str(s["b"])]), "structure": digest([df.columns, p.time, p.dim_names(), [(m.name, m.agg) for m in p.measures]])}


def build_record(identity: dict, result: dict, previous: str | None = None, clock=lambda: datetime.now(timezone.utc).isoformat()) -> dict:
    """`identity` says what was asked of which data and never holds a time; the record hash covers all but itself."""
    record = {"identity": digest(identity), "asked": identity, "result": result, "time": clock(), "previous": previous}
    return record | {"hash": digest(record)}


def append(journal: list[dict], identity: dict, result: dict, **options) -> list[dict]:
    return [*journal, build_record(identity, result, journal[-1]["hash"] if journal else None, **options)]


def verify_record(record: dict) -> list[str]:
    faults = [] if record.get("hash") == digest({k: v for k, v in record.items() if k != "hash"}) else ["content does not match its hash"]
    return faults + ([] if record.get("identity") == digest(record.get("asked")) else ["identity does not match what was asked"])


def verify_journal(journal: list[dict], head: str | None = None) -> list[tuple[int, str]]:
    """Faults as (position, reason); `head` is the known hash of the last record, without which a lost end goes unseen."""
    faults = [(i, f) for i, r in enumerate(journal) for f in verify_record(r)]
    faults += [(i, "chain broken") for i, r in enumerate(journal) if r.get("previous") != (journal[i - 1]["hash"] if i else None)]
    if head is not None and (not journal or journal[-1]["hash"] != head):
        faults.append((len(journal), "the journal does not end with its known last record"))
    return faults


def to_markdown(journal: list[dict]) -> str:
    return "\n".join(["# Journal", *(f"- {r['time']} `{r['hash'][:12]}` {canonical(r['asked'])}: {canonical(r['result'])}" for r in journal)])
