"""Quality rules: base counts plus a calibrated logistic regression on hashed word and character n-grams.

The regression is fitted on the driver over a bounded sample of labelled rows (`max_rows` per label, chosen by hash of
the id, so the choice does not depend on partitioning).  Scoring reads whole texts in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import draw, texts

BITS = 16
SIZE = 1 << BITS
SYMBOLS = b"#*$%&|<>"
#: A text is rejected below this probability of being good.
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_PIECE = 1 << 20


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    if distinct >= 1 << 21:  # keep the triple in 63 bits
        pair = np.unique(ids[:-2].astype(np.int64) * distinct + ids[1:-1], return_inverse=True)[1].astype(np.int64)
        triple = np.unique(pair, return_inverse=True)[1].astype(np.int64) * distinct + ids[2:]
    else:
        triple = (ids[:-2].astype(np.int64) * distinct + ids[1:-1]) * distinct + ids[2:]
    _, inverse, counts = np.unique(triple, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


@dataclass(frozen=True)
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    word_hash: np.ndarray  # hash bucket of each distinct word
    word_count: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def measure(raw: bytes) -> Measures:
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    blank = len(raw) - sum(map(len, words))
    points = len(raw.decode("utf-8", "replace")) if raw else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return Measures(
        len(words), points - blank, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids, len(seen)),
        np.fromiter((crc32(w) & (SIZE - 1) for w in seen), np.int64, len(seen)), np.bincount(ids, minlength=len(seen)) if len(ids) else np.zeros(0, np.int64),
    )


def grams(raw: bytes) -> list[np.ndarray]:
    """Hash buckets of all character (byte) n-grams of three, in pieces of bounded size that overlap by two bytes."""
    found = []
    for at in range(0, max(0, len(raw) - 2), _PIECE):
        a = np.frombuffer(raw[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        found.append((((a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return found


@dataclass(frozen=True)
class Model:
    """Weights of the word and n-gram buckets, and the two numbers of the logistic calibration."""

    words: np.ndarray
    chars: np.ndarray
    slope: float
    shift: float

    def logit(self, raw: bytes, m: Measures) -> float:
        s = float(self.words[m.word_hash] @ m.word_count) / max(1, m.n_words)
        found = grams(raw)
        n = sum(map(len, found))
        return s + sum(float(self.chars[x].sum(dtype=np.float64)) for x in found) / max(1, n)

    def probability(self, raw: bytes, m: Measures) -> float:
        z = self.slope * self.logit(raw, m) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _row(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = measure(raw)
    g = grams(raw)
    c = np.bincount(np.concatenate(g), minlength=0) if g else np.zeros(0, np.int64)
    at = np.nonzero(c)[0]
    return np.concatenate((m.word_hash, at + SIZE)), np.concatenate((m.word_count / max(1, m.n_words), c[at] / max(1, c.sum()))).astype(np.float32)


def fit(raws: list[bytes], good: np.ndarray, steps: int = 80, rate: float = 1.0, decay: float = 1e-6) -> Model:
    """AdaGrad over whole batches on four fifths of the rows; the rest calibrates.  No rows or one class: all good."""
    good = np.asarray(good, np.float64)
    if len(raws) < 10 or good.min() == good.max():
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 5.0 if not len(good) or good.max() > 0 else -5.0)
    rows = [_row(r) for r in raws]
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    hold = np.arange(len(rows)) % 5 == 4
    learn = ~hold
    if good[learn].min() == good[learn].max() or good[hold].min() == good[hold].max():
        learn = np.ones(len(rows), bool)
        hold = learn
    share = np.where(good == 1, 0.5 / good[learn].sum(), 0.5 / (1 - good[learn]).sum()) * learn  # classes weigh the same
    w, sq = np.zeros(2 * SIZE), np.full(2 * SIZE, 1e-8)
    z = np.zeros(len(rows))
    for _ in range(steps):
        pull = share * (1 / (1 + np.exp(-z)) - good)
        grad = np.bincount(index, value * pull[owner], minlength=2 * SIZE) + decay * w
        sq += grad * grad
        w -= rate * grad / np.sqrt(sq)
        z = np.bincount(owner, value * w[index], minlength=len(rows))
    # logistic calibration on the rows held back, by Newton's method with a light ridge
    a, b = 1.0, 0.0
    x, y = z[hold], good[hold]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return Model(w[:SIZE].astype(np.float32), w[SIZE:].astype(np.float32), float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, max_total: int = 30_000_000) -> Model:
    """Fit on at most `max_rows` labelled whole documents of each label, or fewer once they hold `max_total` characters.

    Both bounds hold for the sample of the fit only.  Null labels and null texts are not drawn.  A document labelled
    twice is drawn for each of its labels.
    """
    drawn = draw(docs, labels, "quality", {0: max_rows, 1: max_rows}, max_total)
    # interleave by hash so that the rows held back for calibration hold both labels
    rows = sorted([(r["h"], str(r["doc_id"]), q, r["t"]) for q, part in drawn.items() for r in part])
    return fit([r[3].encode() for r in rows], np.array([r[2] for r in rows], np.float64))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """`keep` columns plus the counts, base_failed, quality_p and kept.

    Null or empty text: all counts zero, so base_failed.  A text of any length is read whole.  A probability equal to the
    threshold passes.  Repeated rows are judged each; an empty table gives no rows; columns of `docs` other than `keep` and
    text take no part.
    """
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = ", ".join(f"{c} long" for c in COUNTS)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + f", {fields}, base_failed boolean, quality_p double, kept boolean"

    def run(batches):
        for b in batches:
            raws = texts(b, "__text")
            found = [measure(r) for r in raws]
            p = [model.probability(r, m) for r, m in zip(raws, found, strict=True)]
            failed = [m.base_failed for m in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.array([getattr(m, c) for m in found], pa.int64()) for c in COUNTS]
                + [pa.array(failed, pa.bool_()), pa.array(p, pa.float64()), pa.array([not f and x >= threshold for f, x in zip(failed, p, strict=True)], pa.bool_())],
                names=[*keep, *COUNTS, "base_failed", "quality_p", "kept"],
            )

    return source.mapInArrow(run, schema)


def filter_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that pass, all columns kept: null and empty texts do not, a text of any length is read whole, a
    probability equal to the threshold passes, repeated rows are judged each, an empty table stays empty."""
    cols = docs.columns
    at = cols.index("text")

    def run(batches):
        for b in batches:
            ok = []
            for r in texts(b, cols[at]):
                m = measure(r)
                ok.append(not m.base_failed and model.probability(r, m) >= threshold)
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
