"""Toxicity by noisy-channel deobfuscation.

A written token is the output of a noisy channel over a clean word: letters are swapped for look-alikes, drawn out, or
held apart by separators or spaces.  Tokens that show such noise become a lattice of clean letters, decoded by Viterbi
search under a character trigram model; other tokens pass unchanged.  The restored words are then scored by a lexicon of
words and word beginnings learned from labelled documents; the evidence of a document is the sum of their log likelihood ratios, turned to a probability.

Both models are fitted on a bounded sample of labelled rows (`max_toxic`, `max_clean` documents, drawn by hash of the id).
A word counts once for each different left neighbour, so near copies of one document do not make a word look frequent.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import crc_fold, draw, texts

#: Clean letters that a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATORS = frozenset(".-_*~'`^:/\\,+|")
SWAP_COST, DROP_COST, DRAWN_COST, PAIR_COST = 1.0, 0.7, 0.5, 3.0
MARGIN = 5.0
CACHE_WORDS = 200_000
_LEAD = regex.compile(r"[^\p{L}\p{N}]*?(?=[@$!|+(€£¡]?[\p{L}\p{N}])")
_TAIL = regex.compile(r"[^\p{L}\p{N}]+$")
_NOISY = regex.compile(r"\p{L}.*[^\p{L}\p{M}]|[^\p{L}\p{M}].*\p{L}|(\p{L})\1\1")


def core(word: str) -> str:
    """Lower case, without the marks around it; a look-alike right before a letter stays."""
    w = word.lower()
    if w.isalpha():
        return w
    lead = _LEAD.match(w)
    return _TAIL.sub("", w[lead.end() :] if lead else "")


@dataclass
class CharacterModel:
    """Trigrams of letters with word ends, interpolated with bigrams and single letters; holds natural logarithms."""

    counts: dict[str, int] = field(default_factory=dict)
    total: int = 0

    @classmethod
    def fit(cls, words: Counter) -> CharacterModel:
        c: Counter = Counter()
        for w, n in words.items():
            s = f"^^{w}$"
            for i in range(2, len(s)):
                for k in (0, 1, 2):
                    c[s[i - k : i + 1]] += n
                    if k:
                        c[s[i - k : i] + "\0"] += n
        return cls(dict(c), sum(n * (len(w) + 1) for w, n in words.items()))

    def log(self, context: str, letter: str) -> float:
        get = self.counts.get
        p = (get(letter, 0) + 0.5) / (self.total + 40)
        for k in (1, 2):
            c = context[-k:]
            seen = get(c + "\0", 0)
            p = (get(c + letter, 0) + 2 * p) / (seen + 2)
        return math.log(p)


def lattice(noisy: str) -> list[list[tuple[str, float, int]]]:
    """Arcs from each position: (clean letters, cost, position reached)."""
    arcs: list[list[tuple[str, float, int]]] = []
    for i, ch in enumerate(noisy):
        run = i + 1
        while run < len(noisy) and noisy[run] == ch:
            run += 1
        out: list[tuple[str, float, int]] = []
        if ch.isalpha():
            out.append((ch, 0.0, i + 1))
            if run - i > 1:
                out += [(ch, DRAWN_COST if run - i > 2 else PAIR_COST, run)] + ([(ch * 2, DRAWN_COST, run)] if run - i > 2 else [])
        else:
            letters = LOOKALIKES.get(ch, "")
            out += [(x, SWAP_COST, i + 1) for x in letters] + ([(x, SWAP_COST + DRAWN_COST, run) for x in letters] if run - i > 1 else [])
            if ch in SEPARATORS or not letters:
                out.append(("", DROP_COST, run if ch in SEPARATORS else i + 1))
        arcs.append(out)
    return arcs


def restore(noisy: str, model: CharacterModel, margin: float = MARGIN) -> list[str]:
    """The clean words that end the best Viterbi path and those within `margin` of it, best first."""
    arcs = lattice(noisy)
    best: list[dict[str, tuple[float, tuple]]] = [{} for _ in range(len(arcs) + 1)]
    best[0]["^^"] = (0.0, ())
    memo: dict[tuple[str, str], float] = {}
    for i, out in enumerate(arcs):
        for state, (score, path) in best[i].items():
            for letters, cost, to in out:
                s, at, p = score - cost, state, path
                for x in letters:
                    key = (at, x)
                    if key not in memo:
                        memo[key] = model.log(at, x)
                    s, at, p = s + memo[key], at[1] + x, (p, x)
                if at not in best[to] or best[to][at][0] < s:
                    best[to][at] = (s, p)
        best[i] = {}
    ends = sorted(((s + model.log(at, "$"), p) for at, (s, p) in best[-1].items()), key=lambda e: -e[0])
    found = []
    for s, p in ends:
        if s < ends[0][0] - margin:
            break
        letters = []
        while p:
            p, x = p
            letters.append(x)
        found.append("".join(reversed(letters)))
    return found


@dataclass
class Model:
    """Lexicon and word beginnings with their log likelihood ratios, letters, and the logistic over summed evidence."""

    words: dict[str, float]
    starts: dict[str, float]
    letters: CharacterModel
    slope: float = 1.0
    shift: float = -5.0
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def feature(self, w: str) -> str | None:
        """What of the model a clean word hits: itself, or else its longest listed beginning."""
        if w in self.words:
            return w
        return next((w[:k] for k in range(min(len(w) - 1, 7), 3, -1) if w[:k] in self.starts), None)

    def clean_word(self, w: str) -> float:
        f = self.feature(w)
        return 0.0 if f is None else self.words.get(f, self.starts.get(f, 0.0))

    def token(self, word: str) -> float:
        """Evidence of one written token, the most of what it may stand for."""
        q = self._known.get(word)
        if q is None:
            c = core(word)
            q = self.clean_word(c)
            if not q and len(c) > 2 and _NOISY.search(c):
                q = max([0.0, *map(self.clean_word, restore(c, self.letters))])
            if len(self._known) < CACHE_WORDS:
                self._known[word] = q
        return q

    def spaced(self, letters: str) -> float:
        """Evidence of a run of single characters: any lexicon word inside one of its restorations."""
        return max([0.0, *(q for r in restore(letters, self.letters) for w, q in self.words.items() if len(w) > 3 and w in r)])

    def evidence(self, raw: bytes) -> float:
        words = raw.decode("utf-8", "replace").split()
        total = 0.0
        known = self._known
        for w, n in Counter(words).items():
            q = known.get(w)
            if q is None:
                q = self.token(w)
            if q:
                total += q * n
        size = np.fromiter(map(len, words), np.int32, len(words))
        short = np.flatnonzero(size == 1)
        if len(short) > 2:
            for run in np.split(short, np.flatnonzero(np.diff(short) > 1) + 1):
                if len(run) > 3:
                    s = "".join(words[i] for i in run).lower()
                    if len(set(s)) > 2:
                        total += self.spaced(s)
        return total

    def score(self, raw: bytes) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.slope * min(self.evidence(raw), 50.0) + self.shift))))


def _divergence(p: np.ndarray, q: float) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))


def fit(toxic: list[str], clean: list[str], least: float = 0.8, odds: float | None = None) -> Model:
    """Learn lexicon and letters.  Without documents of both labels nothing is toxic.

    `odds` are the odds of toxic to clean documents in the population, if the sample does not keep them.

    A word, or a beginning shared by five words, enters if nearly all its contexts are toxic and this is not chance:
    (n times the divergence from the toxic share of all contexts) exceeds the logarithm of 100 times the candidates.
    """
    ids: dict[str, int] = {}
    pairs: list[np.ndarray] = []
    tokens: Counter = Counter()
    cores: dict[str, str] = {}
    for group in (toxic, clean):
        keys = []
        for t in group:
            raw = t.split()
            cores.update((w, core(w)) for w in set(raw).difference(cores))
            words = [cores[w] for w in raw]
            tokens.update(words)
            x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
            keys.append((np.concatenate(([-1], x[:-1])) + 1) << 32 | x if len(x) else x)
        pairs.append(np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64))
    letters = CharacterModel.fit(Counter({w: n for w, n in tokens.items() if w.isalpha() and len(w) < 40}))
    if not toxic or not clean or not ids:
        return Model({}, {}, letters)
    names = list(ids)
    n1, n0 = (np.bincount(p & 0xFFFFFFFF, minlength=len(ids)) for p in pairs)
    share = min(0.9, max(1e-6, n1.sum() / max(1, n1.sum() + n0.sum())))

    def accepted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = a / np.maximum(1, a + b)
        return (p >= max(least, share)) & ((a + b) * _divergence(p, share) > math.log(100 * len(a)))

    words = {names[i]: 0.0 for i in np.flatnonzero(accepted(n1, n0)) if len(names[i]) > 2 and names[i].isalpha()}
    sums: dict[str, list[int]] = {}
    for w, a, b in zip(names, n1.tolist(), n0.tolist(), strict=True):
        for k in range(4, min(len(w), 8)):
            s = sums.setdefault(w[:k], [0, 0, 0, 0])
            s[0] += a
            s[1] += b
            s[2] += b == 0
            s[3] += b > 0
    many = [(k, v) for k, v in sums.items() if v[2] >= 5 and v[2] > v[3] and k.isalpha()]
    starts = {}
    if many:
        a, b = (np.array([v[i] for _, v in many]) for i in (0, 1))
        starts = {many[i][0]: 0.0 for i in np.flatnonzero(accepted(a, b))}
    model = Model(words, starts, letters)
    # log likelihood ratio of each feature, over documents
    hits = [Counter(f for w in set(map(cores.__getitem__, set(t.split()))) if (f := model.feature(w))) for group in (toxic, clean) for t in group]
    d1, d0 = Counter(f for h in hits[: len(toxic)] for f in h), Counter(f for h in hits[len(toxic) :] for f in h)
    for part in (words, starts):
        for f in part:
            part[f] = max(0.1, math.log((d1[f] + 0.5) / (len(toxic) + 1)) - math.log((d0[f] + 0.5) / (len(clean) + 1)))
    model._known.clear()
    # logistic over the evidence of the documents, with a light ridge
    x = np.minimum([model.evidence(t.encode()) for group in (toxic, clean) for t in group], 50.0)
    y = np.repeat([1.0, 0.0], [len(toxic), len(clean)])
    a, b = 1.0, -3.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        v = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * (b + 3)])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b + (math.log(odds * len(clean) / len(toxic)) if odds else 0.0))
    model._known.clear()
    return model


def train(docs: DataFrame, labels: DataFrame, fold: int | None = 5, max_toxic: int = 1500, max_clean: int = 3000, max_total: int = 30_000_000) -> Model:
    """Fit on a bounded sample of whole labelled documents whose crc32(doc_id) modulo `fold` is not 0 (None: all labelled)."""
    drawn = draw(docs, labels, "toxic", {1: max_toxic, 0: max_clean}, max_total, (fold, 0) if fold else None)
    # the odds over all labelled documents; the sample holds fewer clean ones
    known = labels.where("toxic IN (0, 1)")
    sizes = {r["toxic"]: r["n"] for r in (known.where(crc_fold("doc_id", fold) != 0) if fold else known).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return fit([r["t"] for r in drawn[1]], [r["t"] for r in drawn[0]], odds=sizes[1] / sizes[0] if len(sizes) == 2 else None)


def assess(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """`keep` columns plus score and predicted, one row for each row of `docs`.

    Null or empty text gets the score of a text without a hit.  A text of any length is read whole; its evidence is capped
    where the probability no longer moves.  A score equal to the threshold counts as toxic.  Repeated rows are scored each;
    an empty table gives no rows; other columns take no part.
    """
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    def run(batches):
        for b in batches:
            s = [model.score(t) for t in texts(b, "__text")]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)


def filter_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns kept; null and empty texts, repeated rows and an empty
    table as in assess()."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(t) < threshold for t in texts(b)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
