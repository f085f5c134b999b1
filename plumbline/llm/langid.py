"""Language identification by a byte convolutional network, in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its largest response in
the window (max pooling), and a softmax layer turns the pooled responses into languages.  A text is covered whole by
windows that overlap by one filter width less one; its language is that of the length-weighted mean of the windows' log
probabilities.  The network learns, on the driver, from a bounded sample (`max_docs` documents of each language, drawn
by hash of the id); only text and language of the allowed folds are read for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import crc_fold, draw, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_WIDE = max(WIDTHS)
_STEP = WINDOW - _WIDE + 1


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, zero-padded, and how many bytes each is the first to cover."""
    n = max(1, -(-max(1, len(raw) - _WIDE + 1) // _STEP))
    buffer = np.zeros((n - 1) * _STEP + WINDOW, np.uint8)
    buffer[: len(raw)] = np.frombuffer(raw, np.uint8)
    covered = np.full(n, _STEP, np.float64)
    covered[-1] = max(1, len(raw) - (n - 1) * _STEP)
    return np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)[::_STEP], covered


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED); byte 0 is padding and stays zero
    filters: np.ndarray  # (_WIDE * EMBED, FILTERS * widths); a filter of less width has zero rows at its end
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(patches, filter responses before pooling) of windows x."""
        e = self.embed[x]
        patches = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), _WIDE * EMBED, axis=1)[:, ::EMBED]
        flat = np.ascontiguousarray(patches).reshape(-1, _WIDE * EMBED)
        return flat, (flat @ self.filters).reshape(len(x), _STEP, -1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(x)[1].max(1) + self.bias, 0)
        z = (pooled @ self.out + self.out_bias).astype(np.float64)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, raws: list[bytes], chunk: int = 256) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(raws)
        if not self.languages:
            return found
        use = [i for i, r in enumerate(raws) if _LETTER.search(r.decode("utf-8", "replace"))]
        sums = np.zeros((len(raws), len(self.languages)))
        weights = np.zeros(len(raws))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        share: list[np.ndarray] = []

        def flush() -> None:
            if held:
                x, o, w = np.concatenate(held), np.concatenate(owner), np.concatenate(share)
                for at in range(0, len(x), chunk):
                    part = slice(at, at + chunk)
                    np.add.at(sums, o[part], self.log_probabilities(x[part]) * w[part, None])
                np.add.at(weights, o, w)
            held.clear(), owner.clear(), share.clear()

        pending = 0
        for i in use:
            for at in range(0, len(raws[i]), 1 << 20):  # a very long text is read in stretches
                x, w = windows(raws[i][at : at + (1 << 20)])
                held.append(x)
                owner.append(np.full(len(x), i))
                share.append(w)
                pending += len(x)
            if pending >= 8 * chunk:
                flush()
                pending = 0
        flush()
        for i in use:
            mean = sums[i] / weights[i]
            p = np.exp(mean - mean.max())
            k = int(mean.argmax())
            found[i] = (self.languages[k], float(p[k] / p.sum()))
        return found


def fit(texts_by_language: dict[str, list[str]], epochs: int = 10, batch: int = 64, per_text: int = 4, rate: float = 4e-3, seed: int = 7) -> Network:
    """Train by Adam on random windows of the texts, half of them cut short so that short texts are known too.

    No language: a network that answers `und`.  One language: always that one.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(k for k, v in texts_by_language.items() if any(v))
    count = FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(_WIDE) < w).astype(np.float32), EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.3, (_WIDE * EMBED, count)) * mask).astype(np.float32),
        np.zeros(count, np.float32), rng.normal(0, 0.1, (count, max(1, len(languages)))).astype(np.float32), np.zeros(max(1, len(languages)), np.float32),
    )
    net.embed[0] = 0
    if not languages:
        return net
    rows, label = [], []
    for k, name in enumerate(languages):
        for t in texts_by_language[name]:
            raw = t.encode()
            for j in range(per_text if len(raw) > WINDOW else 1):
                size = WINDOW if j % 2 == 0 else int(rng.integers(12, WINDOW))
                at = int(rng.integers(0, max(1, len(raw) - size)))
                piece = np.zeros(WINDOW, np.uint8)
                cut = np.frombuffer(raw[at : at + size], np.uint8)
                piece[: len(cut)] = cut
                rows.append(piece)
                label.append(k)
    x, y = np.array(rows), np.array(label)
    weight = (1 / np.bincount(y, minlength=len(languages)))[y]
    weight /= weight.mean()
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        step = rate * (1 - epoch / epochs)
        for s in range(0, len(order), batch):
            part = order[s : s + batch]
            flat, r = net.responses(x[part])
            at = r.argmax(1)  # (b, count)
            top = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + net.bias
            pooled = np.maximum(top, 0)
            z = pooled @ net.out + net.out_bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            dz = (p * weight[part, None] / len(part)).astype(np.float32)
            dpool = (dz @ net.out.T) * (top > 0)
            taken = flat[(np.arange(len(part))[:, None] * _STEP + at).ravel()].reshape(len(part), count, -1)
            dfilters = np.einsum("bfd,bf->df", taken, dpool) * mask
            # the embedding learns through the patches that won
            dpatch = (dpool[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            which = x[part][np.arange(len(part))[:, None, None], at[:, :, None] + np.arange(_WIDE)].ravel()
            dembed = np.stack([np.bincount(which, dpatch[:, d], minlength=256) for d in range(EMBED)], axis=1).astype(np.float32)
            dembed[0] = 0
            t += 1
            for i, g in enumerate((dembed, dfilters, dpool.sum(0), pooled.T @ dz, dz.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= (step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, fold: tuple[int, int] | None = (4, 2), max_docs: int = 400, max_total: int = 30_000_000, max_languages: int = 200) -> Network:
    """Fit on at most `max_docs` whole documents of each language (fewer once they hold `max_total` characters).

    Nothing of the fold (modulus, remainder) is read, neither text nor language.  The `max_languages` languages of most
    documents are learned (ties by name).  Null languages, null texts and rows without id are left out.
    """
    named = docs.where("lang IS NOT NULL")
    if fold:
        named = named.where(crc_fold("doc_id", fold[0]) != fold[1])
    languages = [r["lang"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    if not languages:
        return fit({})
    drawn = draw(docs, named.select("doc_id", "lang"), "lang", dict.fromkeys(languages, max_docs), max_total, fold)
    return fit({k: [r["t"] for r in v] for k, v in drawn.items()})


def identify(docs: DataFrame, network: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus lang_pred and score, one row for each row of `docs`.

    Null text, or text without a letter: `und` with score 0.  A text of any length is read whole, in windows.  Ties of
    probability go to the language that is first by name.  Repeated rows are answered each; an empty table gives no rows;
    other columns take no part.
    """
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                found = network.predict(texts(b, "__text"))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)
