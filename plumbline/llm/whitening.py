"""Whitening of embeddings: principal components by matrix-free block subspace iteration.

Entries become whole numbers x = floor(64 c) + 1000000.  One pass counts the rows and sums each dimension; after that every
pass over the rows computes V Q = X'(X Q) / n on centred rows for a block Q of orthonormal columns, and no covariance matrix
is ever formed from the rows.  The block is orthonormalised (QR), rotated to its Ritz vectors (Rayleigh-Ritz), and iterated
until the residual of each of the k leading pairs is below TOLERANCE of the largest eigenvalue.  Where the residual falls
too slowly, because the spectrum is flat behind the block, the block is doubled, up to all dimensions, where Rayleigh-Ritz is
exact; so the number of passes is bounded by the spectrum or by the logarithm of the dimensions.

What leaves a task is one dimensions x block matrix, added up by Spark; only sums and the block reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Residual of a certified pair, as a share of the largest eigenvalue.
TOLERANCE = 1e-12
#: The block is doubled if the residual has not fallen to this share of the one before.
SLOW = 0.1
#: Eigenvalues below this share of the largest count as zero: there is nothing to scale along them.
RANK = 1e-10
#: Entries times 64 are exact in a double below this.
LARGEST = float(1 << 52)


@dataclass(frozen=True)
class Whitening:
    """What a fit holds; `components` has one column for each of the `values`, which fall."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from differences of whole numbers, so that nothing is lost to the size of x."""
        near, rest = self._mean()
        return (x - near).astype(np.float64) - rest

    def _mean(self) -> tuple[np.ndarray, np.ndarray]:
        near = self.sums // self.n
        return near, (self.sums - near * self.n) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it is outside a 64-bit number."""
        near = self.sums // self.n
        far, rest = x - near, self.sums - near * self.n
        reach = float(np.abs(far).max(initial=0)) * self.n + float(self.n)
        if reach * reach * max(1, x.shape[1]) < 2.0**62:
            own = self.n * far - rest
            return (own * own).sum(1).tolist()
        wide = [sum((self.n * int(f) - int(r)) ** 2 for f, r in zip(row, rest, strict=True)) for row in far]
        return [v if v < 1 << 63 else None for v in wide]


def usable(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """`keep` columns and x array<long>.  Left out: null vectors, vectors with a null or non-finite entry or one of 2^46 or
    more, and those whose length is not the commonest (ties: the shorter).  Zero vectors and repeated rows stay."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(*keep, v.alias("__v")).where(F.col("__v").isNotNull() & (F.size("__v") > 0) & F.forall("__v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * 64 < LARGEST)))
    size = rows.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("__v") == (size["d"] if size else 0)).select(*keep, F.transform("__v", lambda c: F.floor(c * 64) + 1000000).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _added(rows: DataFrame, part, kind: str) -> dict[tuple[int, int], float]:
    """The matrices part(x) of all batches of x, added up: entries by (row, column).

    Each task emits one matrix; equal entries are summed by Spark.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                own = part(matrix(b.column(0)))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    found = rows.select("x").mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # dimensions x block
    return {(r["i"], r["j"]): r["v"] for r in found}


def _filled(entries: dict[tuple[int, int], float], shape: tuple[int, int], kind=np.float64) -> np.ndarray:
    out = np.zeros(shape, kind)
    for (i, j), v in entries.items():
        out[i, j] = v
    return out


def fit(rows: DataFrame, k: int = COMPONENTS, block: int | None = None, tolerance: float = TOLERANCE, max_passes: int = 300, seed: int = 11) -> Whitening | None:
    """The k leading components (fewer, if fewer have an eigenvalue above zero) of the rows of `usable`; None without rows.

    Repeated rows count each.  Raises ArithmeticError if the residuals do not fall below `tolerance` in `max_passes`.
    """
    counted = _added(rows, lambda x: np.vstack((np.full(x.shape[1], len(x)), x.sum(0))), "long")
    if not counted:
        return None
    d = 1 + max(j for _, j in counted)
    both = _filled(counted, (2, d), np.int64)
    start = Whitening(int(both[0, 0]), both[1], np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0, 1)
    n, want = start.n, min(k, d)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, max(want, block or 2 * k)))))[0]
    trace, before = 0.0, np.inf
    for passes in range(2, max_passes + 2):

        def product(x, q=q):
            c = start.centred(x)
            # the last column holds the squared length of the rows' entries, for the trace
            return np.hstack((c.T @ (c @ q), (c * c).sum(0)[:, None]))

        y = _filled(_added(rows, product, "double"), (d, q.shape[1] + 1)) / n
        trace, y = float(y[:, -1].sum()), y[:, :-1]
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        ritz, image = q @ turn, y @ turn
        top = max(values[0], 0.0)
        residuals = np.linalg.norm(image[:, :want] - ritz[:, :want] * values[:want], axis=0)
        if top <= 0 or residuals.max(initial=0.0) <= tolerance * top:
            real = values[:want] > RANK * top
            vectors = ritz[:, :want][:, real]
            signs = np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if vectors.size else np.zeros(0)
            return Whitening(n, both[1], vectors * signs, values[:want][real], residuals[real], trace, passes)
        if residuals.max() > SLOW * before and q.shape[1] < d:
            more = rng.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1]))
            image = np.hstack((image, more - image @ np.linalg.lstsq(image, more, rcond=None)[0]))
            before = np.inf
        else:
            before = residuals.max()
        # where rows span fewer dimensions than the block, QR still returns orthonormal columns
        q = np.linalg.qr(image)[0]
    raise ArithmeticError(f"residuals of {residuals.max() / top:.2g} of the largest eigenvalue after {max_passes} passes")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, from a pass over the rows."""
    k = len(model.values)
    if not k:
        return 0.0

    def product(x):
        w = model.whitened(x)
        return np.vstack((w.T @ w, w.sum(0)))

    both = _filled(_added(rows, product, "double"), (k + 1, k)) / model.n
    return float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening | None, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """`keep` columns, whitened array<double> (one entry a component) and deviation long, one row for each row of `usable`.

    A deviation outside a 64-bit number is null.  No rows, no result; components whose eigenvalue is zero have no entry.
    """
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", whitened array<double>, deviation long"
    names = [*keep, "whitened", "deviation"]

    def run(batches):
        for b in batches:
            if b.num_rows and model is not None:
                x = matrix(b.column(len(keep)))
                w = model.whitened(x)
                starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.ListArray.from_arrays(starts, pa.array(w.ravel())), pa.array(model.deviations(x), pa.int64())], names=names)

    return rows.select(*keep, "x").mapInArrow(run, schema)


def whitened_components(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Null ids and repeated rows are kept, each with its rows; an empty table, or one whose vectors are all alike, gives none.
    Extra columns take no part.
    """
    rows = usable(vectors)
    model = fit(rows, k)
    error = identity_error(rows, model) if model else 0.0
    held = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if model and len(model.values) else F.array().cast("array<double>")
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(held, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
