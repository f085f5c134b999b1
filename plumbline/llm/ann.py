"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  Every row is posted, with its rank, in the inverted file of
each of its `prefix` nearest pivots.  A query walks the inverted files of its own nearest pivots and sums the footrule
distance of the two orders (a pivot that is missing counts as rank `prefix`); the rows of least footrule distance, ties
included, are reranked by exact Euclidean distance.

Index rows lie in hash blocks of about `block_rows`, each one table row with its inverted files; queries lie in blocks
too, and each pair of blocks is one bounded piece of work that returns k rows a query.  Pivots are chosen from a bounded
sample (SAMPLE rows, drawn by hash of the id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

PIVOTS, PREFIX, SAMPLE = 256, 128, 2048
#: Share of a block that is reranked, and the least number of rows.
SHARE, LEAST = 0.1, 64
BLOCK_ROWS, QUERY_ROWS = 4096, 512


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): one row an id, v of doubles.  Null, zero or non-finite vectors and null ids take no part, nor do vectors
    whose length is not the commonest (ties: the shorter); of several vectors of one id the least counts."""
    v = F.col(vector).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (size["n"] if size else 0)).groupBy("id").agg(F.min("v").alias("v"))


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """At most `pivots` rows of the sample, in its order: first those that keep half the median distance from all taken
    before, so that copies and tight clusters do not use up the pivots; then, if these are few, other different rows."""
    sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
    some = sample[:512]
    typical = np.median(np.sqrt(np.maximum(0, (some * some).sum(1)[:, None] + (some * some).sum(1)[None] - 2 * some @ some.T))[np.triu_indices(len(some), 1)]) if len(some) > 1 else 0.0
    apart = np.full(len(sample), np.inf)
    taken = []
    for i in range(len(sample)):
        if len(taken) < pivots and apart[i] > typical / 2:
            taken.append(i)
            apart = np.minimum(apart, np.sqrt(((sample - sample[i]) ** 2).sum(1)))
    rest = [i for i in range(len(sample)) if i not in set(taken)]
    return sample[taken + rest[: pivots - len(taken)]]


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Nearest pivots of each row, nearest first, ties by pivot number."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None]
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def post(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files: (starts by pivot, row numbers, ranks)."""
    rows, prefix = order.shape
    flat = order.ravel().astype(np.int64)
    by = np.argsort(flat, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=pivots))))
    return starts.astype(np.int32), (by // prefix).astype(np.int32), (by % prefix).astype(np.int16)


def copies(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different vectors, starts, ids): the ids of vector i, ascending, are ids[starts[i]:starts[i + 1]]."""
    different, which = np.unique(x, axis=0, return_inverse=True)
    by = np.lexsort((ids, which.ravel()))
    return different, np.concatenate(([0], np.cumsum(np.bincount(which.ravel(), minlength=len(different))))), ids[by]


def search_block(q: np.ndarray, q_ids: np.ndarray, q_order: np.ndarray, x: np.ndarray, owner: tuple[np.ndarray, np.ndarray], files: tuple, k: int, share: float, least: int):
    """Rows (query id, id, distance): the k nearest of the reranked candidates of each query in this block.

    Candidates are different vectors, so that a vector with many copies cannot crowd out others; the ids of a vector come
    back by `owner` = (starts, ids), of which the first k + 1 can matter.
    """
    starts, rows, ranks = files
    begin, ids = owner
    prefix = q_order.shape[1]
    out_q, out_id, out_d = [], [], []
    ranks = ranks.astype(np.int32)
    # what a shared pivot saves, of the footrule distance of two orders without a shared one
    at = np.arange(prefix)
    save = 2 * prefix - at[:, None] - at[None, :] - np.abs(at[:, None] - at[None, :])
    want = min(len(x), max(least, int(np.ceil(share * len(x)))) + 1)  # one more, as the query may be among them
    for i in range(len(q)):
        saved = np.zeros(len(x), np.int32)
        for place, p in enumerate(q_order[i].tolist()):
            a, b = starts[p], starts[p + 1]
            saved[rows[a:b]] += save[place][ranks[a:b]]
        cut_at = np.partition(saved, len(saved) - want)[len(saved) - want]
        near = np.flatnonzero(saved >= cut_at)
        d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
        if len(near) > k + 1:  # vectors beyond the (k + 1)-th distance cannot matter
            reach = d <= np.partition(d, k)[k]
            near, d = near[reach], d[reach]
        lists = [ids[begin[v] : min(begin[v + 1], begin[v] + k + 1)] for v in near]
        d, found = np.repeat(d, [len(v) for v in lists]), np.concatenate(lists)
        d, found = d[found != q_ids[i]], found[found != q_ids[i]]
        best = np.lexsort((found, d))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_id.append(found[best])
        out_d.append(d[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_d)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest other rows found.

    Fewer than k candidates: all of them.  Ties go to the smaller id.  Empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors, id_col, vector))
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    pivot = spread(np.array([r["v"] for r in sample]), pivots)
    prefix = min(prefix, len(pivot))
    blocks, dim = max(1, -(-n // BLOCK_ROWS)), pivot.shape[1]

    def pack(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy().astype(np.int64)
        x = t.column("v").combine_chunks()
        x = np.asarray(x.flatten() if not isinstance(x, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in x.chunks]), np.float64).reshape(-1, dim)
        by = np.argsort(ids, kind="stable")
        return ids[by], x[by]

    def index(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        ids, x = pack(t)
        x, begin, ids = copies(ids, x)
        starts, posted, ranks = post(orders(x, pivot, prefix), len(pivot))
        return pa.table({"block": pa.array([block], pa.int64()), "begin": [begin.astype(np.int64).tobytes()], "ids": [ids.tobytes()], "x": [x.tobytes()], "starts": [starts.tobytes()], "posted": [posted.tobytes()], "ranks": [ranks.tobytes()]})

    def ask(t: pa.Table) -> pa.Table:
        ids, x = pack(t)
        return pa.table({"q_ids": [ids.tobytes()], "q": [x.tobytes()], "q_order": [orders(x, pivot, prefix).tobytes()]})

    table = cut(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInArrow(index, "block long, begin binary, ids binary, x binary, starts binary, posted binary, ranks binary"))
    asked = rows.where(F.col("id") % every == 0)
    parts = max(1, -(-n // every // QUERY_ROWS))
    queries = cut(asked.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts))).groupBy("part").applyInArrow(ask, "q_ids binary, q binary, q_order binary"))
    # the stated query set meets all rows, block by block
    pairs = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(table.hint("shuffle_hash"), "block")

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                got = search_block(
                    np.frombuffer(r["q"]).reshape(-1, dim), np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_order"], np.int16).reshape(-1, prefix),
                    np.frombuffer(r["x"]).reshape(-1, dim), (np.frombuffer(r["begin"], np.int64), np.frombuffer(r["ids"], np.int64)), (np.frombuffer(r["starts"], np.int32), np.frombuffer(r["posted"], np.int32), np.frombuffer(r["ranks"], np.int16)), k, share, least,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

    found = pairs.repartition(2 * blocks, "block").mapInArrow(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
