"""Connected components by repeated joins, for graphs too large for one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, forget, heavy_keys, lookup


def star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: the greater end of each link, and its other partners, are linked to the least
    partner of that end instead.  Links between equal pairs of nodes, as from many overlapping groups, collapse."""
    low, high = np.minimum(u, v), np.maximum(u, v)
    by = np.lexsort((low, high))
    low, high = low[by], high[by]
    first = np.append(True, high[1:] != high[:-1]) if len(high) else np.empty(0, bool)
    least = low[first][np.cumsum(first) - 1]
    pairs = np.unique(np.column_stack((np.concatenate((least, least)), np.concatenate((high, low)))), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def thin(links: DataFrame) -> DataFrame:
    """(u, v) links -> fewer ones with the same components; see star()."""

    def run(batches):
        for b in batches:
            u, v = star(*(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    ends = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return ends.repartition("v").sortWithinPartitions("v", "u").mapInArrow(run, "u long, v long").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) edges -> (node, component), component being the smallest node reachable.

    Each round gives every vertex the smallest label next to it, passes that on to the vertex that is its present label
    (hook), and then follows labels once more (jump), so the number of rounds grows with the logarithm of the longest
    chain.  The minima are hash aggregates with map-side partials.  The joins that could meet a hub (all edges of one
    vertex) or a hot label (all vertices of one component) answer such keys by broadcast, of fewer than 1,024 rows.
    Isolated vertices are not vertices of the edge table and get no row.  Null ends are dropped; repeated edges and loops
    are harmless; an empty table gives no rows; other columns take no part.
    Raises if the labels still move after `rounds` rounds.
    """
    both = edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    hubs = cut(heavy_keys(both, "v", both.count()))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")))
    n = labels.count()
    for _ in range(rounds):
        near = lookup(both, "v", labels.withColumnRenamed("node", "v"), hubs, "u").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = cut(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")))
        roots = hooked.groupBy("label").agg(F.min("low").alias("root_low"))
        step = lookup(hooked, "label", roots, heavy_keys(hooked, "label", n), "node")
        step = cut(step.select("node", F.col("label").alias("was"), F.least("low", "root_low").alias("label")))
        beyond = step.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = lookup(step, "label", beyond, heavy_keys(step, "label", n), "node")
        new = cut(new.select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        moved = new.where("was <> label").limit(1).count()
        for done in (labels, hooked, step):
            forget(done)
        labels = new.select("node", "label")
        if not moved:
            forget(both), forget(hubs)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components still changing after {rounds} rounds")
