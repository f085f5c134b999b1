"""SimHash near-duplicate detection by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 two-bit segments and mapped to its 32 bit counts (each 0, 1 or 2), held in unary
(00, 01, 11), so that the Manhattan distance of two vectors is the bit count of their xor.  It never exceeds the Hamming
distance of the fingerprints, so it prunes without losing links:

* grid: the segments form `b` blocks.  A pair at Manhattan distance <= d touches at most d blocks, so it agrees on the
  counts of at least b - d of them; every choice of b - d blocks is one grid, and its counts are the cell.  A pair within
  reach meets in a cell of at least one grid.
* range: inside a cell, rows are ordered by total bit count, only rows whose totals differ by <= d meet, and of those
  only pairs at Manhattan distance <= d go on.
* verify: what is left is compared exactly by Hamming distance.

Equal fingerprints collapse to one row before the grid, so groups of copies of any size cost one vertex.  A cell with
more than `block_rows` rows is cut into chunks, and each pair of chunks is one bounded task.  A task returns a spanning
forest of the links it finds, never all pairs, and the forests are joined by connected components.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, forget, heavy_keys, lookup, texts
from plumbline.llm.components import connected_components, star, thin

SEGMENTS = 32
#: Chance that two random two-bit segments have equal counts: (1/4)^2 + (1/2)^2 + (1/4)^2.
SEGMENT_AGREE = 0.375
_ORDER = np.arange(63, -1, -1, dtype=np.uint64)


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of `words` consecutive words, repeats included; fewer words: the whole sequence."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in map(b" ".join, zip(*[found[i:] for i in range(k)], strict=False))], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hash: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 5, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus `fp` (the fingerprint as a signed long).  Null or wordless text: zero."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, words, seed)) for t in texts(b, "__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(fps, pa.int64())], names=[*keep, "fp"])

    return source.mapInArrow(run, schema)


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments in unary: the low bit of a segment says one or more, the high bit two."""
    x = fps.view(np.uint64)
    low = np.uint64(0x5555555555555555)
    high_bits, low_bits = (x >> np.uint64(1)) & low, x & low
    return (high_bits | low_bits) | ((high_bits & low_bits) << np.uint64(1))


def grids(blocks: int, distance: int) -> list[np.ndarray]:
    """Masks over the counts, one for each choice of blocks - distance blocks."""
    edge = [round(i * SEGMENTS / blocks) for i in range(blocks + 1)]
    part = [sum(3 << (2 * s) for s in range(edge[i], edge[i + 1])) for i in range(blocks)]
    return [np.uint64(sum(part[i] for i in pick)) for pick in combinations(range(blocks), blocks - distance)]


def blocks_for(rows: int, distance: int, candidates: int) -> int:
    """The fewest blocks for which a row meets at most `candidates` random rows, over all grids."""
    for b in range(distance + 1, 2 * distance + 8):
        if rows * comb(b, distance) * SEGMENT_AGREE ** (SEGMENTS * (b - distance) / b) <= candidates:
            return b
    return 2 * distance + 7


def forest(fps_a: np.ndarray, fps_b: np.ndarray, distance: int, band: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at `distance` or less within a, or between a and b (b another array)."""
    same = fps_a is fps_b
    nodes = fps_a if same else np.concatenate((fps_a, fps_b))
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ones_a, ones_b = (np.bitwise_count(x.view(np.uint64)).astype(np.int64) for x in (fps_a, fps_b))
    oa, ob = np.argsort(ones_a, kind="stable"), np.argsort(ones_b, kind="stable")
    a, b, sa, sb = fps_a[oa].view(np.uint64), fps_b[ob].view(np.uint64), ones_a[oa], ones_b[ob]
    lo, hi = np.searchsorted(sb, sa - distance, "left"), np.searchsorted(sb, sa + distance, "right")
    shift = 0 if same else len(fps_a)
    counts_a, counts_b = segment_counts(a), segment_counts(b)
    us, vs = [], []
    step = max(1, band // max(1, len(b)))
    for i in range(0, len(a), step):
        j0, j1 = int(lo[i : i + step].min()), int(hi[i : i + step].max())
        x, y = np.nonzero(np.bitwise_count(counts_a[i : i + step, None] ^ counts_b[None, j0:j1]) <= distance)
        near = np.bitwise_count(a[i + x] ^ b[j0 + y]) <= distance
        for x, y in zip(x[near].tolist(), y[near].tolist(), strict=True):
            u, v = int(oa[i + x]), int(ob[j0 + y]) + shift
            if u == v or (same and u > v):
                continue
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
                us.append(u)
                vs.append(v)
    return nodes[np.array(us, np.int64)], nodes[np.array(vs, np.int64)]


def link_forest(distinct: DataFrame, rows: int, distance: int = 4, candidates: int = 4096, block_rows: int = 4096) -> DataFrame:
    """Distinct fingerprints (`fp`) -> (u, v) links whose components are those of all pairs within `distance`."""
    masks = grids(blocks_for(rows, distance, candidates), distance)

    def cells(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            packed = segment_counts(fps)
            for g, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fps), g, np.int32)), pa.array((packed & mask).view(np.int64)), pa.array(fps)], names=["grid", "cell", "fp"]
                )

    placed = distinct.select("fp").mapInArrow(cells, "grid int, cell long, fp long")
    large = placed.groupBy("grid", "cell").count().where(F.col("count") > block_rows).select("grid", "cell", F.ceil(F.col("count") / block_rows).cast("int").alias("chunks"))
    # a chunk of a large cell goes to every pair of chunks that it is part of; other cells are one chunk
    spread = placed.join(large, ["grid", "cell"], "left").select("grid", "cell", "fp", F.coalesce("chunks", F.lit(1)).alias("k")).withColumn("me", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    paired = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "grid", "cell", F.least("me", "other").alias("p"), F.greatest("me", "other").alias("q"), "me", "fp"
    )

    def links(batches):
        """Sorted rows of whole cells; a cell may run over batches, and is never larger than two chunks."""
        held: list[np.ndarray] = []
        for t in batches:
            new = np.column_stack([t.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            rows = np.concatenate([*held, new]) if held else new
            if not len(rows):
                continue
            cuts = np.nonzero((rows[1:, :4] != rows[:-1, :4]).any(1))[0] + 1
            held = [rows[cuts[-1] :] if len(cuts) else rows]
            if len(cuts):
                yield solve(rows[: cuts[-1]], cuts[:-1])
        if held:
            yield solve(held[0], np.empty(0, np.int64))

    def solve(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        edges = np.concatenate(([0], cuts, [len(rows)]))
        for i in np.nonzero(np.diff(edges) > 1)[0]:
            x = rows[edges[i] : edges[i + 1]]
            if x[0, 2] == x[0, 3]:
                u, v = forest(x[:, 5], x[:, 5], distance) if len(x) > 2 else close(x[:, 5])
            else:
                here = x[:, 4] == x[0, 2]
                a, b = x[here, 5], x[~here, 5]
                u, v = forest(a, b, distance)
            if len(u):
                us.append(u)
                vs.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    def close(two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = int(two[0] ^ two[1]).__and__((1 << 64) - 1).bit_count() <= distance
        return (two[:1], two[1:]) if near else (two[:0], two[:0])

    keys = ["grid", "cell", "p", "q"]
    return thin(paired.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(links, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, distance: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: id, fp, component_id (the smallest id reachable over links, itself included).

    Null or wordless texts have fingerprint zero and link like any other.  Empty table: no rows.  Repeated ids stay
    repeated rows.  Other columns of `docs` take no part, so clashing names do no harm.
    """
    fps = cut(fingerprints(docs, text, words, seed, (id_col,)))
    distinct = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    n = distinct.count()
    edges = link_forest(distinct, n, distance, 4096 if distance < 5 else 65536)
    parts = connected_components(edges)
    # only fingerprints with a link have a component; the smallest id of a component is found over fingerprints
    linked = cut(distinct.join(parts, distinct.fp == parts.node).select("fp", "least_id", F.col("component").alias("class")))
    named = linked.groupBy("class").agg(F.min("least_id").alias("component_id"))
    moved = lookup(linked, "class", named, heavy_keys(linked, "class", n), "fp").select("fp", "component_id")
    label = cut(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")))
    forget(parts), forget(linked), forget(distinct)
    return lookup(fps, "fp", label, heavy_keys(fps, "fp", fps.count()), id_col)


def deduplicate(docs: DataFrame, words: int = 5, distance: int = 4) -> DataFrame:
    """The first row of each near-duplicate component, by doc_id (nulls last) and then by place; all columns kept.

    Rows are told apart by a number of their own, so rows with no id or a repeated id take part like any other.
    """
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    return _first_rows(rows, near_duplicates(rows, "__row", "text", words, distance))


#: Wide fingerprints: PRINTS words of 64 bits or more, mapped to the bit counts of their segments.  Two texts at five-word
#: Jaccard 0.8 differ in about 15 % of the bits, so a segment keeps its count with chance 0.734; random ones with SEGMENT_AGREE.
PRINTS, MOST_PRINTS, NEAR_AGREE, MISS = 16, 64, 0.734, 0.007
#: Random rows that a row may meet over all cells; from here on cells are made of more segments, and of more words.
MEET = 1 << 16
#: Most differing bits of the first two words (128 bits) of a candidate; 19 are expected at Jaccard 0.8, deviation 4.
CHECK_BITS = 36
BLOCK_ROWS = 4096
GROUP_ROWS = 2048
_MIX = np.random.default_rng(64).integers(0, 1 << 64, MOST_PRINTS, dtype=np.uint64)[:, None]


def cell_plan(rows: int) -> tuple[int, int]:
    """(segments of a cell, words of a fingerprint): the least cells over which a row meets MEET random rows at most, and the
    words that make enough of them for a pair at Jaccard 0.8 to share none with chance MISS only."""
    for width in range(8, 14):
        cells = ceil(log(MISS) / log(1 - NEAR_AGREE**width))
        prints = max(PRINTS, ceil(cells * width / SEGMENTS))
        if prints > MOST_PRINTS:
            break
        found = width, prints
        if rows * (prints * SEGMENTS // width) * SEGMENT_AGREE**width <= MEET:
            break
    return found


def wide_fingerprint(hashes: np.ndarray, prints: int = PRINTS) -> np.ndarray:
    """`prints` fingerprints of the shingles, each from the hashes mixed anew; no hash: zeros."""
    counts = np.zeros((prints, 64), np.int64)
    for at in range(0, len(hashes), 2048):
        x = hashes[None, at : at + 2048] ^ _MIX[:prints]
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8).reshape(prints, -1, 8), axis=2, bitorder="little")
        counts += bits.sum(1, dtype=np.uint16)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def wide_fingerprints(rows: DataFrame, words: int = 5, seed: int = 42, size: int = PRINTS) -> DataFrame:
    """__row, copy (digest of the lower-cased words, the same for copies only) and prints (the wide fingerprint of `size` words)."""

    def run(batches):
        for b in batches:
            raw = texts(b)
            copies = [xxhash.xxh3_128_digest(b" ".join(t.lower().split()), seed) for t in raw]
            prints = [wide_fingerprint(shingle_hashes(t, words, seed), size).tobytes() for t in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(copies, pa.binary()), pa.array(prints, pa.binary())], names=["__row", "copy", "prints"])

    return rows.select("__row", "text").mapInArrow(run, "__row long, copy binary, prints binary")


def near_in_block(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions) of the pairs with at most CHECK_BITS differing bits of the words a and b.

    The Manhattan distance of the segment counts comes first, and bits are compared where it lets a pair through.
    """
    n, step = len(a), max(1, (1 << 20) // max(1, len(a)))
    degree = np.zeros(n, np.int64)
    ca, cb = segment_counts(a), segment_counts(b)
    for i in range(0, n, step):
        x, y = np.nonzero(np.bitwise_count(ca[i : i + step, None] ^ ca) + np.bitwise_count(cb[i : i + step, None] ^ cb) <= CHECK_BITS)
        near = np.bitwise_count(a[i + x] ^ a[y]) + np.bitwise_count(b[i + x] ^ b[y]) <= CHECK_BITS
        degree[i : i + step] = np.bincount(x[near], minlength=min(step, n - i)) - 1
    left = np.flatnonzero(degree)
    us, vs = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(a[left] ^ a[at]) + np.bitwise_count(b[left] ^ b[at]) <= CHECK_BITS
            found = left[near]
            us.append(np.full(len(found), at))
            vs.append(found)
            queue.extend(found)
            left = left[~near]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def _groups(batches, keys: int):
    """Runs of rows with equal first `keys` columns, in sorted batches, as lists of whole tables (a run may span batches)."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        moved = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            moved |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(moved) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(c[lo] for c in cols)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def count_cells(prints: np.ndarray, width: int) -> np.ndarray:
    """Cells of fingerprints (rows of words): each is the counts of `width` segments, with the number of the cell before them."""
    counts = segment_counts(prints)
    cells = counts.shape[1] * SEGMENTS // width
    bits = np.unpackbits(counts.view(np.uint8), axis=1, bitorder="little")[:, : cells * 2 * width].reshape(-1, cells, 2 * width)
    return bits @ (1 << np.arange(2 * width, dtype=np.int64)) + (np.arange(cells, dtype=np.int64) << (2 * width))


def candidate_forest(distinct: DataFrame, width: int = 8) -> DataFrame:
    """(node, prints) -> (u, v) links, whose components are those of all pairs that share a cell of segment counts and pass
    CHECK_BITS, by Manhattan distance of their counts and then by their bits."""

    def place(batches):
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                if not b.num_rows:
                    continue
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(b.num_rows, -1)
                key = count_cells(x, width)
                wide = lambda v: pa.array(np.repeat(v, key.shape[1]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel()), wide(b.column(0).to_numpy()), wide(x[:, 0].view(np.int64)), wide(x[:, 1].view(np.int64))], names=["cell", "node", "a", "b"]
                )

    placed = distinct.select("node", "prints").mapInArrow(place, "cell long, node long, a long, b long")
    paired = _pairs_of_chunks(placed, ["cell"], "node", BLOCK_ROWS)

    def links(batches):
        """Sorted rows; all whole cells of a batch at once, as most have few rows."""
        held: list[np.ndarray] = []
        for t in batches:
            new = np.column_stack([t.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            rows = np.concatenate([*held, new]) if held else new
            if not len(rows):
                continue
            cuts = np.nonzero((rows[1:, :3] != rows[:-1, :3]).any(1))[0] + 1
            held = [rows[cuts[-1] :] if len(cuts) else rows]
            if len(cuts):
                yield solve(rows[: cuts[-1]], cuts[:-1])
        if held:
            yield solve(held[0], np.empty(0, np.int64))

    def solve(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
        size = ends - starts
        node, a, b = (np.ascontiguousarray(rows[:, i]).view(np.uint64) for i in (3, 4, 5))
        ca, cb = segment_counts(a), segment_counts(b)
        stop = np.where(np.repeat(size <= 16, size), np.repeat(ends, size), 0)
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s in range(1, 16):
            i = np.flatnonzero(np.arange(len(rows)) + s < stop)
            if not len(i):
                break
            i = i[np.bitwise_count(ca[i] ^ ca[i + s]) + np.bitwise_count(cb[i] ^ cb[i + s]) <= CHECK_BITS]
            i = i[np.bitwise_count(a[i] ^ a[i + s]) + np.bitwise_count(b[i] ^ b[i + s]) <= CHECK_BITS]
            us.append(rows[i, 3])
            vs.append(rows[i + s, 3])
        for k in np.flatnonzero(size > 16):
            at = slice(starts[k], ends[k])
            u, v = near_in_block(a[at], b[at])
            us.append(rows[at, 3][u])
            vs.append(rows[at, 3][v])
        u, v = star(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    keys = ["cell", "p", "q"]
    return thin(paired.select(*keys, "node", "a", "b").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(links, "u long, v long"))


def _pairs_of_chunks(rows: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """Rows with p, q: a group of more than `most` rows is cut into chunks, and each pair of chunks is a group of its own."""
    large = rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("k"))
    spread = rows.join(large, keys, "left").withColumn("me", F.coalesce(F.pmod(F.xxhash64(member), F.col("k")), F.lit(0)).cast("int"))
    others = F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("k") - 1), F.col("me")))
    return spread.withColumn("other", F.explode(others)).withColumn("p", F.least("me", "other")).withColumn("q", F.greatest("me", "other"))


def jaccard_forest(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """A spanning forest (positions) of the pairs of sorted sets at Jaccard `least` or more, counted exactly."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, ids = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    posting, begin = owner[order], np.searchsorted(ids[order], np.arange(len(flat) + 1))
    first = np.concatenate(([0], np.cumsum(sizes)))
    free = np.ones(len(sets), bool)
    us, vs = [], []
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue and free.any():
            at = queue.pop()
            common = np.zeros(len(sets), np.int64)
            for x in ids[first[at] : first[at + 1]]:
                common[posting[begin[x] : begin[x + 1]]] += 1
            whole = sizes + sizes[at] - common
            found = np.flatnonzero(free & ((common >= least * whole - 1e-9) if sizes[at] else sizes == 0)).tolist()
            free[found] = False
            us += [at] * len(found)
            vs += found
            queue += found
    return us, vs


def verified_copies(rows: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """__row, component_id for each row (__row, text): groups linked by pairs at Jaccard `least` or more of their shingles.

    Candidates come from cells of segment counts of wide fingerprints; each candidate component is then linked by exact Jaccard of its texts' shingle
    sets, so a fingerprint alone never makes a link.  Null or wordless texts are copies of each other.
    """
    width, size = cell_plan(rows.count())
    prints = cut(wide_fingerprints(rows, words, seed, size))
    distinct = cut(prints.groupBy("copy").agg(F.min_by(F.struct("__row", "prints"), "__row").alias("least")).select("copy", F.col("least.__row").alias("node"), F.col("least.prints").alias("prints")))
    groups = connected_components(candidate_forest(distinct, width))
    members = cut(rows.select(F.col("__row").alias("node"), "text").join(groups, "node").select("component", "node", "text"))
    forget(groups)

    def links(batches):
        for t in _groups(batches, 3):
            node = t.column("node").to_numpy()
            sets = [np.unique(shingle_hashes(x.as_py().encode(), words, seed)) if x.is_valid else np.empty(0, np.uint64) for x in t.column("text")]
            u, v = jaccard_forest(sets, least)
            yield pa.RecordBatch.from_arrays([pa.array(node[u], pa.int64()), pa.array(node[v], pa.int64())], names=["u", "v"])

    keys = ["component", "p", "q"]
    paired = _pairs_of_chunks(members, ["component"], "node", GROUP_ROWS).select(*keys, "node", "text")
    true = connected_components(paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(links, "u long, v long"))
    named = cut(distinct.join(true, "node", "left").select("copy", F.coalesce("component", "node").alias("component_id")))
    forget(members), forget(true), forget(distinct)
    found = prints.select("__row", "copy")
    return lookup(found, "copy", named, heavy_keys(found, "copy", found.count()), "__row").select("__row", "component_id")


def deduplicate_verified(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Like deduplicate(), over groups linked by pairs at Jaccard `least` or more."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    return _first_rows(rows, verified_copies(rows, words, least))


def _first_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row of `rows` for each component_id of found (__row, component_id)."""
    ranked = rows.select("__row", "doc_id").join(found.select("__row", "component_id"), "__row")
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first"))
    return rows.join(first.select(F.col("first.__row").alias("__row")), "__row", "left_semi").select(*[c for c in rows.columns if c != "__row"])
