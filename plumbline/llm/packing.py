"""Packing along a space-filling curve.

Each document becomes the mean of hashed token vectors in `DIMS` dimensions; the dimensions are standardised by their
mean and spread over all documents, cut to `BITS` bits, and turned into a Hilbert key.  Documents are range-sorted by
that key and laid end to end; the line is cut every `max_tokens` tokens.  Neighbours on the curve so share sequences, and
only the last sequence is not full.

The line is built without a global window.  Light rows (key, row, length) are range-sorted, and each range gives its first
row and its number of tokens; so the driver learns where each range begins on the line (one row a range, and a range holds
about RANGE_BYTES of ids).  Then the token arrays are dealt by range, sorted, and cut while the place on the line is counted.
Token arrays are written once and shuffled once, at every size.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, texts

DIMS, BITS = 4, 10
RANGE_BYTES = 32 << 20
_SCALE = 1 << 20
#: Words kept in each worker's cache; once full it stays as it is (frequent words come early), and other words are encoded anew.
CACHE_WORDS, CACHE_PARTS = 900_000, 700_000
_LETTERS = regex.compile(r"[^\p{L}\p{N}']+|\p{L}+")


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that never joins across ASCII white space.

    `encode` gives the ids as little-endian unsigned 32-bit numbers.  Words go through a cache; a word made of letters
    and of symbols without digits or apostrophes is put together from cached parts, since the pre-tokenizer splits there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words: dict[bytes, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _plain(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _split(self, word: str) -> list[str]:
        """Parts that encode on their own; only plain ASCII words are split, others may compose under NFC."""
        if not word.isascii() or "<|" in word:
            return [word]
        parts = _LETTERS.findall(word)
        return [p.lower() for p in parts] if sum(map(len, parts)) == len(word) else [word]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        split = {w: self._split(w.decode()) for w in words}
        new = list({p for parts in split.values() for p in parts if p not in self._parts})
        fresh = dict(zip(new, self._plain(new), strict=True)) if new else {}
        known = self._parts
        found = {w: b"".join([fresh[p] if p in fresh else known[p] for p in parts]) for w, parts in split.items()}
        if len(known) < CACHE_PARTS:
            known.update(fresh)
        if len(self._words) < CACHE_WORDS:
            self._words.update(found)
        return found

    def encode(self, raw: bytes) -> bytes:
        words = raw.split()
        known = self._words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            found = self._learn({w for w in words if w not in known})
            return b"".join([found[w] if w in found else known[w] for w in words])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, so that its cache lasts over tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def hashed_vectors(vocabulary: int, dims: int = DIMS) -> np.ndarray:
    """A fixed vector for each token id, from a hash of (id, dimension); entries in [-1, 1)."""
    x = (np.arange(vocabulary, dtype=np.uint64)[:, None] * np.uint64(dims) + np.arange(dims, dtype=np.uint64)) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, dims) with coordinates below 2**bits (Skilling's method)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turn, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def encode_documents(docs: DataFrame, path: str, end_id: int, narrow: bool) -> DataFrame:
    """(row, doc_id, ids, n, c0..): a unique row number, the ids with the end id, their number, fixed-point coordinates."""
    width = "<u2" if narrow else "<u4"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, ids binary, n long, " + ", ".join(f"c{i} long" for i in range(DIMS))

    def run(batches):
        encode, at = tokenizer(path).encode, TaskContext.get().partitionId() << 36
        vectors = hashed_vectors(1 << 16).astype(np.float64)
        tail = np.array([end_id], "<u4").tobytes()
        for big in batches:
            for start in range(0, big.num_rows, 256):
                b = big.slice(start, 256)
                ids = [np.frombuffer(encode(t) + tail, "<u4") for t in texts(b)]
                mean = np.array([np.ones(len(x)) @ vectors[x & 0xFFFF] / len(x) for x in ids]).reshape(-1, DIMS)
                fixed = np.rint(mean * _SCALE).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(ids))), b.column(0), pa.array([x.astype(width).tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())] + [pa.array(fixed[:, i]) for i in range(DIMS)],
                    names=["row", "doc_id", "ids", "n"] + [f"c{i}" for i in range(DIMS)],
                )
                at += len(ids)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def curve(light: DataFrame):
    """Function of fixed-point coordinates (n, DIMS) to keys: standardised by mean and spread over all documents, squashed to
    the unit interval, cut to BITS bits, on the Hilbert curve."""
    whole = "decimal(38,0)"
    sums = light.agg(F.count("*").alias("rows"), *[F.sum(F.col(f"c{i}").cast(whole)).alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col(f"c{i}").cast(whole) * F.col(f"c{i}").cast("decimal(20,0)")).alias(f"q{i}") for i in range(DIMS)]).first()
    rows = max(1, sums["rows"])
    mean = np.array([float(sums[f"s{i}"] or 0) / rows for i in range(DIMS)])
    spread = np.sqrt(np.maximum(np.array([float(sums[f"q{i}"] or 0) / rows for i in range(DIMS)]) - mean**2, 1.0))

    def keys(columns: list[pa.Array]) -> np.ndarray:
        x = np.array([c.to_numpy(zero_copy_only=False) for c in columns], np.float64).T
        unit = 1 / (1 + np.exp(-1.7 * np.clip((x - mean) / spread, -8, 8)))
        return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))

    return keys


def ranges(light: DataFrame, keys, count: int) -> tuple[list[tuple[int, int]], list[int]]:
    """First (key, row) of each of about `count` ranges of all documents in the order (key, row), and where it begins on the line."""

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys([b.column(i + 2) for i in range(DIMS)]))], names=["row", "n", "key"])

    def total(batches):
        first, tokens = None, 0
        for b in batches:
            if b.num_rows:
                first = first or (b.column(0)[0].as_py(), b.column(1)[0].as_py())
                tokens += int(b.column(2).to_numpy(zero_copy_only=False).sum())
        if first:
            yield pa.RecordBatch.from_pylist([{"key": first[0], "row": first[1], "n": tokens}])

    keyed = light.select("row", "n", *[f"c{i}" for i in range(DIMS)]).mapInArrow(place, "row long, n long, key long")
    found = keyed.select("key", "row", "n").repartitionByRange(count, "key", "row").sortWithinPartitions("key", "row").mapInArrow(total, "key long, row long, n long")
    firsts, begins, at = [], [], 0
    for r in sorted(found.collect()):  # one row a range
        firsts.append((r["key"], r["row"]))
        begins.append(at)
        at += r["n"]
    return firsts, begins


def pack(docs: DataFrame, path: str, max_tokens: int = 2048, end_id: int = 1, narrow: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: only the end id.  Repeated ids are packed once for each row.  An empty table gives no rows.
    A document longer than a sequence is cut where the sequence ends; each id lies in exactly one piece.  Documents of
    equal key lie in the order of the table.  Columns of `docs` other than doc_id and text take no part.  `narrow` stores
    ids in 16 bits and needs a vocabulary below 65,536.
    """
    encoded = cut(encode_documents(docs, path, end_id, narrow))
    keys = curve(encoded)
    width = "<u2" if narrow else "<u4"
    tokens = int(encoded.agg(F.sum("n")).first()[0] or 0)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens * np.dtype(width).itemsize // RANGE_BYTES)
    firsts, begins = ranges(encoded, keys, parts)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def deal(batches):
        for b in batches:
            key, rows = keys([b.column(i + 3) for i in range(DIMS)]), b.column(0).to_pylist()
            part = [bisect_right(firsts, at) - 1 for at in zip(key.tolist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(key), b.column(0), b.column(1), b.column(2)], names=["part", "key", "row", "doc_id", "ids"])

    def pieces(batches):
        part, g = None, 0
        for b in batches:
            out = []
            which: list[int] = []
            for k, (now, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if now != part:
                    part, g = now, begins[now]
                ids = np.frombuffer(raw, width).astype("<u4")
                at = 0
                while at < len(ids):
                    piece = ids[at : at + max_tokens - g % max_tokens]
                    out.append((at, len(piece), crc32(piece.tobytes()), len(ids), g // max_tokens, g % max_tokens))
                    which.append(k)
                    at += len(piece)
                    g += len(piece)
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(which, pa.int32()))] + [pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = encoded.select("row", "doc_id", "ids", *[f"c{i}" for i in range(DIMS)]).mapInArrow(deal, f"part int, key long, row long, doc_id {kind}, ids binary")
    line = dealt.repartition(parts, "part").sortWithinPartitions("part", "key", "row").select("part", "doc_id", "ids")
    return line.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
