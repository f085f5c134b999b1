"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to five symbols, with the counts of the symbols that follow: the 256 byte values
and an end mark.  A symbol unseen in a context escapes to the next shorter one (escape mass: the number of different
symbols seen, method C), and symbols of the longer context are excluded there.  Below the empty context all remaining
symbols are equally likely.  Places before a text hold a mark of their own.

The trie is a table: (order, context and symbol, count), with one row a context beside it, and it keeps every context of the
whole training corpus.  It is never gathered: documents lie in blocks of bounded bytes, each block asks once for each of
its different grams (context and symbol), joins find the probability of every different gram of the corpus once, and the
answers go back to the blocks.  What is asked is kept in buckets of the gram (or word), so counting and answering shuffle it
once.  Texts and answers travel to their block packed: one compressed row holds many.  The score of a document is the sum over
its grams.

The unigram base works alike: a block asks once for each of its words.  A gram or word occurs at most once a block, however
frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import crc_fold, cut, cut_by, forget, texts

ORDER = 5
#: Symbols are 0 to 255 for bytes, then the end of a text and the places before it; BITS hold one.
END, BEFORE, BITS = 256, 257, 9
SYMBOLS = 257
BLOCK_BYTES = 16 << 20
_PART = 1 << 20
_EMPTY = np.int64(-1)


def gram_keys(raw: bytes, size: int = 1 << 20):
    """For each byte of a text and its end, the ORDER + 1 symbols that end there, as one number; in stretches of `size`."""
    padded = np.empty(len(raw) + ORDER + 1, np.int64)
    padded[:ORDER], padded[ORDER:-1], padded[-1] = BEFORE, np.frombuffer(raw, np.uint8), END
    for at in range(0, len(raw) + 1, size):
        part = padded[at : at + size + ORDER]
        key = np.zeros(len(part) - ORDER, np.int64)
        for i in range(ORDER + 1):
            key = (key << BITS) | part[i : len(part) - ORDER + i]
        yield key


class Table:
    """A fixed hash table of 64-bit keys (not negative) in numpy: key -> position in the arrays it was built from."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.where = np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == _EMPTY
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[first]] = keys[first]
            self.where[slot[first]] = first
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.where[slot], -1)
        ask = np.flatnonzero((there != keys) & (there != _EMPTY))
        at = slot[ask]
        while len(ask):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[ask]
            out[ask[hit]] = self.where[at[hit]]
            on = ~hit & (there != _EMPTY)
            ask, at = ask[on], at[on]
        return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, with the sums of their counts."""
    keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _by_block(batches, begin, add, end):
    """Runs begin() for each run of equal blocks (column 0), add(held, text) for its rows, and yields end(block)."""
    block = None
    for b in batches:
        for name, held, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b, "text"), strict=True):
            if name != block:
                if block is not None:
                    yield from end(block)
                begin()
                block = name
            add(held, raw.lower())
    if block is not None:
        yield from end(block)


def split_words(low: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and the number of the text that each is in.  They stay in one Arrow array, as a Python object
    for each would take several times the room of the texts."""
    lists = pc.ascii_split_whitespace(pa.array(low, pa.binary()).view(pa.string()))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    which = np.repeat(np.arange(len(low)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return flat.filter(real).view(pa.binary()), which[real.to_numpy(zero_copy_only=False)]


def in_parts(texts_: Iterable[bytes], size: int = 4 << 20) -> Iterator[list[bytes]]:
    """Texts in runs of about `size` bytes; a longer text is a run of its own."""
    held, total = [], 0
    for t in texts_:
        if held and total + len(t) > size:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t)
    if held:
        yield held


def block_words(blocks: DataFrame) -> DataFrame:
    """(word, block, n) for each different word of each block, n its count in training texts."""

    def run(batches):
        counted: list[pa.Table] = []
        buffers: dict[bool, list[bytes]] = {True: [], False: []}
        sizes = {True: 0, False: 0}

        def merge() -> pa.Table:
            whole = pa.concat_tables(counted).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": whole.column("word"), "n": whole.column("n_sum")})

        def squeeze(held):
            if buffers[held]:
                found = pc.value_counts(split_words(buffers[held])[0])
                n = found.field("counts")
                counted.append(pa.table({"word": found.field("values"), "n": pa.array(np.zeros(len(n), np.int64)) if held else n}))
                buffers[held], sizes[held] = [], 0
                if len(counted) > 3:
                    counted[:] = [merge()]

        def begin():
            counted.clear()

        def add(held, low):
            held = bool(held)
            buffers[held].append(low)
            sizes[held] += len(low)
            if sizes[held] > 4 * _PART:
                squeeze(held)

        def end(block):
            squeeze(True), squeeze(False)
            if counted:
                for part in merge().to_batches(max_chunksize=100_000):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(part.num_rows, block)), part.column(1)], names=["word", "block", "n"])
            counted.clear()
            pa.default_memory_pool().release_unused()

        yield from _by_block(batches, begin, add, end)

    return blocks.select("block", "held", "text").mapInArrow(run, "word binary, block long, n long")


def block_grams(blocks: DataFrame) -> DataFrame:
    """(key, block, n) for each different gram of each block, n its count in training texts."""

    def run(batches):
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        buffers: dict[bool, list[np.ndarray]] = {True: [], False: []}
        sizes = {True: 0, False: 0}

        def squeeze(held):
            if buffers[held]:
                keys, n = np.unique(np.concatenate(buffers[held]), return_counts=True)
                counted.append((keys, np.zeros(len(keys), np.int64) if held else n))
                buffers[held], sizes[held] = [], 0
                if len(counted) > 3:
                    counted[:] = [_merge(counted)]

        def begin():
            counted.clear()

        def add(held, low):
            held = bool(held)
            for keys in gram_keys(low):
                buffers[held].append(keys)
                sizes[held] += len(keys)
                if sizes[held] > _PART:
                    squeeze(held)

        def end(block):
            squeeze(True), squeeze(False)
            keys, n = _merge(counted)
            counted.clear()
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block)), pa.array(n[at : at + 100_000])], names=["key", "block", "n"])
            pa.default_memory_pool().release_unused()

        yield from _by_block(batches, begin, add, end)

    return blocks.select("block", "held", "text").mapInArrow(run, "key long, block long, n long")


def squeeze_numbers(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers as one compressed string; equal bytes of neighbouring numbers lie side by side."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), 1)


def unsqueeze_numbers(packed: bytes, kinds: list[type]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(len(kinds), 8, -1)
    return [np.ascontiguousarray(c.T).view(kind).ravel() for c, kind in zip(raw, kinds, strict=True)]


def squeeze_words(words: pa.Array) -> bytes:
    return zstandard.compress(b"\n".join(words.to_pylist()), 1)


def unsqueeze_words(packed: bytes) -> pa.Array:
    """A word never holds white space, so that it can part them."""
    return split_words([zstandard.decompress(packed)])[0]


def pack_texts(blocks: DataFrame) -> DataFrame:
    """(block, rows): runs of rows of one block as compressed Arrow, to be read by `unpack_texts`."""

    def run(batches):
        for b in batches:
            block = b.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            for at, end in zip(starts, [*starts[1:], len(block)], strict=True):
                part, out = b.slice(at, end - at).select(["doc_id", "held", "text"]), pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([block[at]], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    return blocks.select("block", "doc_id", "held", "text").mapInArrow(run, "block long, rows binary")


def unpack_texts(packed: pa.Table) -> Iterator[pa.RecordBatch]:
    for rows in packed.column("rows"):
        yield from pa.ipc.open_stream(rows.as_buffer())


def pack_replies(replies: DataFrame, of_words: bool, size: int) -> DataFrame:
    """(block, of_words, names, worth) of rows (block, word, c) or (block, key, a, b): what one task answers to one block, in
    stretches of `size` rows of the task.  Few answers make a short row, so it takes no more room however many blocks there are."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            block = t.column("block").to_numpy()
            order = np.argsort(block, kind="stable") if of_words else np.lexsort((t.column("key").to_numpy(), block))
            t, block = t.take(pa.array(order)), block[order]
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            rest = [t.column(c).to_numpy() for c in (("c",) if of_words else ("key", "a", "b"))]
            names, worth = [], []
            for at, end in zip(starts, [*starts[1:], len(block)], strict=True):
                if of_words:
                    names.append(squeeze_words(t.column("word").slice(at, end - at)))
                    worth.append(squeeze_numbers([rest[0][at:end]]))
                else:
                    names.append(squeeze_numbers([np.diff(rest[0][at:end], prepend=0)]))
                    worth.append(squeeze_numbers([rest[1][at:end], rest[2][at:end]]))
            return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array([of_words] * len(starts)), pa.array(names, pa.binary()), pa.array(worth, pa.binary())], names=["block", "of_words", "names", "worth"])

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= size:
                yield flush()
                rows = 0
        if held:
            yield flush()

    return replies.mapInArrow(run, "block long, of_words boolean, names binary, worth binary")


def _last(key: str | Column, symbols: int) -> Column:
    """The last so many symbols of a gram."""
    return (F.col(key) if isinstance(key, str) else key).bitwiseAND(F.lit((1 << (BITS * symbols)) - 1))


def trie(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of gram counts (key, n > 0): entries (k, key, n) and contexts (k, context, total, seen, rest_total, rest_seen).

    An entry of order k holds k symbols of context and the one that follows.  `rest` of a context is what the next shorter
    one holds besides the symbols seen here.  No context is left out.
    """
    parts = [grams.groupBy(_last("key", k + 1).alias("key")).agg(F.sum("n").alias("n")).select(F.lit(k).alias("k"), "key", "n") for k in range(ORDER)]
    entries = grams.select(F.lit(ORDER).alias("k"), "key", "n")
    for part in parts:
        entries = entries.unionByName(part)
    entries = cut(entries)
    shorter = entries.where(F.col("k") < ORDER).select((F.col("k") + 1).alias("k"), F.col("key").alias("end"), F.col("n").alias("end_n"))
    ends = F.expr(f"key & (shiftleft(1L, {BITS} * k) - 1)")
    # a shorter entry is the end of at most as many longer ones as there are symbols, so these joins have no hot keys
    linked = entries.withColumn("end", F.when(F.col("k") > 0, ends)).join(shorter, ["k", "end"], "left")
    contexts = cut(linked.groupBy("k", F.shiftright("key", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("seen"), F.sum("end_n").alias("lost")))
    outer = contexts.where(F.col("k") < ORDER).select((F.col("k") + 1).alias("k"), F.col("context").alias("end"), F.col("total").alias("end_total"), F.col("seen").alias("end_seen"))
    ends = F.expr(f"context & (shiftleft(1L, {BITS} * (k - 1)) - 1)")
    whole = contexts.withColumn("end", F.when(F.col("k") > 0, ends)).join(outer, ["k", "end"], "left")
    done = cut(whole.select("k", "context", "total", "seen", (F.col("end_total") - F.col("lost")).alias("rest_total"), (F.col("end_seen") - F.col("seen")).alias("rest_seen")))
    forget(contexts)
    return entries, done


def probabilities(grams: DataFrame, entries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(key, n) -> (key, a, b): the probability of each gram's last symbol after the others, as its logarithm to base 10 in a
    where b is 0, and else as the fraction a / b; counts take less room than logarithms."""
    longest = contexts.where(F.col("k") == ORDER).select("context", "total", "seen")
    known = grams.where("n > 0").withColumn("context", F.shiftright("key", BITS)).join(longest, "context").select("key", F.col("n").cast("double").alias("a"), (F.col("total") + F.col("seen")).cast("double").alias("b"))

    new = cut(grams.where("n = 0").select("key"))
    rows = None
    for k in range(ORDER + 1):
        entry = entries.where(F.col("k") == k).select(F.col("key").alias("end"), "n")
        context = contexts.where(F.col("k") == k).drop("k")
        # order 1 has at most 258 * 258 entries, and order 2 as many contexts
        entry, context = (F.broadcast(entry) if k <= 1 else entry), (F.broadcast(context) if k <= 2 else context)
        part = new.withColumn("end", _last("key", k + 1)).join(entry, "end", "left").withColumn("context", F.shiftright("end", BITS)).join(context, "context", "left")
        part = part.select("key", F.lit(k).alias("k"), "n", "total", "seen", "rest_total", "rest_seen")
        rows = part if rows is None else rows.unionByName(part)
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = rows.groupBy("key").agg(
        F.coalesce(F.max(F.when(F.col("n").isNotNull(), F.col("k"))), F.lit(-1)).alias("found"),
        F.coalesce(F.max(F.when(F.col("total").isNotNull(), F.col("k"))), F.lit(-1)).alias("top"),
        *[at(k, c).alias(f"{c}{k}") for k in range(ORDER + 1) for c in ("n", "total", "seen", "rest_total", "rest_seen")],
    )
    col = lambda c, k: F.col(f"{c}{k}")
    value = F.lit(0.0)
    for k in range(ORDER + 1):
        mass = col("rest_total", k) + col("rest_seen", k)
        # the longest known context gives its symbol, or escapes; shorter ones do without the symbols of the longer
        value += F.when((F.col("top") == k) & (F.col("found") == k), F.log10(col("n", k)) - F.log10(col("total", k) + col("seen", k))).when((F.col("top") == k), F.log10(col("seen", k) / (col("total", k) + col("seen", k)))).otherwise(0.0)
        if k:  # what context k leaves of the next shorter one; a context that leaves nothing passes on at no cost
            value += F.when((F.col("top") >= k) & (F.col("found") == k - 1), F.log10(col("n", k - 1)) - F.log10(mass)).when((F.col("top") >= k) & (F.col("found") < k - 1) & (mass > 0), F.log10(col("rest_seen", k) / mass)).otherwise(0.0)
    value += F.when(F.col("found") < 0, -F.log10(F.greatest(F.lit(1), SYMBOLS - F.coalesce(col("seen", 0), F.lit(0))))).otherwise(0.0)
    return known.unionByName(wide.select("key", value.alias("a"), F.lit(0.0).alias("b")))


def score_documents(docs: DataFrame, fold: tuple[int, int] = (7, 2)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Null text counts as empty: one token, the end.  The model reads A-Z as a-z, like the base.  A row without id is not held
    out.  Without training documents every word is unknown and every symbol equally likely.  Repeated rows count and are
    scored each; a text longer than a block is a block of its own; an empty table gives no rows; columns other than doc_id
    and text take no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce(crc_fold("doc_id", fold[0]) == fold[1], F.lit(False)).alias("held"), "text")

    def number(batches):
        part, n, size = TaskContext.get().partitionId() << 32, 0, 0
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                block = []
                for raw in texts(b):
                    if size and size + len(raw) > BLOCK_BYTES:
                        n, size = n + 1, 0
                    size += len(raw)
                    block.append(part + n)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *b.columns], names=["block", "doc_id", "held", "text"])

    blocks = cut(source.mapInArrow(number, f"block long, doc_id {kind}, held boolean, text string"))
    seen = blocks.agg(F.count_distinct("block").alias("blocks"), F.count(F.when(~F.col("held"), 1)).alias("ends")).first()
    parts, ends = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), seen["blocks"]), seen["ends"]
    asked = cut_by(block_grams(blocks), "key", parts)
    grams = cut(asked.groupBy("key").agg(F.sum("n").alias("n")))
    entries, contexts = trie(grams.where("n > 0"))
    values = cut(probabilities(grams, entries, contexts))
    for done in (grams, entries, contexts):
        forget(done)

    words = cut_by(block_words(blocks), "word", parts)
    counts = words.groupBy("word").agg(F.sum("n").alias("c"))
    whole = counts.agg(F.sum("c").alias("tokens"), F.sum((F.col("c") > 0).cast("long")).alias("kinds")).first()
    tokens = int(whole["tokens"] or 0) + ends
    unit = float(np.log10(tokens + int(whole["kinds"] or 0) + (1 if ends else 0) + 1))
    end_value = float(np.log10(ends + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        # words first, then grams, so that only one of their lookups is held at a time
        replies = {held: right.filter(pc.equal(right.column("of_words"), held)) for held in (True, False)}
        del right
        names = pa.concat_arrays([pa.array([], pa.binary()), *(unsqueeze_words(x.as_py()) for x in replies[True].column("names"))])
        worth = np.log10(np.concatenate([np.zeros(0), *(unsqueeze_numbers(x.as_py(), [np.int64])[0] for x in replies[True].column("worth"))]) + 1.0)
        ids, held, n, hits, base = [], [], [], [], []
        for rows in unpack_texts(left):
            ids.append(rows.column(0))
            held.append(rows.column(1))
            for some in in_parts(raw.lower() for raw in texts(rows)):
                found, which = split_words(some)
                x = worth[pc.index_in(found, value_set=names).to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0)
                count = np.bincount(which, minlength=len(some)) + 1
                n += count.tolist()
                hits += (np.bincount(which, weights=x != 0, minlength=len(some)).astype(np.int64) + bool(ends)).tolist()
                base += (np.bincount(which, weights=x, minlength=len(some)) + end_value - count * unit).tolist()
        del names, worth
        keys = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unsqueeze_numbers(x.as_py(), [np.int64])[0]) for x in replies[False].column("names"))])
        value = np.zeros(len(keys))
        at = 0
        for x in replies[False].column("worth"):
            a, b = unsqueeze_numbers(x.as_py(), [np.float64, np.float64])
            value[at : at + len(a)] = np.where(b > 0, np.log10(np.where(b > 0, a, 1.0)) - np.log10(np.where(b > 0, b, 1.0)), a)
            at += len(a)
        place = Table(keys)
        del keys, replies
        total = [float(sum(value[place.find(k)].sum() for k in gram_keys(raw.lower()))) for rows in unpack_texts(left) for raw in texts(rows)]
        del place, value
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": pa.chunked_array(ids), "held_out": pa.chunked_array(held), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(hits, pa.int64()), "train_tokens": pa.array([tokens] * len(n), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64())})

    replies = pack_replies(words.join(counts, "word").select("block", "word", "c"), True, 1 << 18).unionByName(
        pack_replies(asked.join(values, "key").select("block", "key", "a", "b"), False, 1 << 20)
    )
    return pack_texts(blocks).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
