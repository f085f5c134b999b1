"""SentencePiece encoding with offsets into the original bytes, and decoding.

Normalisation reads the model's compiled character map (a double-array trie and a blob of replacements) and always takes
the longest matching prefix, recording for each normalised byte the original byte span it came from.  The normalised text
is segmented by the model's own pieces with normalisation switched off, and every piece is projected through the record to
a byte span of the original text.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import texts

SPACE = "▁"


class CharacterMap:
    """The compiled map: trie units as of the Darts-clone format, and NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.replacements = blob[4 + size :]

        self.pairs = np.zeros((256, 257), bool)
        for b in range(256):
            node, one = self._step(_offset(self.units[0]), b)
            if node is not None:
                self.pairs[b] = True if one else [self._step(node, c)[0] is not None for c in range(256)] + [False]

    def _step(self, node: int, byte: int) -> tuple[int | None, bool]:
        """The node behind one more byte, or None, and whether a key ends there."""
        node ^= byte
        if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
            return None, False
        return node ^ _offset(self.units[node]), bool(self.units[node] >> 8 & 1)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """(length, replacement) of the longest key that is a prefix of text[at:]; length 0 if there is none."""
        node, found = _offset(self.units[0]), (0, b"")
        for i in range(at, len(text)):
            node, ends = self._step(node, text[i])
            if node is None:
                break
            if ends:
                start = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)])
        return found

    def apply(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each the begin and end of the bytes of `raw` that it came from.

        Only places where a byte and the next one begin some key are looked up; all between is copied.
        """
        b = np.frombuffer(raw, np.uint8)
        after = np.append(b[1:], 256).astype(np.int64) if len(b) else np.empty(0, np.int64)
        out, begins, ends, at = [], [], [], 0

        def copy(to: int) -> None:
            out.append(raw[at:to])
            begins.append(np.arange(at, to))
            ends.append(np.arange(at + 1, to + 1))

        for p in np.flatnonzero(self.pairs[b, after]).tolist():
            if p < at:
                continue
            took, new = self.longest(raw, p)
            if took:
                copy(p)
                out.append(new)
                begins.append(np.full(len(new), p))
                ends.append(np.full(len(new), p + took))
                at = p + took
        copy(len(raw))
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate(begins), np.concatenate(ends)


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Codec:
    """A model file, ready to encode whole texts with offsets and to decode ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self._decoder = SentencePieceProcessor(model_proto=model.SerializeToString())
        # the segmenter sees text that is normalised already
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self._segmenter = SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [(p.piece, p.type) for p in model.pieces]
        self.mark = (SPACE if self.escape else " ").encode()
        self.is_byte = np.array([kind == 6 for _, kind in pieces])
        self.unknown = next((i for i, (_, kind) in enumerate(pieces) if kind == 2), 0)
        #: Bytes of normalised text that a piece covers; none for an unknown one, which has no length of its own.
        self.length = np.array([1 if kind == 6 else len(piece.encode()) for piece, kind in pieces])
        self.length[self.unknown] = -1

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised text, and for each of its bytes the begin and end of the bytes of the original it came from."""
        raw = text.encode()
        if self.map:
            out, begins, ends = self.map.apply(raw)
        else:
            out, begins = np.frombuffer(raw, np.uint8), np.arange(len(raw))
            ends = begins + 1
        if self.squeeze:
            space = out == 0x20
            keep = ~(space & np.append(True, space[:-1])) if len(out) else np.empty(0, bool)
            if keep.any() and out[last := np.flatnonzero(keep)[-1]] == 0x20:
                keep[last] = False
            out, begins, ends = out[keep], begins[keep], ends[keep]
        if not len(out):
            return b"", begins, ends
        body = out.tobytes().replace(b" ", self.mark)
        if len(body) > len(out):
            wide = np.where(out == 0x20, len(self.mark), 1)
            begins, ends = np.repeat(begins, wide), np.repeat(ends, wide)
        if self.prefix:  # the added mark comes from no byte
            edge = np.full(len(self.mark), len(raw) if self.suffix else begins[0])
            parts = (body, self.mark), (begins, edge), (ends, edge)
            body, begins, ends = (b"".join(parts[0]), *map(np.concatenate, parts[1:])) if self.suffix else (self.mark + body, np.append(edge, begins), np.append(edge, ends))
        return body, begins, ends

    def encode_all(self, batch: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """(ids, begins, ends) for each text: every piece with its span in bytes of the original text.

        The fallback bytes of a character share its span, and so do the pieces of one replacement.
        """
        found = [self.normalise(t) for t in batch]
        ids = self._segmenter.encode([body.decode("utf-8", "replace") for body, _, _ in found], num_threads=1)
        return [(i, *self._project(i, *f)) for i, f in zip(ids, found, strict=True)]

    def _project(self, ids: list[int], body: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not ids:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        which = np.array(ids)
        length = self.length[which]
        if (length < 0).any():
            length = self._unknown_lengths(ids, body)
        stop = np.cumsum(length)
        start, last = stop - length, stop - 1
        if (fallback := self.is_byte[which]).any():
            first = (np.frombuffer(body, np.uint8) & 0xC0) != 0x80
            place = np.arange(len(body))
            lead = np.maximum.accumulate(np.where(first, place, 0))
            trail = np.append(np.minimum.accumulate(np.where(first, place, len(body))[::-1])[::-1][1:], len(body)) - 1
            start, last = np.where(fallback, lead[start], start), np.where(fallback, trail[last], last)
        return begins[start], ends[last]

    def _unknown_lengths(self, ids: list[int], body: bytes) -> np.ndarray:
        """Lengths of pieces where some are unknown: such a piece runs up to the next piece's surface."""
        out, at = [], 0
        for k, i in enumerate(ids):
            end = at + int(self.length[i])
            if i == self.unknown:
                after = self._segmenter.id_to_piece(ids[k + 1]).encode() if k + 1 < len(ids) else b""
                end = body.find(after, at + 1) if after else len(body)
                end = end if end > at else len(body)
            out.append(end - at)
            at = end
        return np.array(out)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0][0]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece, in bytes of the original text."""
        ids, begins, ends = self.encode_all([text])[0]
        return list(zip(ids, begins.tolist(), ends.tolist(), strict=True))

    def decode_all(self, batch: list[list[int]]) -> list[str]:
        return self._decoder.decode(batch, num_threads=1) if batch else []

    def decode(self, ids: list[int]) -> str:
        return self._decoder.decode(ids)

    def digests(self, batch: list[str]) -> list[tuple[int, str, str, str]]:
        """Number of ids, SHA-256 of the ids, of the decoded text, and of the spans (begins, then ends, as 64-bit numbers)."""
        coded = self.encode_all(batch)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        back = self.decode_all([ids for ids, _, _ in coded])
        return [(len(ids), sha(str(ids)[1:-1].replace(" ", "").encode()), sha(t.encode()), sha(np.concatenate((a, b)).astype("<i8").tobytes())) for (ids, a, b), t in zip(coded, back, strict=True)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process, so that its model is read once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus n_tokens, ids_sha256, decoded_sha256 and spans_sha256, one row for each row of `docs`.

    Null text counts as empty: no ids, empty text.  Texts of any length are encoded whole.  Repeated rows are encoded
    each; an empty table gives no rows; other columns take no part.
    """
    source = docs.select(*keep, docs["text"].alias("__text"))
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"

    def run(batches):
        digest = codec(path).digests
        for big in batches:
            for at in range(0, big.num_rows, 256):
                yield row(digest, big.slice(at, 256))

    def row(digest, b):
        cols = list(zip(*digest([t.decode() for t in texts(b, "__text")]), strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(cols)], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus ids, begins, ends: every piece with its byte span in the original text.

    Null text: empty lists.  Texts of any length are encoded whole.  Repeated rows are encoded each; an empty table gives no
    rows; other columns take no part.
    """
    source = docs.select(*keep, docs["text"].alias("__text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>, begins array<long>, ends array<long>"

    def run(batches):
        coded = codec(path).encode_all
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                found = coded([t.decode() for t in texts(b, "__text")])
                cols = [pa.array([f[k] for f in found], pa.list_(pa.int64() if k else pa.int32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + cols, names=[*keep, "ids", "begins", "ends"])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus text, decoded from `ids`, one row for each row.  Null ids: empty text.  Empty table: no rows."""
    source = encoded.select(*keep, encoded["ids"].alias("__ids"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", text string"

    def run(batches):
        back = codec(path).decode_all
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(back([x or [] for x in b.column(len(keep)).to_pylist()]), pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)
