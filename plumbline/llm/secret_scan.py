"""Secret scans by a recursive decoding worklist.

A text is the first layer.  Every layer is scanned for secrets and for encoded regions: lines with percent or Unicode
escapes, and runs of base64, whose bytes may be compressed.  Each decoded region is a new layer on the worklist; it knows
which characters of its parent every one of its characters came from, so a find in any depth is mapped back to a span of the
document.  The worklist ends at a fixpoint: a layer with the same content and place is not entered twice, which also ends
archives that unpack to themselves.  Layers are taken depth first, so only one chain of them and its siblings are held.

No pattern or alphabet of a secret contains a line break, so escapes are decoded line by line without loss.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import texts

# Kinds in the order in which they are listed, with the pattern, the group that is measured and its least length.
KINDS = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
ORDER = {kind: i for i, (kind, *_) in enumerate(KINDS)}

#: An escape whose own percent sign or backslash is escaped, however often, is decoded in one step.
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
UNICODE = re.compile(r"\\(?:u005[Cc])*(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))|&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_PLAIN = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}={0,2}")
BASE64_LINES = re.compile(r"(?:(?:[A-Za-z0-9+/]{64}|[A-Za-z0-9+/]{76})\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}")
URLSAFE = bytes.maketrans(b"-_", b"+/")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f\ufffe\uffff]")
#: Bytes of an unpacked layer that are scanned at once, and that are unpacked in one step.
PIECE, CHUNK = 16 << 20, 1 << 20
BATCH = 64

Place = Callable[[int, int], tuple[int, int]]


def found_in(text: str) -> Iterator[tuple[str, int, int]]:
    """Secrets of one layer: leftmost matches of each kind that do not overlap, less those that are too short."""
    for kind, pattern, group, least in KINDS:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


class _Pieces:
    """Where the characters of a decoded text came from: piece i begins at `at[i]` and came from begins[i]:ends[i]; a kept
    piece maps character by character, a decoded one as a whole."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.kept: list[bool] = []
        self.parts: list[str] = []
        self.size = 0

    def add(self, text: str, begin: int, end: int, kept: bool) -> None:
        if text:
            for own, value in zip((self.at, self.begins, self.ends, self.kept, self.parts), (self.size, begin, end, kept, text), strict=True):
                own.append(value)
            self.size += len(text)

    def place(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        begin = self.begins[i] + (start - self.at[i] if self.kept[i] else 0)
        return begin, self.begins[j] + end - self.at[j] if self.kept[j] else self.ends[j]


def _escapes(line: str, pattern: re.Pattern, value: Callable[[list[re.Match]], Iterator[tuple[str, int, int]]]) -> tuple[str, Place] | None:
    """line with its escapes replaced; neighbouring escapes are decoded together, by `value`."""
    pieces, here, run = _Pieces(), 0, []

    def close() -> None:
        for text, begin, end in value(run):
            pieces.add(text, begin, end, False)
        run.clear()

    for m in pattern.finditer(line):
        if m.start() > here:
            close()
            pieces.add(line[here : m.start()], here, m.start(), True)
        run.append(m)
        here = m.end()
    if not run and not pieces.parts:
        return None
    close()
    pieces.add(line[here:], here, len(line), True)
    out = "".join(pieces.parts)
    return None if out == line else (out, pieces.place)


def _percent(run: list[re.Match]) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of percent escapes, read as UTF-8; bytes that are none come as Latin-1."""
    data, i = bytes(int(m[1], 16) for m in run), 0
    while i < len(data):
        size = 1 if data[i] < 0xC2 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        try:
            char = data[i : i + size].decode()
        except UnicodeDecodeError:
            char, size = chr(data[i]), 1
        yield char, run[i].start(), run[min(i + size, len(run)) - 1].end()
        i += size


def _unicode(run: list[re.Match]) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of Unicode escapes; a pair of surrogates is one, a lone one and what is no character stay written."""
    i = 0
    while i < len(run):
        m, n = run[i], _number(run[i])
        if 0xD800 <= n < 0xDC00 and i + 1 < len(run) and 0xDC00 <= (low := _number(run[i + 1])) < 0xE000:
            yield chr(0x10000 + ((n - 0xD800) << 10) + low - 0xDC00), m.start(), run[i + 1].end()
            i += 2
            continue
        yield (chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]), m.start(), m.end()
        i += 1


def _number(m: re.Match) -> int:
    return int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)


def _readable(data: bytes) -> str | None:
    """The text of some bytes, None if they are none."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if not text or CONTROL.search(text) else text


def _unpacker(head: bytes):
    """A decompressor for data that begins like this: gzip, zlib, bzip2, xz; None for anything else."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 6 and head[0] & 15 == 8 and head[0] >> 4 < 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _stream(unpack, chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What unpack makes of the chunks, in chunks of at most CHUNK; raises EOFError if the data end too soon."""
    for chunk in chunks:
        while True:
            out = unpack.decompress(chunk, CHUNK)
            if out:
                yield out
            if unpack.eof:
                return
            chunk = getattr(unpack, "unconsumed_tail", b"")
            if not out and not chunk:
                break
    raise EOFError


def _unpacked(data: bytes) -> Iterator[str]:
    """The text inside compressed data, however often compressed, in one piece up to PIECE and else cut at line breaks (a
    longer line within it).  Nothing if it is not compressed, broken, no text, or unpacks to what it was before."""
    seen, chunks, head = set(), iter([data]), data
    while (unpack := _unpacker(head)) is not None:
        if head in seen:
            return
        seen.add(head)
        chunks = _stream(unpack, chunks)
        head = next(chunks, b"")
        chunks = chain([head], chunks)
    if not seen:
        return
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) > PIECE:
            # continuation bytes of a character stay with it
            cut = held.rfind(b"\n") + 1 or next(i for i in range(len(held) - 1, 0, -1) if held[i] & 0xC0 != 0x80)
            if (text := _readable(held[:cut])) is None:
                return
            yield text
            held = held[cut:]
    if (text := _readable(held)) is not None:
        yield text


def _base64(layer: str) -> Iterator[tuple[str, str, Place]]:
    """(how, text, place) of every base64 run of a layer that holds text, or compressed text."""
    seen: set[tuple[int, int]] = set()
    for pattern in (BASE64, BASE64_PLAIN, BASE64_LINES):
        for m in pattern.finditer(layer):
            if m.span() in seen:
                continue
            seen.add(m.span())
            own = [i for i in range(m.start(), m.end()) if layer[i] not in "\r\n="] if pattern is BASE64_LINES else range(m.start(), m.start() + len(m[0].rstrip("=")))
            chars = m[0].encode().translate(URLSAFE, b"\r\n=")
            if len(chars) % 4 == 1:
                own, chars = own[:-1], chars[:-1]  # a character too many encodes nothing
            data = base64.b64decode(chars + b"=" * (-len(chars) % 4))
            try:
                for text in _unpacked(data):
                    yield "base64>unpack", text, lambda s, e, a=m.start(), z=m.end(): (a, z)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                pass  # no such data, or cut short: what came before counts
            if (text := _readable(data)) is not None:
                sizes = None if text.isascii() else _starts(text)

                def place(s, e, own=own, sizes=sizes):
                    first, past = (s, e) if sizes is None else (sizes[s], sizes[e])
                    return own[first * 8 // 6], own[min(len(own) - 1, (past * 8 - 1) // 6)] + 1

                yield "base64", text, place


def _starts(text: str) -> list[int]:
    """Where each character begins in UTF-8, and where the last ends."""
    out = [0]
    for c in text:
        out.append(out[-1] + (1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4))
    return out


def _lines(layer: str, sign: str) -> Iterator[tuple[int, str]]:
    """Lines that hold a sign, with where they begin."""
    at = layer.find(sign)
    while at >= 0:
        begin = layer.rfind("\n", 0, at) + 1
        end = layer.find("\n", at)
        end = len(layer) if end < 0 else end
        yield begin, layer[begin:end]
        at = layer.find(sign, end)


def _inner(layer: str) -> Iterator[tuple[str, str, Place]]:
    """Every layer that lies directly in this one, with how it is decoded and where its characters come from."""
    for how, sign, pattern, value in (("url", "%", PERCENT, _percent), ("unicode", "\\", UNICODE, _unicode), ("unicode", "&#", UNICODE, _unicode)):
        for begin, line in _lines(layer, sign):
            if (done := _escapes(line, pattern, value)) is not None:
                text, place = done
                yield how, text, lambda s, e, b=begin, p=place: tuple(b + x for x in p(s, e))
    yield from _base64(layer)


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, via): secrets of a text by start, then kind as listed, then end.  `via` is how the layer was decoded
    ('' in the text itself); a span that several layers hold is listed with the first that shows it."""
    found: dict[tuple[str, int, int], str] = {}
    seen: set[tuple[bytes, int, int]] = set()
    work: list[tuple[str, Place | None, str]] = [(text, None, "")]
    while work:
        layer, place, via = work.pop()
        for kind, start, end in found_in(layer):
            found.setdefault((kind, *((start, end) if place is None else place(start, end))), via)
        for how, inner, local in _inner(layer):
            whole = local if place is None else lambda s, e, outer=place, own=local: outer(*own(s, e))
            key = (hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *whole(0, len(inner)))
            if key not in seen:
                seen.add(key)
                work.append((inner, whole, f"{via}>{how}" if via else how))
    return sorted(((*k, v) for k, v in found.items()), key=lambda f: (f[1], ORDER[f[0]], f[2]))


def secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and secrets array<struct<kind, start, end, via>>, spans in code points of the text, end exclusive.

    Null and empty texts have none.  Texts of any length are scanned whole; repeated rows come out alike; an empty table
    gives no rows; columns other than `keep` take no part, so their names do not clash.
    """
    own = [F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    source = docs.select(*own, F.col(text).alias("__text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())]))
    schema = ", ".join(f"__keep_{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[: len(keep)])) + ", secrets array<struct<kind:string,start:bigint,end:bigint,via:string>>"

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                b = big.slice(at, BATCH)
                found = [[dict(zip(("kind", "start", "end", "via"), f, strict=True)) for f in scan(t.decode())] for t in texts(b, "__text")]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(found, span)], names=[f"__keep_{i}" for i in range(len(keep))] + ["secrets"])

    return source.mapInArrow(run, schema).withColumnsRenamed({f"__keep_{i}": c for i, c in enumerate(keep)})


def of_kind(spans: Column, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
