"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, each of them in furniture (menus, headers, footers, forms, adverts, comments and so on, by element or by
class, id or role), outside of it, or in an article or main element.  Every page is differenced first: pages are ordered by
URL path within each host, the page is aligned with its nearest pages of other content (up to NEAREST on each side, copies
and near copies passed over) by longest common subsequence of all lines.  Template is what at least half of them share; at
the head and tail of an article only what all of them share and what every page around holds too, SURE at least: sentences
that recur in the articles of some neighbours are text of the article (see the README for figures).

Structure settles what differencing leaves: of a page with an article or main element its lines are the text, of other
pages the lines outside furniture.

Differencing works on hashes of lines; pages whose text it changes are few beside all pages, or else met by a join.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, deque
from math import isqrt
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select xmp noembed noframes".split())
#: Elements that hold no text and have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form head dialog menu button fieldset figure-ad".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Where a line of a page lies; of a page with a line in an article these are its text, else those outside furniture.
FURNISHED, OUTSIDE, ARTICLE = 0, 1, 2
#: Pages of other content within REACH that must all hold the first or last lines of an article before these are template.
SURE = 8
#: Changed pages that are sent to every task; more of them are joined by a shuffle.
FEW = 100_000
#: Pages of other content on each side that a page is aligned with, the rows looked through for them, and the share of
#: characters from which a page counts as a near copy.
NEAREST, REACH, NEAR_COPY = 2, 8, 0.8
#: Words of class, id or role that mark furniture; matched as whole words between separators.
_MARKED = re.compile(
    r"(?:^|\s)header(?=$|\s)|(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|adsbygoogle|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall"
    r"|side-?bar|nav(?:bar|igation)?|menus?|breadcrumbs?|pagination|pager|toolbar|foot(?:er)?|masthead|site-?header|page-?header|topbar|comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommended|widget|skip-?link|search(?:box|form)?)(?:$|[\s_-])",
    re.I,
)
_MAIN_MARK = re.compile(r"(?:^|\s)(?:main|article)(?:$|\s)|articlebody", re.I)


def _marks(attributes: str) -> tuple[bool, bool]:
    """(furniture, main) from the attributes of a start tag."""
    furniture = main = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            furniture |= bool(_MARKED.search(value))
        elif name == "role":
            furniture |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu")
            main |= value.lower() in ("main", "article")
        elif name == "itemprop":
            main |= bool(_MAIN_MARK.search(value))
        elif name == "hidden":
            furniture = True
        elif name == "style":
            furniture |= bool(re.search(r"display\s*:\s*none", value, re.I))
    return furniture, main


def _tags(page: str):
    """(text before, end tag?, name, attributes, closes itself?, where it ends) for each tag, in one pass; last the text left.

    Comments, declarations and the content of RAW elements are passed over.  A quote opens an attribute value only after
    an equals sign; if it is never closed, the tag ends at the next angle bracket.  A tag without an end takes the rest.
    """
    at = begin = 0
    size, closed = len(page), {'"': True, "'": True}
    parts: list[str] = []
    while (lt := page.find("<", at)) >= 0:
        m = _NAME.match(page, lt + 1)
        if not m:
            if page.startswith("<!--", lt):
                end, skip = page.find("-->", lt + 4), 3
            elif page.startswith("<![CDATA[", lt):
                end, skip = page.find("]]>", lt + 9), 3
            elif page.startswith(("<!", "<?", "</"), lt):
                end, skip = page.find(">", lt + 2), 1
            else:
                at = lt + 1  # a bare angle bracket is text
                continue
            parts.append(page[begin:lt])
            at = begin = end + skip if end >= 0 else size
            continue
        parts.append(page[begin:lt])
        stop = m.end()
        while True:
            q = _TAG_STOP.search(page, stop)
            if not q:
                stop = gt = size
                break
            if q[0] == ">":
                gt, stop = q.start(), q.end()
                break
            stop = q.end()
            if closed[q[0]] and page[max(m.end(), q.start() - 64) : q.start()].rstrip().endswith("="):
                close = page.find(q[0], stop)
                if close < 0:
                    closed[q[0]] = False
                else:
                    stop = close + 1
        name, ends, own = m[1].lower(), page[lt + 1] == "/", page[gt - 1 : gt] == "/"
        yield "".join(parts), ends, name, page[m.end() : gt], own
        parts.clear()
        at = begin = stop
        if name in RAW and not ends and not own:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = begin = close.end() if close else size
    parts.append(page[begin:])
    yield "".join(parts), False, "", "", False


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, where it lies) of every line of a page, in its order.  Time grows with the page's length."""
    stack: list[tuple[str, bool, bool]] = []  # (element, inside furniture, inside main)
    places: dict[str, list[int]] = {}  # where each element is open
    mains: list[int] = []
    found: list[tuple[str, int]] = []
    held: list[str] = []
    aside: list[str] = []  # of furniture

    def inside() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def close_block() -> None:
        for parts, where in ((held, ARTICLE if inside()[1] else OUTSIDE), (aside, FURNISHED)):
            text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
            parts.clear()
            if text:
                found.append((text, where))

    def push(name: str, hidden: bool, is_main: bool) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in MAIN:
            mains.append(len(stack))
        stack.append((name, hidden, is_main))

    def pop() -> None:
        name = stack.pop()[0]
        places[name].pop()
        if name in MAIN:
            mains.pop()

    for before, ends, name, attributes, own in _tags(page):
        if before:
            (aside if inside()[0] else held).append(before)
        if not name:
            continue
        if ends:
            if name in BLOCK:
                close_block()
            # an end tag reaches over unclosed elements, but never out of an article
            if places.get(name) and (name in MAIN or not mains or mains[-1] <= places[name][-1]):
                k = places[name][-1]
                while len(stack) > k:
                    if stack[-1][0] in BLOCK or (len(stack) > 1 and stack[-2][2]) != stack[-1][2]:
                        close_block()
                    pop()
            continue
        if name in RAW:
            continue
        if name in BLOCK:
            close_block()
            if stack and stack[-1][0] == "p":
                pop()
        if name == "br":
            held.append(" ")
        if name in VOID:
            continue
        hidden, is_main = inside()
        furniture, marked = _marks(attributes) if attributes else (False, False)
        if name in MAIN or marked:
            close_block()
            if name in MAIN and not is_main:
                # furniture that was never closed ends where the article begins
                while stack and stack[-1][1]:
                    pop()
                hidden = False
            is_main = True
        hidden = hidden or furniture and name not in ("html", "body", "article", "main") or name in FURNITURE or (name == "header" and not is_main)
        if not own:
            push(name, hidden, is_main)
    close_block()
    return found


def chosen(where: list[int]) -> int:
    """Which lines of a page structure takes for its text."""
    return ARTICLE if ARTICLE in where else OUTSIDE


def blocks(page: str) -> tuple[bool, list[str]]:
    """(has a main element, its blocks) or else (False, all blocks outside furniture)."""
    found = page_lines(page)
    own = chosen([where for _, where in found])
    return own == ARTICLE, [text for text, where in found if where == own]


def shared_lines(a: list, b: list) -> np.ndarray:
    """Which lines of a lie on a longest common subsequence with b (bit-parallel rows, then a walk back).

    Of the rows every so many are held, and those between are worked out again on the way back, so that memory grows with
    the length of b and the root of that of a.
    """
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full, step = (1 << len(b)) - 1, isqrt(len(a)) + 1

    def below(s: int, first: int, end: int):
        """The rows after s, which is that before line `first` of a."""
        for line in a[first:end]:
            u = s & where.get(line, 0)
            s = ((s + u) | (s - u)) & full
            yield s

    marks = [full]
    for at in range(0, len(a), step):
        s = marks[-1]
        for s in below(s, at, at + step):  # noqa: B007
            pass
        marks.append(s)
    common = np.zeros(len(a), bool)
    rows: list[int] = []
    begin = len(a) + 1  # rows[k] is that after begin + k lines of a

    def length(i: int, j: int) -> int:
        nonlocal begin, rows
        if i < begin:
            begin = i // step * step
            rows = [marks[i // step], *below(marks[i // step], begin, begin + step)]
        return j - (rows[i - begin] & ((1 << j) - 1)).bit_count()

    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            common[i - 1] = True
            i, j = i - 1, j - 1
            continue
        # the row of i - 1 may lie before the held ones, that of i then still does
        upper = length(i, j - 1)
        if length(i - 1, j) >= upper:
            i -= 1
        else:
            j -= 1
    return common


Line = tuple  # (what it says or the hash of it, its characters, where it lies)


def near_copy(a: list[Line], b: list[Line]) -> bool:
    """Whether NEAR_COPY of the characters of both pages are in lines that they share."""
    shared = sum(x[1] * n for x, n in (Counter(a) & Counter(b)).items())
    return shared >= NEAR_COPY * max(sum(x[1] for x in a), sum(x[1] for x in b))


def text_of(page: list[Line]) -> list[Line]:
    """The lines of a page that structure takes for its text."""
    own = chosen([x[2] for x in page])
    return [x for x in page if x[2] == own]


def template(page: list[Line], before: list[list[Line]], after: list[list[Line]]) -> list[bool]:
    """Which lines of a page are template; before and after are the nearest pages, nearest first.

    Lines of all kinds are aligned.  Copies and near copies are passed over, since they share the text itself.
    """
    own = text_of(page)
    near = [[other for other in side if not near_copy(own, text_of(other))] for side in (before, after)]
    votes, found = np.zeros(len(page), int), near[0][:NEAREST] + near[1][:NEAREST]
    said = [x[0] for x in page]
    for other in found:
        theirs = [x[0] for x in other]
        both = set(said) & set(theirs)
        at = [i for i, x in enumerate(said) if x in both]
        votes[at] += shared_lines([said[i] for i in at], [x for x in theirs if x in both])
    gone = [bool(found) and n >= max(1, len(found) // 2) for n in votes]
    article = [i for i, x in enumerate(page) if x[2] == ARTICLE]
    for i in article:
        gone[i] = False
    if len(near[0]) + len(near[1]) >= SURE:
        held = set(said).intersection(*[{x[0] for x in other} for side in near for other in side])
        for run in (article, article[::-1]):
            for i in run:
                if votes[i] < len(found) or said[i] not in held:
                    break
                gone[i] = True
    return gone


def difference(lines: list[str], before: list[list[str]], after: list[list[str]]) -> list[str]:
    """Lines not shared with at least half of the nearest other pages; before and after are given nearest first."""
    typed = lambda page: [(x, len(x), OUTSIDE) for x in page]
    gone = template(typed(lines), [typed(x) for x in before], [typed(x) for x in after])
    return [x for x, out in zip(lines, gone, strict=True) if not out]


def _address(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").removeprefix("www.").removeprefix("m.")
    except ValueError:
        return "", url or ""
    # numbers of a path compare by size, not by digits
    return host, re.sub(r"\d+", lambda m: m[0].zfill(20), u.path)


def _digest(said: str, size: int) -> bytes:
    return hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row.

    Null or empty html: empty text.  A null or odd URL belongs to the empty host.  Repeated ids and URLs stay repeated rows;
    equal pages next to each other count as one.  Ties of URLs go by a hash of their lines.  Empty table: no rows.  Columns other than page_id, url and html take no part.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                found = [page_lines(h or "") for h in b.column(2).to_pylist()]
                places = [_address(u) for u in b.column(1).to_pylist()]
                said = [np.frombuffer(b"".join(_digest(text, 8) for text, _ in page), np.int64) for page in found]
                where = [bytes(w for _, w in page) for page in found]
                # pages of one address with the same lines in the same places are one page
                key = [hashlib.blake2b(b"\0".join([_digest(host, 16), _digest(path, 16), w, x.tobytes()]), digest_size=16).digest() for (host, path), w, x in zip(places, where, said, strict=True)]
                own = [chosen(list(w)) for w in where]
                texts = [[text for text, w in page if w == o] for page, o in zip(found, own, strict=True)]
                columns = [pa.array(key, pa.binary()), *[pa.array([p[i] for p in places], pa.string()) for i in (0, 1)], pa.array(said, pa.list_(pa.int64())), pa.array([[len(text) for text, _ in page] for page in found], pa.list_(pa.int32())), pa.array(where, pa.binary()), pa.array(texts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["page_id", "url", "key", "host", "path", "said", "sizes", "places", "lines"])

    digest = ["key", "host", "path", "said", "sizes", "places"]
    kinds = "key binary, host string, path string, said array<long>, sizes array<int>, places binary"
    parsed = cut(pages.select("page_id", "url", "html").mapInArrow(parse, f"page_id {kind}, url string, {kinds}, lines array<string>"))

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part)), pa.array(np.arange(n, n + b.num_rows)), *b.columns], names=["part", "pos", *b.schema.names])
            n += b.num_rows

    # hashes of every page in URL order; partitions are ranges, so a large host spreads over many
    order = ["host", "path", "key"]
    once = parsed.select(*digest).dropDuplicates(["key"])
    ranged = cut(once.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"part long, pos long, {kinds}"))
    # the rows before a partition's first and after its last come from the partitions next to it
    ends = ranged.groupBy("part").agg(F.max("pos").alias("last"))
    steps = sorted((r["part"], r["last"] + 1) for r in ends.collect())  # one row a partition
    owner: list[tuple[int, int, int]] = []  # (part, first row, end) on the line of all rows
    for part, count in steps:
        at = owner[-1][2] if owner else 0
        owner.append((part, at, at + count))
    halo = []
    for i, (part, first, end) in enumerate(owner):
        for step, edge in ((-1, first), (1, end)):
            j, left = i + step, REACH
            while left and 0 <= j < len(owner):
                p, a, b = owner[j]
                take = range(max(a, b - left), b) if step < 0 else range(a, min(b, a + left))
                halo += [(p, g - a, part, g - first) for g in take if abs(g - edge) <= REACH]
                left, j = left - len(take), j + step
    full = ranged.withColumn("own", F.lit(True))
    if halo:
        move = pages.sparkSession.createDataFrame(halo, "part long, pos long, to_part long, to_pos long")
        copied = ranged.join(F.broadcast(move), ["part", "pos"]).drop("part", "pos").withColumnsRenamed({"to_part": "part", "to_pos": "pos"}).withColumn("own", F.lit(False))
        full = full.unionByName(copied)

    def compare(batches):
        """Rows in URL order; a run of rows with equal lines is one page, and is settled once REACH others follow it."""
        runs: deque[tuple[tuple, list[Line], list[bytes]]] = deque()  # ((part, host), lines, rows of this partition)
        begun = 0  # runs before this one are settled

        def settle(i: int) -> list[tuple]:
            place, page, rows = runs[i]
            if not rows:
                return []
            before = [r[1] for r in reversed(list(runs)[max(0, i - REACH) : i]) if r[0] == place]
            after = [r[1] for r in list(runs)[i + 1 : i + 1 + REACH] if r[0] == place]
            own = chosen([x[2] for x in page])
            gone = [out for out, x in zip(template(page, before, after), page, strict=True) if x[2] == own]
            return [(key, gone) for key in rows] if any(gone) else []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, result, strict=True)], schema=result)

        for b in batches:
            out: list[tuple] = []
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "host", "said", "sizes", "places", "key", "own")]
            for part, host, said, sizes, places, key, own in zip(*cols, strict=True):
                page = list(zip(said, sizes, places, strict=True))
                if not (runs and runs[-1][0] == (part, host) and runs[-1][1] == page):
                    runs.append(((part, host), page, []))
                    while begun < len(runs) - 1 - REACH:
                        out += settle(begun)
                        begun += 1
                    while begun > REACH:
                        runs.popleft()
                        begun -= 1
                if own:
                    runs[-1][2].append(key)
            yield batch(out)
        yield batch([row for i in range(begun, len(runs)) for row in settle(i)])

    result = pa.schema([("key", pa.binary()), ("gone", pa.list_(pa.bool_()))])
    changed = cut(full.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(compare, "key binary, gone array<boolean>"))
    met = parsed.select("page_id", "url", "key", "lines").join(F.broadcast(changed) if changed.count() <= FEW else changed, "key", "left")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.element_at("gone", i + 1)))
    return met.select("page_id", "url", F.array_join(left, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
