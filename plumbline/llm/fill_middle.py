"""Fill-in-the-middle transformation by a two-pass matcher in constant memory.

Units are matches of UNIT, left to right over code points.  The first pass counts them; two ranks are drawn from a hash of
the id; the second pass advances one lazy match iterator to the smaller rank and on to the larger, and keeps no unit but
the two places where it stopped.  Beside the text itself a document needs a handful of numbers, whatever its length.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import texts

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, in hundredths: documents that are cut, and cut documents whose suffix comes first.
CUT, SUFFIX_FIRST = 90, 20
BATCH = 64


def count_units(text: str) -> int:
    """First pass: how many units a text has."""
    return sum(1 for _ in UNIT.finditer(text))


def ends_of(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the first `first` units end, and the first `second` >= `first`; code points from the start."""
    matches = UNIT.finditer(text)
    a = _advance(matches, first, 0)
    return a, _advance(matches, second - first, a)


def _advance(matches, steps: int, here: int) -> int:
    """The end of the steps-th next match; `here` for no step."""
    if steps == 0:
        return here
    return next(islice(matches, steps - 1, None)).end()


def draws(doc_id: Column, count: int = 4) -> list[Column]:
    """Whole numbers below 2^32 from a hash of the id: the 8-digit groups of its SHA-256.  No id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n, form ('plain', 'psm' or 'spm'), prefix_chars, middle_chars and output, a row for each row.

    Plain are texts that are empty (null counts as empty), that hold one of the three marks, or that the draw leaves; their
    output is the text and their lengths are null.  Texts of any length are cut whole; repeated rows come out alike; an empty
    table gives no rows; columns other than `keep` take no part, so their names do not clash.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col(id_col))
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((whole == "") | marked | (h[2] % 100 >= CUT), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    own = [F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    source = docs.select(*own, whole.alias("__text"), form.alias("__form"), h[0].alias("__h1"), h[1].alias("__h2"))
    schema = ", ".join(f"__keep_{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[: len(keep)])) + ", n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                yield cut(big.slice(at, BATCH))

    def cut(b):
        out = []
        for t, form, h1, h2 in zip((t.decode() for t in texts(b, "__text")), *[b.column(len(keep) + i).to_pylist() for i in (1, 2, 3)], strict=True):
            n = count_units(t)
            if form == "plain":
                out.append((n, form, None, None, t))
                continue
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, z = ends_of(t, low, high)
            prefix, middle, suffix = t[:a], t[a:z], t[z:]
            shown = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
            out.append((n, form, a, z - a, shown))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + cols, names=[f"__keep_{i}" for i in range(len(keep))] + ["n", "form", "prefix_chars", "middle_chars", "output"])

    return source.mapInArrow(run, schema).withColumnsRenamed({f"__keep_{i}": c for i, c in enumerate(keep)})


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form alone.  The text of a cut document holds no mark, so the first mark of a kind
    is the one that was put there."""

    def between(left: str, right: str) -> Column:
        begin = F.instr(output, left) + len(left)
        return F.substring(output, begin, F.instr(output, right) - begin)

    after = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
