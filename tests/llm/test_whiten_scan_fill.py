"""Whitening, secret scans and fill-in-the-middle against brute force, with their edge cases."""

import base64
import bz2
import gzip
import hashlib
import re
import urllib.parse
import zlib

import duckdb
import numpy as np
import pytest

from plumbline.llm import fill_middle, secret_scan, whitening
from plumbline.llm.queries import ORACLE_SQL, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SECRET = 'api_key="abcdEFGH12345678"'


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- whitening


def test_op11_equals_an_eigendecomposition(spark):
    held = duckdb.sql(f"SELECT vec_id, embedding FROM '{MIDDLE}/embeddings.parquet'").fetchall()
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for _, v in held], object)
    n, sums = len(x), x.sum(0)
    c = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    want = (c @ vectors[:, ::-1][:, :32]) / np.sqrt(values[::-1][:32])
    rows = QUERIES["op11_embedding_whitening"](spark, MIDDLE).collect()
    assert len(rows) == 32 * n and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    got = np.zeros((n, 32))
    place = {i: k for k, (i, _) in enumerate(held)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert abs(r.explained / (values[::-1][r.component - 1] / values.sum()) - 1) < 1e-9
        if r.component == 1:
            assert r.deviation == sum(int(v) ** 2 for v in n * x[place[r.vec_id]] - sums)
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-7


def test_whitening_leaves_out_what_is_no_vector(spark):
    good = [(i, [float(i % 3), float(i * i % 5), 0.5 * i]) for i in range(8)]
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [1.0, float("nan"), 2.0]), (23, [float("inf"), 1.0, 2.0]), (24, []), (25, [1.0]), (26, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad + [good[0], (None, [0.0, 0.0, 0.0])]], "vec_id long, embedding array<double>, component string")
    rows = whitening.whitened_components(df).collect()
    assert len(rows) == 3 * 10 and {r.vec_id for r in rows} == {*range(8), None} and {r.n for r in rows} == {10}
    assert rows[0].identity_error < 1e-9 and abs(sum({r.component: r.explained for r in rows}.values()) - 1) < 1e-12


def test_whitening_without_variance_or_rows(spark):
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert whitening.whitened_components(alike).count() == 0
    assert whitening.whitened_components(alike.limit(0)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened_components(flat).collect()} == {1}  # the second has no variance


def test_block_grows_where_the_spectrum_is_flat(spark):
    x = np.random.default_rng(3).standard_normal((1500, 90))
    rows = whitening.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    model = whitening.fit(rows, 4, block=4)
    y = np.floor(64 * x)
    exact = np.linalg.eigvalsh(np.cov(y.T, bias=True))[::-1][:4]
    assert np.allclose(model.values, exact, rtol=1e-11) and model.residuals.max() <= 1e-12 * exact[0] and model.passes < 20
    steep = x * 0.2 ** np.arange(90)
    model = whitening.fit(whitening.usable(spark.createDataFrame([(i, (1000 * v).tolist()) for i, v in enumerate(steep)], "vec_id long, embedding array<double>")), 3, block=5)
    assert len(model.values) == 3 and model.components.shape == (90, 3)


def test_deviations_beyond_a_machine_number():
    model = whitening.Whitening(3, np.array([30, 3 << 40]), np.zeros((2, 0)), np.zeros(0), np.zeros(0), 1.0, 1)
    assert model.deviations(np.array([[10, 1 << 40], [11, (1 << 40) + 5]])) == [0, 9 + 225]
    assert model.deviations(np.array([[10, 1 << 40], [11, 1 << 45]])) == [0, None]


# ---------------------------------------------------------------- secrets


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Secrets of the text itself, by the patterns as they are stated."""
    rules = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, group, least) in enumerate(rules) for m in p.finditer(text) if len(m[group]) >= least]
    return [(kind, a, z) for a, _, z, kind in sorted(found)]


def test_op12_holds_every_plain_span(spark):
    texts = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{MIDDLE}/documents.parquet'").fetchall()}
    rows = QUERIES["op12_secret_scan"](spark, MIDDLE).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    total = 0
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        shown = [":".join(map(str, s)) for s in want]
        assert r.base_sha256 == sha(",".join(shown)) and set(shown) <= set(r.spans.split(",") if r.spans else [])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex"))
        total += len(want)
    assert total > 10


def encoded(x) -> str:
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


QUOTED = urllib.parse.quote(SECRET, safe="")
LAYERS = {
    "base64": encoded("x " + SECRET + " yé"),
    "base64>base64": encoded("see " + encoded(SECRET)),
    "base64>unpack": encoded(gzip.compress(zlib.compress(bz2.compress(SECRET.encode())))),
    "url": urllib.parse.quote(QUOTED, safe=""),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "base64>url>unicode": encoded(urllib.parse.quote("".join(f"&#x{ord(c):x};" for c in SECRET), safe="")),
    "base64>unpack>base64": encoded(gzip.compress(("key " + encoded(SECRET)).encode())),
}


@pytest.mark.parametrize("via", list(LAYERS))
def test_secret_of_a_nested_layer_is_mapped_to_the_text(via):
    before, after = "é😀 start ", " end\nsecond line"
    found = [f for f in secret_scan.scan(before + LAYERS[via] + after) if f[0] == "assign"]
    assert [f[3] for f in found] == [via]
    start, end = found[0][1:3]
    assert len(before) <= start < end <= len(before) + len(LAYERS[via])


def test_spans_are_no_wider_than_the_encoding_asks_for():
    kind, start, end, via = secret_scan.scan(f"a%20{QUOTED} b")[0]
    assert f"a%20{QUOTED} b"[start:end] == QUOTED.removesuffix("%22")
    text = encoded("padding, " + SECRET + ", padding")
    _, start, end, _ = secret_scan.scan(text)[0]
    inner = base64.b64decode(text[start // 4 * 4 : -(-end // 4) * 4]).decode()
    assert SECRET.rstrip('"') in inner and len(inner) <= len(SECRET) + 5
    wrapped = base64.encodebytes(("word " * 40 + SECRET + " word" * 30).encode()).decode()
    assert [f[3] for f in secret_scan.scan(wrapped)] == ["base64"]


def test_worklist_ends(monkeypatch):
    assert secret_scan.scan("%25" * 30000 + "41") == []
    # data that unpack to themselves
    monkeypatch.setattr(secret_scan, "_unpacker", lambda head: zlib.decompressobj(15) if head == b"same" else None)
    monkeypatch.setattr(secret_scan, "_stream", lambda unpack, chunks: iter([b"same"]))
    assert list(secret_scan._unpacked(b"same")) == []


def test_large_and_broken_archives(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 1000)
    lines = "filler line é\n" * 500 + SECRET + "\n" + "filler line\n" * 500
    assert [f[0] for f in secret_scan.scan(encoded(gzip.compress(lines.encode()))) if f[0] == "assign"] == ["assign"]
    assert secret_scan.scan("x " + encoded(gzip.compress(SECRET.encode() * 50))[:-40]) == []
    assert secret_scan.scan(encoded(bytes(range(256)))) == []


def test_secret_scan_of_edge_cases(spark):
    long = "word " * 400_000 + SECRET
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, SECRET, 5), (3, SECRET, 5), (None, long, 5)], "doc_id long, text string, secrets int")
    rows = sorted(((r.doc_id or 0, r.secrets) for r in secret_scan.secrets(df).collect()), key=lambda r: r[0])
    assert [(i, len(s)) for i, s in rows] == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert rows[0][1][0].start == 2_000_000
    assert secret_scan.secrets(df.limit(0)).collect() == []


# ---------------------------------------------------------------- fill in the middle


def cut_by_list(doc_id: int, text: str) -> tuple:
    """The row of a document, with all its units in a list."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"1:{doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, z = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:z], units[z:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), sha(output), sha(text)


def test_op13_equals_a_list_of_units(spark):
    texts = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{MIDDLE}/documents.parquet'").fetchall()}
    rows = {r.doc_id: tuple(r) for r in QUERIES["op13_fill_in_middle"](spark, MIDDLE).collect()}
    assert rows == {i: cut_by_list(i, t) for i, t in texts.items()}
    assert {r[2] for r in rows.values()} == {"plain", "psm", "spm"}


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    cur = con.execute(ORACLE_SQL["op13_fill_in_middle"])
    names = [d[0] for d in cur.description]
    got = QUERIES["op13_fill_in_middle"](spark, SMALL).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))


def test_fill_in_middle_of_edge_cases(spark):
    texts = [None, "", "one", "<P> is a mark", "half <", "<S", ">", "<<<<", "é😀\n\r x", "word " * 300_000, "A" * 2_000_000]
    rows = [(i, t, "n") for i, t in enumerate(texts * 12)] + [(3, "again", "n"), (3, "again", "n"), (None, "no id", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    done = fill_middle.transform(df, keep=("doc_id", "text"))
    back = done.select("doc_id", "form", "n", "text", "output", fill_middle.restored(done["output"], done["form"]).alias("restored")).collect()
    assert len(back) == len(rows) and all(r.restored == (r.text or "") for r in back)
    assert all(r.form == "plain" for r in back if not r.text or "<P>" in r.text) and {r.n for r in back if r.text == "A" * 2_000_000} == {1}
    assert len({r.output for r in back if r.text == "again"}) == 1
    assert fill_middle.transform(df.limit(0)).collect() == []
