import hashlib
import random
import time
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm import ann, html_extract, langid, packing, ppm, quality, simhash, toxicity
from plumbline.llm.sentencepiece_codec import Codec

ALPHABET = "ab ▁\n\té漢😀́\xa0 <s>1'A  "


def odd_texts(n: int = 400) -> list[str]:
    rnd = random.Random(1)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(n)] + ["", " ", "  ", "\n", "▁", "a" * 3000, " " * 300, "x\0y", "<unk>"]


def test_sentencepiece_equals_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for t, d in zip(odd_texts(), codec.digests(odd_texts()), strict=True):
        ids = lib.encode(t)
        assert d[:3] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
        check_spans(codec, t, ids, lambda part: part)


def check_spans(codec: Codec, text: str, ids: list[int], normal) -> None:
    """Spans run on without gaps (but for dropped spaces), and the bytes of a span normalise to its piece."""
    raw, at = text.encode(), 0
    spans = codec.spans(text)
    assert [s[0] for s in spans] == ids
    for i, (piece, begin, end) in enumerate(spans):
        assert begin <= end and not normal(raw[at:begin].decode()).strip(" ▁")
        at = max(at, end)
        shown = codec._segmenter.id_to_piece(piece).replace("▁", " ")
        shared = any(0 <= k < len(spans) and max(begin, spans[k][1]) < min(end, spans[k][2]) for k in (i - 1, i + 1))
        if not codec.is_byte[piece] and piece != codec.unknown:
            whole = normal(raw[begin:end].decode()).replace("▁", " ")
            assert shown.strip(" ") in whole if shared else shown.strip(" ") == whole.strip(" ")
    assert not normal(raw[at:].decode()).strip(" ▁")


@pytest.mark.parametrize(("squeeze", "prefix", "suffix"), [(True, True, False), (False, True, False), (True, False, False), (True, True, True)])
def test_sentencepiece_with_a_compiled_map(tmp_path, squeeze, prefix, suffix):
    from sentencepiece import sentencepiece_model_pb2 as proto

    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    rules, model = proto.ModelProto(), proto.ModelProto()
    rules.ParseFromString(normaliser.serialized_model_proto())
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    spec.name, spec.precompiled_charsmap = "nmt_nfkc", rules.normalizer_spec.precompiled_charsmap
    spec.remove_extra_whitespaces, spec.add_dummy_prefix, model.trainer_spec.treat_whitespace_as_suffix = squeeze, prefix, suffix
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), Codec(str(path))
    assert codec.map.longest("ﬁx".encode(), 0) == (3, b"fi")
    assert codec.map.longest("e\u0301x".encode(), 0) == (3, "é".encode())
    rng = random.Random(3)
    parts = ["ﬁ", "Ａ", "e\u0301", "é", "ｶﾞ", "㍿", " ", "  ", "\u3000", "\t", "\n", "a", "the ", "\u200b", "½", "漢", "😀", "\x01", "x", "Å", "가"]
    for t in [*odd_texts(200), *["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]]:
        if not t.isascii() and "\0" in t:
            continue
        check_spans(codec, t, lib.encode(t), lambda part: codec.map.apply(part.encode())[0].tobytes().decode())


def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for t in [*odd_texts(), "It's 12% <|endoftext|>x ***ab,cd*** É"]:
        assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    grid = np.array(np.meshgrid(*[np.arange(4)] * 3)).reshape(3, -1).T
    key = packing.hilbert_key(grid, 2)
    assert sorted(key) == list(range(64))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_simhash_grids_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, 3, replace=False)) for b in base for _ in range(2)]
    fps = np.unique(np.concatenate([base, np.array(near, np.int64)]))
    links = simhash.link_forest(spark.createDataFrame([(int(f),) for f in fps], "fp long"), len(fps), 4).collect()
    u = fps.view(np.uint64)
    want = [(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 4), strict=True)]
    assert groups(fps.tolist(), [(r.u, r.v) for r in links]) == groups(fps.tolist(), want)


def groups(nodes: list[int], pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The least node reachable from each node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_duplicates_equal_brute_force(spark):
    """Fingerprints by their definition and links pair by pair, with the parameters of the query."""
    import xxhash

    rng = random.Random(21)
    base = [[rng.choice("abcdefghijklm") * rng.randrange(1, 4) for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(40)]
    texts = [None, "", " \n\t", "One", "one  TWO three"]
    for words in base:
        texts.append(" ".join(words))
        texts.append("\n".join(words).upper())
        for _ in range(3):
            w = list(words)
            w[rng.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))

    def brute(text):
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        words = [w for w in words if w]
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))

    prints = [brute(t) for t in texts]
    want = groups(list(range(len(texts))), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    rows = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4, distance=4).collect()
    assert {r.doc_id: r.fp & ((1 << 64) - 1) for r in rows} == dict(enumerate(prints))
    assert {r.doc_id: r.component_id for r in rows} == want and len(set(want.values())) < 0.7 * len(want)


def test_simhash_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A B C D E F", "x"), (3, None, "x"), (4, " \n", "x"), (4, " \n", "x")], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_quality_counts():
    m = quality.measure("a b c a b c x\nfoo #\nfoo #\n \n".encode())
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == (11, 15, 2, 1, 6)
    assert quality.measure(b"").base_failed
    rng = random.Random(5)
    for _ in range(200):
        w = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        want = len({i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})
        assert quality.measure(" ".join(w).encode()).n_repeat_words == want


def test_toxicity_restores_noise():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["th", "er", "an", "on", "in", "re"]) for _ in range(rng.randrange(1, 4)))
    text = lambda bad: " ".join(rng.choice(bad) if bad and rng.random() < 0.05 else word() for _ in range(120))
    model = toxicity.fit([text(["moron", "stupid"]) for _ in range(80)], [text([]) for _ in range(160)])
    for w in ("moron", "M0R0N", "mo-ron", "moooron", "$tupid", "s t u p 1 d"):
        assert model.score(f"the {w} then".encode()) > model.score(b"the then"), w
    assert model.score(b"") < 0.5
    assert toxicity.fit([], []).score(b"anything") < 0.5


def test_language_network_learns_and_abstains():
    rng = random.Random(4)
    make = lambda parts: [" ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(60)) for _ in range(40)]
    net = langid.fit({"x": make(["th", "er", "ing"]), "y": make(["ión", "ñ", "que"])}, epochs=4)
    got = net.predict([b"therther ingth", "queñión ñque".encode(), b"", b"123 !"])
    assert [g[0] for g in got] == ["x", "y", "und", "und"]
    assert langid.fit({}).predict([b"abc"]) == [("und", 0.0)]


class BrutePpm:
    """Prediction by partial matching over whole Python objects: symbols are bytes and "end", "before" fills the context."""

    def __init__(self, texts: list[bytes], order: int = 5):
        self.order, self.counts = order, {}
        for t in texts:
            p = ["before"] * order + list(t) + ["end"]
            for i in range(order, len(p)):
                for k in range(order + 1):
                    self.counts.setdefault(tuple(p[i - k : i]), Counter())[p[i]] += 1

    def log10(self, context: list, symbol) -> float:
        log, out = 0.0, set()
        for k in range(self.order, -1, -1):
            here = self.counts.get(tuple(context[len(context) - k :]), {})
            seen = {s: n for s, n in here.items() if s not in out}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return log + np.log10(seen[symbol] / total)
            log += np.log10(len(seen) / total)
            out |= set(here)
        return log - np.log10(257 - len(out))

    def score(self, text: bytes) -> float:
        p = ["before"] * self.order + list(text) + ["end"]
        return sum(self.log10(p[i - self.order : i], p[i]) for i in range(self.order, len(p)))


def test_brute_ppm_sums_to_one():
    brute = BrutePpm([b"abracadabra", b"abra cadabra", b"", b"zzz"])
    for context in (["before"] * 5, list(b"abrac"), list(b"qqqqq"), ["before", *b"abra"]):
        assert sum(10 ** brute.log10(context, s) for s in [*range(256), "end"]) == pytest.approx(1)


def test_ppm_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 400)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ab", "ra", "cad", " ", "e\0", "Z", "é", "\n"]) for _ in range(rng.randrange(60))) for _ in range(60)] + [None, "", "\0", "entirely unseen 漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = {i: crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    low = [(t or "").encode().lower() for t in texts]
    brute = BrutePpm([low[i] for i in held if not held[i]])
    words = Counter(w for i in held if not held[i] for w in [*low[i].split(), b"\n end"])
    n, v = sum(words.values()), len(words)
    rows = ppm.score_documents(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and any(held.values())
    for r in rows:
        tokens = [*low[r.doc_id].split(), b"\n end"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(w in words for w in tokens), n)
        assert r.base_score == pytest.approx(sum(np.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score == pytest.approx(brute.score(low[r.doc_id])), r.doc_id


def test_ppm_without_training_documents(spark):
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    r = ppm.score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert r.score == pytest.approx(-3 * np.log10(257)) and r.n_known == r.train_tokens == 0 and r.base_score == 0


def test_html_blocks_and_differencing():
    page = "<nav>menu<article><header><h1>T&amp;1</h1></header>a <b>b</b>\n c<p>two<br>x<aside>no</aside><div class=comments><p>c</p></div></article><footer>f</footer>"
    assert html_extract.blocks(page) == (True, ["T&1", "a b c", "two x"])
    assert html_extract.blocks("") == (False, [])
    assert html_extract.blocks("<script>var a='</p>'</script><p>x<p>y") == (False, ["x", "y"])
    assert html_extract.blocks("<article><p>See <a href='/x'>this</a> and <em>that</em>, <code>x</code>.</p>1 < 2 <span class=ad>no</span>yes</article>") == (True, ["See this and that, x.", "1 < 2 yes"])
    assert html_extract.blocks('<p title="a>b">x</p><p title=it\'s>y</p><p title="open>z</p>') == (False, ["x", "y", "z"])
    long, other = "the text of this page", "another page altogether"
    assert html_extract.difference(["m", long, "f"], [["m", other, "f"]], []) == [long]
    assert html_extract.difference(["m", long], [["m", long]], []) == ["m", long]
    # copies and near copies are passed over, the next page decides
    assert html_extract.difference(["m", long, "f"], [["m", long, "f"], ["m", long, "g"], ["m", other, "f"]], []) == [long]
    assert html_extract.shared_lines(list("abcde"), list("xbydz")).tolist() == [False, True, False, True, False]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        common = [x for x, g in zip(a, html_extract.shared_lines(a, b), strict=True) if g]
        rest = iter(b)
        assert all(x in rest for x in common) and len(common) == longest(a, b)


@pytest.mark.parametrize("page", ['<a href="' * 110_000, "<div>" * 200_000, "<div></span>" * 90_000, "<p>a<b>" * 150_000, "<svg/>" * 170_000, "<!-- " * 200_000, "<article><i>" + "</div><i>" * 100_000])
def test_long_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    html_extract.blocks(page)
    assert time.perf_counter() - began < 8


def test_copies_do_not_hide_the_template(spark):
    page = lambda x: f"<body><p>Site</p><p>the text of page {x} in full</p><p>Imprint</p></body>"
    rows = [(i, f"http://h.example/{i:03}", page("a" if i < 60 else i)) for i in range(70)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.text for r in html_extract.extract(df).collect()} == {f"the text of page {x} in full" for x in ["a", *range(60, 70)]}


def test_pages_with_article_are_differenced_too(spark):
    """Lines that every page around holds at the head or tail of its article are template, by differencing alone; sentences
    that recur within articles or on some pages, and copies, stay."""
    page = lambda x, y: f"<body><nav><p>Menu</p></nav><article><p>Print this</p><p>{x}</p><p>It rained.</p><p>{y}</p><p>Read more</p></article></body>"
    rows = [(i, f"http://h.example/{i:03}", page(f"the text of page {i} in full", "Sunny." if i % 2 else f"end {i}")) for i in range(30)]
    rows += [(100 + i, "http://copies.example/a", page("a copy", "end")) for i in range(40)] + [(200, "http://h.example/007", rows[7][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    want = {i: f"the text of page {i} in full\nIt rained.\n{'Sunny.' if i % 2 else f'end {i}'}" for i in range(30)}
    want |= {100 + i: "Print this\na copy\nIt rained.\nend\nRead more" for i in range(40)} | {200: want[7]}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    joined, html_extract.FEW = html_extract.FEW, -1
    try:
        assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
    finally:
        html_extract.FEW = joined


def test_furniture_is_differenced_before_structure_decides():
    pages = [html_extract.page_lines(f"<nav><p>Home</p><p>n{i}</p></nav><article><p>text {i}</p></article>") for i in range(3)]
    typed = [[(text, len(text), where) for text, where in p] for p in pages]
    assert html_extract.template(typed[0], [], typed[1:]) == [True, False, False]


def test_shared_lines_of_long_pages_hold_few_rows():
    import tracemalloc

    a, b = [i % 977 for i in range(12_000)], [i * 7 % 977 for i in range(12_000)]
    tracemalloc.start()
    shared = html_extract.shared_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shared.any() and peak < 6e6


def test_pages_without_article_lose_shared_lines(spark):
    page = lambda x: f"<body><p>Site</p><p>{x}</p><p>Imprint</p></body>"
    rows = [(i, f"http://h.example/{i}", page(f"text {i}")) for i in range(6)] + [(9, None, None)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"text {i}" for i in range(6)}, 9: ""}


def test_neighbours_of_copies():
    x = np.random.default_rng(0).normal(size=(300, 8))
    x[50:200] = x[50]
    different, begin, ids = ann.copies(np.arange(300), x)
    assert len(different) == 151 and len(ids) == 300
    pivots = ann.spread(x, 32)
    files = ann.post(ann.orders(different, pivots, 16), len(pivots))
    q, found, d = ann.search_block(x[:1], np.array([0]), ann.orders(x[:1], pivots, 16), different, (begin, ids), files, 10, 1.0, 1)
    true = np.sqrt(((x - x[0]) ** 2).sum(1))
    true[0] = np.inf
    assert found.tolist() == np.lexsort((np.arange(300), true))[:10].tolist()


def test_fold_hash(spark):
    from plumbline.llm.common import crc_fold

    assert [r[0] for r in spark.range(20).withColumnRenamed("id", "doc_id").select(crc_fold("doc_id", 7)).collect()] == [crc32(str(i).encode()) % 7 for i in range(20)]
