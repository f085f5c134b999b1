"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from plumbline.llm import ann, html_extract, langid, packing, ppm, quality, sharding, simhash, toxicity
from plumbline.llm.common import draw
from plumbline.llm.sentencepiece_codec import digests, encode

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, score double, hub string"


@pytest.fixture(scope="module")
def docs(spark):
    words = "the cat and that dog ran over some hill in rain " * 12
    rows = [(1, words), (2, words), (2, words), (3, None), (4, ""), (5, " \n\t"), (6, "x" * 5000), (7, "a b " * 3000), (8, "né ¿qué? 123"), (None, "no id"), (9, words + "end")]
    return spark.createDataFrame([(i, t, "en", None, None, 5, 7, 0.5, "h") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_row_by_row_operators(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 0, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    q, t, n = quality.train(docs, labels), toxicity.train(docs, labels), langid.train(docs)
    path = public_tokenizers.path("piece_bpe_32k.model")
    for run in (lambda d: quality.assess(d, q), lambda d: toxicity.assess(d, t), lambda d: langid.identify(d, n), lambda d: digests(d, path), lambda d: encode(d, path), ppm.score_documents):
        assert run(docs).count() == docs.count()
        assert run(empty).count() == 0
    assert quality.filter_documents(docs, q).columns == docs.columns
    assert toxicity.filter_documents(docs, t).columns == docs.columns
    lang = {r.doc_id: r.lang_pred for r in langid.identify(docs, n).collect()}
    assert lang[3] == lang[4] == lang[5] == "und" and lang[1] == "en"


def test_drawn_texts_are_whole(spark):
    late = "word " * 5000 + "moron"
    docs = spark.createDataFrame([(i, late) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    drawn = draw(docs, labels, "toxic", {1: 9, 0: 9}, 1_000_000)
    assert [r["t"] for r in drawn[1]] == [r["t"] for r in drawn[0]] == [late] * 2
    assert [r["t"] for r in draw(docs, labels, "toxic", {1: 9, 0: 9}, 10)[1]] == [late]


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    part = {r.doc_id: r.component_id for r in got}
    assert part[1] == part[2] == 1 and part[3] == part[4] == part[5] == 3
    assert simhash.deduplicate(empty).count() == 0


def test_deduplicate_keeps_one_row_a_component(spark):
    text = lambda seed: " ".join(f"w{seed}x{i * i % 97}" for i in range(80))
    rows = [(None, text(1), 0), (5, text(2), 1), (5, text(2), 2), (5, text(3), 3), (7, text(3), 4), (None, text(2), 5), (None, text(4), 6), (None, text(4), 7)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, place int")).collect()
    assert sorted(r.text for r in kept) == sorted(text(k) for k in (1, 2, 3, 4))
    assert {r.doc_id for r in kept if r.text in (text(2), text(3))} == {5}


def test_verified_copies_are_those_of_jaccard(spark, docs, empty):
    rng = random.Random(9)
    rows, words = [], []
    for k in range(40):
        words.append([f"w{rng.randrange(3000)}" for _ in range(200)])
        rows.append((3 * k, " ".join(words[k])))
        for i, changes in ((1, 3), (2, 9)):  # Jaccard about 0.85 and about 0.6
            w = list(words[k])
            for at in range(changes):
                w[10 + at * (180 // changes)] = f"new{k}x{at}"
            rows.append((3 * k + i, " ".join(w)))
    grams = {i: set(zip(*[t.split()[n:] for n in range(5)], strict=False)) for i, t in rows}
    want = {frozenset((i, j)) for i in grams for j in grams if i < j and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    assert len(want) == 40
    df = spark.createDataFrame(rows, "__row long, text string")
    part = {r["__row"]: r.component_id for r in simhash.verified_copies(df).collect()}
    got = {frozenset((i, j)) for i in part for j in part if i < j and part[i] == part[j]}
    assert got <= want and len(got) >= 38
    kept = simhash.deduplicate_verified(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert simhash.deduplicate_verified(empty).count() == 0


def test_large_groups_of_near_copies_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)
    base = " ".join(f"w{i}" for i in range(150))
    df = spark.range(90).selectExpr("id AS __row", f"CASE WHEN id < 70 THEN concat('{base} end', id) ELSE concat_ws(' ', transform(sequence(1, 100), x -> concat('o', id, 'x', x))) END AS text")
    part = {r["__row"]: r.component_id for r in simhash.verified_copies(df).collect()}
    assert [part[i] for i in range(90)] == [0] * 70 + list(range(70, 90))


def test_packing_covers_each_id_once(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, max_tokens=64).collect()
    line = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for s, o, n in line:
        assert s * 64 + o == at and o + n <= 64
        at += n
    assert {r.doc_id: r.doc_tokens for r in rows}[3] == 1
    assert packing.pack(empty, path).count() == 0


def test_shards(docs, empty):
    rows = sharding.shard_documents(docs, shards=2).collect()
    assert len(rows) == docs.count()
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.doc_id: r.size for r in rows}[3] == 1
    assert sharding.shard_documents(empty).count() == 0


def test_shards_split_a_hot_group_and_stay_even(spark):
    hot = spark.range(400).selectExpr("id AS doc_id", "CASE WHEN id < 150 THEN repeat('hot text ', 20) ELSE concat('text ', id, repeat('x', 150)) END AS text")
    rows = sharding.shard_documents(hot, shards=4).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(sizes) < 1.05 * min(sizes)
    assert len({r.shard for r in rows if r.doc_id < 150}) < 4


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (2, [0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, k=10, every=100).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, pytest.approx(2**0.5))]
    assert ann.nearest(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://[bad", "<p>x"), (1, "http://[bad", "<p>x"), (None, None, ""), (2, "http://a.example/1", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "1 AS part", "'t' AS text")
    assert sorted(r.text for r in html_extract.extract(df).collect()) == ["", "", "x", "x"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_propagation_joins_groups_within_quota(spark):
    """Against brute force: cut links counted pair by pair, before and after."""
    rng = random.Random(12)
    nodes = [(n, rng.randrange(1, 5), rng.randrange(4)) for n in range(300)]
    links = [(n, n // 3) for n in range(240)] + [(n, 1000 + n % 7) for n in range(0, 60, 3)]
    of = {}
    for n, hub in links:
        of.setdefault(hub, []).append(n)

    def cut_pairs(shard):
        return sum(shard[a] != shard[b] for members in of.values() for i, a in enumerate(members) for b in members[:i])

    df, edges = spark.createDataFrame(nodes, "node long, w long, shard int"), spark.createDataFrame(links, "node long, hub long")
    quota = sum(w for _, w, _ in nodes) / 4 * 1.02
    got = sharding.propagate(df, edges, 4, quota)
    before, after = {n: s for n, _, s in nodes}, {r.node: r.shard for r in got.collect()}
    found = [sharding.cut_edges(d, edges).first() for d in (df, got)]
    assert [f.cut_links for f in found] == [cut_pairs(before), cut_pairs(after)] and found[0].links == sum(len(m) * (len(m) - 1) / 2 for m in of.values())
    assert cut_pairs(after) < cut_pairs(before) / 4
    loads = [[sum(w for n, w, _ in nodes if where[n] == s) for s in range(4)] for where in (before, after)]
    assert all(b <= max(quota, a) + 10 for a, b in zip(*loads, strict=True))
    assert all(after[n] == before[n] for n in range(240, 300))


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i % 150} " + "x" * (i % 150) if i < 400 else f"alone {i} " + "y" * (i % 77)) for i in range(1000)] + [(None, None)] * 5
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    where = {r.doc_id: r.shard for r in got}
    assert sum(len({where[i] for i in range(k, 400, 150)}) == 1 for k in range(150)) >= 140
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) < 1.01 * sum(sizes) / 8 and sum(r.doc_id is None for r in got) == 5


def test_thinned_links_have_the_same_components(spark):
    import numpy as np

    from plumbline.llm.components import connected_components, star

    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 400, 500), rng.integers(0, 400, 500)
    u, v = np.append(u, np.full(300, 1000)), np.append(v, np.arange(1000, 1300))  # a hub

    def parts(a, b):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        return {x: find(x) for x in root}

    thin_u, thin_v = star(u, v)
    want = parts(u, v)
    assert {x: c for x, c in want.items() if x in set(thin_u.tolist()) | set(thin_v.tolist())} == parts(thin_u, thin_v)
    edges = spark.createDataFrame([(int(a), int(b), "x", 1) for a, b in zip(u, v, strict=True)] + [(None, 5, "x", 1)], "u long, v long, label string, node int")
    assert {r.node: r.component for r in connected_components(edges).collect()} == want


def test_recall_with_the_parameters_of_the_query(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2500, 64)), rng.normal(size=(20, 64)).repeat(50, 0) + 0.3 * rng.normal(size=(1000, 64)), np.ones((300, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, k=10, every=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    right = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        assert all(score == pytest.approx(d[v]) for v, score in got[q]) and len(got[q]) == 10
        right += len(set(best) & {v for v, _ in got[q]})
    assert right >= 0.95 * 10 * len(got) and len(got) == 38


def test_packing_equals_brute_force(spark):
    """Ids by the library, laid on one line in the order of the pieces: checksums, places and lengths."""
    from zlib import crc32

    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Alpha", "beta!", "it's", "12", "éa", "x" * 9]) for _ in range(rng.choice([0, 1, 30, 400]))) for _ in range(60)] + [None, ""]
    lib = Tokenizer.from_file(path)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), path, max_tokens=128).collect()
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.sequence_id, r.offset) == divmod(at, 128) and r.doc_tokens == len(ids[r.doc_id]) and len(piece) == r.length
        assert r.ids_crc32 == crc32(np.array(piece, "<u4").tobytes())
        at += r.length
    assert at == sum(map(len, ids.values()))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) == len(ids[d]) for d, v in by_doc.items()) and set(by_doc) == set(ids)


def test_learned_operators_read_no_held_out_label(spark):
    """Labels and languages of the fold that is left out may say anything."""
    from zlib import crc32

    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(["th", "er", "ing"] if i % 2 else ["ñ", "que", "ión"]) for _ in range(3)) for _ in range(40)), "ab"[i % 2] if crc32(str(i).encode()) % 4 != 2 else f"lie{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, fold=(4, 2))
    assert net.languages == ["a", "b"]
    found = langid.identify(docs, net).collect()
    assert sum(r.lang_pred == "ab"[r.doc_id % 2] for r in found) >= 115


def test_quality_verdict_equals_brute_force(spark):
    """The query's columns from the model's own numbers, gram by gram."""
    from zlib import crc32

    import numpy as np

    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=quality.SIZE).astype(np.float32), 2.0, 0.1)
    texts = [" ".join(random.Random(i).choice(["alpha", "beta#", "γ", "d"]) + str(random.Random(i * 7 + k).randrange(300)) for k in range(40 + i)) for i in range(40)]
    rows = quality.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        raw = texts[r.doc_id].encode()
        words = raw.split()
        grams = [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> (32 - quality.BITS) for i in range(len(raw) - 2)]
        z = sum(float(model.words[crc32(w) & (quality.SIZE - 1)]) for w in words) / len(words) + sum(float(model.chars[g]) for g in grams) / len(grams)
        p = 1 / (1 + np.exp(-(2.0 * z + 0.1)))
        assert r.quality_p == pytest.approx(p, abs=1e-5) and r.kept == (not r.base_failed and p >= quality.THRESHOLD)
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))


def test_bucketed_tables_lie_in_the_shared_folder(spark):
    """Whatever op8 keeps in buckets lies in the folder that all share, needs no further shuffle, and is deleted once it is read."""
    from pathlib import Path

    from plumbline.llm.common import cut_by, forget, shared_dir

    held = cut_by(spark.range(100).withColumnRenamed("id", "key"), "key", 4)
    files = [f.removeprefix("file:").replace("///", "/") for f in held.inputFiles()]
    assert files and all(f.startswith(shared_dir(spark)) for f in files)
    counted = held.groupBy("key").count()
    assert counted.count() == 100 and "Exchange hashpartitioning(key" not in counted._jdf.queryExecution().executedPlan().toString()
    forget(held)
    assert not any(Path(f).exists() for f in files)


def test_packed_answers_and_texts_come_back_whole(spark):
    """Numbers, words and rows are the same after packing: negative and large numbers, bytes that are no UTF-8, no rows at all."""
    numbers = [np.array([0, 5, -3, 2**62], np.int64), np.array([0.0, -1.5, 1e300, 2.0])]
    got = ppm.unsqueeze_numbers(ppm.squeeze_numbers(numbers), [np.int64, np.float64])
    assert all((a == b).all() for a, b in zip(numbers, got, strict=True))
    assert [len(x) for x in ppm.unsqueeze_numbers(ppm.squeeze_numbers([np.zeros(0)] * 2), [np.float64, np.float64])] == [0, 0]
    words = pa.array([b"a", "é中".encode(), b"\xff\xfe", b"x" * 70_000], pa.binary())
    assert ppm.unsqueeze_words(ppm.squeeze_words(words)).to_pylist() == words.to_pylist()

    rows = [(b, f"w{i}".encode(), i) for i in range(50) for b in (1 << 32, 7)]
    packed = ppm.pack_replies(spark.createDataFrame(rows, "block long, word binary, c long").coalesce(2), True, 16).collect()
    back = [(r["block"], w, int(c)) for r in packed for w, c in zip(ppm.unsqueeze_words(bytes(r["names"])).to_pylist(), ppm.unsqueeze_numbers(bytes(r["worth"]), [np.int64])[0], strict=True)]
    assert sorted(back) == sorted(rows) and len(packed) < len(rows)

    texts = [(1, 1, True, "ab"), (1, 2, False, None), (2, 3, False, ""), (1, None, False, "ä" * 5000)]
    docs = spark.createDataFrame(texts, "block long, doc_id long, held boolean, text string").coalesce(1)
    back = [(r["block"], *(x[c] for c in ("doc_id", "held", "text"))) for r in ppm.pack_texts(docs).collect() for b in ppm.unpack_texts(pa.table({"rows": [bytes(r["rows"])]})) for x in b.to_pylist()]
    assert back == texts and ppm.pack_texts(docs.where("false")).count() == 0


def test_cells_of_counts_find_near_copies_at_any_size(spark):
    rng = np.random.default_rng(9)
    # 300 pairs that share eight of nine hashes: Jaccard 0.8, each with 270 shingles
    sets = []
    for _ in range(300):
        own = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
        sets += [own[:270], own[30:]]
    for rows in (10_000, 10**7):
        width, size = simhash.cell_plan(rows)
        prints = np.array([simhash.wide_fingerprint(x, size) for x in sets])
        keys = simhash.count_cells(prints, width)
        assert (keys[::2] == keys[1::2]).any(1).mean() > 0.97
        # a cell is the counts of its segments: swapping the two bits of a segment moves none
        low = np.uint64(0x5555555555555555)
        assert (simhash.count_cells(((prints & low) << np.uint64(1)) | ((prints >> np.uint64(1)) & low), width) == keys).all()
        assert rows * keys.shape[1] * simhash.SEGMENT_AGREE**width <= simhash.MEET
    df = spark.createDataFrame([(i, simhash.wide_fingerprint(x).tobytes()) for i, x in enumerate(sets)], "node long, prints binary")
    linked = {(r["component"], r["node"]) for r in simhash.connected_components(simhash.candidate_forest(df)).collect()}
    assert sum((2 * i, 2 * i + 1) in linked for i in range(300)) > 285
