"""The registered queries, with production parameters, against brute force or held-out truth on whole small tables."""

import hashlib
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest

from plumbline.llm.queries import QUERIES

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def table(folder: str, name: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()


def fold(doc_id: int, modulus: int) -> int:
    return crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def documents():
    return {i: t or "" for i, t in table(SMALL, "documents", "doc_id, text")}


def answers(spark, name: str, folder: str = SMALL) -> list:
    return QUERIES[name](spark, folder).collect()


def test_op1_equals_the_library(spark, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = answers(spark, "op1_sentencepiece")
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        ids = lib.encode(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))


def test_op3_knows_held_out_languages(spark):
    truth = dict(table(MIDDLE, "documents", "doc_id, lang"))
    rows = answers(spark, "op3_language_id", MIDDLE)
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert len(held) > 200 and np.mean(held) >= 0.98


def test_op4_finds_held_out_toxic_documents(spark):
    truth = dict(table(LARGE, "labels", "doc_id, toxic"))
    rows = answers(spark, "op4_toxicity", LARGE)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert len(toxic) > 50 and np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.01


def test_op6_pieces_hold_the_ids_of_the_library(spark, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, seen = 0, Counter()
    for r in sorted(answers(spark, "op6_packing"), key=lambda r: (r.sequence_id, r.offset)):
        ids = np.array([*lib.encode(documents[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.sequence_id, r.offset, r.doc_tokens) == (*divmod(at, 2048), len(ids)) and r.ids_crc32 == crc32(ids[r.start : r.start + r.length].tobytes())
        at += r.length
        seen[r.doc_id] += r.length
    assert set(seen) == set(documents)


def test_op7_counts_equal_brute_force(spark, documents):
    import regex

    for r in answers(spark, "op7_quality_rules"):
        text = documents[r.doc_id]
        words = regex.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = len({i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)})
        lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed)
        assert not (r.base_failed and r.kept)


def test_op8_base_equals_brute_force_and_the_model_has_learned(spark, documents):
    low = {i: t.encode().lower() for i, t in documents.items()}
    words = Counter(w for i, t in low.items() if fold(i, 7) != 2 for w in [*t.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    rows = answers(spark, "op8_lm_scoring")
    for r in rows:
        tokens = [*low[r.doc_id].split(), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(w in words for w in tokens), n, fold(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(sum(np.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > -0.4 * np.log10(257) * sum(len(low[r.doc_id]) + 1 for r in held)


def test_op9_law_holds(spark):
    documents = dict(table(MIDDLE, "documents", "doc_id, text"))
    rows = answers(spark, "op9_sharding", MIDDLE)
    assert sorted(r.doc_id for r in rows) == sorted(documents) and {r.law for r in rows} == {"bytes"}
    groups: dict[str, set] = {}
    for r in rows:
        raw = (documents[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, crc32(raw))
        groups.setdefault(documents[r.doc_id], set()).add(r.shard)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) < 1.02 * sum(sizes) / 8 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(8))
    shared = [len(s) for t, s in groups.items() if t is not None and sum(x == t for x in documents.values()) > 1]
    assert shared and np.mean([n == 1 for n in shared]) > 0.9


def test_op10_recall_and_distances(spark):
    vectors = {i: np.array(v, float) for i, v in table(LARGE, "embeddings", "vec_id, embedding") if v is not None}
    ids = np.array([i for i, v in vectors.items() if len(v) == 64 and np.isfinite(v).all() and v.any()])
    x = np.array([vectors[i] for i in ids])
    got: dict[int, list] = {}
    for r in QUERIES["op10_permutation_index"](spark, LARGE).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    right = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - vectors[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        right += len(set(ids[best].tolist()) & {v for v, _ in got[q]})
        assert all(s == pytest.approx(np.sqrt(((vectors[v] - vectors[q]) ** 2).sum())) for v, s in got[q])
    assert right >= 0.95 * 10 * len(got) and set(got) == set(ids[ids % 100 == 0].tolist())
