"""The pipeline over small tables: nulls, repeated rows, empty tables, extra columns; each stage's decisions take effect."""

import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node long, ids string, part int"


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "er", "an", "on", "in", "re", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(160):
        words = prose(i).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "m0r0n", "stupid", "st.up.id"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    copied = prose(1).split()
    rows += [(200, prose(1)), (201, " ".join([*copied[:119], "end"])), (202, None), (203, ""), (204, "too short"), (205, "same words here " * 60), (206, prose(900, 6000)), (None, prose(901)), (1, prose(1)), (207, "Moron " + prose(902) + " you st.up.id m0r0n stupid moron")]
    spark.createDataFrame([(i, t, "en", None, None, 5, 6, "x", 7) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        kept[name] = [r.doc_id for r in docs.collect()]
    assert not {202, 203, 204, 205} & set(kept["quality_rules"]) and {1, 200, 206, 207, None} <= set(kept["quality_rules"])
    assert {0, 4, 8, 207}.isdisjoint(kept["toxicity"]) and len(kept["toxicity"]) >= 120
    near = kept["simhash_near_dedup"]
    assert near.count(1) == 1 and not {200, 201} & set(near) and len(near) == len(kept["toxicity"]) - 3 and None in near
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == set(near) and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_run_equals_its_stages_and_bears_empty_tables(spark, folder, tmp_path):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.sequence_id, r.offset) for r in rows)[0] == (0, 0) and len({r.doc_id for r in rows}) > 100
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
