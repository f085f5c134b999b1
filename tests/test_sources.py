"""Delimited text in splits, streamed cells, bucket joins, journals and plans of cells on small cases."""

import csv
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions.textdates import date_spans, numbers
from plumbline.operators import cells, joins, journal, sketches
from plumbline.sources.delimited import read_delimited, records
from plumbline.streaming import cells_stream


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, held[k]) if k in held else spark.conf.unset(k)


def test_text_with_quoted_line_breaks_is_read_in_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    rows = [[str(i), "".join(rng.choice('ab,;"\n é') for _ in range(rng.randrange(40))).strip() + "x", "line\n" * rng.randrange(60) + "end"] for i in range(300)]
    path = tmp_path / "a.csv"
    with path.open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "text", "long"])
        w.writerows(rows)
    assert path.stat().st_size > 20 * 700
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    assert records(spark, str(path)).select("split").distinct().count() > 10
    got = sorted(([r.id, r.text, r.long] for r in read_delimited(spark, str(path)).collect()), key=lambda r: int(r[0]))
    assert got == rows


def test_text_with_carriage_returns_short_rows_and_an_open_quote(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_bytes(b'\xef\xbb\xbfid;name;name\r\n1;"a;""b""\r\nc";x;surplus\r\n\r\n2\r\n3;"never closed\r\n4;y')
    rows = {r[0]: tuple(r) for r in read_delimited(spark, str(path)).collect()}
    assert rows["1"] == ("1", 'a;"b"\r\nc', "x") and rows["2"] == ("2", None, None) and set(rows) == {"1", "2", "3"}
    with pytest.raises(ValueError, match="no rows"):
        (tmp_path / "c.csv").write_text("a,b\n")
        read_delimited(spark, str(tmp_path / "c.csv"))


def test_dates_and_numbers_of_a_text(spark):
    cases = {
        "2024/3/5 and 2024.03.05, 2024-3-5": [(date(2024, 3, 5),) * 2],
        "5/3/2024, 3/25/2024 and 31/2/2024": [(date(2024, 3, 5),) * 2, (date(2024, 3, 25),) * 2],
        "in 2024-02, not 2024-02-01/7": [(date(2024, 2, 1),) * 2, (date(2024, 2, 1), date(2024, 2, 29))],
        "Sept 14th, 2025; 14 september 2025; Sep. 2025": [(date(2025, 9, 1), date(2025, 9, 30)), (date(2025, 9, 14),) * 2],
        "Q3 2025, 2024 q1 and q5 2025": [(date(2024, 1, 1), date(2024, 3, 31)), (date(2025, 7, 1), date(2025, 9, 30))],
        "1890-01-01, 12345-01-01": [],
        None: [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", date_spans(F.col("t")).alias("d"))
    assert {r.t: [(s.start, s.end) for s in r.d] for r in df.collect()} == cases
    df = spark.createDataFrame([("1,234.5 is -12% of $1.2M, 3.4e-5 and 7K but 8Kg",)], "t string").select(numbers(F.col("t")).alias("n"))
    assert df.first().n == [1234.5, -12.0, 1.2e6, 3.4e-5, 7000.0, 8.0]


def test_overlapping_spans_equal_all_pairs(spark):
    rng = random.Random(2)
    span = lambda: sorted(date.fromordinal(730000 + rng.randrange(400)) for _ in range(2))
    a, b = [(i, *span()) for i in range(60)] + [(99, None, date(2000, 1, 1))], [(i, *span()) for i in range(40)]
    got = joins.overlapping(spark.createDataFrame(a, "id int, start date, end date"), spark.createDataFrame(b, "id int, start date, end date"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.r_id) for r in got.collect()) == sorted((i, j) for i, s, e in a for j, t, u in b if s and s <= u and t <= e)


def test_names_are_found_from_word_to_word(spark):
    texts = spark.createDataFrame([(1, "From New York, not Newyork; 1-URGENT."), (2, "new york's x_1 and 1 urgent"), (3, None), (4, ""), (5, "New  York")], "id int, text string")
    names = spark.createDataFrame([("New York",), ("york",), ("1-URGENT",), ("x_1",), ("x",), ("#tag",), (None,)], "name string")
    assert sorted(map(tuple, joins.mentions(texts, names).collect())) == [(1, "1-URGENT"), (1, "New York"), (1, "york"), (2, "New York"), (2, "x_1"), (2, "york"), (5, "york")]
    assert joins.mentions(texts, names.limit(0)).collect() == []


def test_matches_and_mentions_shuffle_no_pairs(spark, monkeypatch):
    rng, day = random.Random(5), date(2024, 1, 1)
    spans = [(day + timedelta(i := rng.randrange(400)), day + timedelta(i + rng.choice((0, 0, 6, 30, 95, -3)))) for _ in range(90)]
    rows = [(i, [rng.choice(spans) for _ in range(rng.choice((0, 1, 1, 3)))]) for i in range(60)] + [(7, [spans[0]]), (8, None)]
    periods = [(f"p{i}", *spans[i]) for i in range(20)]
    notes = spark.createDataFrame(rows, "id int, dates array<struct<start: date, end: date>>")
    asked = spark.createDataFrame(periods, "name string, start date, end date")
    want = {}
    for i, dates in rows:
        for a, b in dates or []:
            for name, s, e in periods:
                n = (e - s).days + 1
                if n <= 0 or a > b or a > e + timedelta(n) or b < s - timedelta(2 * n):
                    continue
                score = 100 if a <= e and s <= b else 70 if a <= s - timedelta(1) and s - timedelta(n) <= b else 25
                want[name, i] = max(score, want.get((name, i), 0))
    got = lambda: sorted((r["name"], r["id"], r["score"]) for r in joins.dated_matches(asked, notes).collect())
    assert got() == sorted((*k, v) for k, v in want.items())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [r_period" not in plan(joins.dated_matches(asked, notes)) and "rightHint=(strategy=broadcast)" in plan(joins.dated_matches(asked, notes))
    texts, names = spark.createDataFrame([(1, "from New York today")], "id int, text string"), spark.createDataFrame([("New York",)], "name string")
    assert "strategy=broadcast" in plan(joins.mentions(texts, names))
    monkeypatch.setattr(joins, "FEW", 0)
    assert got() == sorted((*k, v) for k, v in want.items())
    assert [tuple(r) for r in joins.mentions(texts, names).collect()] == [(1, "New York")]


def test_numbers_without_evidence_equal_all_pairs(spark):
    rng = random.Random(9)
    number = lambda: rng.choice([0.0, 1.0, -1.0]) * 10 ** rng.uniform(-3, 6)
    held, claims = [number() for _ in range(25)] + [0.0, 38.7], [(i, number()) for i in range(3000)] + [(3000, 39.0), (3001, 1e-12), (3002, 0.387)]

    def allowed(v):
        return any((abs(f) < 1e-9 if a == 0 else abs(f - a) / abs(a) <= 0.02 or (abs(a) >= 1 and (f + 0.5) // 1 == (a + 0.5) // 1)) for a in held for f in (v, v / 100, v * 100))

    got = joins.without_evidence(spark.createDataFrame(claims, "id int, value double"), spark.createDataFrame([(v,) for v in held], "value double"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in got.collect()) == [i for i, v in claims if not allowed(v)]


def test_journal_faults_and_trees(spark):
    rows = spark.createDataFrame([(j, i, 0.1 + i, f"r{i}") for j in (1, 2) for i in range(20 + j)], "j int, i int, v double, t string")
    held = journal.build(rows, "j", ["i"], ["t", "v", "i"])
    held = spark.createDataFrame(held.collect(), held.schema)
    heads = held.groupBy("journal").agg(F.max_by("hash", "place").alias("hash"))
    assert journal.faults(held, heads).collect() == []
    assert held.where("journal = 1 AND place = 3").first().body == '{"i":3,"t":"r3","v":3.1}'
    hurt = held.where("NOT (journal = 1 AND place IN (5, 20))").withColumn("body", F.when(F.expr("journal = 2 AND place = 7"), "{}").otherwise(F.col("body")))
    assert sorted(map(tuple, journal.faults(hurt, heads).collect())) == [(1, 6, "chain"), (1, 20, "end"), (2, 7, "content")]
    assert journal.faults(held.unionByName(held.where("place = 4"))).select("fault").distinct().collect()[0].fault == "repeated"
    whole = journal.tree(held, 4)
    assert whole.where("level = 3").count() == 2
    moved = held.withColumn("hash", F.when(F.expr("journal = 2 AND place IN (0, 13)"), F.lit("x")).otherwise(F.col("hash"))).where("NOT (journal = 1 AND place = 20)")
    assert sorted(map(tuple, journal.differences(whole, journal.tree(moved, 4), 4).collect())) == [(1, 20), (2, 0), (2, 13)]
    assert journal.differences(whole, whole, 4).collect() == []


def test_streamed_cells_survive_replay_late_and_repeated_events(spark, tmp_path):
    rows = [(i, datetime(2024, 1 + i % 3, 1 + i % 28, 5), "ab"[i % 2] if i % 5 else None, float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, v double")
    want = sorted(map(str, cells.build_cells(df.withColumn("d", F.col("ts").cast("date")), "d", ["kind"], ["v"]).collect()))
    arrivals, kept, check = (str(tmp_path / n) for n in ("arrivals", "kept", "check"))
    ingest = lambda: cells_stream.ingest(spark, arrivals, df.schema, kept, check, "ts", ["kind"], ["v"], "event_id", "400 days").awaitTermination()
    assert cells_stream.day_cells(spark, kept).count() == 0
    for part in (df.where("event_id % 3 = 1"), df.where("event_id % 3 = 0"), df.where("event_id % 3 = 2 OR event_id < 30")):
        part.write.mode("append").parquet(arrivals)
        ingest()
    ingest()  # nothing new
    assert sorted(map(str, cells_stream.cells(spark, kept).collect())) == want
    # a replay of the last batch: its commit is lost, its folder is there
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink(missing_ok=True)
    ingest()
    assert sorted(map(str, cells_stream.cells(spark, kept).collect())) == want
    cells_stream.compact(spark, kept, str(tmp_path / "merged"))
    assert sorted(map(str, cells_stream.cells(spark, str(tmp_path / "merged")).collect())) == want


def test_roots_of_the_lattice():
    pairs = {frozenset(p): n for p, n in ((("a",), 3), (("b",), 5), (("c",), 1000), (("a", "b"), 15), (("a", "c"), 3000), (("b", "c"), 5000))}
    wanted = cells.wanted_sets(["a", "b", "c"], [("a", "b"), ("a", "c")], ("month", "quarter"))
    assert ("month", frozenset(("a", "c"))) in wanted and not any(g == "quarter" for g, _ in wanted)
    roots = cells.plan_roots(cells.Sizes(10**9, {"day": 1000, "month": 36}, pairs), wanted)
    assert {d for r in roots for d in r.serves} == {d for _, d in wanted} and len(roots) == 2  # one by day and one by month
    assert len(cells.plan_roots(cells.Sizes(100, {"day": 1000, "month": 36}, pairs), wanted)) >= 4  # nothing is smaller than the rows


def test_roots_of_many_tasks_stay_small():
    one = {"r": 5, "n": 25, "s": 5, "p": 5, "f": 3}
    members = {frozenset(d): one[d] for d in one} | {frozenset((a, b)): one[a] * one[b] for a in one for b in one if a < b} | {frozenset("nr"): 25}
    wanted = cells.wanted_sets(list(one), [(a, b) for a in one for b in one if a < b], ("month",))
    share = []
    for rows in (36 * 10**6, 216 * 10**6):
        sizes = cells.Sizes(rows, {"day": 2500, "month": 84}, members)
        roots = cells.plan_roots(sizes, wanted, sizes.tasks())
        assert {(r.grain, d) for r in roots for d in r.serves} == set(wanted)
        share.append(sum(r.shuffled(rows, sizes.tasks()) for r in roots) / rows)
    assert max(share) < 0.5 and share[1] < 1.05 * share[0]  # cells shuffled for each row do not grow with the rows


def test_cells_do_not_hang_on_the_plan(spark):
    rng = random.Random(1)
    rows = [(date(2024, 1 + rng.randrange(12), 1 + rng.randrange(28)), rng.choice(["x", "y", None]), rng.choice("pqr"), rng.choice(["m", None]), float(rng.randrange(50)) if rng.random() < 0.9 else None) for _ in range(400)]
    df = spark.createDataFrame(rows, "d date, a string, b string, c string, v double")
    pairs, grains = [("a", "b"), ("b", "c")], ("month", "year", "week")
    members = {frozenset(s): 3 for s in (("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"))}
    built = [sorted(map(str, cells.build_cells(df, "d", ["a", "b", "c"], ["v"], pairs, grains, sizes=cells.Sizes(n, {"day": 9, "month": 2, "week": 5}, members)).collect())) for n in (1, 10**9)]
    assert built[0] == built[1] and len(built[0]) > 100
    months = [r for r in cells.build_cells(df, "d", ["a", "b", "c"], ["v"], pairs, grains).where("grain = 'year' AND dim_b = 'b'").collect()]
    want = {}
    for d, a, b, _, v in rows:
        if a and v is not None:
            want[a, b] = want.get((a, b), 0) + v
    assert {(r.val_a, r.val_b): r.sum for r in months} == want


def test_sketches_merge_up_the_grains(spark):
    rows = spark.range(5000).select(F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 90).cast("int")).alias("d"), (F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 700).alias("u"), F.col("id").cast("double").alias("v"))
    year = sketches.estimates(sketches.merged(sketches.day_sketches(rows, "d", ["k"], "u", "v"), "year")).collect()
    assert len(year) == 4
    for r in year:
        users = 700 if r.dim is None else 700
        assert abs(r.members - users) <= sketches.DISTINCT_ERROR * users and abs(r.quantiles[1] - 2500) < 5000 * 2 * sketches.RANK_ERROR


def test_dates_of_notes_are_read_once(spark):
    from plumbline.plans import meeting

    plan = meeting.text_dates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4  # one for each shape: not once more for leaving out notes without a date
    odd = spark.createDataFrame([("on 31/12/2024, 13/12/2024 and 12/13/2024", 2), ("2024-02-30 and 0/5/2024 or 2024.13.01", 0), ("Feb 29th, 2023; Sept. 3rd, 2024; May 2024", 2), ("Q4 2200, 2025 Q1, 1990-05", 1), (None, 0)], "text string, n int")
    assert all(r["n"] == len(r["d"]) for r in odd.select("n", date_spans(F.col("text")).alias("d")).collect())


def test_faults_of_repeated_and_odd_places_need_no_collected_sets(spark, capsys):
    rows = [("a", 0, "{}", None), ("a", 1, "{}", "h0"), ("a", 1, "{1}", "h0"), ("a", 2, "{}", "h1b"), ("a", 3, "{}", None), ("b", 0, "{}", "x"), (None, 1, "{}", "h0"), ("b", None, "{}", "h0")]
    hashes = ["h0", "h1", "h1b", "h2", "h3", "g0", "n1", "n2"]
    df = spark.createDataFrame([(*r, h) for r, h in zip(rows, hashes, strict=True)], "journal string, place long, body string, previous string, hash string")
    found = journal.faults(df)
    got = sorted(((r.journal, r.place) for r in found.where("fault = 'chain'").collect()), key=str)
    assert got == sorted([("a", 3), ("b", 0), (None, 1), ("b", None)], key=str)
    found.explain()
    assert "collect_set" not in capsys.readouterr().out
