from plumbline.operators.cells import build_cells
from plumbline.operators.profile import profile
from plumbline.plans import analyses, intent, ledger, narration
from plumbline.sources.delimited import clean_headers, read_delimited, sniff_delimiter


def test_delimited(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes(b'id,name,date,amt\r\n1,"Smith, John",2024-01-01,5\r\n2,"He said ""hi""",2024-01-02,6\r\n\r\n3,short\r\n')
    rows = read_delimited(spark, str(f)).orderBy("id").collect()
    assert [r["name"] for r in rows] == ["Smith, John", 'He said "hi"', "short"] and rows[2]["amt"] is None
    assert sniff_delimiter('a;"x,y,z";c') == ";"
    assert len(set(clean_headers(["a", "a", "", "b", "a_2"]))) == 5


def test_simpson_reversal(spark):
    rows = [(f"2024-{m:02d}-{1 + i % 28:02d}", s, r) for m in (1, 2, 3, 4) for s, k, r in ([("Enterprise", 70, 0.40), ("SMB", 30, 0.10)] if m < 4 else [("Enterprise", 15, 0.44), ("SMB", 85, 0.14)]) for i in range(k)]
    df = spark.createDataFrame([(f"o{i}", *r) for i, r in enumerate(rows)], "order_id string, order_date string, segment string, margin_rate double")
    p = profile(df, {"margin_rate": "measure"})
    assert (p.time, p.dim_names(), p.agg_of("margin_rate")) == ("order_date", ["segment"], "avg")
    cells = build_cells(df, p.time, p.dim_names(), p.measure_names()).persist()
    card = analyses.run(cells, p, intent.parse_intent("explain the change in margin rate by segment", p))
    t = card["total"]
    assert t["paradox"] and t["change"] < 0 < t["rate"] and abs(t["mix"]) > abs(t["rate"])
    assert abs(t["rate"] + t["mix"] + t["interaction"] - t["change"]) < 1e-9
    assert "too few" in analyses.run(cells, p, intent.parse_intent("forecast margin_rate", p))["summary"]
    assert intent.parse_intent("why did it drop in SMB", p)["member"] == "SMB"


def test_journal():
    j = ledger.append([], {"q": 1}, {"summary": "a"}, clock=lambda: "t")
    j = ledger.append(j, {"q": 2}, {"summary": "b"}, clock=lambda: "t")
    assert not ledger.verify_journal(j, j[-1]["hash"])
    assert ledger.verify_journal([{**j[0], "result": {}}, j[1]]) and ledger.verify_journal(j[1:]) and ledger.verify_journal(j[:1], j[1]["hash"])


def test_narration_guard():
    card = {"summary": "West fell 12.4% to 1,204,300.", "kpi": 1204300}
    assert narration.narrate(card, writer=lambda x: "West fell 12% to $1.2M")["source"] == "writer"
    assert narration.narrate(card, writer=lambda x: "West lost 47,000")["source"] == "template"
    assert narration.narrate(card, writer=lambda x: 1 / 0)["text"] == card["summary"]


def test_notes(spark):

    from plumbline.plans import notes

    assert notes.chunk("# A\n- x\n\ntext")[1]["heading"] == "A"
    text = "# Incidents\n- 2024-03-05: warehouse fire in West\n- February 2024 strike\n- 2019-01-01 old\n- West is large\n"
    hits = notes.retrieve(notes.index_notes(spark, text, ["West"]), "2024-03", "month", ["West"]).collect()
    assert [h["id"] for h in hits] == [0, 1, 3]


def test_brief(spark):
    from plumbline.plans import brief

    df = spark.createDataFrame([(f"2024-{1 + i % 9:02d}-01", "ab"[i % 2], float(i)) for i in range(90)], "day string, side string, revenue double")
    p = profile(df)
    b = brief.build_brief(p, build_cells(df, p.time, p.dim_names(), p.measure_names()))
    assert any("too few" in g["text"] for g in b["gotchas"]) and "revenue" in brief.to_markdown(b)


def test_conditions_that_the_tables_do_not_show(spark):
    from plumbline.plans import brief

    df = spark.createDataFrame([(f"2024-{1 + i % 9:02d}-01", "ab"[i % 10 == 0], float(i) if i % 3 else None) for i in range(90)], "day string, side string, revenue double")
    p = profile(df)
    cells = build_cells(df, p.time, p.dim_names(), p.measure_names())
    found = {(r["severity"], r["id"], r["subject"], r["n"]) for r in brief.conditions(p, cells, unparsed=4, truncated_at=90, pairs_skipped=2, min_rows=3, period="2024-01").collect()}
    assert found >= {("high", "unparsed-dates", "day", 4), ("high", "truncated", None, 90), ("medium", "skipped-pairs", None, 2), ("medium", "nulls", "revenue", 30), ("medium", "short-history", "month", 6), ("medium", "small-dimension", "side", 2)}
    said = brief.gotchas(p, cells, unparsed=4, truncated_at=90)
    assert [g["severity"] for g in said] == sorted((g["severity"] for g in said), key=brief.SEVERITY.get) and "4 rows" in said[1]["text"]
    empty = cells.where("false")
    assert all(r["id"] != "thin" for r in brief.conditions(p, empty).collect())


def test_payload_and_suggestions(spark):
    from plumbline.plans import brief, intent

    df = spark.createDataFrame([(f"2024-{1 + i % 9:02d}-01", "ab"[i % 2], float(i), float(i % 17)) for i in range(90)], "day string, side string, revenue double, units double")
    p = profile(df)
    b = brief.build_brief(p, build_cells(df, p.time, p.dim_names(), p.measure_names()))
    got = narration.payload({"measure": "revenue", "summary": "revenue 5", "evidence": {"p": 0.01, "test": "t"}}, b, [{"id": 1, "text": "note"}])
    assert any(x["kind"] == "measure" and x["subjects"] == ["revenue"] for x in brief.passages(b)) and got["finding"]["evidence"]["p"] == 0.01
    assert {x["kind"] for x in got["passages"]} <= {"gotcha", "measure"} and 5.0 in got["allowed_numbers"] and len(got["notes"]) == 1
    for s in intent.suggestions(p):
        assert intent.parse_intent(s["text"], p)["analysis"] == s["analysis"], s


def test_evidence_tiers():
    tier = analyses.evidence_tier
    assert [tier(e) for e in (None, {"p": None}, {"p": 0.01, "q": 0.02}, {"p": 0.01, "q": 0.02, "low_power": True}, {"p": 0.2, "q": 0.5})] == ["lookup", "descriptive", "tested", "limited power", "not significant"]


def test_load(spark, tmp_path):
    import pytest

    from plumbline.plans import dataset

    def write(name, lines):
        (tmp_path / name).write_text("\n".join(lines))
        return str(tmp_path / name)

    rows = [f"2024-{1 + i % 12:02d}-{1 + i % 28:02d},{'NSEW'[i % 4]},{'xyz'[i % 3]},{100 + i * 7 % 53}.5" for i in range(600)]
    good = dataset.load(spark, write("a.csv", ["day,side,kind,revenue", *rows, "never,N,x,1.0"]))
    assert good.profile.time == "day" and good.profile.dim_names() == ["kind", "side"] and any("1 row(s)" in w for w in good.warnings)
    assert good.cells.where("dim_a IS NULL AND grain = 'year'").first()["n"] == 600
    cards = analyses.feed_cards(good.cells, good.profile, "month", "2024-06")
    assert cards["audit"]["tests"] >= 0 and all(c["chart"]["rows"] for c in cards["cards"])
    assert "only the first 50" in dataset.load(spark, write("a.csv", ["day,side,kind,revenue", *rows]), row_limit=50).warnings[0]
    for name, lines, message in (("b.csv", ["a,b"], "no rows"), ("c.csv", ["a,b", "x,1", "y,2"], "No date"), ("d.csv", ["day,b", "2024-01-01,x", "2024-01-02,y"], "No measure"), ("e.pdf", ["a"], "no delimited text")):
        with pytest.raises(ValueError, match=message):
            dataset.load(spark, write(name, lines))


def test_planted_and_flat_data(spark):
    """A planted effect is found; of twenty measures of pure noise, each searched on its own, few show a finding."""
    import numpy as np

    from plumbline.functions.stats import benjamini_hochberg
    from plumbline.operators import discover
    from plumbline.sources.store import keep

    rng = np.random.default_rng(42)
    rows = []
    for i in range(7000):
        month, region, segment = 1 + i % 20, "ABCDEFGH"[rng.integers(8)], "xyz"[rng.integers(3)]
        planted = 130.0 if region == "C" and month == 20 else 100.0
        rows.append((f"{2022 + (month - 1) // 12}-{(month - 1) % 12 + 1:02d}-{1 + i % 28:02d}", region, segment, float(planted + rng.normal(0, 20)), *[float(x) for x in rng.gamma(4, 25, 20)]))
    names = [f"m{k}" for k in range(20)]
    df = spark.createDataFrame(rows, "day string, region string, segment string, planted double, " + ", ".join(f"{n} double" for n in names))
    cells = keep(build_cells(df, "day", ["region", "segment"], ["planted", *names], [("region", "segment")]), by="grain")
    found = discover.candidates(cells, {"planted": "avg"} | dict.fromkeys(names, "avg"), "month", "2023-08").select("kind", "measure", "dim", "value", "p", "q").collect()
    assert any(r.measure == "planted" and r.value == "C" and r.q is not None and r.q <= 0.1 for r in found)
    flat = sum(min(benjamini_hochberg([r.p for r in found if r.measure == n and r.p is not None]), default=1) <= 0.1 for n in names)
    assert flat <= 6


def test_scan_keeps_to_survivors_and_to_the_measure_asked_for(spark):
    from plumbline.operators import discover
    from plumbline.sources.store import keep

    rows = [(f"{2022 + m // 12}-{m % 12 + 1:02d}-{1 + i % 28:02d}", f"R{i % 8}", (900.0 if m == 19 and i % 8 == 3 else 100.0) + i * 7 % 13, float(50 + i * 11 % 17) + (400 if m == 19 and i % 8 == 5 else 0)) for m in range(20) for i in range(400)]
    df = spark.createDataFrame(rows, "day string, region string, price double, units double")
    p = profile(df, {"price": "measure", "units": "measure"})
    cells = keep(build_cells(df, p.time, p.dim_names(), p.measure_names()), by="grain")
    asked, open_ = (intent.parse_intent(q, p) for q in ("scan price", "does anything stand out? scan"))
    assert asked["explicit"] and not open_["explicit"] and open_["measure"] and intent.parse_intent("scan the revenue", p)["explicit"]
    cards = [analyses.run(cells, p, {**i, "period": "2023-08"}) for i in (asked, open_)]
    assert cards[0]["findings"] and {r["measure"] for r in cards[0]["findings"]} == {"price"}
    assert cards[0]["findings"][0]["value"] == "R3"
    limit = discover.Settings().q_limit
    assert all(r["q"] is not None and r["q"] <= limit for c in cards for r in c["findings"])
    strengths = [r["strength"] for r in cards[1]["findings"]]
    assert strengths == sorted(strengths, reverse=True)


def test_backtest_equals_a_fit_for_every_fold():
    import numpy as np

    from plumbline.operators import forecast

    x = np.cumsum(np.random.default_rng(5).normal(3, 20, 40)) + 500
    got = forecast.backtest(x, 12)
    folds = [(abs(forecast.forecast(forecast.fit(x[:i]), 1)[0]["value"] - x[i]), abs(x[i - 1] - x[i])) for i in range(12, 40)]
    mae, naive = (float(np.mean([f[k] for f in folds])) for k in (0, 1))
    assert got["folds"] == 28 and abs(got["mae"] - mae) < 1e-9 and abs(got["naive_ratio"] - mae / naive) < 1e-12


def test_statistics_take_few_passes_whatever_the_columns(spark):
    from plumbline.operators.profile import column_statistics

    n, read = 400, spark.sparkContext.accumulator(0)
    columns = [f"'{'ab'}' || (id % {k + 2}) AS c{k}" for k in range(9)] + ["'k' || id AS k1", "id AS k2", "id / 7D AS k3", "CAST(id % 5 AS float) / 10 AS f", "date_format(date_add(DATE'2024-01-01', CAST(id AS int)), 'd/M/yyyy') AS said", "CASE WHEN id % 2 = 0 THEN 'x' ELSE '1-2' END AS part", "CAST(NULL AS double) AS empty"]

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    base = spark.range(n).selectExpr(*columns)
    found = {s["name"]: s for s in column_statistics(base.mapInArrow(count, base.schema))}
    assert read.value <= 4 * n
    assert [found[f"c{k}"]["unique"] for k in range(9)] == [k + 2 for k in range(9)] and found["c1"]["values"] == ["ab0", "ab1", "ab2"]
    assert [found[k]["unique"] for k in ("k1", "k2", "k3", "f")] == [n, n, n, 5] and found["f"]["high"] == 0.4
    assert (found["said"]["dates"], found["said"]["first"].isoformat(), found["part"]["dates"], found["empty"]["non_null"], found["k2"]["numbers"]) == (n, "2024-01-01", 0, 0, n)


def test_questions_are_dealt_and_each_different_one_is_read_once(spark, tmp_path):
    p = profile(spark.createDataFrame([(f"2024-{1 + i % 9:02d}-01", "ab"[i % 2], float(i)) for i in range(90)], "day string, side string, revenue double"))
    asked = ["why did revenue drop", None, "top 7 by side", ""]
    got = intent.read_questions(spark.createDataFrame([(i, asked[i % 4]) for i in range(3000)], "id long, question string").coalesce(1), p)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = got.collect()
    want = [intent.parse_intent(q or "", p) for q in asked]
    assert len(rows) == 3000 and all(r[k] == want[r.id % 4][k] for r in rows for k in r.asDict() if k != "id")
