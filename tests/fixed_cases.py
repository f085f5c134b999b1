"""Fixed cases, which read no table: each is a function of the session and SQL that states the same."""

from pyspark.sql import functions as F

from plumbline.functions import special, stats
from plumbline.operators import profile
from plumbline.plans import intent, ledger, narration, notes
from plumbline.plans.evidence import _AGG_SQL, _INTENT_CASES, t_sql, text
from plumbline.sources import tables
from plumbline.sources.delimited import clean_headers

CASES: dict[str, tuple] = {}


def query(sql: str, on_sales: bool = True):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


@query(f"WITH g AS (SELECT df, x / 4.0 AS t FROM (SELECT unnest([1, 3, 5, 17, 58, 4.5, 211.25]) AS df), range(1, 16) r(x)) SELECT CAST(df AS DOUBLE) AS df, CAST(t AS DOUBLE) AS t, round({t_sql('t', 'df')}, 8) AS p, round(1 - ({t_sql('t', 'df')}) / 2, 8) AS cdf FROM g", on_sales=False)
def t_distribution(spark, sf_dir):
    """p and distribution of Student's t for odd and fractional degrees of freedom."""
    g = spark.range(1).select(F.explode(F.array(*[F.lit(float(k)) for k in (1, 3, 5, 17, 58, 4.5, 211.25)])).alias("df"), F.sequence(F.lit(1), F.lit(15)).alias("s")).select("df", F.explode("s").alias("x")).select("df", (F.col("x") / 4.0).alias("t"))
    return g.select("df", "t", F.round(special.t_two_sided(F.col("t"), F.col("df")), 8).alias("p"), F.round(special.t_cdf(F.col("t"), F.col("df")), 8).alias("cdf"))


@query("""WITH g AS (SELECT unnest([0.51, 0.6, 0.75, 0.9, 0.975, 0.995]) AS p), f AS (SELECT CAST(p AS DOUBLE) AS p, 4.0 * p * (1 - p) AS a FROM g)
SELECT 1 AS df, p, round(tan(pi() * (p - 0.5)), 6) AS t FROM f UNION ALL SELECT 2, p, round((2 * p - 1) * sqrt(2 / a), 6) FROM f UNION ALL SELECT 4, p, round(2 * sqrt(cos(acos(sqrt(a)) / 3) / sqrt(a) - 1), 6) FROM f""", on_sales=False)
def t_quantiles(spark, sf_dir):
    """Quantiles of Student's t where a closed form exists."""
    g = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in (1, 2, 4)])).alias("df"), F.array(*[F.lit(p) for p in (0.51, 0.6, 0.75, 0.9, 0.975, 0.995)]).alias("ps")).select("df", F.explode("ps").alias("p"))
    return g.select("df", "p", F.round(special.t_quantile(F.col("p"), F.col("df")), 6).alias("t"))




@query("""WITH z AS (SELECT x / 4.0 AS z FROM range(-12, 13) r(x)), d AS (SELECT CAST(z AS DOUBLE) AS z, 0.5 + z / 6000.0 * list_sum(list_transform(range(2001), lambda k: CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z * k / 2000.0) ** 2) / sqrt(2 * pi()))) AS c FROM z)
SELECT z, round(c, 5) AS cdf, round(2 * least(c, 1 - c), 5) AS p FROM d""", on_sales=False)
def normal_distribution(spark, sf_dir):
    """Distribution and two-sided p of the normal, against Simpson's rule."""
    z = spark.range(-12, 13).select((F.col("id") / 4.0).alias("z"))
    return z.select("z", F.round(special.normal_cdf(F.col("z")), 5).alias("cdf"), F.round(special.normal_two_sided(F.col("z")), 5).alias("p"))




_NAMES = [("margin_pct", 0.0, 0.5, False), ("conversion rate", 0.0, 400.0, True), ("conversion rate", 0.0, 99.5, False), ("lead_time", 1.0, 90.0, True), ("units", 0.0, 900.0, True), ("revenue", 0.0, 1e6, False), ("weight", 0.0, 1.0, False), ("flag", 0.0, 1.0, True), ("growth%", -250.0, 300.0, False), ("days open", 0.0, 30.0, True)]


@query(f"SELECT name, low, high, whole, {_AGG_SQL} AS agg FROM (VALUES {', '.join(f'({text(n)}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {w})' for n, a, b, w in _NAMES)}) v(name, low, high, whole)", on_sales=False)
def aggregation_rules(spark, sf_dir):
    """Sum or average, by name and range."""
    return spark.createDataFrame([(*r, profile.classify_aggregation(*r)[0]) for r in _NAMES], "name string, low double, high double, whole boolean, agg string")




_HEADERS = ["id", "name", "", "id", " name ", None, "id"]


@query(f"WITH h AS (SELECT i, coalesce(nullif(trim(raw), ''), 'column_' || i) AS base FROM (VALUES {', '.join(f'({i + 1}, ' + ('NULL' if h is None else text(h)) + ')' for i, h in enumerate(_HEADERS))}) v(i, raw)), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM h) SELECT CAST(i AS INTEGER) AS i, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM k", on_sales=False)
def header_names(spark, sf_dir):
    """Blank and repeated header names made different."""
    return spark.createDataFrame(list(enumerate(clean_headers(_HEADERS), 1)), "i int, name string")





_QUESTIONS = ["Scan for anything unusual", "Why did price drop in ASIA?", "top 7 nations by quantity", "forecast the next 5 quarters", "what moves together with discount?", "explain the change by region yearly", "weekly trend of price", "deep dive into every member", "bottom 3 regions per day", "total price overall", "price by r name"]
@query(f"""WITH q AS (SELECT question, ' ' || lower(question) || ' ' AS q FROM (VALUES {", ".join(f"({text(q)})" for q in _QUESTIONS)}) v(question))
SELECT question, {_INTENT_CASES["analysis"]} AS analysis, {_INTENT_CASES["grain"]} AS grain, least(20, coalesce(try_cast(nullif(regexp_extract(q, '\\btop\\s+(\\d{{1,2}})\\b', 1), '') AS INTEGER), 5)) AS k, least(12, coalesce(try_cast(nullif(regexp_extract(q, '\\bnext\\s+(\\d{{1,2}})\\b', 1), '') AS INTEGER), 3)) AS horizon,
regexp_matches(q, '\\b(bottom|worst|lowest)\\b') AS ascending, CASE WHEN q LIKE '%discount%' THEN 'discount' WHEN q LIKE '%price%' THEN 'price' WHEN q LIKE '%quantity%' THEN 'quantity' ELSE 'discount' END AS measure, CASE WHEN q LIKE '%asia%' THEN 'ASIA' END AS member FROM q""", on_sales=False)
def intents(spark, sf_dir):
    """Questions read as analysis, grain, number, horizon, direction, measure and member."""
    p = profile.Profile(0, "day", dims=[(d, 5) for d in sorted(tables.SALES_DIMS)], measures=[profile.Measure(m, a, "", 0, 0, 0, 0, 0, 0, 0, False, 0) for m, a in sorted(tables.SALES_MEASURES.items())], members={"r_name": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]})
    rows = [(q, *(i[c] for c in ("analysis", "grain", "k", "horizon", "ascending", "measure", "member"))) for q in _QUESTIONS for i in [intent.parse_intent(q, p)]]
    return spark.createDataFrame(rows, "question string, analysis string, grain string, k int, horizon int, ascending boolean, measure string, member string")


_NOTES = "# Incidents\n- 2001-10-05: warehouse fire in ASIA\n- September 2001 strike at the ports\n- 2001-12-03 new tariff\n- 1999-01-01 an old matter\n- ASIA is the largest region\n\nPrices of Q4 2001 were revised in EUROPE and ASIA.\n"
_SPANS = [(0, "2001-10-05", "2001-10-05", 1), (1, "2001-09-01", "2001-09-30", 0), (2, "2001-12-03", "2001-12-03", 0), (3, "1999-01-01", "1999-01-01", 0), (4, None, None, 1), (5, "2001-10-01", "2001-12-31", 1)]


@query(f"""WITH n AS (SELECT id, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b, subjects FROM (VALUES {", ".join(f"({i}, {text(a) if a else 'NULL'}, {text(b) if b else 'NULL'}, {s})" for i, a, b, s in _SPANS)}) v(id, a, b, subjects)), p AS (SELECT DATE '2001-10-01' AS s, DATE '2001-10-31' AS e),
m AS (SELECT id, subjects, CASE WHEN a IS NULL THEN 0 WHEN a <= e AND s <= b THEN 100 WHEN a <= s - 1 AND s - 31 <= b THEN 70 WHEN a <= e + 31 AND s - 62 <= b THEN 25 END AS aligned FROM n, p) SELECT id, aligned + subjects * 40 AS score FROM m WHERE aligned IS NOT NULL AND aligned + subjects * 40 >= 20 ORDER BY score DESC, id LIMIT 4""", on_sales=False)
def note_scores(spark, sf_dir):
    """Notes matched to a month by the spans of their dates and by subject."""
    return notes.retrieve(notes.index_notes(spark, _NOTES, ["ASIA", "EUROPE"]), "2001-10", "month", ["ASIA"]).select("id", "score")


_ASKED = [{"question": "why", "period": "2001-10"}, {"question": "scan", "limit": 0.1}, {"question": "forecast", "horizon": 3}]
_STEPS = ["{\"period\":\"2001-10\",\"question\":\"why\"}", "{\"limit\":0.1,\"question\":\"scan\"}", "{\"horizon\":3,\"question\":\"forecast\"}"]


def _record_sql(i: int, previous: str) -> str:
    """SQL of the hash of record i, `previous` being SQL of the JSON of the hash before."""
    parts = [text('{"asked":'), f"a{i}", text(',"identity":"'), f"sha256(a{i})", text('","previous":'), previous, text(f',"result":{{"n":{i}}},"time":"t"}}')]
    return f"sha256({' || '.join(parts)}) AS h{i}"


_CHAIN_SQL = "WITH a AS (SELECT " + ", ".join(f"{text(s)} AS a{i}" for i, s in enumerate(_STEPS)) + f"), h0 AS (SELECT *, {_record_sql(0, text('null'))} FROM a)"
for _i in (1, 2):
    _quote = text('"')
    _CHAIN_SQL += f", h{_i} AS (SELECT *, {_record_sql(_i, f'{_quote} || h{_i - 1} || {_quote}')} FROM h{_i - 1})"


@query(_CHAIN_SQL + " UNION ALL ".join(f" SELECT CAST({i} AS INTEGER) AS place, sha256(a{i}) AS identity, h{i} AS hash, 0 AS faults FROM h2" for i in range(3)), on_sales=False)
def ledger_chain(spark, sf_dir):
    """Hash-chained records: canonical JSON, identity, chain, faults."""
    journal: list[dict] = []
    for i, asked in enumerate(_ASKED):
        journal = ledger.append(journal, asked, {"n": i}, clock=lambda: "t")
    faults = ledger.verify_journal(journal, journal[-1]["hash"])
    return spark.createDataFrame([(i, r["identity"], r["hash"], sum(f[0] == i for f in faults)) for i, r in enumerate(journal)], "place int, identity string, hash string, faults int")


_CLAIMS = [("West fell 12.4 to 1204300", [1204300.0, 12.4]), ("West fell 12 to 1,200,000", [1204300.0, 12.4]), ("West lost 47000", [1204300.0, 12.4]), ("a third, 0.33, of 900", [33.0, 905.0]), ("seven of 8 and 13", [100.0])]


@query(f"""WITH c AS (SELECT claim, allowed FROM (VALUES {", ".join(f"({text(t)}, {[float(i) for i in range(13)] + a})" for t, a in _CLAIMS)}) v(claim, allowed)), n AS (SELECT claim, allowed, CAST(replace(unnest(regexp_extract_all(claim, '[0-9][0-9,]*\\.?[0-9]*')), ',', '') AS DOUBLE) AS v FROM c)
SELECT claim, count(*) AS numbers, count(*) FILTER (WHERE len(list_filter(allowed, lambda a: abs(v - a) <= 0.02 * a OR abs(v - a / 100) <= 0.02 * a / 100 OR abs(v - a * 100) <= 0.02 * a * 100 OR v = round(a) OR v = round(a / 100) OR v = round(a * 100))) = 0) AS without_evidence FROM n GROUP BY 1""", on_sales=False)
def narration_guard(spark, sf_dir):
    """Numbers of a text, and those that the evidence lacks."""
    rows = [(t, len(narration.extract_numbers(t)), len(narration.verify(t, narration.allowed_numbers(a)))) for t, a in _CLAIMS]
    return spark.createDataFrame(rows, "claim string, numbers long, without_evidence long")


_P = [0.5, 0.0314, 0.00052, 2e-9]


@query(f"SELECT p, CASE WHEN p < 1e-6 THEN 'p < 1e-6' WHEN p < 1e-3 THEN 'p = ' || printf('%.1e', p) ELSE 'p = ' || printf('%.3f', p) END AS shown FROM (SELECT CAST(unnest({_P}) AS DOUBLE) AS p)", on_sales=False)
def p_formats(spark, sf_dir):
    """p-values as they are shown."""
    return spark.createDataFrame([(p, stats.format_p(p)) for p in _P], "p double, shown string")




@query("WITH d AS (SELECT k AS df FROM (SELECT unnest([2, 4, 6, 10, 30]) AS k)), g AS (SELECT df, x / 4.0 AS t FROM d, range(1, 13) r(x)), s AS (SELECT df, t, cos(atan(t / sqrt(df))) AS c, sin(atan(t / sqrt(df))) AS n FROM g), f AS (SELECT df, t, c, n, unnest(range(0, df // 2)) AS j FROM s) SELECT df, t, round(1 - any_value(n) * sum(exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4.0)) * c ** (2 * j)), 9) AS p FROM f GROUP BY df, t", on_sales=False)
def t_pvalue(spark, sf_dir):
    """Two-sided p of Student's t over a grid of even degrees of freedom, where a closed form exists."""
    g = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in (2, 4, 6, 10, 30)])).alias("df"), F.sequence(F.lit(1), F.lit(12)).alias("s")).select("df", F.explode("s").alias("x")).select("df", (F.col("x") / 4.0).alias("t"))
    return g.select("df", "t", F.round(special.t_two_sided(F.col("t"), F.col("df")), 9).alias("p"))
