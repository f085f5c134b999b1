import fixed_cases
import oracle
import pytest

from plumbline.plans import evidence as catalogue
from plumbline.plans import meeting

SF = "/root/testdata/sf0.001"
QUICK = ["breakdown", "topk", "cross_cell", "contribution", "mix_rate_summary", "cells_week", "bh_qvalues", "date_shapes", "profile_counts", "discover_candidates", "discovery_subjects", "discovery_feed", "feed_cards", "data_conditions", "profile_percentiles", "scan_findings", "deepdive_members", "drill_dimensions", "drill_inside", "correlations", "holt_forecast", "intents", "t_distribution", "column_roles", "delimited_text", "dropped_rows", "fingerprints"]
MEETING = ["text_dates", "period_notes", "subject_mentions", "document_numbers", "narration_numbers", "journal_chain", "journal_faults", "journal_tree", "streamed_cells", "sketch_errors", "cube_sets"]


@pytest.fixture(scope="module")
def con():
    return oracle.tables(SF)


@pytest.mark.parametrize("name", QUICK + MEETING)
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differ(meeting.QUERIES[name](spark, SF), con, meeting.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", list(fixed_cases.CASES))
def test_fixed_case_equals_its_sql(spark, con, name):
    run, sql = fixed_cases.CASES[name]
    assert oracle.differ(run(spark, SF), con, sql) is None


def test_every_query_reads_a_table(spark):
    from_tables = {n for n in meeting.QUERIES if n in meeting.ORACLE_SQL and "FROM" in meeting.ORACLE_SQL[n].upper()}
    assert from_tables == set(meeting.ORACLE_SQL) and set(meeting.QUERIES) - set(meeting.ORACLE_SQL) == {"cube_parents"}


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(meeting.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).where("p IS NOT NULL").count() > 20


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=Path(__file__).parent.parent, check=True, timeout=120)


def test_conditions_are_read_from_rows_that_are_joined_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    def see(rows, roles):
        raise Seen(rows.inputFiles())

    monkeypatch.setattr(catalogue.profile, "profile", see)
    with pytest.raises(Seen) as e:
        catalogue.data_conditions(spark, SF)
    assert e.value.args[0] and all("plumbline-kept-" in f for f in e.value.args[0])


def test_numbers_of_documents_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(meeting.tables, "sales_cells", lambda *_: pytest.fail("cells of all dimensions and pairs"))
    plan = meeting.document_numbers(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id#") == 1 and plan.count("regexp_extract_all(") == 1


def test_numbers_of_repeated_ids_are_all_counted(spark):
    texts = spark.createDataFrame([(1, [100.0, 7.0, 7.0]), (1, [100.0, 7.0, 7.0]), (2, []), (3, [102.0])], "id int, numbers array<double>")
    got = meeting._checked(texts, spark.createDataFrame([(100.0,)], "value double"))
    assert sorted(map(tuple, got.collect())) == [(1, 6, 4), (3, 1, 0)]
