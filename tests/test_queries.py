"""Every registered query against its check SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        cur = db.execute(entry.oracle_sql()[name])
        assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got[1]


def test_every_check_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["n01_tokens_to_notes", "q08_fix_time_signature", "q_repair_chain",
                                  "q16_split_voice_pairs", "d01_explode_samples"])
def test_one_exchange_per_pipeline(spark, name):
    """The whole pipeline lives on the label table's partitioning by score."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_hot_songs_are_limited_before_the_exchange(spark):
    plan = entry.queries()["k01_leaderboard_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("name", ["t01_explode_tokens", "k06_shared_result", "s10_list_scores"])
def test_scans_read_only_what_they_need(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "user_id:bigint" not in plan
    if name != "t01_explode_tokens":
        assert "PushedFilters: [" in plan


@pytest.mark.parametrize("name", ["r03_grade_performance", "r04_wait_mode_grade", "r05_quiz_grade",
                                  "p05_performance_scores", "j08_expected_step_presses"])
def test_graders_run_in_the_jvm(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_split_labels_rows_where_they_are(spark):
    plan = entry.queries()["d03_split_dataset"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan
