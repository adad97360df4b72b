import time

import pytest

from darwise.operators import routing, sqlgate


@pytest.mark.parametrize(
    "text, route, project, lang",
    [
        ("كم عدد الفلل المتاحة في واحة النرجس؟", "inventory", "NRJ", "ar"),
        ("ما هي سياسة الإلغاء؟", "docs", None, "ar"),
        ("How many apartments are available and what is the payment plan?", "both", None, "en"),
        ("prices in Coast Towers", "docs", "CST", "en"),
        ("a REVIEW of the coffee", "both", None, "en"),  # words are found inside words
    ],
)
def test_triage(spark, text, route, project, lang):
    r = routing.triage(spark.createDataFrame([(1, text)], "question_id long, text string")).first()
    assert (r["route"], r["project_id"], r["lang"]) == (route, project, lang)
    assert r["needs_documents"] == (route != "inventory") and r["needs_inventory"] == (route != "docs")


def test_recent_turns(spark):
    df = spark.createDataFrame([(c, t, "user", "x") for c in (1, 2) for t in range(c * 5)], "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"]) for r in routing.recent_turns(df).collect())
    assert got == [(1, t) for t in range(5)] + [(2, t) for t in range(4, 10)]


@pytest.mark.parametrize(
    "sql, reason",
    [
        ("DROP TABLE units", "only SELECT statements are allowed"),
        ("SELECT 1; DELETE FROM units", "multiple statements are not allowed"),
        ("PRAGMA table_info(units)", "only SELECT statements are allowed"),
        ("UPDATE units SET status='x'", "only SELECT statements are allowed"),
        ("ATTACH DATABASE 'x' AS y", "only SELECT statements are allowed"),
        ("with x as (select 1) insert into t select * from x", "statement contains a forbidden keyword"),
        ("select 'drop' from units", "statement contains a forbidden keyword"),
        ("select reflect('java.lang.System', 'exit', 1)", "statement contains a forbidden keyword"),
    ],
)
def test_gate_refuses(spark, sql, reason):
    with pytest.raises(sqlgate.UnsafeSQL, match=reason):
        sqlgate.checked_sql(spark, sql)


def test_gate_limits(spark):
    assert sqlgate.checked_sql(spark, " select * from units ; ").endswith("units LIMIT 50")
    assert sqlgate.checked_sql(spark, "select * from units limit 5000").endswith("units LIMIT 50")
    assert sqlgate.checked_sql(spark, "select * from units limit 7").endswith("units LIMIT 7")


@pytest.fixture(scope="module")
def big(spark):
    spark.range(1000).createOrReplaceTempView("big_units")


@pytest.mark.parametrize("sql", ["select * from big_units", "select * from (select * from big_units limit 900) t", "select id from big_units limit 60"])
def test_never_more_rows(spark, big, sql):
    assert sqlgate.guarded_sql(spark, sql).count() == 50


@pytest.mark.parametrize("sql", ["select * from big_units limit -1", "select * from big_units limit 5,1000"])
def test_odd_limits_fail_closed(spark, big, sql):
    r = sqlgate.first_runnable(spark, [sql])
    assert r.error and r.rows == []


def test_files_are_no_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    r = sqlgate.first_runnable(spark, [f"select * from parquet.`{path}`"])
    assert r.error and r.rows == []
    assert spark.sql(f"select * from parquet.`{path}`").count() == 3  # the session is as before


def test_second_attempt(spark, big):
    r = sqlgate.first_runnable(spark, ["select nope from big_units", "select count(*) as n from big_units"])
    assert r.attempts == 2 and r.error is None and r.rows == [(1000,)] and r.columns == ["n"]
    r = sqlgate.first_runnable(spark, [("select id from big_units;", "all of them")])
    assert r.sql == "select id from big_units LIMIT 50" and r.explanation == "all of them" and len(r.rows) == 50


def test_slow_statement_is_stopped(spark):
    spark.range(30000).createOrReplaceTempView("slow_units")
    slow = "select count(*) from slow_units a join slow_units b on sha2(cast(a.id * b.id as string), 512) = 'x'"
    start = time.time()
    r = sqlgate.first_runnable(spark, [slow], timeout_s=1)
    assert r.error and time.time() - start < 20
