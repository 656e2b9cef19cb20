"""What a task holds doesn't grow with the table."""

from dockmill.operators import profiles
from dockmill.sources import cases

TABLES = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    lines = cases.table(spark, TABLES, "lineitem").count()
    want = sorted(map(tuple, cases.analogue_judges(spark, TABLES).collect()))
    monkeypatch.setattr(cases, "LINES_OF_A_TASK", 500)
    got = cases.analogue_judges(spark, TABLES)
    most = max(got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
    assert sorted(map(tuple, got.collect())) == want and most < 2000 < lines


def test_recent_cases_are_ranked_by_one_window(spark):
    """The first of each task are taken before the shuffle, by judge and not by share of a judge."""
    rows = cases.analogue_cases(spark, TABLES).join(cases.analogue_judges(spark, TABLES), "case_id")
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(profiles.recent_cases(rows)._jdf.queryExecution(), "simple")
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Window [") == 1 and "row_number(), 10, Partial" in final and "row_number(), 10, Final" in final
