"""Driver contract: entry, queries and oracle keys."""

import __spark_entry__ as entry

CHEAP = ["sql_count", "sql_month", "month_table", "season_table", "kpis", "corr_matrix",
         "month_dense", "confusion"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 12 and df.columns == ["MO", "mean", "std", "min", "max"]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_cheap_queries_run_on_smoke_data(spark):
    q = entry.queries()
    for name in CHEAP:
        assert q[name](spark, "/root/testdata/sf0.001").count() >= 1, name


def test_dashboard_analysis_runs_end_to_end(spark):
    from lumen.plans.dashboard import analyse
    from lumen.schema import ROW_KEY
    from lumen.sources.fixtures import obs
    res = analyse(spark, obs(spark, "/root/testdata/sf0.001"), key_cols=ROW_KEY)
    sizes = {k: v.count() for k, v in res.items()}
    assert sizes["month_table"] == 12 and sizes["kpis"] == 1 and sizes["histogram"] == 120
    assert sizes["shapiro"] == 4 and sizes["report_by_month"] == 12
