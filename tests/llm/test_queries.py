"""The registered queries run over whole tables and have the columns the driver compares."""

import os

import pytest

from jobweft.llm.queries import QUERIES, SQL

DATA = os.environ.get("JOBWEFT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
PAIR = [("id_a", "bigint"), ("id_b", "bigint")]
COLUMNS = {
    "p5_found": PAIR, "p6_found": PAIR, "p7_found": [("id", "bigint"), ("field_name", "string"), ("canon_id", "bigint")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p10_found": [("doc_id", "bigint"), ("pii_type", "string"), ("pii_text", "string")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_with_distinct_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert name not in COLUMNS or df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert rows and (name not in COLUMNS or len(rows) == len(set(map(tuple, rows))))


def test_names():
    assert set(SQL) <= set(QUERIES) and set(COLUMNS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("jobs", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    result = con.execute(SQL[name])
    assert sorted(d[0] for d in result.description) == sorted(df.columns)
    df = df.select(*[d[0] for d in result.description])
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, result.fetchall()))


@pytest.mark.parametrize("name", ["p5_found", "p6_found", "p6_groups", "p7_found", "p9_found", "p10_found"])
def test_plans_form_no_product(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
