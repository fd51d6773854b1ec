"""What the driver relies on."""

import importlib
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.environ.get("JOBWEFT_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
COLUMNS = {
    "p1_found": [("snapshot_no", "int"), ("company_id", "bigint"), ("external_id", "string"), ("change_type", "string")], "p2_found": [("id", "bigint"), ("bound", "string"), ("usd_year", "bigint")],
    "p3_found": [("id", "bigint"), ("field_name", "string"), ("utc_micros", "bigint")], "p4_found": [("field_name", "string"), ("key_text", "string")],
}


@pytest.fixture(scope="module")
def entry():
    sys.path.insert(0, ROOT)
    return importlib.import_module("__spark_entry__")


@needs_data
def test_entry(spark, entry):
    assert entry.entry(spark).count() > 0


def test_names(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(COLUMNS) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, entry, name):
    assert entry.queries()[name](spark, DATA).dtypes == COLUMNS[name]


def test_nothing_else_imports_the_text_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "jobweft")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    assert "jobweft.llm" not in source.read(), f
