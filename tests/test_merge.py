"""The golden cases of a merge: inserts, updates, keys given twice, values kept or overwritten, revival, absence."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobweft.operators.merge import COMPANY_POLICIES, POLICIES, absence, merge, sync_counts

STORED = "id bigint, company_id bigint, external_id string, title string, description string, salary_min string, visa_sponsorship string, experience_level string, removed_at timestamp_ntz, absent_syncs int, last_seen_at timestamp_ntz"
SNAP = "company_id bigint, external_id string, title string, description string, salary_min string, visa_sponsorship string, experience_level string, seq int"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 2, 1)


def now():
    return F.lit("2025-02-01 00:00:00").cast("timestamp_ntz")


def stored(spark, *rows):
    return spark.createDataFrame([(i, 1, e, t, d, s, v, x, r, a, T0) for i, (e, t, d, s, v, x, r, a) in enumerate(rows)], STORED)


def snap(spark, *rows):
    return spark.createDataFrame([(1, *r, i) for i, r in enumerate(rows)], SNAP)


def by_key(df):
    return {r["external_id"]: r.asDict() for r in df.collect()}


def test_insert_update_and_last_wins(spark):
    s = stored(spark, ("a", "old", "text", "10", "yes", "senior", None, 2))
    n = snap(spark, ("a", "mid", None, None, "", None), ("a", "new", None, None, "", None), ("b", "x", "d", "5", None, None), (None, "z", None, None, None, None))
    got = by_key(merge(s, n, POLICIES["sync"], order="seq", as_of=now()))
    assert set(got) == {"a", "b"} and got["a"]["_action"] == "updated" and got["b"]["_action"] == "inserted"
    assert (got["a"]["title"], got["a"]["description"], got["a"]["salary_min"], got["a"]["visa_sponsorship"], got["a"]["experience_level"], got["a"]["absent_syncs"], got["a"]["last_seen_at"]) == ("new", "text", "10", "yes", "senior", 0, T1)
    assert [tuple(r) for r in sync_counts(s, n).collect()] == [(1, 1, 0)]


def test_salary_overwrite_and_revival(spark):
    s = stored(spark, ("a", "t", None, "10", None, None, T0, 0))
    n = snap(spark, ("a", "t", None, "55", None, None))
    got = by_key(merge(s, n, POLICIES["sync"], order="seq", as_of=now()))["a"]
    assert got["salary_min"] == "55" and got["removed_at"] is None and got["_action"] == "revived"
    assert [tuple(r) for r in sync_counts(s, n).collect()] == [(1, 0, 0)]


def test_gap_fill_keeps_what_is_there(spark):
    s = stored(spark, ("a", "t", None, "10", "unknown", "", T0, 0))
    got = by_key(merge(s, snap(spark, ("a", "new", "d", "55", "no", "lead")), POLICIES["gap_fill"], order="seq", as_of=now()))["a"]
    assert (got["title"], got["description"], got["salary_min"], got["visa_sponsorship"], got["experience_level"], got["removed_at"]) == ("t", "d", "10", "no", "lead", T0)


def test_empty_snapshot_and_idempotence(spark):
    s = stored(spark, ("a", "t", None, None, None, None, None, 1), (None, "n", None, None, None, None, None, 0))
    kept = merge(s, snap(spark).limit(0), POLICIES["sync"], order="seq", as_of=now())
    assert kept.drop("_action").exceptAll(s).count() == 0 and kept.count() == 2
    n = snap(spark, ("a", "new", "d", None, None, None), ("b", "x", None, None, None, None))
    once = merge(s, n, POLICIES["sync"], order="seq", as_of=now()).drop("_action")
    twice = merge(once, n, POLICIES["sync"], order="seq", as_of=now()).drop("_action")
    assert twice.exceptAll(once).count() == 0 and once.count() == twice.count() == 3


@pytest.mark.parametrize(("armed", "partial", "torn", "want"), [(True, False, False, (3, T1)), (False, False, False, (3, None)), (True, True, False, (2, None)), (True, False, True, (2, None))])
def test_absence(spark, armed, partial, torn, want):
    s = stored(spark, ("a", "t", None, None, None, None, None, 2), ("b", "t", None, None, None, None, None, 0))
    n = snap(spark, ("b", "t", None, None, None, None), *([(None, "t", None, None, None, None)] if torn else []))
    got = by_key(absence(s, n, armed=armed, partial=partial, as_of=now()))
    assert (got["a"]["absent_syncs"], got["a"]["removed_at"]) == want and got["b"]["absent_syncs"] == 0


@pytest.mark.parametrize(("policy", "want"), [("insert_only", ("Old", "lever")), ("keep_name", ("Old", "lever")), ("name_and_logo", ("New", "lever")), ("board", ("Old", "ashby"))])
def test_company_policies(spark, policy, want):
    schema = "career_url string, company_name string, logo_url string, ats string, ats_slug string, status string"
    have = spark.createDataFrame([("u", "Old", None, "lever", "s", "active"), ("n", None, None, "lever", "n", "active")], schema)
    new = spark.createDataFrame([("u", "New", "l", "ashby", "t", "pending"), ("v", "V", None, "ashby", "v", "pending"), ("n", "Named", None, "lever", "n", "active")], schema)
    got = {r["career_url"]: r for r in merge(have, new, COMPANY_POLICIES[policy], keys=("career_url",)).collect()}
    assert (got["u"]["company_name"], got["u"]["ats"]) == want and got["v"]["_action"] == "inserted" and set(got) == {"u", "v", "n"}
    assert got["n"]["company_name"] == (None if policy in ("insert_only", "board") else "Named")
