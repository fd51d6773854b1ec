from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jobweft.operators.snapshots import snapshot_changes, squeezed, stripped, tree_bits

SCHEMA = "snapshot_no int, company_id bigint, external_id string, title string, department string, location string, workplace_type string, employment_type string, removed_at timestamp_ntz, load_seq bigint, change_type string"


def row(s, c, e, title="t", removed=None, seq=0, location=None):
    return (s, c, e, title, None, location, None, None, removed, seq, "clash")


def changes(spark, rows, **k):
    return sorted(tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), **k).collect())


def brute(rows):
    clean = lambda x: " ".join((x or "").split())
    last = {}
    for r in sorted(rows, key=lambda r: r[9]):
        if r[0] is not None and r[1] is not None and r[2] is not None:
            last[r[0], r[1], r[2].strip()] = r
    numbers = sorted({r[0] for r in rows if r[0] is not None})
    out = []
    for before, now in zip(numbers, numbers[1:]):
        a = {k[1:]: v for k, v in last.items() if k[0] == before and v[8] is None}
        b = {k[1:]: v for k, v in last.items() if k[0] == now and v[8] is None}
        out += [(now, *k, "added") for k in b.keys() - a.keys()] + [(now, *k, "removed") for k in a.keys() - b.keys()]
        out += [(now, *k, "changed") for k in a.keys() & b.keys() if any(clean(a[k][i]) != clean(b[k][i]) for i in range(3, 8))]
    return sorted(out)


def test_cases(spark):
    from datetime import datetime

    gone = datetime(2025, 1, 1)
    rows = [
        row(1, 1, "a", seq=1), row(1, 1, "a ", "x", seq=2), row(3, 1, " a", "x", seq=3), row(3, 1, " a", "x", seq=3),  # repeated, versions, blanks
        row(1, 1, "b", seq=4), row(3, 1, "b", removed=gone, seq=5),  # withdrawn
        row(3, 2, "a", seq=6), row(1, 2, "c", "T  t ", seq=7, location=""), row(3, 2, "c", "T t", seq=8), row(1, None, "z"), row(3, 1, None),  # added, only blanks differ, null ids
        row(1, 5, "long" * 5000, "y" * 100_000, seq=9), row(3, 5, "long" * 5000, "y" * 100_000 + "z", seq=10),
    ]
    assert changes(spark, rows) == brute(rows) == [(3, 1, "b", "removed"), (3, 2, "a", "added"), (3, 5, "long" * 5000, "changed")]


def test_empty_and_single(spark):
    assert changes(spark, []) == []
    assert changes(spark, [row(1, 1, "a")]) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, 4]), st.integers(1, 3), st.sampled_from(["a", "b", " b", "c"]), st.sampled_from(["t", "t ", "u"])), max_size=25))
def test_like_brute_force_at_any_depth(spark, items):
    rows = [row(s, c, e, t, seq=i) for i, (s, c, e, t) in enumerate(items)]
    assert changes(spark, rows, depth=1) == changes(spark, rows, depth=3) == changes(spark, rows, small_leaves=0) == brute(rows)


def test_only_differing_branches_are_opened(spark):
    rows = [row(s, c, str(c), "t", seq=c) for s in (1, 2) for c in range(2000)] + [row(2, 9999, "new")]
    levels = {r["level"]: r["differing"] for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), depth=2, report=True).collect()}
    assert levels == {0: 1, 1: 1, 2: 1}


def test_bits_of_a_leaf():
    assert tree_bits(0, 0, 4) == 1 and tree_bits(10**6, 10, 4) == 15 and tree_bits(10**15, 10, 4) == 28


def test_trimming_like_a_pattern(spark):
    texts = ["a", " a ", "\u00a0a\u2003b \t", "a  b", "a\nb", "", "\u3000", None, "x y z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", stripped("t").alias("s"), squeezed("t").alias("q"))
    for t, s, q in df.collect():
        assert s == (None if t is None else t.strip()) and q == " ".join((t or "").split())


def test_only_rows_of_open_leaves_are_compared(spark):
    """One change among many rows: what is shuffled by key is a handful of rows."""
    rows = [row(s, c, str(c), "t", seq=c) for s in (1, 2, 3) for c in range(3000)] + [row(3, 9999, "new")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in snapshot_changes(df, depth=3).collect()] == [(3, 9999, "new", "added")]
    report = {r["level"]: (r["nodes"], r["differing"]) for r in snapshot_changes(df, depth=3, report=True).where("snapshot_no = 3").collect()}
    assert all(d == 1 for _, d in report.values()) and report[3][0] > 1500
