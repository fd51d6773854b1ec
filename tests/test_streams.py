"""What single batches over the test tables cannot show: late events, state over batches, and stamps that are set again."""

from datetime import datetime


from jobweft.operators import changes
from jobweft.streaming import pipelines


def test_events_of_closed_windows_are_dropped(spark, tmp_path):
    batches = [[("2024-01-01 10:00", "a"), ("2024-01-10 10:00", "a")], [("2024-01-01 11:00", "a"), ("2024-01-10 11:00", "a"), ("2024-01-09 23:30", "b")], [("2024-01-10 12:00", "b")]]
    for i, rows in enumerate(batches):
        d = spark.createDataFrame([(datetime.fromisoformat(t), k) for t, k in rows], "ts timestamp, event_type string")
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        place = f"{tmp_path}/work"
        stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/events")
        agg = pipelines.counted_windows(stream, "1 day", "20 hours")
        pipelines.keep_latest(spark, agg, place)  # goes on behind the batch before
    got = {(str(r["day"])[:10], r["event_type"]): r["n"] for r in pipelines.latest(spark, place, agg.schema, "day", "event_type").collect()}
    # the second event of 1 January comes when that day is closed, the one of the ninth when it is not
    assert got == {("2024-01-01", "a"): 1, ("2024-01-10", "a"): 2, ("2024-01-09", "b"): 1, ("2024-01-10", "b"): 1}


def test_a_row_touched_again_keeps_its_stamp(spark):
    t = lambda n: datetime(2024, 1, n)
    before = spark.createDataFrame([(1, t(1)), (2, t(2))], "id int, index_dirty_at timestamp_ntz")
    now = spark.createDataFrame([(1, t(1)), (2, t(5)), (3, t(1)), (4, None)], "id int, index_dirty_at timestamp_ntz")
    got = {r["id"]: r["index_dirty_at"] for r in changes.cleared(now, before).collect()}
    assert got == {1: None, 2: t(5), 3: t(1), 4: None}


def test_rows_that_cannot_be_stored_are_kept_apart(spark):
    d = spark.createDataFrame([(1, "a", "ok"), (None, "b", "ok"), (2, "c", "é" * 30)], "k int, e string, t string")
    good, bad = changes.quarantined(d, ("k", "e"), ("t",), most_bytes=50)
    assert [r["k"] for r in good.collect()] == [1] and sorted(r["reason"] for r in bad.collect()) == ["null key", "text too long"]


def test_absence_over_batches(spark, tmp_path):
    rows = [(1, 1, "a"), (1, 1, "b"), (2, 1, "a"), (5, 1, "a")]
    for n in (1, 2, 5):
        d = spark.createDataFrame([(s, c, e, None) for s, c, e in rows if s == n], "snapshot_no int, company_id bigint, external_id string, removed_at timestamp_ntz")
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/job_snapshots.parquet")
    got = pipelines.absence_stream(spark, str(tmp_path)).collect()
    assert [(r["company_id"], r["external_id"], r["absent"]) for r in got] == [(1, "b", 2)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest

    from jobweft import session

    class Elsewhere:
        class sparkContext:
            master = "spark://x"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere, "x")
