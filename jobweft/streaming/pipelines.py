"""Streaming twins of the batch pipelines, driven to completion over what has landed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweft.session import shared_folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder of the session."""
    return f"{shared_folder(spark, 'jobweft-stream-')}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A table read as a stream. The source reads a folder: a table of one file is picked out of its folder by its name."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    schema = schema or batch.schema
    files = batch.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(f"{name}.parquet"):
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return spark.readStream.schema(schema).parquet(path)


def run_now(stream: DataFrame, each: Callable[[DataFrame, int], None], place: str, mode: str = "append") -> None:
    """All that has landed is taken up in batches; a restart goes on behind the last batch that was completed."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def keep_latest(spark: SparkSession, stream: DataFrame, place: str) -> None:
    """The groups that a batch changed are written to a folder of that batch, which a repeated batch overwrites; the state is never rewritten whole."""
    run_now(stream, lambda d, i: d.write.mode("overwrite").parquet(f"{place}/changes/batch={i}"), place, "update")


def latest(spark: SparkSession, place: str, schema: T.StructType, *keys: str) -> DataFrame:
    """The state: of each group what the last batch said that changed it."""
    rest = [f.name for f in schema if f.name not in keys]
    changes = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).option("basePath", f"{place}/changes").parquet(f"{place}/changes")
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def grouped_stream(spark: SparkSession, agg: DataFrame, name: str, *keys: str) -> DataFrame:
    place = work_folder(spark, name)
    keep_latest(spark, agg, place)
    return latest(spark, place, agg.schema, *keys)


def rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, least and greatest value of each event type, kept up by a stream."""
    agg = table_stream(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return grouped_stream(spark, agg, "rollup", "event_type")


def counted_windows(events: DataFrame, window: str, late: str) -> DataFrame:
    """Events (ts, event_type) per window and type. A window that ended ``late`` before the greatest time of the batches before is closed: what comes for it then is dropped and its state is gone."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def windows_stream(spark: SparkSession, sf_dir: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events per day and type, events of closed days left out; times are cast, since a watermark needs a zone."""
    events = table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return grouped_stream(spark, counted_windows(events, window, late), "windows", "day", "event_type")


def absence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the number of their company's newest snapshots in a row that lack them, by two streams: where each posting was last live, and which snapshots each company has."""
    rows = lambda: table_stream(spark, sf_dir, "job_snapshots").where("company_id IS NOT NULL AND external_id IS NOT NULL")
    seen = grouped_stream(spark, rows().groupBy("company_id", "external_id").agg(F.max(F.when(F.col("removed_at").isNull(), F.col("snapshot_no"))).alias("last_no")), "seen", "company_id", "external_id")
    taken = grouped_stream(spark, rows().groupBy("company_id", "snapshot_no").agg(F.count(F.lit(1)).alias("n_rows")), "taken", "company_id", "snapshot_no")
    # snapshots of a company are few: each has its place from the newest
    place = taken.groupBy("company_id").agg(F.array_sort(F.collect_list("snapshot_no")).alias("_all"))
    d = seen.join(place, "company_id")
    return d.select("company_id", "external_id", F.size(F.filter("_all", lambda n: n > F.coalesce("last_no", F.lit(-1)))).alias("absent")).where("absent > 0")


def outbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that were touched, split by a stream into index additions and deletions; a batch written twice overwrites itself."""
    place = work_folder(spark, "outbox")
    touched = table_stream(spark, sf_dir, "jobs").where("last_checked_at IS NOT NULL").select("id", F.when(F.col("removed_at").isNull(), "add").otherwise("delete").alias("op"))
    run_now(touched, lambda d, i: d.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{place}/out/batch={i}"), place)
    return spark.read.parquet(f"{place}/out").select("id", "op").distinct()


QUERIES = {"stream_rollup": rollup_stream, "stream_windows": windows_stream, "stream_outbox": outbox_stream, "stream_absence": absence_stream}
SQL = {
    "stream_rollup": "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_absence": """WITH r AS (SELECT company_id, external_id, snapshot_no, removed_at FROM job_snapshots WHERE company_id IS NOT NULL AND external_id IS NOT NULL),
      l AS (SELECT company_id, external_id, max(snapshot_no) FILTER (removed_at IS NULL) AS last_no FROM r GROUP BY ALL), s AS (SELECT DISTINCT company_id, snapshot_no FROM r)
      SELECT l.company_id, l.external_id, CAST(count(*) AS INTEGER) AS absent FROM l JOIN s ON s.company_id = l.company_id AND s.snapshot_no > coalesce(l.last_no, -1) GROUP BY ALL""",
    "stream_outbox": "SELECT DISTINCT id, CASE WHEN removed_at IS NULL THEN 'add' ELSE 'delete' END AS op FROM jobs WHERE last_checked_at IS NOT NULL",
}
