"""Session building and the few cluster services the operators need."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "jobweft", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's session is used as it is."""
    cpus = cpus or os.cpu_count() or 4
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_jobweft_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    place = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
    place.write_bytes(buffer.getvalue())
    sc.addPyFile(str(place))  # served by the driver to all executors
    sc._jobweft_shipped = True


def shipped_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver, such as a vocabulary, to all executors once; SparkFiles.get finds it there by the name returned."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_jobweft_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor loses nothing.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where that is unset and
    all runs on one machine, as in tests, a folder of this machine is taken.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "jobweft-checkpoint-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only for a local master, since executors elsewhere cannot see it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by key where a table has fewer pieces to read than there are cores, for costly work on each row; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores, *keys)
