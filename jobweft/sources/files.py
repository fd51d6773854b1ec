"""Files in and out: CSV, JSON lines, maps of arrays, Parquet, with bad rows kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, *, short_rows: str = "pad") -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, fields over several lines. Short rows are padded with nulls or dropped."""
    if short_rows not in ("pad", "drop"):
        raise ValueError("short_rows is pad or drop")
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", False)
    return reader.option("mode", "PERMISSIVE" if short_rows == "pad" else "DROPMALFORMED").schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; lines that are none are dropped."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


def read_board_map(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows (ats, name, slug, url) of {ats: [{name, slug, url}]}."""
    m = F.from_json(F.col(payload), "map<string, array<struct<name:string, slug:string, url:string>>>")
    return df.select(F.explode(m).alias("ats", "list")).select("ats", F.explode("list").alias("e")).select("ats", "e.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def insert_new(have: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, one per key."""
    return rows.dropna(subset=keys).dropDuplicates(keys).join(have.select(*keys).distinct(), keys, "left_anti")


def walk_ids(spark: SparkSession, low: int, high: int, step: int, offset: int, seen: DataFrame, key: str) -> DataFrame:
    """Ids of a numeric range that one worker of several still has to read."""
    return spark.range(low + offset, high, step).withColumnRenamed("id", key).join(seen.select(key).distinct(), key, "left_anti")


def health_line(counts: DataFrame) -> DataFrame:
    """One text row of k=v pairs from one row of numbers."""
    return counts.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("0"))) for c in counts.columns]).alias("line"))
