"""Change capture between two states, and what an index must take up or drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The indexed columns; a change of any other leaves the index as it is.
INDEXED = ("title", "department", "location", "workplace_type", "employment_type", "salary_min", "salary_max", "url", "posted_at", "ats", "removed_at", "visa_sponsorship", "experience_level", "is_remote")


def indexed_document() -> list[Column]:
    """Columns of the index document of a posting: texts without empties, numbers, and times as epoch seconds."""
    texts = ("title", "department", "location", "workplace_type", "employment_type", "url", "ats", "experience_level")
    number = lambda c: F.regexp_extract(F.col(c), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return [F.col("id"), F.col("company_id"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in texts], number("salary_min").alias("salary_min"), number("salary_max").alias("salary_max"),
            F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("first_seen_ts")]


def changed_rows(before: DataFrame, after: DataFrame, key: str = "id", columns: Sequence[str] = INDEXED) -> DataFrame:
    """Rows (key, op): insert, update or delete, where a compared column is distinct, nulls equal to nulls."""
    columns = [c for c in columns if c in before.columns and c in after.columns]
    a = before.select(F.col(key).alias("_ka"), F.struct(*columns).alias("_a"))
    b = after.select(F.col(key).alias("_kb"), F.struct(*columns).alias("_b"))
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    op = F.when(F.col("_ka").isNull(), "insert").when(F.col("_kb").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return both.select(F.coalesce("_ka", "_kb").alias(key), op.alias("op")).where("op IS NOT NULL")


def outbox_split(dirty: DataFrame, removed: str = "removed_at") -> tuple[DataFrame, DataFrame]:
    """Documents to add or replace, and keys to delete."""
    return dirty.where(F.col(removed).isNull()).select(*indexed_document()), dirty.where(F.col(removed).isNotNull()).select("id")


def fan_out(jobs: DataFrame, changed_companies: DataFrame) -> DataFrame:
    """All live postings of the companies that changed."""
    return jobs.where("removed_at IS NULL").join(changed_companies.select(F.col("id").alias("company_id")).distinct(), "company_id", "left_semi")


def cleared(rows: DataFrame, batch: DataFrame, stamp: str = "index_dirty_at", key: str = "id") -> DataFrame:
    """The rows after a batch was taken up: its rows lose their stamp unless they were touched again behind the batch's last stamp, so that nothing is lost."""
    done = batch.select(F.col(key).alias("_k")).distinct()
    last = batch.agg(F.max(stamp)).scalar()
    d = rows.join(done, F.col(key) == F.col("_k"), "left")
    return d.select(*[F.when(F.col("_k").isNull() | (F.col(stamp) > last), F.col(stamp)).alias(c) if c == stamp else F.col(c) for c in rows.columns])


def quarantined(rows: DataFrame, keys: Sequence[str], texts: Sequence[str], most_bytes: int = 2600) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and those that cannot with the reason: a null key, or an indexed text over so many bytes."""
    reason = F.when(F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x), "null key").when(F.exists(F.array(*[F.coalesce(F.octet_length(c) > most_bytes, F.lit(False)) for c in texts]), lambda x: x), "text too long")
    d = rows.withColumn("reason", reason)
    return d.where("reason IS NULL").drop("reason"), d.where("reason IS NOT NULL")
