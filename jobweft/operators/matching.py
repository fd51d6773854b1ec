"""Matching cascades, survivors and positional lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(left: DataFrame, right: DataFrame, steps: Sequence[tuple[str, Column, Column]], left_key: str, right_key: str) -> DataFrame:
    """Rows (left key, right key, how): the first step whose two expressions are equal; of several owners the least key.

    Each step is an equi join; a right value that several rows claim belongs to the least key.
    """
    base = left.select(F.col(left_key).alias("_l"), *[lc.alias(f"_v{i}") for i, (_, lc, _) in enumerate(steps)])
    for i, (_, _, rc) in enumerate(steps):
        owners = right.select(rc.alias("_v"), F.col(right_key).alias("_r")).where("_v IS NOT NULL AND _v <> ''").groupBy("_v").agg(F.min("_r").alias(f"_r{i}"))
        base = base.join(owners.withColumnRenamed("_v", f"_w{i}"), F.col(f"_v{i}") == F.col(f"_w{i}"), "left").drop(f"_w{i}")
    how = F.coalesce(*[F.when(F.col(f"_r{i}").isNotNull(), F.lit(n)) for i, (n, _, _) in enumerate(steps)])
    return base.select(F.col("_l").alias(left_key), F.coalesce(*[f"_r{i}" for i in range(len(steps))]).alias("match"), how.alias("how")).where("match IS NOT NULL")


def prefix_pairs(df: DataFrame, key: str, name: Column, block: int = 10) -> DataFrame:
    """Pairs (a, b) of keys whose names have so many characters or more and one of which begins the other: each name meets the names that are one of its own beginnings."""
    d = df.select(F.col(key).alias("k"), name.alias("n")).where(F.length("n") >= block).distinct()
    beginnings = d.select(F.col("k").alias("long"), F.explode(F.transform(F.sequence(F.lit(block), F.length("n")), lambda i: F.substr("n", F.lit(1), i))).alias("n"))
    return beginnings.join(d, "n").where("long <> k").select(F.least("long", "k").alias("a"), F.greatest("long", "k").alias("b")).distinct()


def survivors(df: DataFrame, group: Sequence[str], key: str, weight: str) -> DataFrame:
    """Rows (group, survivor): of each group of two or more the key with the most weight, then the least key."""
    best = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(F.col(weight).alias("w"), (-F.col(key)).alias("k"))).alias("_best"))
    return best.where("_n > 1").select(*group, (-F.col("_best.k")).alias("survivor"), F.col("_n").alias("members"))


def unique_claims(df: DataFrame, claimed: str, owner: str) -> DataFrame:
    """Rows (claimed, owner) of the values that exactly one owner claims."""
    return df.where(F.col(claimed).isNotNull()).groupBy(claimed).agg(F.min(owner).alias(owner), F.max(owner).alias("_m")).where(F.col(owner) == F.col("_m")).drop("_m")


def nearest_before(points: DataFrame, marks: DataFrame, by: str, at: str, mark_key: str, bucket: Column | None = None) -> DataFrame:
    """The points with the last mark of the same key at or before them (null if there is none), and its time.

    Each key's time is cut into buckets (days of a timestamp, thousands of a number, or ``bucket``, which
    must rise with it), so that a key with most of the rows is sorted in many tasks: the last mark of
    each bucket is carried to the later ones first. No pair is ever formed. Of marks at one time the
    greatest counts; points with a null key or time find none.
    """
    kind = dict(points.dtypes)[at]
    cut = bucket if bucket is not None else F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 86_400_000_000) if kind.startswith("timestamp") else F.floor(F.col(at) / 1000)
    point_type = points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType
    m = marks.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_by"), cut.alias("_b"), F.col(at).alias("_at"), F.lit(None).cast(point_type).alias("_p"), F.col(mark_key).alias("_m"))
    p = points.select(F.col(by).alias("_by"), cut.alias("_b"), F.col(at).alias("_at"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(marks.schema[mark_key].dataType).alias("_m"))
    last = m.groupBy("_by", "_b").agg(F.max(F.struct("_at", "_m")).alias("_last"))
    asked = last.unionByName(p.select("_by", "_b").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))).groupBy("_by", "_b").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # buckets of one key, not its rows
    carried = asked.select("_by", "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("_by", "_b").orderBy("_at", F.col("_p").isNotNull(), "_m").rowsBetween(Window.unboundedPreceding, 0)
    d = p.unionByName(m).withColumn("_near", F.last(F.when(F.col("_m").isNotNull(), F.struct("_at", "_m")), ignorenulls=True).over(within)).where("_p IS NOT NULL")
    d = d.join(carried, ["_by", "_b"], "left").withColumn("_near", F.coalesce("_near", "_carried"))
    return d.select("_p.*", F.col("_near._m").alias(f"near_{mark_key}"), F.col("_near._at").alias("near_at"))


def absence_runs(seen: DataFrame, key: Sequence[str], order: str, present: str) -> DataFrame:
    """Rows (key, run_start, run_length) of the longest runs of consecutive absences of each key (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy(order)
    d = seen.withColumn("_seen", F.sum(F.when(F.col(present), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col(present))
    runs = d.groupBy(*key, "_seen").agg(F.min(order).alias("run_start"), F.count(F.lit(1)).alias("run_length"))
    return runs.groupBy(*key).agg(F.max(F.struct("run_length", (-F.col("run_start")).alias("s"))).alias("_r")).select(*key, (-F.col("_r.s")).alias("run_start"), F.col("_r.run_length").alias("run_length"))
