"""Stored state merged with a snapshot, one policy per column, without a MERGE statement: one full outer join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Who wins in each column where a key is on both sides; columns not named keep the stored value.

    ``new`` takes the snapshot's value, null included; ``coalesce`` the snapshot's unless null;
    ``unless_empty`` the snapshot's unless null or empty; ``fill`` the stored one unless null;
    ``fill_empty`` the stored one unless null, empty or unknown. ``revive`` clears the removal mark.
    """

    new: Sequence[str] = ()
    coalesce: Sequence[str] = ()
    unless_empty: Sequence[str] = ()
    fill: Sequence[str] = ()
    fill_empty: Sequence[str] = ()
    revive: bool = True
    insert: bool = True
    constants: Mapping[str, object] = field(default_factory=dict)


SALARY = ("salary_min", "salary_max", "salary_currency", "salary_interval")
# The merge policies by name.
POLICIES = {
    "sync": Policy(new=("title", "department", "location", "workplace_type", "employment_type", "url", "posted_at", "raw_data", "is_remote"), coalesce=(*SALARY, "description"),
                   unless_empty=("visa_sponsorship", "experience_level"), constants={"absent_syncs": 0}),
    "replicate": Policy(new=("title", "url", "posted_at"), coalesce=("description",)),
    "gap_fill": Policy(fill=("description", *SALARY), fill_empty=("visa_sponsorship", "experience_level"), revive=False),
    "demand": Policy(new=("location", "url"), coalesce=("description",)),
    "marketplace": Policy(new=("title", "department", "location", "workplace_type", "employment_type", "url", "posted_at", "raw_data"), coalesce=("description",)),
    "aggregate": Policy(new=("title", "location", "workplace_type", "url"), coalesce=("description",), revive=False),
    "insert_only": Policy(revive=False),
}
# The merge policies of organisations, whose key is their career address.
COMPANY_POLICIES = {
    "insert_only": Policy(revive=False), "keep_name": Policy(fill=("company_name",), revive=False), "name_and_logo": Policy(coalesce=("company_name", "logo_url"), revive=False),
    "board": Policy(new=("ats", "ats_slug", "status"), revive=False),
}


def last_of_key(snapshot: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """One row per key, the last in ``order``; rows with a null key are left out. The window sorts the versions of one key only."""
    clean = snapshot.dropna(subset=list(keys))
    if order is None:
        return clean.dropDuplicates(list(keys))
    packed = clean.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in clean.columns if c not in (*keys, order)])).alias("_r"))
    return packed.select(*keys, "_r.*")


def merge(
    stored: DataFrame, snapshot: DataFrame, policy: Policy, *, keys: Sequence[str] = ("company_id", "external_id"), order: str | None = None,
    removed: str = "removed_at", seen: str = "last_seen_at", as_of: Column | None = None,
) -> DataFrame:
    """The stored columns after the merge, with ``_action``: inserted, revived, updated or kept.

    Stored rows with a null key are kept as they are. A key the snapshot repeats counts once, its last
    row. ``as_of`` is stamped on every row that the snapshot holds.
    """
    new = last_of_key(snapshot, keys, order)
    have = [c for c in stored.columns if c in new.columns and c not in keys]
    right = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in have], F.lit(True).alias("_in"))
    on = [stored[k] == right[f"_k_{k}"] for k in keys]
    both = stored.withColumn("_was", F.lit(True)).join(right, on, "full_outer" if policy.insert else "left")
    hit, fresh = F.col("_in") & F.col("_was"), F.col("_was").isNull()
    out = []
    for c in stored.columns:
        old, now = F.col(c), F.col(f"_n_{c}") if c in have else F.lit(None).cast(stored.schema[c].dataType)
        if c in keys:
            value = F.coalesce(old, F.col(f"_k_{c}"))
        elif c in policy.constants:
            value = F.when(F.col("_in"), F.lit(policy.constants[c]).cast(stored.schema[c].dataType)).otherwise(old)
        elif c == seen and as_of is not None:
            value = F.when(F.col("_in"), as_of).otherwise(old)
        elif c == removed:
            value = F.when(hit & F.lit(policy.revive), F.lit(None)).otherwise(old)
        elif c in policy.new and c in have:
            value = F.when(F.col("_in"), now).otherwise(old)
        elif c in policy.coalesce:
            value = F.coalesce(now, old)
        elif c in policy.unless_empty:
            value = F.coalesce(F.nullif(now, F.lit("")), old)
        elif c in policy.fill:
            value = F.coalesce(old, now)
        elif c in policy.fill_empty:
            value = F.coalesce(F.when(~old.isin("", "unknown"), old), now, old)
        else:
            value = F.when(fresh, now).otherwise(old)
        out.append(value.alias(c))
    gone = F.col(removed).isNotNull() if removed in stored.columns else F.lit(False)
    action = F.when(fresh, "inserted").when(hit & gone & F.lit(policy.revive), "revived").when(hit, "updated").otherwise("kept")
    return both.select(*out, action.alias("_action"))


def absence(
    stored: DataFrame, snapshot: DataFrame, *, keys: Sequence[str] = ("company_id", "external_id"), limit: int = 3, armed: bool = True, partial: bool = False, as_of: Column,
) -> DataFrame:
    """The stored rows with their counter of consecutive absences: one more for a live row of a covered company that the snapshot lacks.

    A company is covered if the snapshot holds it; if any of its rows there has a null key nothing is
    counted for it, and a partial snapshot counts nothing at all. At ``limit`` a row is retired if armed.
    """
    owner = keys[0]
    if partial:
        return stored
    covered = snapshot.groupBy(F.col(owner).alias("_o")).agg(F.max(F.col(keys[1]).isNull()).alias("_torn")).where(~F.col("_torn")).select("_o")
    present = snapshot.dropna(subset=list(keys)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct().withColumn("_there", F.lit(True))
    d = stored.join(covered, stored[owner] == F.col("_o"), "left").join(present, [stored[k] == F.col(f"_k{i}") for i, k in enumerate(keys)], "left")
    missed = F.col("_o").isNotNull() & F.col("_there").isNull() & F.col("removed_at").isNull()
    count = F.coalesce(F.col("absent_syncs"), F.lit(0)) + 1
    retired = missed & (count >= limit) & F.lit(armed)
    return d.select(*[
        F.when(missed, count).otherwise(F.col(c)).cast(stored.schema[c].dataType).alias(c) if c == "absent_syncs" else
        F.when(retired, as_of).otherwise(F.col(c)).alias(c) if c == "removed_at" else F.col(c)
        for c in stored.columns
    ])


def sync_counts(stored: DataFrame, snapshot: DataFrame, keys: Sequence[str] = ("company_id", "external_id"), limit: int = 3) -> DataFrame:
    """One row (added, updated, removed): keys of the snapshot that are not among the live stored ones, those that are, and live rows that this absence retires."""
    live = stored.where("removed_at IS NULL").dropna(subset=list(keys)).select(*keys).distinct().withColumn("_live", F.lit(True))
    new = snapshot.dropna(subset=list(keys)).select(*keys).distinct()
    counts = new.join(live, list(keys), "left").agg(F.count_if(F.col("_live").isNull()).alias("added"), F.count_if("_live").alias("updated"))
    after = absence(stored.where("removed_at IS NULL"), snapshot, keys=keys, limit=limit, as_of=F.current_timestamp())
    return counts.select("added", "updated", after.where("removed_at IS NOT NULL").agg(F.count(F.lit(1))).scalar().alias("removed"))
