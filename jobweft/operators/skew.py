"""Per-key results when a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How partial results of one kind are made and merged.
PARTIAL = {
    "count": (lambda c: F.count(c), lambda c: F.sum(c)),
    "sum": (lambda c: F.sum(c), lambda c: F.sum(c)),
    "min": (lambda c: F.min(c), lambda c: F.min(c)),
    "max": (lambda c: F.max(c), lambda c: F.max(c)),
}


def salt_of(columns: Sequence[str | Column], salts: int) -> Column:
    """A salt that a rerun of a lost task repeats, unlike rand()."""
    return F.pmod(F.xxhash64(F.lit("salt"), *columns), F.lit(salts)).cast("int")


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Keys with at least ``share`` of the rows: never more than 1 / share of them. Counts are combined before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") >= total * share).select(*keys, F.lit(True).alias("_heavy"))


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, tuple[str, Column | str]],
    *,
    distinct: Mapping[str, str] | None = None,
    salt_by: Sequence[str] = (),
    salts: int = 64,
    heavy_share: float | None = None,
) -> DataFrame:
    """One row per key with ``aggregates`` {name: (count, sum, min, max or avg, input)} and ``distinct`` {name: column} counts.

    Stage one appends a salt to the keys and gives partial results per (key, salt); stage two merges
    them by key. The salt is a hash of ``salt_by`` (all columns if not given), so it is even and a rerun
    repeats it. Distinct counts are exact: for each such column equal values are sent to one salt and
    counted there, and the merge adds the parts up. With ``heavy_share`` only keys that hold that share
    of the rows are salted (their list has at most 1 / heavy_share entries and is broadcast).

    Null keys form a group of their own. Nulls in an input are ignored, as in SQL: count 0, others null.
    Repeated rows count each time, except in distinct counts. An empty table gives no rows. Names that
    clash with a key raise ValueError.
    """
    distinct = dict(distinct or {})
    if clash := set(keys) & (set(aggregates) | set(distinct)):
        raise ValueError(f"result names clash with keys: {sorted(clash)}")
    parts: dict[str, tuple[str, Column | str]] = {}
    for name, (kind, c) in aggregates.items():
        if kind == "avg":
            parts |= {f"_{name}_s": ("sum", c), f"_{name}_n": ("count", c)}
        else:
            parts[name] = (kind, c)
    if heavy_share is not None:
        heavy = heavy_keys(df, keys, heavy_share)
        right = heavy.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_heavy")
        on = [df[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)]
        df = df.join(F.broadcast(right), on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    spread = salt_of(salt_by or [c for c in df.columns if c != "_heavy"], salts)
    salt = spread if heavy_share is None else F.when(F.col("_heavy"), spread).otherwise(0)
    result = None
    if parts or not distinct:
        stage1 = df.groupBy(*keys, salt.alias("_salt")).agg(F.count(F.lit(1)).alias("_rows"), *[PARTIAL[k][0](c).alias(n) for n, (k, c) in parts.items()])
        result = stage1.groupBy(*keys).agg(F.sum("_rows").alias("_rows"), *[PARTIAL[k][1](n).alias(n) for n, (k, _) in parts.items()])
    for name, c in distinct.items():
        # equal values share a salt: once a value is met in its salt it is counted nowhere else
        by_value = salt_of([c], salts) if heavy_share is None else F.when(F.col("_heavy"), salt_of([c], salts)).otherwise(0)
        own = df.groupBy(*keys, by_value.alias("_salt"), F.col(c).alias("_v")).agg(F.lit(1).alias("_one"))
        own = own.groupBy(*keys, "_salt").agg(F.count("_v").alias("_part")).groupBy(*keys).agg(F.sum("_part").alias(name))
        if result is None:
            result = own
        else:
            other = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
            result = result.join(other, [result[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)]).drop(*[f"_k{i}" for i in range(len(keys))])
    final = []
    for name, (kind, _) in aggregates.items():
        final.append((F.col(f"_{name}_s") / F.when(F.col(f"_{name}_n") > 0, F.col(f"_{name}_n"))).alias(name) if kind == "avg" else F.col(name))
    return result.select(*keys, *final, *distinct)


def keys_with_share(df: DataFrame, fields: Mapping[str, Column], unit: str, share: float, salts: int = 64) -> DataFrame:
    """Rows (field_name, key_text): keys of each field that hold at least ``share`` of the distinct units of the table.

    Null keys and null units are left out; the whole table's distinct units are the base. All fields and
    the base are counted in one pass: the base is a further key, the hottest of all, and salting spreads it.
    """
    wanted = [F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("key_text")) for n, c in fields.items()]
    wanted.append(F.struct(F.lit("").alias("field_name"), F.lit("").alias("key_text")))
    long = df.where(F.col(unit).isNotNull()).select(F.col(unit).alias("_unit"), F.explode(F.array(*wanted)).alias("_k"))
    long = long.select("_unit", "_k.field_name", "_k.key_text").where("key_text IS NOT NULL")
    counts = salted_aggregate(long, ["field_name", "key_text"], {}, distinct={"n": "_unit"}, salts=salts)
    base = counts.where("field_name = ''").select("n").scalar()
    return counts.where("field_name <> ''").where(F.col("n") >= base * share).select("field_name", "key_text")
