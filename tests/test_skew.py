import pytest
from pyspark.sql import functions as F

from jobweft.operators.skew import heavy_keys, keys_with_share, salted_aggregate

SCHEMA = "id bigint, k string, v double, n bigint"


def frame(spark):
    rows = [(i, "hot", float(i % 7), i) for i in range(3000)] + [(i, f"k{i % 50}", None, None) for i in range(3000, 3500)] + [(9000, None, 1.0, 1), (9000, None, 1.0, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("share", [None, 0.2])
def test_like_plain_aggregation(spark, share):
    df = frame(spark)
    got = salted_aggregate(df, ["k"], {"rows": ("count", "id"), "total": ("sum", "v"), "mean": ("avg", "v"), "low": ("min", "n"), "high": ("max", "n")}, distinct={"ids": "id", "vs": "v"}, salts=8, heavy_share=share)
    want = df.groupBy("k").agg(F.count("id").alias("rows"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"), F.count_distinct("id").alias("ids"), F.count_distinct("v").alias("vs"))
    key = lambda r: str(r["k"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_heavy_keys_and_shares(spark):
    df = frame(spark)
    assert [r["k"] for r in heavy_keys(df, ["k"], 0.2).collect()] == ["hot"]
    assert [tuple(r) for r in keys_with_share(df, {"k": F.col("k")}, "id", 0.05).collect()] == [("k", "hot")]


def test_empty_clash_and_rerun(spark):
    empty = frame(spark).limit(0)
    assert salted_aggregate(empty, ["k"], {"rows": ("count", "id")}, distinct={"ids": "id"}).count() == 0
    assert keys_with_share(empty, {"k": F.col("k")}, "id", 0.05).count() == 0
    with pytest.raises(ValueError):
        salted_aggregate(empty, ["k"], {"k": ("count", "id")})
    assert salted_aggregate(frame(spark), ["k"], {}).count() == 52
