"""Connected components of links, without collecting a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweft.session import checkpointed


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Rows (node, component): component is the least node of the component; only nodes that have a link.

    Alternates large-star and small-star steps: every node links its larger neighbours to the least
    one, then its smaller neighbours to the least. The number of links never grows, no step collects a
    neighbourhood, and the rounds are about the logarithm of the largest component. Each round is cut
    off by a checkpoint in the shared folder. Loops, repeated and null links are ignored.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("u", "v", "m")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = checkpointed(after)
        same = after.count() == links.count() and after.join(links, ["u", "v"], "left_anti").isEmpty()
        links = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("u")).distinct()
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots.join(links, "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component")))
