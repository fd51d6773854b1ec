"""What changed between full snapshots, by comparing Merkle trees of hashed key ranges.

Rows are placed in hash buckets of their key. One digest per bucket and snapshot forms the leaves of
a tree; each parent digests its children. Trees of consecutive snapshots are compared from the root
down. Then the table is read again for the rows of the buckets whose digests differ, and only these are
shuffled by key and compared with one another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweft.session import checkpointed

#: All blanks, those that do not break a line included.
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
BLANKS = BLANK + "+"
#: Blanks that are more than one, or other than a plain space.
UNEVEN = BLANK + r"{2,}|[\t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
_BLANK_SIGNS = " \t\n\x0b\f\r\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def squeezed(c: Column | str) -> Column:
    """Outer blanks trimmed, inner blanks reduced to one, null as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(F.regexp_replace(c, UNEVEN, " ")), F.lit(""))


def stripped(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(_BLANK_SIGNS))


def tree_bits(rows: int, snapshots: int, leaf_rows: int) -> int:
    """Bits of a leaf's number, so that a leaf holds about leaf_rows rows of one snapshot."""
    return min(28, max(1, round(math.log2(max(2, rows / max(1, snapshots) / leaf_rows)))))


#: Up to so many open leaves, 40 MB, are sent to the tasks that read the rows; beyond, rows are joined to them.
SMALL_LEAVES = 2_000_000


def snapshot_changes(
    df: DataFrame,
    *,
    snapshot: str = "snapshot_no",
    keys: Sequence[str] = ("company_id", "external_id"),
    order: str = "load_seq",
    gone: str = "removed_at",
    compare: Sequence[str] = ("title", "department", "location", "workplace_type", "employment_type"),
    bits: int = 6,
    leaf_rows: int = 4,
    depth: int | None = None,
    report: bool = False,
    small_leaves: int = SMALL_LEAVES,
) -> DataFrame:
    """Rows (snapshot, keys, change_type) for what was added, removed or changed since the snapshot before.

    Text keys are compared trimmed; a row with a null key is left out. Of several versions of a key in
    one snapshot the one with the highest ``order`` counts (null lowest; of equals the one with the
    larger content digest, so a rerun gives the same). A row with ``gone`` set is not live. Repeated
    rows change nothing, an empty table or a single snapshot gives no rows, columns not named here are
    not read. Contents are compared by a 64-bit digest.

    ``bits`` is the fan-out of the tree as a power of two, ``depth`` its levels below the root; they default
    to what gives about ``leaf_rows`` rows to a leaf, from a row count that a columnar file answers from its footers. Repeated
    rows are combined in each task before a shuffle. A column common to many rows (one company) is spread
    over all leaves, since the whole key is hashed. Leaves that differ are sent to the tasks that read the
    rows, if they are no more than ``small_leaves``.
    With ``report`` the result is instead one row per tree level and snapshot: nodes and differing nodes.
    """
    kinds = dict(df.dtypes)
    clean = [(stripped(k) if kinds[k] == "string" else F.col(k)).alias(k) for k in keys]
    numbers = df.select(F.col(snapshot).alias("cur")).where("cur IS NOT NULL").distinct()
    # a row per snapshot, so one partition is enough for the order of the snapshots
    pairs = numbers.select("cur", F.lag("cur").over(Window.orderBy("cur")).alias("prev"), F.lead("cur").over(Window.orderBy("cur")).alias("next"))
    pairs = checkpointed(pairs)
    leaf_bits = bits * depth if depth is not None else tree_bits(df.count(), pairs.count(), leaf_rows)
    keyed = df.select(
        F.col(snapshot).alias("_s"), *clean, F.col(order).alias("_o"), F.col(gone).isNull().alias("_live"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(compare)],
    ).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ("_s", *keys)]))
    leaf = F.shiftrightunsigned(F.xxhash64(*keys), 64 - leaf_bits)

    def winners(rows: DataFrame, *carried: str) -> DataFrame:
        """The live rows that count; versions and repeated rows of a key are combined in each task first."""
        content = F.xxhash64(*[squeezed(f"_c{i}") for i in range(len(compare))])
        best = rows.groupBy("_s", *keys, *carried).agg(F.max(F.struct("_o", "_live", content.alias("_h"))).alias("_v"))
        return best.where("_v._live").select("_s", *keys, *carried, F.col("_v._h").alias("_h"))

    level = winners(keyed).groupBy(leaf.alias("_node"), "_s").agg(F.bit_xor(F.xxhash64(*keys, "_h")).alias("_d"))
    level = checkpointed(level)
    levels, up = [level], [0]  # from the root down, with the bits by which each is above the next
    for left in range(leaf_bits, 0, -bits):
        up.insert(0, min(bits, left))
        levels.insert(0, levels[0].groupBy(F.shiftright("_node", up[0]).alias("_node"), "_s").agg(F.bit_xor(F.xxhash64("_node", "_d")).alias("_d")))

    def compared(nodes: DataFrame) -> DataFrame:
        """(_node, _snap, differs): each digest is "now" for its own snapshot and "before" for the next one."""
        d = nodes.join(F.broadcast(pairs), nodes["_s"] == pairs["cur"]).select("_node", "_d", F.explode(F.array(  # one row per snapshot
            F.struct(F.when(F.col("prev").isNotNull(), F.col("cur")).alias("snap"), F.lit(True).alias("now")), F.struct(F.col("next").alias("snap"), F.lit(False).alias("now")))).alias("_p"))
        d = d.where("_p.snap IS NOT NULL").groupBy("_node", F.col("_p.snap").alias("_snap"))
        d = d.agg(F.max(F.when(F.col("_p.now"), F.col("_d"))).alias("_n"), F.max(F.when(~F.col("_p.now"), F.col("_d"))).alias("_b"))
        return d.select("_node", "_snap", (~F.col("_n").eqNullSafe(F.col("_b"))).alias("differs"))

    if report:
        return reduce(DataFrame.unionByName, [
            compared(x).groupBy(F.col("_snap").alias(snapshot)).agg(F.count(F.lit(1)).alias("nodes"), F.count_if("differs").alias("differing")).withColumn("level", F.lit(i))
            for i, x in enumerate(levels)
        ])
    open_nodes = compared(levels[0]).where("differs").select("_node", "_snap")
    for below, step in zip(levels[1:], up):
        open_nodes = checkpointed(open_nodes)
        # a node is looked at only where its parent differs, in the snapshot or the one before
        above = open_nodes.join(F.broadcast(pairs), F.col("_snap") == F.col("cur")).select(F.col("_node").alias("_up"), F.explode(F.array("cur", "prev")).alias("_s")).distinct()
        under = below.withColumn("_up", F.shiftright("_node", step)).join(above, ["_up", "_s"], "left_semi")
        parents = open_nodes.select(F.col("_node").alias("_up"), "_snap")
        open_nodes = compared(under.drop("_up")).where("differs").withColumn("_up", F.shiftright("_node", step)).join(parents, ["_up", "_snap"], "left_semi").select("_node", "_snap")
    open_nodes = checkpointed(open_nodes)
    # the rows to read: of an open leaf those of the snapshot, _now, and those of the one before, _then
    sides = open_nodes.join(F.broadcast(pairs), F.col("_snap") == F.col("cur")).select("_node", F.explode(F.array(
        F.struct(F.col("cur").alias("s"), F.lit(True).alias("now")), F.struct(F.col("prev").alias("s"), F.lit(False).alias("now")))).alias("_p"))
    sides = checkpointed(sides.groupBy(F.col("_node").alias("_leaf"), F.col("_p.s").alias("_s")).agg(F.max("_p.now").alias("_now"), F.max(~F.col("_p.now")).alias("_then")))
    wanted = F.broadcast(sides) if sides.count() <= small_leaves else sides
    last = winners(keyed.withColumn("_leaf", leaf).join(wanted, ["_leaf", "_s"]), "_now", "_then")
    own = Window.partitionBy(*keys).orderBy("_s")  # the snapshots of one key
    d = last.join(F.broadcast(pairs), last["_s"] == pairs["cur"]).select(
        *keys, "cur", "prev", "next", "_h", "_now", "_then", F.lag("_s").over(own).alias("_ps"), F.lag("_h").over(own).alias("_ph"), F.lead("_s").over(own).alias("_ns"))
    here = F.when(~F.col("_now") | F.col("prev").isNull(), None).when(~F.col("_ps").eqNullSafe(F.col("prev")), "added").when(F.col("_ph") != F.col("_h"), "changed")
    after = F.when(F.col("_then") & F.col("next").isNotNull() & ~F.col("_ns").eqNullSafe(F.col("next")), "removed")
    both = d.select(*keys, F.explode(F.array(F.struct(F.col("cur").alias("s"), here.alias("kind")), F.struct(F.col("next").alias("s"), after.alias("kind")))).alias("_e"))
    return both.where("_e.kind IS NOT NULL").select(F.col("_e.s").alias(snapshot), *keys, F.col("_e.kind").alias("change_type"))
