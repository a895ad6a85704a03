"""Connected components of a distributed edge table.

An edge with a null end is left out; nodes without an edge to another node are
not in the result.  Repeated edges count once, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.staging import stage, unstage

#: Neighbours of one node are dealt into that many groups, and those into ROOTS larger ones.
GROUPS, ROOTS = 1024, 32
#: Tasks among which those that ask for one label are dealt.
SHARES = 64


def without_hubs(edges: DataFrame, hub: str, leaf: str) -> DataFrame:
    """Edges a, b with the same components, in which the stars around each ``hub`` are trees.

    A star's leaves are dealt into groups by hash; the least leaf of a group
    stands for it, so no node keeps many neighbours for the join that spreads
    labels, and no step here gathers a node's edges either.
    """
    dealt = edges.select(F.col(hub).alias("hub"), F.col(leaf).alias("leaf"), F.pmod(F.xxhash64(leaf), F.lit(GROUPS)).alias("group"))
    groups = stage(dealt.groupBy("hub", "group").agg(F.min("leaf").alias("least")), "groups").withColumn("root", F.col("group") % ROOTS)
    roots = groups.groupBy("hub", "root").agg(F.min("least").alias("top"))
    outer = dealt.join(groups, ["hub", "group"]).filter("leaf <> least").select(F.col("leaf").alias("a"), F.col("least").alias("b"))
    inner = groups.join(roots, ["hub", "root"]).filter("least <> top").select(F.col("least").alias("a"), F.col("top").alias("b"))
    return outer.unionByName(inner).unionByName(roots.select(F.col("hub").alias("a"), F.col("top").alias("b")))


def attach(rows: DataFrame, values: DataFrame, key: str, by: str = "node") -> DataFrame:
    """``rows`` with the columns of ``values``, which has a row for each ``key``; a third of all rows may have one key.

    A key's row is fetched once for each share of the rows that have it, dealt by
    the column ``by``, so they are never in one task.
    """
    shared = rows.withColumn("__share", F.pmod(F.xxhash64(by), F.lit(SHARES)))
    asked = shared.select(key, "__share").distinct().join(values, key)
    return shared.join(asked.hint("merge"), [key, "__share"]).drop("__share")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b (long).  A staged table of node and label, the least node of its component.

    b is the end that many edges may share (a pivot, a root), and is freed of them first.
    Each round takes the least label among a node's neighbours and then the
    label's own label, so that long chains shrink fast.  Rounds go on until
    nothing changes.  Nothing but the count of changes reaches the driver.
    """
    once = stage(_ordered(without_hubs(edges.filter("a <> b").distinct(), "b", "a")), "edges")
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = stage(near, "near")
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("via"), F.pmod(F.xxhash64("node"), F.lit(SHARES)).alias("share"))
        # a third of all nodes may ask for one label's own: it is fetched once for each share of them
        asked = lower.select("via", "share").distinct().join(labels.select(F.col("node").alias("via"), F.col("label").alias("up")), "via")
        new = stage(lower.join(asked, ["via", "share"], "left").select("node", "was", F.least("via", "up").alias("label")), "labels")
        changed = new.filter("label <> was").limit(1).count()
        unstage(labels)
        unstage(near)
        labels = new.drop("was")
        if not changed:
            unstage(once)
            return labels
