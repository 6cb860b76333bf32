"""Closures and paths over typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.tables import materialised, together

#: Levels at most; a closure that isn't complete by then raises.
LEVELS = 100


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """curie, root: the nodes from which each root (seeds.curie) can be reached, itself included.

    Walks edges (src, dst) backwards level by level; nodes seen before are
    left out, so cycles end and many paths to a node cost no more than one.
    Edges are stored once, and each level adds a file to what was seen.
    """
    steps = materialised(edges.select("src", "dst").distinct())
    seen = frontier = materialised(seeds.select("curie", F.col("curie").alias("root")).distinct())
    for _ in range(LEVELS):
        found = frontier.join(steps, frontier["curie"] == steps["dst"]).select(F.col("src").alias("curie"), "root").distinct()
        frontier = materialised(found.join(seen, ["curie", "root"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = together(seen._paths + frontier._paths, seen)
    raise ValueError(f"closure deeper than {LEVELS} levels")


def ancestors(edges: DataFrame) -> DataFrame:
    """curie, root: closure() of every node of edges (src, dst) at once.

    Each round joins what was reached with itself, so that the length of the
    ways doubles: a hierarchy of 16 levels takes four joins. Cycles end as
    soon as nothing new is reached.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("curie"))
    reached = materialised(edges.select(F.col("src").alias("curie"), F.col("dst").alias("root")).unionByName(ends.select("curie", F.col("curie").alias("root"))).distinct())
    size = reached.count()
    while True:
        # A node's way to itself adds nothing to another one.
        first = reached.where("curie <> root").select("curie", F.col("root").alias("via"))
        second = reached.where("curie <> root").select(F.col("curie").alias("via"), "root")
        reached = materialised(reached.unionByName(first.join(second, "via").select("curie", "root")).distinct())
        if (grown := reached.count()) == size:
            return reached
        size = grown


def write_ancestors(edges: DataFrame, path: str) -> None:
    """ancestors() as a table in the order of roots: what lies under a root is one range of it, however deep."""
    ancestors(edges).repartitionByRange("root", "curie").sortWithinPartitions("root", "curie").write.mode("overwrite").parquet(path)


def stored_ancestors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("curie string, root string").parquet(path)


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """curie: the nodes that can be reached from any of seeds.curie over edges (src, dst), those included; each once, however many seeds lead there."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    steps = materialised(turned)
    seen = frontier = materialised(seeds.select("curie").distinct())
    for _ in range(LEVELS):
        found = steps.join(frontier, steps["dst"] == frontier["curie"], "left_semi").select(F.col("src").alias("curie")).distinct()
        frontier = materialised(found.join(seen, "curie", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = together(seen._paths + frontier._paths, seen)
    raise ValueError(f"nodes further than {LEVELS} levels away")


def edges_at(edges: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """The edges whose src or dst (column) is one of nodes.curie.

    A few nodes may have most of the edges, and a join by node would bring all
    of one to one task. So the edges' different nodes are looked for first;
    where they are few, Spark sends them to the edges.
    """
    own = materialised(edges.select(F.col(column).alias("curie")).distinct().join(nodes.select("curie"), "curie", "left_semi"))
    return edges.join(own.select(F.col("curie").alias(column)), column, "left_semi").select(edges.columns)


def useful_edges(edges: DataFrame, seeds: DataFrame, ends: DataFrame) -> DataFrame:
    """The edges that lie on a way from seeds.curie to ends.curie: their source is reached from a seed, and from their target an end is.

    Forward reach comes first and narrows what the backward one walks.
    """
    edges = materialised(edges)
    ahead = reached(edges, seeds)
    left = materialised(edges_at(edges, "src", ahead))
    turned = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = reached(turned, ends.join(ahead, "curie", "left_semi"))
    return materialised(edges_at(left, "dst", back))


def paths(edges: DataFrame, seeds: DataFrame, levels: int | None, backwards: bool = False, ends: DataFrame | None = None, with_edges: bool = False) -> DataFrame:
    """start, node, path: every path of up to `levels` edges from seeds.curie, the empty one included; with ends, only those that end at one of ends.curie.

    Without a number of levels all paths are followed to their ends, at most
    LEVELS edges long; longer ones raise. path has the nodes behind the start.
    An edge isn't used twice in a path; nodes may repeat. with_edges adds
    used, the edges in their order.

    With ends, edges that lead to none are taken out beforehand. In a
    hierarchy without cycles every path begun then is the beginning of one
    that is returned, so that the rows of a level are never more than those.
    """
    if ends is not None:
        ends = materialised(ends.select("curie").distinct())
        turned = edges.select(F.col("dst").alias("src"), "type", F.col("src").alias("dst")) if backwards else edges.select("src", "type", "dst")
        kept = useful_edges(turned, seeds, ends)
        edges = kept.select(F.col("dst").alias("src"), "type", F.col("src").alias("dst")) if backwards else kept
    a, b = ("dst", "src") if backwards else ("src", "dst")
    steps = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct("src", "type", "dst").alias("edge"))
    level = seeds.select(F.col("curie").alias("start"), F.col("curie").alias("node"), F.array().cast("array<string>").alias("path"), F.array().cast("array<struct<src:string,type:string,dst:string>>").alias("used"))
    found, whole = level, levels is not None
    for _ in range(LEVELS + 1 if levels is None else levels):
        # Many paths may have come to a few nodes: what leads on from there then is small, and is sent to the paths.
        onward = steps if levels is not None or level is found else materialised(edges_at(steps, "a", level.select(F.col("node").alias("curie")).distinct()))
        level = level.join(onward, F.col("node") == F.col("a")).where(~F.array_contains("used", F.col("edge"))).select("start", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), F.concat("used", F.array("edge")).alias("used"))
        if levels is None:
            level = materialised(level)
            if level.isEmpty():
                whole = True
                break
        found = found.unionByName(level)
    if not whole:
        raise ValueError(f"paths longer than {LEVELS} edges")
    if ends is not None:
        found = found.join(ends.select(F.col("curie").alias("node")), "node", "left_semi").select(found.columns)
    return found if with_edges else found.drop("used")
