"""Reachability and hierarchy operators (G1, G4-G7) as loops of joins with a visited anti-join, so cycles end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import cut


def bounded_reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth): every node within ``depth`` steps of a root and its least distance. edges: (src, dst)."""
    step = edges.select("src", "dst").distinct()
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for k in range(1, depth + 1):
        fresh = frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = fresh.join(seen, "node", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(frontier)
        if k % 4 == 0:
            seen, frontier = cut(seen), cut(frontier)
    return seen


def closure(edges: DataFrame, roots: DataFrame, limit: int = 200) -> DataFrame:
    """(node, depth): everything reachable, until no round adds a node."""
    step = cut(edges.select("src", "dst").distinct())
    seen = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, limit + 1):
        fresh = frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(fresh.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        if not frontier.limit(1).count():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError(f"no fixpoint after {limit} rounds")


def ancestors(tree: DataFrame, limit: int = 50) -> DataFrame:
    """(node, ancestor, distance) for a table (node, parent), a node being its own ancestor at 0.

    Distances double each round: pairs up to 2**k steps apart are joined with themselves, so a tree of depth d takes
    log2(d) rounds. A cycle would not end and raises.
    """
    pairs = cut(
        tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).union(
            tree.filter("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
        )
    )
    n = pairs.count()
    for _ in range(limit):
        a, b = pairs.alias("a"), pairs.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.node")).select(
            F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance")
        )
        pairs = cut(longer.distinct())
        now = pairs.count()
        if now == n:
            return pairs
        n = now
    raise ValueError("the hierarchy has a cycle")


def numbered_tree(tree: DataFrame, width: int, hops: int) -> DataFrame:
    """(node, number, depth, more): a tree (node, parent, rank) as a numbered outline.

    At most ``width`` children of a node are shown, by rank, and ``more`` says how many of its children are not; nodes
    deeper than ``hops`` are not shown. A level is one join; what was shown once is not shown again.
    """
    w = Window.partitionBy("parent").orderBy("rank", "node")
    kids = cut(tree.withColumn("place", F.row_number().over(w)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("parent"))))
    per = kids.groupBy(F.col("parent").alias("node")).agg(F.greatest(F.max("of") - width, F.lit(0)).alias("more"))
    level = cut(kids.filter(F.col("parent").isNull() & (F.col("place") <= width)).select("node", F.col("place").cast("string").alias("number"), F.lit(0).alias("depth")))
    shown = level
    for depth in range(1, hops + 1):
        below = level.select(F.col("node").alias("parent"), F.col("number").alias("above")).join(kids.filter(F.col("place") <= width), "parent")
        fresh = below.select("node", F.concat("above", F.lit("."), F.col("place").cast("string")).alias("number"), F.lit(depth).alias("depth"))
        level = cut(fresh.join(shown.select("node"), "node", "left_anti"))
        if level.isEmpty():
            break
        shown = shown.unionByName(level)
    return shown.join(per, "node", "left").select("node", "number", "depth", F.coalesce("more", F.lit(0)).alias("more"))
