"""Connected components of an edge table, by joins only; nothing but counters reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import cut


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(src, dst) long edges, any direction -> (node, component): the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then follows that label's own label (pointer
    jumping), so the rounds needed grow with the logarithm of the longest chain. ``min`` combines on the map side, so a
    hub of any degree is no hot task, and each round is cut through the shared checkpoint folder.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).filter(F.col("src") != F.col("dst")).distinct())
    labels = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    for _ in range(limit):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["node"] == near["src"], "left").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("via"), F.col("component").alias("top"))
        jumped = lower.join(up, lower["component"] == up["via"], "left").select("node", "was", F.least("component", "top").alias("component"))
        new = cut(jumped)
        changed = new.filter(F.col("component") < F.col("was")).limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"no fixpoint after {limit} rounds")
