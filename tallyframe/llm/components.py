"""Connected components of an undirected graph of links, by minimum labels with pointer jumping.

Every round a node takes the least label among its own and its neighbours', then that label's label; rounds grow with the logarithm of the
longest path. Labels are written to the shared folder each round, nothing but a count reaches the driver. Labels of up to MOST_SENT nodes are
broadcast, so that a round shuffles for its two minima alone; beyond it all joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Up to this number of nodes (16 bytes each) labels are broadcast.
MOST_SENT = 1 << 18


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of all nodes of links (a, b); label is the least node that can be reached."""
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "labels")
    sent = F.broadcast if labels.count() <= MOST_SENT else lambda df: df  # every round has the same nodes
    for _ in range(most_rounds):
        seen = both.join(sent(labels), both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        # the label's own node hears of the smaller label too, so that whole trees hook at once
        heard = labels.join(sent(seen), labels["node"] == seen["u"], "left").select("node", "label", F.least("label", "near").alias("new"))
        hooks = heard.where("new < label").groupBy(F.col("label").alias("h")).agg(F.min("new").alias("hook"))
        merged = heard.join(sent(hooks), F.col("node") == F.col("h"), "left").select("node", "label", F.least("new", "hook").alias("new"))
        roots = merged.select(F.col("node").alias("r"), F.col("new").alias("jump"))
        jumped = written(merged.join(sent(roots), F.col("new") == F.col("r"), "left").select("node", F.col("label").alias("old"), F.least("new", "jump").alias("label")), "labels")
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links: these connect labels, so only as many nodes as they touch are looked at again."""
    one, other = (labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}")) for k in ("a", "b"))
    between = links.join(one, "a", "left").join(other, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    tops = components(between).select(F.col("node").alias("old"), F.col("label").alias("top"))
    moved = labels.join(tops, labels["label"] == tops["old"], "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = tops.join(labels, tops["old"] == labels["node"], "left_anti").select(F.col("old").alias("node"), F.col("top").alias("label"))
    return written(moved.unionByName(fresh), "labels")
