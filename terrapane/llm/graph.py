"""Connected components of a graph of members and hubs, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (member, hub), both long: two members are joined if they share a hub. Gives member, label: the least member reachable.

    Each round takes the least label at each hub (summed up before the shuffle), then the least of its hubs for each
    member, then the label of that label. Rounds grow with the logarithm of the longest path, and stop when no label
    changes; each is written to the shared folder, so a lost executor costs one round.
    """
    edges = materialize(edges.select("member", "hub").distinct(), "edges")
    # what is summed up per hub is written before the join, so that Spark can broadcast it, or split a hub of many members
    least = materialize(edges.groupBy("hub").agg(F.min("member").alias("label")), "hubs")
    labels = materialize(edges.join(least, "hub").groupBy("member").agg(F.min("label").alias("label")), "labels")
    while True:
        hubs = materialize(edges.join(labels, "member").groupBy("hub").agg(F.min("label").alias("label")), "hubs")
        near = edges.join(hubs, "hub").groupBy("member").agg(F.min("label").alias("near"))
        far = labels.select(F.col("member").alias("near"), F.col("label").alias("far"))
        new = labels.join(near, "member").join(far, "near", "left").select("member", F.least("label", "near", "far").alias("label"), F.col("label").alias("old"))
        new = materialize(new, "labels")
        changed = new.where("label < old").limit(1).count()
        labels = new.select("member", "label")
        if not changed:
            return labels
