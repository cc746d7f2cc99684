"""Connected components of a table of links."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from postlake.sources.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(id, component) of each end of ``links`` (a, b); component is the smallest id that can be reached.

    Each round takes the smallest component among the neighbours and then follows that component's own
    label, so the number of rounds grows with the logarithm of a chain's length. Every round is one
    aggregation with partial sums and joins whose one side has unique keys: a centre with very many links
    is split by adaptive execution. No links give an empty table.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    both = scratch.table(both, f"{label}-links", small=True)
    labels = scratch.table(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")), f"{label}-0", small=True)
    for k in itertools.count(1):
        near = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("seen")), "other").groupBy("id").agg(F.min("seen").alias("seen"))
        nearer = labels.join(near, "id").select("id", "component", F.least("component", "seen").alias("next"))
        jumped = nearer.join(labels.select(F.col("id").alias("next"), F.col("component").alias("beyond")), "next", "left")
        new = scratch.table(jumped.select("id", F.least("next", F.coalesce("beyond", "next")).alias("component"), (F.least("next", F.coalesce("beyond", "next")) != F.col("component")).alias("moved")), f"{label}-{k}", small=True)
        scratch.drop(f"{label}-{k - 1}")
        moving = new.where("moved").limit(1).count()
        labels = new.select("id", "component")
        if not moving:
            return labels
