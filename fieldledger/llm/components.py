"""Connected components of a graph held in a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import staged


def _links(pairs: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return pairs.where(F.col("a") != F.col("b")).select(low, high).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, the smallest node reachable, for every node of `a`, `b`.

    Every round points each node to its smallest neighbour or to that one's own, merges
    what points together, and goes on with the links that are left, distinct and without
    loops. A node that stays has a neighbour that goes, so rounds at least halve the nodes.
    Each round is written before the next, and no neighbourhood is ever gathered: smallest
    neighbours are found with partial aggregation and links are renamed by joins.
    """
    open_links = staged(_links(links), "component-links")
    labels = None
    while not open_links.isEmpty():
        both = open_links.unionByName(open_links.select(F.col("a").alias("b"), F.col("b").alias("a")))
        up = staged(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")),
            "component-up",
        )
        over = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        hop = staged(up.join(over, "up").select("node", "root"), "component-hop")
        if labels is None:
            labels = hop.select("node", F.col("root").alias("component"))
        else:
            step = hop.select(F.col("node").alias("component"), "root")
            renamed = labels.join(step, "component", "left")
            labels = staged(
                renamed.select("node", F.coalesce("root", "component").alias("component")),
                "component-labels",
            )
        for end in ("a", "b"):
            step = hop.select(F.col("node").alias(end), F.col("root").alias("root"))
            other = "b" if end == "a" else "a"
            open_links = open_links.join(step, end).select(F.col("root").alias(end), other)
        open_links = staged(_links(open_links), "component-links")
    if labels is None:
        kind = links.schema["a"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return labels
