"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import discard, shuffled, stash


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, component)``; ``component`` is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then follows that label twice (pointer
    jumping), so chains shorten geometrically. Labels are written to the shared folder each round: plans stay short and
    a lost executor costs one round. Nodes without an edge are absent from the result; self loops and repeated edges
    are harmless; an empty edge table gives an empty result.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    links = stash(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = stash(
        links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")),
        "labels",
    )
    for _ in range(max_rounds):
        spread = (
            links.join(shuffled(labels), links["b"] == labels["node"])
            .groupBy(links["a"].alias("to"))
            .agg(F.min("component").alias("offer"))
        )
        lowered = labels.join(shuffled(spread), labels["node"] == spread["to"], "left").select(
            "node", F.col("component").alias("before"), F.least("component", "offer").alias("label")
        )
        parent = labels.select(F.col("node").alias("p"), F.col("component").alias("up"))
        jumped = lowered.join(shuffled(parent), lowered["label"] == parent["p"], "left").select(
            "node", "before", F.least("label", "up").alias("component")
        )
        turned = stash(jumped, "labels")
        changed = turned.where("component <> before").limit(1).count()
        discard(labels)
        labels = turned.select("node", "component")
        labels._stash_path = turned._stash_path
        if not changed:
            discard(links)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
