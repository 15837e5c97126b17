"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, settle


def _jump(up: DataFrame) -> DataFrame:
    """Each node's root, one pointer further: the root of its root."""
    over = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
    return settle(up.join(over, "root").select("node", F.col("further").alias("root")), "roots")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b), component being the smallest
    node that can be reached. Null ends, loops and repeated links are without effect.

    Each round points every node to its smallest neighbour, follows pointers four steps,
    and replaces link ends by what they point to. Stars vanish in one round, chains of n
    nodes in a logarithmic number of them. All state is in tables, none on the driver.
    """
    tidy = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = settle(tidy.distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b"))
        one = settle(near.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
        two = _jump(one)
        four = _jump(two)
        discard(one, two)
        if labels is None:
            labels = four.select("node", F.col("root").alias("component"))
        else:
            on = four.select(F.col("node").alias("component"), "root")
            labels = settle(labels.join(on, "component", "left")
                            .select("node", F.coalesce("root", "component").alias("component")), "labels")
        ends = (edges.join(four.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
                .join(four.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
                .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))
        past, edges = edges, settle(ends.distinct(), "edges")
        discard(past)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
