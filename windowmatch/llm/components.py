"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmatch.llm.shared import Staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest node around it."""
    both = edges.select("hi", "lo").union(edges.select(F.col("lo"), F.col("hi"))).toDF("node", "near")
    least = both.groupBy("node").agg(F.min("near").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    return (
        both.where("near > node")
        .join(least, "node")
        .where("near <> least")
        .select(F.col("near").alias("hi"), F.col("least").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = (
        edges.join(least, "hi")
        .where("lo <> least")
        .select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    )
    return moved.union(least.select("hi", F.col("least").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> Staged:
    """The smallest node that each linked node can reach.

    ``links`` holds two long columns; order, repetition and links of a node with itself do not
    matter, NULL ends are left out. Returns a staged table (node, root) with a row for every node
    that is linked with another one, the root itself included. Each round is written to the shared
    folder, so no plan grows with the number of rounds and a lost executor repeats one round at most.
    No step needs the links of a node in one task: groups are only reduced to their minimum.
    """
    a, b = links.columns
    start = links.where(f"{a} <> {b}").select(
        F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")
    )
    edges = Staged(start.distinct(), "links")
    state = _state(edges.frame)
    while state[0]:
        following = Staged(_small_star(_large_star(edges.frame)), "links")
        edges.drop()
        edges, before, state = following, state, _state(following.frame)
        if state == before:
            break
    roots = edges.frame
    nodes = roots.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    result = Staged(nodes.union(roots.select("lo", "lo").distinct()), "components")
    edges.drop()
    return result
