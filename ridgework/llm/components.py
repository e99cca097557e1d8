"""Connected components of a link table, for any size of component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ridgework.session import stage

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link ``(a, b)``; ``component`` is the least node reachable.

    Alternates large-star and small-star steps: each node links its larger neighbours, then its
    smaller ones, to the least neighbour, until nothing changes. The number of links never grows, a
    node's neighbours are only ever reduced to their minimum (no group is gathered), and each round is
    stored in shared scratch space, which cuts the lineage. Links of a node to itself and repeated or
    NULL links count for nothing.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    kind = links.schema["a"].dataType
    edges = stage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        summary = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if summary[0] == 0 or summary == before:
            break
        before = summary
        edges = stage(_small_star(_large_star(edges)), "star")
    else:
        raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
    flat = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return flat.unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
        edges.select(F.col("v").alias("n"), F.col("u").alias("m"))
    )
    # Stored, so that the join shuffles both sides and adaptive execution can split a node with many neighbours.
    least = stage(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("low", "n").alias("low")), "star-least")
    larger = both.where("m > n").join(least, "n")
    return larger.select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    smaller = edges.join(least, "u")
    linked = smaller.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return linked.unionByName(least.select("u", F.col("low").alias("v"))).distinct()
