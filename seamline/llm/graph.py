"""Connected components of a link table by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.storage import store


def components(links: DataFrame) -> DataFrame:
    """The smallest node that links reach from every linked node.

    ``links`` has two ``bigint`` columns ``a`` and ``b``, in any direction,
    repeats and loops allowed; rows with a null are ignored. Returns one row
    ``(node, root)`` per node that is linked with another one; an empty table
    gives an empty result.

    Every round points each node at the smallest neighbour, first from its larger
    neighbours, then from its smaller ones, until the edges form stars. Minima are
    aggregated before they are shuffled, a hub's edges are only ever joined to one
    row, and the round's edges are written once, so neither lineage nor any task
    grows with a component.
    """
    edges = store(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _fingerprint(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "large-star")
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(nearest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(small.union(nearest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum over them: one row on the driver."""
    hashed = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed)).first())
