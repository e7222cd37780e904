"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, discard


def _shape(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _star(arcs: DataFrame, larger_only: bool) -> DataFrame:
    """Hang the neighbours v of each u on the least node among u and all v.

    The least neighbour is an aggregate, and the neighbours meet it in a join:
    no task holds the neighbours of one node.
    """
    least = arcs.groupBy("u").agg(F.min("v").alias("m"))
    met = arcs.join(least.withColumn("m", F.least("m", "u")), "u")
    hung = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if larger_only:
        return hung.where(met["v"] > met["u"]).distinct()
    own = least.select("u", F.col("m").alias("v"))
    return hung.where(F.col("u") != F.col("v")).union(own).distinct()


def connected(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Edges (u, v) of 64-bit nodes to rows (node, root); root is the least node.

    The roots themselves are not listed. Loops and repeated edges do no harm.
    """
    now = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    shape = _shape(now)
    for _ in range(max_rounds):
        if shape[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger_only=True)
        after = cut_lineage(_star(large, larger_only=False))
        before, shape = shape, _shape(after)
        discard(now)
        now = after
        if shape == before:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
