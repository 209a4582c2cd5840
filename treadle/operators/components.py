"""Connected components of an edge table, by alternating stars.

Each round connects the larger neighbours of every node to its least neighbour
(large star), then its smaller neighbours (small star); the distance to the
component's least node shrinks geometrically. Rounds are cut in the shared
folder. Neighbourhoods are never collected: a star is a join of the edges with
the least neighbour of each node, whatever its degree.

Defined results: null ends give no edge, an edge to itself makes a component of
one, repeated edges count once, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadle.session import cut


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """``e`` has ``u > v``. Connect a node's larger (or smaller) neighbours to the least one, itself included."""
    if large:
        n = _both(e)
        least = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = n.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(least, "u")
        out = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``; a component is named by its least node."""
    plain = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = plain.select(F.col("a").alias("node")).unionByName(plain.select(F.col("b").alias("node"))).distinct()
    e = cut(plain.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        e = cut(_star(_star(e, True), False), e)
        # xor is enough to see a change: an unchanged edge set is a fixed point
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
