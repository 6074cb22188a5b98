"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node of its component) of every node with an edge to another one.

    Edges are undirected, may repeat, and may join a node to itself (no effect); edges with a null are ignored. Each round
    is written to the shared checkpoint folder. The least neighbour of a node is aggregated before the shuffle and written
    before its edges are joined to it: nothing but that join then needs a node's edges together, and Spark may split the
    partition of a node that has very many.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") < F.col("hi")))
        .distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())
        if state == before or state[0] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
        large = (
            both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("x"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        large = cut(large)
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "x"))
        small = large.join(least, F.col("hi") == F.col("x")).select(
            F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("p")
        )
        e = cut(small.select("p.hi", "p.lo").where(F.col("lo") < F.col("hi")).distinct())
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
