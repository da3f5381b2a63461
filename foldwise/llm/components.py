"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.store import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Alternating large and small stars: each round hangs a node's neighbours on the smallest of them, first upwards, then
    downwards, until nothing moves, which takes a logarithmic number of rounds. Every round is one shuffle per star and is
    written to the shared folder, so lineage stays short and a lost executor costs a re-read. A hub with many neighbours is
    only aggregated (partial minima) and joined, where adaptive execution can split it.
    Self-links, repeated edges and NULL ends are ignored; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    current = materialize(start.filter(start[2] & (u != v)).select("u", "v").distinct())
    seen = _signature(current)
    while seen[0]:
        both = current.unionByName(current.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.join(low, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        current = materialize(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        found = _signature(current)
        if found == seen:
            break
        seen = found
    roots = current.select(v.alias("node"), v.alias("component")).distinct()
    return current.select(u.alias("node"), v.alias("component")).unionByName(roots)
