"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.session import pin, unpin


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node in ``links`` (``a``, ``b``).

    A large star links the larger neighbours of a node to its smallest neighbour, a small star the smaller ones.
    Both are a minimum by node and a join, so a node with very many links is never gathered in one place. A round
    ends in a table in the shared folder; the rounds, of which there are about as many as the logarithm of the
    longest chain, end when a round changes no link. Null ends and loops are ignored.
    """
    edges = pin(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a != b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lower, "a").select(
            F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")
        )
        last, edges = edges, pin(small.select("e.a", "e.b").where("a != b").distinct())
        unpin(last)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pin(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of the set of links."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)
