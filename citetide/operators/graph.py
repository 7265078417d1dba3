"""PageRank over directed links."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetide.functions.filters import drop_missing_edges
from citetide.operators.lists import BLOCK, blocked_lists
from citetide.session import pin, unpin

#: Sub-keys over which the blocks of a source are dealt out.
SPREAD = 256


def adjacency(edges: DataFrame, size: int = BLOCK) -> DataFrame:
    """``src, block, targets``: the distinct targets of each source in blocks of at most ``size``; a written table."""
    return blocked_lists(drop_missing_edges(edges.select("src", "dst")), ["src"], ["dst"], size=size, name="targets")


def pagerank(
    edges: DataFrame, iterations: int, damping: float = 0.85, checkpoint_every: int = 5, block: int = BLOCK
) -> DataFrame:
    """``node, rank`` after ``iterations`` rounds of un-normalised PageRank over distinct edges.

    Every node with out-links starts at 1. A round gives each target the sum of ``rank / out-degree`` of
    its sources, times ``damping``, plus ``1 - damping``. A node without in-links leaves the ranking
    after the first round and stops contributing; a node without out-links is ranked but passes nothing
    on; with no rounds the sources keep 1.

    The links are blocks of targets (:func:`adjacency`), shuffled once and kept for all rounds, each source's blocks
    dealt out over ``SPREAD`` sub-keys. So a round joins one row per block instead of one per link, a hub is spread
    whatever its size, and only ranks and summed contributions move. The plan is cut every ``checkpoint_every``
    rounds, and the final ranks are read from the checkpoint folder.
    """
    blocks = adjacency(edges, block)
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = blocks.select("src", F.pmod("block", F.lit(SPREAD)).cast("int").alias("sub"), "targets")
    links = links.repartition(partitions, "src", "sub").persist(StorageLevel.MEMORY_AND_DISK)
    sources = blocks.groupBy("src").agg(F.sum(F.size("targets")).alias("degree"), F.count("*").alias("blocks"))
    subs = F.sequence(F.lit(0), F.least(F.col("blocks"), F.lit(SPREAD)).cast("int") - 1)
    sources = sources.select("src", "degree", subs.alias("subs"))
    sources = sources.repartition(partitions, "src").persist(StorageLevel.MEMORY_AND_DISK)
    steps = [blocks]
    try:
        # the planner trusts the partitioning of a persisted table only once it is filled
        for table in (links, sources):
            table.count()

        ranks = sources.select(F.col("src").alias("node"), F.lit(1.0).alias("rank"))
        for done in range(1, iterations + 1):
            shares = sources.join(ranks.withColumnRenamed("node", "src"), "src")
            shares = shares.select("src", (F.col("rank") / F.col("degree")).alias("share"), F.explode("subs").alias("sub"))
            passed = links.join(shares, ["src", "sub"]).select("share", F.explode("targets").alias("node"))
            ranks = passed.groupBy("node").agg(F.sum("share").alias("got"))
            ranks = ranks.select("node", (F.col("got") * damping + (1 - damping)).alias("rank"))
            if done % checkpoint_every == 0 and done < iterations:
                ranks = pin(ranks)
                steps.append(ranks)
        return pin(ranks)
    finally:
        sources.unpersist()
        links.unpersist()
        unpin(*steps)
