"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step replaces links by links to smaller nodes that connect the same nodes, until all links of a component
lead to its smallest node.  The smallest neighbours are summed up first and written, so that the join that follows
has a plain shuffle on both sides and Spark can split a node with very many links; nothing is collected, and a lost
executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Far above the logarithm of any number of nodes.
MOST_STEPS = 100


def star(links: DataFrame, large: bool, tables: Tables) -> DataFrame:
    """links: (a, b) with a > b. large: link the larger neighbours to the smallest; else the node and its smaller ones."""
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = tables.write(links.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), "star-least")
    joined = links.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return tables.write(out.where(F.col("a") > F.col("b")).distinct(), "star-large" if large else "links")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b) but the smallest of each component, which is ``component``."""
    tables = Tables(links.sparkSession, name)
    now = tables.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct(), "links")
    seal = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    sealed = seal(now)
    for _ in range(MOST_STEPS):
        if not sealed[0]:
            break
        now = star(star(now, True, tables), False, tables)
        before, sealed = sealed, seal(now)
        if before == sealed:
            break
    else:
        raise RuntimeError("components did not settle")
    tables.drop("star-least", "star-large")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
