"""Connected components of a table of links, by alternating large and small stars.

Each round is a few joins and groupings on the link table, which shrinks to one
link from every node to its component's least node; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesostate.llm.common import checkpoint


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every linked node; a node without links to others has no row."""
    greater, lesser = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = checkpoint(links.where(F.col(a) != F.col(b)).select(greater, lesser).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        links = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(links)
        if before == state:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
