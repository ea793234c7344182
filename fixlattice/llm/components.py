"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two grouped minima (combined before the shuffle) and a join on the
node, which adaptive execution splits where one node has very many links; no node's
links are ever gathered. A round's links are written to the shared folder. Nodes are of any type with an
order; links of a node to itself and repeated links are ignored, rows with a null node aren't linked. Without links there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.store import discard, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: every greater neighbour of u is linked to u's least neighbour (or u); small star: every lesser one, and u."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(u, root): the least node reachable, for every node of the links (u, v) that isn't itself its root."""
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, narrow=True)
    digest = None
    while True:
        after = written(_star(_star(now, True), False), name, narrow=True)
        # every node has one link, to a node that has none downwards: the stars are final when nothing changes
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if tuple(seen) == digest or not seen[0]:
            return now.select("u", F.col("v").alias("root"))
        digest = tuple(seen)
