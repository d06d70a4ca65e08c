"""Connected components of a table of links, by alternating stars.

Each round replaces links by links to smaller neighbours until every node links
to the smallest of its component: O(log n) rounds in practice. Minima are
pre-aggregated before they are shuffled, and are written out before they are
joined, so that Spark can split the partition of a node with many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postworks.llm.scratch import written


def _minima(pairs: DataFrame) -> DataFrame:
    """Smallest of each u's neighbours v and itself."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in links (columns a, b) the smallest id that it is connected with."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Large star: larger neighbours of u go to the smallest neighbour of u.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_minima(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        # Small star: u and its smaller neighbours go to the smallest of them.
        lows = _minima(large)
        joined = large.join(lows, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "edges")
        changed = small.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(small, ["u", "v"], "left_anti").limit(1).count()
        edges = small
        if not changed:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
