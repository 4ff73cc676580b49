"""Connected components of links between rows, by alternating large-star and small-star steps.

A hub's links stay where they are if there are very many: its least neighbour comes to them by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import joined_by, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with b < a. Each row's neighbours get the least of them (and of itself) instead of the row.

    large: the neighbours above the row; else those below it, and the row itself.
    """
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = written(least.select("a", F.least("a", "m").alias("m") if large else "m", "n"), "least-neighbours")
    joined = joined_by(both, least, ["a"], "n")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("b < a").distinct()


def components(links: DataFrame) -> DataFrame:
    """row, root (the component's least row) for each row of links (a, b: long), roots included."""
    links = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        # Links no longer change once each row points to its component's root.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        links = written(_stars(_stars(links, large=True), large=False), "links")
    roots = links.select(F.col("b").alias("row")).distinct().select("row", F.col("row").alias("root"))
    return links.select(F.col("a").alias("row"), F.col("b").alias("root")).unionByName(roots)
