"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a > b); the minima are cut first, so that the join of a hub's edges can be split by adaptive execution."""
    if large:
        turned = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        turned = edges
    least = cut(turned.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    joined = turned.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(least.select("a", F.col("m").alias("b")))
    found = cut(out.filter("a > b").distinct())
    drop_cut(least)
    return found


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b): every node a that is not the smallest of its component, with that smallest node b.

    edges: long columns a and b, in any order, repeated or not; loops and nulls are ignored. Without edges the result is empty.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now
        before = state
        wide = _star(now, large=True)
        drop_cut(now)
        now = _star(wide, large=False)
        drop_cut(wide)
