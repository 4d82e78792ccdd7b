"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _contract(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node hands its neighbours to the smallest of them.

    The minimum of each node comes from an aggregation with partial sums, and goes back by a join that may be split when a
    node has very many neighbours; no list of neighbours is ever built."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    met = both.join(low, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) -> (id, component): for every id in a link the smallest id reachable from it.

    Self-links and repeated links are allowed; rows with a null end are left out. Each round is cut by a checkpoint."""
    pairs = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        pairs = cut(_contract(_contract(pairs, True), False))
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select("b").distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("id"), F.col("b").alias("component")))
