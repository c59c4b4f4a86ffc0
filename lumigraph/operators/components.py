"""Connected components by large-star and small-star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumigraph.session import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours beyond a node (large), or all smaller ones and itself (small), are linked to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    own = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = own.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = own.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` -> ``(id, root)``, root the smallest id linked; self-links and repeats are ignored."""
    cur = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    before = None
    while True:
        nxt = cut(_star(_star(cur, True), False))
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        drop_cut(cur)
        cur, before = nxt, now
    return cur.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(cur.select(F.col("u").alias("id"), F.col("u").alias("root"))).distinct()
