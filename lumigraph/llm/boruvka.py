"""Consolidating pairwise matches into groups: deterministic Boruvka hooking on DataFrames.

Every component selects its smallest outgoing edge, the selected edges form trees whose only cycles are
two components that chose each other, pointer doubling collapses every tree to its root, edges are relabelled
and deduplicated, and this repeats until no edge is left.  A round at least halves the number of components
that still have an edge, so there are at most log2(n) rounds, each of them joins and map-side combined
aggregates on keys; nothing is collected, no group meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumigraph.session import cut, drop_cut


def clean_edges(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``(u, v)`` with ``u < v``, distinct.  Pairs with a null id or of an id with itself carry no link."""
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), a.isNull().alias("_x"), b.isNull().alias("_y")).where("not _x and not _y and u <> v").select("u", "v").distinct()


def _roots(parent: DataFrame) -> DataFrame:
    """``(c, p)`` -> ``(c, p)`` with every ``p`` a root, by pointer doubling."""
    while True:
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("q"))
        nxt = parent.join(up, "p").select("c", F.col("q").alias("p"), F.col("p").alias("was"))
        up2 = nxt.select(F.col("c").alias("p"), F.col("p").alias("q"))
        nxt = cut(nxt.join(up2, "p").select("c", F.col("q").alias("p"), F.col("was")))
        drop_cut(parent)
        moved = nxt.where("p <> was").limit(1).count()
        parent_path = nxt
        parent = nxt.select("c", "p")
        parent._lumigraph_path = parent_path._lumigraph_path
        if not moved:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges, distinct and ``u < v`` -> ``(id, group_id)`` for every id of an edge.

    ``group_id`` is the smallest id linked to it directly or through others.  No edges give no rows; repeated
    edges and any order of rows give the same result.
    """
    first = cut(edges.select("u", "v"))
    live = first.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("u", "v").alias("w"))
    hold, labels = None, None
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        best = both.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select(F.col("a").alias("c"), F.col("m.b").alias("p"))
        best = cut(best)
        back = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        # two components that chose the same edge: the smaller becomes the root
        tree = cut(best.join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        drop_cut(best)
        root = _roots(tree)
        ra, rb = root.select(F.col("c").alias("a"), F.col("p").alias("ra")), root.select(F.col("c").alias("b"), F.col("p").alias("rb"))
        moved = live.join(ra, "a").join(rb, "b").where("ra <> rb")
        nxt = cut(moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("w").alias("w")))
        if labels is None:
            new = cut(root.select(F.col("c").alias("id"), F.col("p").alias("comp")))
        else:
            step = root.select(F.col("c").alias("comp"), F.col("p").alias("up"))
            new = cut(labels.join(step, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")))
        for old in (hold, labels, root):
            drop_cut(old)
        live, hold, labels = nxt, nxt, new
    if labels is None:
        return edges.sparkSession.createDataFrame([], "id long, group_id long")
    drop_cut(first)
    least = labels.groupBy("comp").agg(F.min("id").alias("group_id"))
    return labels.join(least, "comp").select("id", "group_id")


def group_pairs(pairs: DataFrame, left: str = "id1", right: str = "id2") -> DataFrame:
    """Group ids of all ids that ``pairs`` links: ``(id, group_id)``.

    Rows with a null id, and ids paired with themselves, make no link and no row; either order and repeats count
    once; further columns (a distance, a time) are ignored whatever they are called; an empty table gives none.
    """
    return components(clean_edges(pairs, left, right))
