"""Density clustering, centroids and suggestions to merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumigraph.operators import cells
from lumigraph.operators.components import components
from lumigraph.operators.similarity import cell_join, cell_pairs, distance_join
from lumigraph.session import cut, ship

NOISE = -1
SALTS = 16


def numbered(roots: DataFrame) -> DataFrame:
    """Cluster ids 0, 1, ... in the order of the smallest face: the ranks of distinct roots, summed over ranges."""
    heads = roots.select("root").distinct()
    ranges = heads.repartitionByRange("root").withColumn("p", F.spark_partition_id())
    ranges = cut(ranges)
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))  # one row a range
    rank = F.row_number().over(Window.partitionBy("p").orderBy("root"))
    ids = ranges.withColumn("r", rank).join(F.broadcast(before), "p").select("root", (F.col("before") + F.col("r") - 1).cast("int").alias("cluster_id"))
    return roots.join(ids, "root").select("id", "cluster_id")


def dbscan(df: DataFrame, id_col: str, vec: str, eps: float, min_samples: int = 1, exact: bool = False, dims: int = 128) -> DataFrame:
    """``(id, cluster_id)``: clusters of core points within ``eps``; the count of a point's neighbours includes itself.

    A border point joins the smallest adjacent core point's cluster, whichever way points are visited; noise is -1.
    Links come from the join in cells, which works on tables of any size and usable vectors of ``dims`` values; with
    ``exact`` from the join of all blocks, for small tables of vectors of any length.  An empty table gives no rows.
    """
    if exact:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec")).where("id is not null and vec is not null")
        near, ids = distance_join(rows, "id", "vec", eps), rows.select("id").distinct()
        members = ids.where("false").select(F.col("id").alias("rep"), "id")
    else:
        near, members = cell_pairs(df, id_col, vec, eps, dims=dims)
        ids = cells.prepare(df, id_col, vec, dims).select("id").distinct()
    edges = cut(near.select(F.col("i").alias("u"), F.col("j").alias("v")).distinct())
    members = cut(members)
    reps = cut(ids.join(members, "id", "left_anti"))
    weight = members.groupBy(F.col("rep").alias("p")).agg((F.count("*") + 1).alias("w"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    core = reps
    if min_samples > 1:
        degree = both.join(weight, both.v == weight.p, "left").groupBy("u").agg(F.sum(F.coalesce("w", F.lit(1))).alias("d"))
        size = reps.join(weight, reps.id == weight.p, "left").join(degree, reps.id == degree.u, "left").select("id", (F.coalesce("w", F.lit(1)) + F.coalesce("d", F.lit(0))).alias("n"))
        core = cut(size.where(F.col("n") >= min_samples).select("id"))
    inner = edges if min_samples <= 1 else edges.join(core.select(F.col("id").alias("u")), "u", "left_semi").join(core.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")
    linked = components(inner)
    roots = cut(core.join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    named = numbered(roots)
    if min_samples > 1:
        border = both.join(core.select(F.col("id").alias("u")), "u", "left_anti").join(named.select(F.col("id").alias("v"), "cluster_id"), "v").groupBy("u").agg(F.min("cluster_id").alias("cluster_id"))
        rest = reps.join(core, "id", "left_anti").join(border, F.col("id") == F.col("u"), "left").select("id", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"))
        named = named.unionByName(rest)
    if exact:
        return named
    named = cut(named)
    salted = named.select(F.col("id").alias("rep"), "cluster_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).join(weight.select(F.col("p").alias("rep")), "rep", "left_semi")
    copies = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["rep", "salt"])
    # an id delivered with several vectors is in the smallest of their clusters
    return named.unionByName(copies.select("id", "cluster_id")).groupBy("id").agg(F.coalesce(F.min(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))), F.lit(NOISE)).alias("cluster_id"))


def current_labels(assignment: DataFrame) -> DataFrame:
    """``(face_id, cluster_id)``: the label of the latest run; ties go to the larger label, null labels are none."""
    best = assignment.where("face_id is not null").groupBy("face_id").agg(F.max(F.struct("assigned_at", "cluster_id")).alias("m"))
    return best.select("face_id", F.col("m.cluster_id").alias("cluster_id")).where("cluster_id is not null")


def person_labels(labels: DataFrame) -> DataFrame:
    """Labels without noise: -1 is not a person."""
    return labels.where(F.col("cluster_id") != NOISE)


SCALE = 10**9  # sums are whole billionths, so that their order does not matter


def centroids(faces: DataFrame, labels: DataFrame, dims: int = 128) -> DataFrame:
    """``(cluster_id, n_faces, vec)``: the means of the faces' vectors, all of ``dims`` values.

    Vectors are summed per batch, batch sums per cluster; a cluster with very many faces has a sum a batch, which are
    added up in ``SALTS`` places first.  Coordinates count to nine decimals, up to some billions in all.
    """
    ship(faces.sparkSession)

    def partial(batches):
        for b in batches:
            if b.num_rows:
                keys, inv = np.unique(b.column(0).to_numpy(), return_inverse=True)
                s = np.zeros((len(keys), dims), np.int64)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
                np.add.at(s, inv, np.rint(v * SCALE).astype(np.int64))
                yield _sums(keys, np.bincount(inv), s)

    def add(t: pa.Table) -> pa.Table:
        s = t["s"].combine_chunks().flatten().to_numpy().reshape(-1, dims).sum(0, keepdims=True)
        return pa.Table.from_batches([_sums(t["cluster_id"][:1].to_numpy(), np.array([t["n"].to_numpy().sum()]), s)])

    schema = "cluster_id int, n long, s array<long>"
    parts = faces.join(labels, "face_id").select("cluster_id", "encoding").mapInArrow(partial, schema)
    salted = parts.groupBy("cluster_id", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")).applyInArrow(add, schema)
    whole = salted.groupBy("cluster_id").applyInArrow(add, schema)
    return whole.select("cluster_id", F.col("n").alias("n_faces"), F.transform("s", lambda x: x.cast("decimal(28,0)").cast("double") / F.lit(float(SCALE)) / F.col("n")).alias("vec"))


def _sums(keys: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(n.astype(np.int64)), flat], names=["cluster_id", "n", "s"])


def merge_suggestions(centroid: DataFrame, threshold: float = 0.6, exact: bool = False) -> DataFrame:
    """``(id1, id2)``, sorted, of clusters whose means are closer than ``threshold`` (strictly).

    Clusters with the same mean are each suggested with the smallest of them only.
    """
    one = centroid.where(F.col("vec").isNotNull()).groupBy("cluster_id").agg(F.first("vec").alias("vec"))
    near = (distance_join if exact else cell_join)(one, "cluster_id", "vec", threshold, strict=True)
    return near.select(F.col("i").cast("int").alias("id1"), F.col("j").cast("int").alias("id2"))
