"""Grouping records into similarity clusters: density clustering over cells with overlapping margins.

Vectors are reduced and spread over cells with margins (:mod:`lumigraph.operators.cells`); each cell is clustered on its own with exact
distances, and local clusters that hold the same core point are one.  A point is core if at least ``min_points``
points, itself included, lie within ``eps``; with ``min_points=1`` every point is core and a cluster is all points
linked within ``eps`` directly or through others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumigraph.llm.boruvka import clean_edges, components
from lumigraph.operators import cells
from lumigraph.operators.similarity import near_rows
from lumigraph.session import cut, ship

DIMS = 128
EPS = 0.6
MARGIN = 0.08  # of EPS = 0.6; tests measure the share of links it keeps
KEPT_AXES = 48  # coordinates of a sketch


def _joined(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows ``a`` and ``b``: always the smallest row number."""
    while len(a):
        la, lb = lab[a], lab[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def roots(c: cells.Cell, eps: float) -> np.ndarray:
    """Of the vectors of a part, the one with the smallest id that each is linked to within the part."""
    lab = np.arange(len(c.m))
    for left, right in cells.lanes(c):
        for a, b, _ in near_rows(c.m, left, right, eps, distances=False):
            lab = _joined(lab, a, b)
    return lab


def by_id(c: cells.Cell) -> cells.Cell:
    """The vectors in the order of their smallest ids, one id each, so that the smallest row number is the smallest id."""
    order = np.argsort(c.first, kind="stable")
    return cells.Cell(np.arange(len(order)), c.first[order], c.m[order], c.tails[order], c.side[order], c.codes)


LOCAL = pa.schema([("rep", pa.int64()), ("root", pa.int64())])


def cluster(df: DataFrame, id_col: str, vec: str, eps: float = EPS, dims: int = DIMS, margin: float | None = None, cell_rows: int = 400, min_points: int = 1) -> DataFrame:
    """``(id, group_id)`` for every id in a group of two or more; ``group_id`` is the smallest id of the group.

    Rows that repeat an id count once (their vectors are linked if they differ); rows with a null id or an unusable
    vector (null, wrong length, null/NaN/infinite values, all zero) are in no group; an empty table gives no rows;
    ties do not matter, the result depends on the set of rows only.  With ``min_points`` above 1 a point that is not
    core joins the group of the smallest core id within ``eps``, and is in none if there is no core point.
    """
    rows = cells.prepare(df, id_col, vec, dims)
    total = df.count()
    margin = MARGIN * eps / EPS if margin is None else margin
    data = cells.sample(df, id_col, vec, dims, total, cells.sample_size(total, cell_rows))
    space = cells.fit(data, total, margin, cell_rows=cell_rows)
    sketch, parts = cells.Reduced(space, KEPT_AXES), cells.partitions_for(df, total)
    placed = cells.spread(rows, space, sketch, dims, parts)
    guests = cells.visitors(placed, sketch, dims, eps, parts)
    # ids with their vectors' hashes; copies go by their smallest id
    ids = cut(rows.groupBy("id", "h", "g").agg(F.count("*").alias("_n")).select("id", "h", "g"))
    copies = ids.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    if min_points > 1:
        return _dense(placed, guests, sketch, dims, eps, ids, copies, min_points)

    def run(c: cells.Cell) -> pa.Table:
        c = by_id(c)
        lab = roots(c, eps)
        many = np.bincount(lab, minlength=len(lab))[lab] > 1
        return pa.table({"rep": c.ids[many], "root": c.ids[lab[many]]}, schema=LOCAL)

    local = cells.meet(placed, guests, sketch, dims, run, "rep long, root long")
    # a point of several cells joins their local clusters; most points are in one cluster only
    member = cut(local.groupBy("rep").agg(F.collect_set("root").alias("roots")).select("rep", F.array_min("roots").alias("root"), F.when(F.size("roots") > 1, F.col("roots")).alias("roots")))
    links = member.where("roots is not null").select(F.col("root").alias("x"), F.explode("roots").alias("y"))
    twice = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("twice"))
    named = _by_copies(ids, copies).join(twice, "id", "left").withColumn("twice", F.coalesce("twice", F.lit(False)))
    # an id delivered with different vectors links them
    root_of = named.join(member.select("rep", "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"), F.col("root").isNotNull().alias("linked"), "copied", "twice")
    other = root_of.where("twice").groupBy("id").agg(F.min("root").alias("x"), F.collect_set("root").alias("ys")).select("x", F.explode("ys").alias("y"))
    merged = components(clean_edges(links.unionByName(other), "x", "y")).select(F.col("id").alias("root"), "group_id")
    return root_of.where("linked or copied or twice").join(merged, "root", "left").select("id", F.coalesce("group_id", "root").alias("group_id")).groupBy("id").agg(F.min("group_id").alias("group_id"))


SALTS = 16


def _by_copies(ids: DataFrame, copies: DataFrame) -> DataFrame:
    """``(id, h, g, rep, copied)``; a vector with very many copies is met in ``SALTS`` places."""
    salted = copies.select("h", "g", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = ids.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["h", "g", "salt"], "left").select("id", "h", "g", F.coalesce("rep", "id").alias("rep"), F.col("rep").isNotNull().alias("copied"))


def _dense(placed, guests, sketch, dims: int, eps: float, ids: DataFrame, copies: DataFrame, min_points: int) -> DataFrame:
    """Groups where not every point is core: degrees first, then links among core points, then the points at borders."""

    def pairs(c: cells.Cell) -> pa.Table:
        c = by_id(c)
        found = [(a, b) for left, right in cells.lanes(c) for a, b, _ in near_rows(c.m, left, right, eps, distances=False)]
        a, b = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        a, b = c.ids[a], c.ids[b]
        return pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b)}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    near = cut(cells.meet(placed, guests, sketch, dims, pairs, "u long, v long").distinct())
    weight = copies.select(F.col("rep").alias("p"), F.col("n").alias("w"))
    named = cut(_by_copies(ids, copies))
    both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(weight, both.v == weight.p, "left").groupBy("u").agg(F.sum(F.coalesce("w", F.lit(1))).alias("d"))
    reps = named.select("rep").distinct()
    size = reps.join(weight, reps.rep == weight.p, "left").join(degree, reps.rep == degree.u, "left").select("rep", (F.coalesce("w", F.lit(1)) + F.coalesce("d", F.lit(0))).alias("n"))
    core = cut(size.where(F.col("n") >= min_points).select("rep"))
    of = lambda c: core.select(F.col("rep").alias(c))
    inner = near.join(of("u"), "u", "left_semi").join(of("v"), "v", "left_semi")
    twice = named.join(core, "rep", "left_semi").groupBy("id").agg(F.min("rep").alias("u"), F.collect_set("rep").alias("vs")).where(F.size("vs") > 1).select("u", F.explode("vs").alias("v"))
    grouped = components(clean_edges(inner.unionByName(twice), "u", "v")).select(F.col("id").alias("rep"), "group_id")
    roots_ = core.join(grouped, "rep", "left").select("rep", F.coalesce("group_id", "rep").alias("root"))
    border = both.join(of("u"), "u", "left_anti").join(of("v"), "v", "left_semi").groupBy("u").agg(F.min("v").alias("core"))
    border = border.join(roots_.withColumnRenamed("rep", "core"), "core").select(F.col("u").alias("rep"), "root")
    placed_ids = named.join(roots_.unionByName(border), "rep").groupBy("id").agg(F.min("root").alias("root"))
    several = placed_ids.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("group_id")).where("n > 1")
    return placed_ids.join(several, "root").select("id", "group_id")


def describe(df: DataFrame, groups: DataFrame, id_col: str, vec: str, dims: int = DIMS, top: int = 3) -> DataFrame:
    """Per group: its size and its ``top`` most typical members.

    The medoid under squared distance is the member nearest to the mean, so partial sums per batch, not pairs, give
    it exactly.  ``(group_id, n_members, medoid, typical)``; ties go to the smaller id.
    """
    ship(df.sparkSession)
    one = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(cells.usable("vec", dims))

    def packed(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), cells.pack(cells.matrix(b.column(1), dims))], names=["id", "code"])

    rows = one.mapInArrow(packed, "id long, code binary").groupBy("id").agg(F.min("code").alias("code"))
    joined = cut(rows.join(groups.select("id", "group_id"), "id"))

    def partial(batches):
        for b in batches:
            g = b.column(0).to_numpy()
            if len(g):
                keys, inv = np.unique(g, return_inverse=True)
                s = np.zeros((len(keys), dims))
                np.add.at(s, inv, cells.unpack(b.column(1), dims)[0])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(inv)), pa.array(list(s), pa.list_(pa.float64()))], names=["group_id", "n", "s"])

    parts = joined.select("group_id", "code").mapInArrow(partial, "group_id long, n long, s array<double>")
    salted = parts.groupBy("group_id", F.pmod(F.monotonically_increasing_id(), F.lit(32)).alias("salt"))

    def add(t: pa.Table) -> pa.Table:
        s = cells.matrix(t["s"], dims).sum(0)
        return pa.table({"group_id": t["group_id"][:1], "n": [sum(t["n"].to_pylist())], "s": pa.array([s], pa.list_(pa.float64()))})

    parts = salted.applyInArrow(add, "group_id long, n long, s array<double>")
    means = parts.groupBy("group_id").applyInArrow(add, "group_id long, n long, s array<double>")

    def far(batches):
        for b in batches:
            m, s = cells.unpack(b.column(2), dims)[0], cells.matrix(b.column(4), dims)
            d = np.round(np.sqrt(((m - s / b.column(3).to_numpy()[:, None]) ** 2).sum(1)), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(d)], names=["group_id", "id", "n", "d"])

    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")  # a very large group meets its mean in several places
    means = means.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = joined.withColumn("salt", salt).join(means, ["group_id", "salt"]).select("group_id", "id", "code", "n", "s").mapInArrow(far, "group_id long, id long, n long, d double")
    # Spark limits every window group before its shuffle, so at most ``top`` rows a group leave a task
    w = Window.partitionBy("group_id").orderBy("d", "id")
    best = near.select("*", F.row_number().over(w).alias("rn")).where(F.col("rn") <= top)
    best = best.groupBy("group_id").agg(F.max("n").alias("n_members"), F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("t"))
    return best.select("group_id", "n_members", F.col("t")[0]["id"].alias("medoid"), F.col("t.id").alias("typical"))
