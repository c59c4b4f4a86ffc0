"""Distance joins: in cells with margins for large tables, or exact in blocks, where every pair of blocks is one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumigraph.operators import cells
from lumigraph.session import cut, ship

BLOCK_ROWS = 4_000


def distance_join(df: DataFrame, id_col: str, vec: str, limit: float, strict: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(i, j, d)`` with ``i < j`` for every two ids within ``limit`` (below it, if ``strict``).

    For small tables: every row is copied to each of n / ``block_rows`` blocks.  All pairs are compared, none are emitted but those within; ids of a null or empty vector, or of another length
    than the vector they meet, match nothing.  A repeated id must repeat its vector.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    n = rows.count()
    k = max(1, -(-n // block_rows))
    b = F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    placed = rows.select("id", "v", b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("o"))
    placed = placed.select("id", "v", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), (F.col("b") <= F.col("o")).alias("low"))

    def run(t: pa.Table) -> pa.Table:
        ids, first = np.unique(t["id"].to_numpy(), return_index=True)
        v = t["v"].combine_chunks().take(pa.array(first))
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        low = t["low"].to_numpy()[first]
        same = t["x"][0].as_py() == t["y"][0].as_py()
        lengths, values = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).astype(float)
        begin = np.cumsum(lengths) - lengths
        out = [[], [], []]
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            cut_at = len(at)
            if not same:  # the rows of one block first: they meet those of the other only
                at = np.concatenate([at[low[at]], at[~low[at]]])
                cut_at = int(low[at].sum())
            m = values[begin[at][:, None] + np.arange(d)]
            sq = (m * m).sum(1)
            for s in range(0, cut_at, 512):
                e, o = min(s + 512, cut_at), s if same else cut_at
                d2 = sq[s:e, None] + sq[o:] - 2 * m[s:e] @ m[o:].T
                p, q = np.nonzero(d2 <= limit * limit + 1e-6 * (1 + sq.max()))
                p, q = p + s, q + o
                keep = p < q
                p, q = p[keep], q[keep]
                dist = np.sqrt(((m[p] - m[q]) ** 2).sum(1))
                ok = dist < limit if strict else dist <= limit
                i, j = ids[at[p[ok]]], ids[at[q[ok]]]
                out[0].append(np.minimum(i, j))
                out[1].append(np.maximum(i, j))
                out[2].append(dist[ok])
        z = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"i": pa.array(z[0].astype(np.int64)), "j": pa.array(z[1].astype(np.int64)), "d": pa.array(z[2].astype(float))})

    return placed.groupBy("x", "y").applyInArrow(run, "i long, j long, d double")


MARGIN = 0.08  # of a limit of 0.6; tests measure the share of pairs it keeps
SALTS = 16


def near_rows(m: np.ndarray, left: np.ndarray, right: np.ndarray, limit: float, strict: bool = False, distances: bool = True, block: int = 4_000_000):
    """``(i, j, distance)`` of rows of ``m`` within ``limit``, one of ``left`` and one of ``right`` (once each, if they are the same).

    Without ``distances`` only those near the limit are measured exactly, and none are told: the pairs are the same.
    """
    f = m.astype(np.float32)
    sq = (f * f).sum(1)
    slack = 1e-4 * max(1.0, float(sq.max(initial=0.0)))
    fr, sr = f[right], sq[right]
    step = max(1, block // max(len(right), 1))
    for s in range(0, len(left), step):
        d2 = sq[left[s : s + step], None] + sr - 2 * (f[left[s : s + step]] @ fr.T)
        a, b = np.nonzero(d2 <= limit * limit + slack)
        keep = a + s < b if left is right else np.ones(len(a), bool)
        open_ = (d2[a, b] > limit * limit - slack)[keep]
        a, b = left[a[keep] + s], right[b[keep]]
        if not distances:
            yield a[~open_], b[~open_], None
            a, b = a[open_], b[open_]
        for o in range(0, len(a), 100_000):
            p, q = a[o : o + 100_000], b[o : o + 100_000]
            d = np.sqrt(((m[p] - m[q]) ** 2).sum(1))
            ok = d < limit if strict else d <= limit + 1e-9
            yield p[ok], q[ok], d[ok]


PAIRS = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())])


def cell_pairs(df: DataFrame, id_col: str, vec: str, limit: float, strict: bool = False, dims: int = 128, margin: float | None = None, cell_rows: int = 400) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(i, j, d)`` of distinct vectors within ``limit``, each by its smallest id, and ``(rep, id)`` of their other ids.

    For tables of any size; only usable vectors of ``dims`` values match.  Distances are exact.  Two vectors of
    different cells are missed only if they lie further apart along the normal of the plane between them than twice the
    margin; at 0.08 for a limit of 0.6 no pair of the test tables is.  Copies of one vector are not paired with each
    other one by one, so no group of copies is expanded.
    """
    rows = cells.prepare(df, id_col, vec, dims)
    total = df.count()
    margin = MARGIN * limit / 0.6 if margin is None else margin
    data = cells.sample(df, id_col, vec, dims, total, cells.sample_size(total, cell_rows))
    space = cells.fit(data, total, margin, cell_rows=cell_rows)
    sketch, parts = cells.Reduced(space), cells.partitions_for(df, total)
    placed = cells.spread(rows, space, sketch, dims, parts)
    guests = cells.visitors(placed, sketch, dims, limit, parts)

    def run(c: cells.Cell) -> pa.Table:
        found = [x for left, right in cells.lanes(c) for x in near_rows(c.m, left, right, limit, strict)]
        a, b, d = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64 if k < 2 else float) for k in range(3))
        first = c.first
        return pa.table({"i": np.minimum(first[a], first[b]), "j": np.maximum(first[a], first[b]), "d": d}, schema=PAIRS)

    near = cells.meet(placed, guests, sketch, dims, run, "i long, j long, d double").groupBy("i", "j").agg(F.min("d").alias("d"))
    ids = cut(rows.groupBy("id", "h", "g").agg(F.count("*").alias("_n")).select("id", "h", "g"))
    copies = ids.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    salted = copies.select("h", "g", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a vector may have very many copies
    members = ids.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "g", "salt"])
    return near.where("i <> j"), members.where("id <> rep").select("rep", "id")


def cell_join(df: DataFrame, id_col: str, vec: str, limit: float, **how) -> DataFrame:
    """``(i, j, d)`` with ``i < j``: the pairs of :func:`cell_pairs`, and each further copy with the first one, at 0."""
    near, members = cell_pairs(df, id_col, vec, limit, **how)
    return near.unionByName(members.select(F.col("rep").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"))).groupBy("i", "j").agg(F.min("d").alias("d"))
