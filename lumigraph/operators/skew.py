"""Per-key results when a few keys hold most rows: range partitions, partial states, stitched boundaries.

Rows are range-partitioned on the composite of key, secondary order and a row salt, with bounds from sampled
quantiles, so a heavy key spans as many partitions as its share asks for and a light one lies in one.  Each partition
folds its sorted rows in one pass to a state per key.  Only a partition's first and last key can continue elsewhere;
those boundary states (at most two a partition) are stitched in order, all others are final where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lumigraph.session import cut, ship

STATE = "part int, seq int, edge boolean, key long, n_rows long, n_distinct long, first string, last string, least timestamp, most timestamp"


def _partition_count(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_sorted(df: DataFrame, key: Column, second: Column, partitions: int | None = None) -> DataFrame:
    """``df`` with ``_k``, ``_s`` range-partitioned and sorted by them; equal rows of a hot pair split by a salt."""
    rows = df.withColumns({"_k": key, "_s": second})
    salt = F.monotonically_increasing_id()
    rows = rows.withColumn("_r", salt)
    return rows.repartitionByRange(_partition_count(df, partitions), "_k", "_s", "_r").sortWithinPartitions("_k", "_s")


def partial_states(df: DataFrame, key: Column, second: Column, at: Column, partitions: int | None = None) -> DataFrame:
    """A state per partition and key: rows, distinct secondary values, the first and last of them, and the time span."""
    ship(df.sparkSession)
    rows = spread_sorted(df.select(key.cast("long").alias("k"), second.cast("string").alias("s"), at.cast("timestamp").alias("t")), F.col("k"), F.col("s"), partitions)
    rows = rows.where("_k is not null").select(F.spark_partition_id().alias("p"), "_k", "_s", "t")

    def fold(batches):
        held: _Keys | None = None
        seq = part = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            mine = _Keys.of(b)
            if held is not None:
                mine = held.followed_by(mine)
            last = len(mine.key) - 1
            if last:
                yield mine.rows(slice(0, last), part, seq, seq == 0)
            seq, held = seq + last, mine.only(last)
        if held is not None:
            yield held.rows(slice(0, 1), part, seq, True)

    return rows.mapInArrow(fold, STATE)


NONE = np.iinfo(np.int64)


@dataclass
class _Keys:
    """States of the keys of sorted rows, a column each; ``least`` and ``most`` in microseconds."""

    key: np.ndarray
    n_rows: np.ndarray
    n_distinct: np.ndarray
    first: pa.Array
    last: pa.Array
    least: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(b: pa.RecordBatch) -> _Keys:
        n = b.num_rows
        key, sec = b.column(1).to_numpy(), b.column(2)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        there = sec.is_valid().to_numpy(zero_copy_only=False)
        new = there.copy()  # the first row of a run of an equal secondary value
        new[1:] &= pc.fill_null(pc.not_equal(sec[1:], sec[:-1]), True).to_numpy(zero_copy_only=False) | (key[1:] != key[:-1])
        rows = np.arange(n)
        head = np.minimum.reduceat(np.where(there, rows, n), start)
        tail = np.maximum.reduceat(np.where(there, rows, -1), start)
        none = pa.array(tail < 0)
        pick = lambda at: sec.take(pa.array(at, mask=none.to_numpy(zero_copy_only=False)))
        at = b.column(3)
        us = pc.fill_null(at.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        least, most = np.minimum.reduceat(np.where(known, us, NONE.max), start), np.maximum.reduceat(np.where(known, us, NONE.min), start)
        return _Keys(key[start], np.diff(np.append(start, n)), np.add.reduceat(new.astype(np.int64), start), pick(np.minimum(head, n - 1)), pick(np.maximum(tail, 0)), least, most)

    def only(self, k: int) -> _Keys:
        return _Keys(*(getattr(self, f.name)[k : k + 1] for f in fields(self)))

    def followed_by(self, other: _Keys) -> _Keys:
        """The states of both, where this is one key's and may go on as the other's first."""
        join = lambda a, b: pa.concat_arrays([a, b]) if isinstance(a, pa.Array) else np.concatenate([a, b])
        if self.key[0] != other.key[0]:
            return _Keys(*(join(getattr(self, f.name), getattr(other, f.name)) for f in fields(self)))
        z, a = self.last[0].as_py(), other.first[0].as_py()
        other.n_rows[0] += self.n_rows[0]
        other.n_distinct[0] += self.n_distinct[0] - (a is not None and a == z)
        if z is not None:
            other.first = pa.concat_arrays([self.first, other.first[1:]])
            if a is None:
                other.last = pa.concat_arrays([self.last, other.last[1:]])
        other.least[0], other.most[0] = min(self.least[0], other.least[0]), max(self.most[0], other.most[0])
        return other

    def rows(self, at: slice, part: int, seq: int, edge: bool) -> pa.RecordBatch:
        n = at.stop - at.start
        edges = np.zeros(n, bool)
        edges[0] = edge
        ts = lambda v, none: pa.array(v[at], mask=v[at] == none).cast(pa.timestamp("us", "UTC"))
        cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n, dtype=np.int32)), pa.array(edges), pa.array(self.key[at]), pa.array(self.n_rows[at]), pa.array(self.n_distinct[at]), self.first[at.start : at.stop], self.last[at.start : at.stop], ts(self.least, NONE.max), ts(self.most, NONE.min)]
        return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "edge", "key", "n_rows", "n_distinct", "first", "last", "least", "most"])


def stitch(states: DataFrame) -> DataFrame:
    """``(key, n_rows, n_distinct, least, most)``: interior states as they are, boundary states of a key in order."""
    inner = states.where("not edge").select("key", "n_rows", "n_distinct", "least", "most")

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("seq", "ascending")])
        first, last = t["first"].to_pylist(), t["last"].to_pylist()
        shared, prev = 0, None
        for f, z in zip(first, last):
            shared += f is not None and f == prev
            prev = z if z is not None else prev
        one = lambda v, kind: pa.array([v], kind)
        ts = pa.timestamp("us", "UTC")
        return pa.table({"key": t["key"][:1], "n_rows": one(pc.sum(t["n_rows"]).as_py(), pa.int64()), "n_distinct": one(pc.sum(t["n_distinct"]).as_py() - shared, pa.int64()), "least": one(pc.min(t["least"]).as_py(), ts), "most": one(pc.max(t["most"]).as_py(), ts)})

    edge = states.where("edge").groupBy("key").applyInArrow(join, "key long, n_rows long, n_distinct long, least timestamp, most timestamp")
    return inner.unionByName(edge)


def per_key(df: DataFrame, key: str, second: str, at: str, partitions: int | None = None) -> DataFrame:
    """``(key, n_rows, n_distinct, least, most)`` for every non-null key, without any key holding a task up.

    ``n_rows`` counts all rows, repeats included; ``n_distinct`` the distinct non-null values of ``second``; ``least``
    and ``most`` are the span of ``at``, null if it is.  Rows with a null key are left out; a null ``second`` counts as
    a row only; an empty table gives no rows; further columns, whatever they are called, are not read.
    """
    return stitch(partial_states(df, F.col(key), F.col(second), F.col(at), partitions))


def heavy_keys(df: DataFrame, key: str, second: str, at: str, share: float = 0.05) -> DataFrame:
    """The keys that hold at least ``share`` of the rows with a key, with their counts."""
    counts = cut(per_key(df, key, second, at))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.where(F.col("n_rows") >= F.lit(share) * F.lit(total))
