"""Cells of vector space with overlapping margins: the partitioning that distance joins, clustering and neighbour search share.

A bounded sample gives a mean, the leading principal directions and k-means pivots of the reduced vectors.  Every
vector goes, whole, to the cell of its nearest pivot, its home; to each cell whose bisecting plane is within ``margin``
of it goes only a sketch of a few bytes.  A cell compares its vectors with the sketches that lie over from other
cells.  A sketch bounds the distance from below, so no pair within the limit is passed over; where one may be within
it, the cell sends its own vector to the home of the other, which then holds both and measures exactly.  Two vectors of
different cells are missed only if they lie further apart along the normal of the dividing plane than twice the
margin.  Every row is placed, none is sampled away: only the pivots come from the sample.

A cell that the sample expects to outgrow ``block_rows`` is split into blocks whose pairs are the tasks, so a hot
cell is many tasks and all its pairs are covered.  Copies of one vector are collapsed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumigraph.session import ship

SAMPLE_ROWS = 65_536  # bound of the sample that pivots and codebooks are fitted on
MAX_PIVOTS = 16_384  # at most 6 MB broadcast
PART_ROWS = 200_000  # vectors a shuffle partition
FLUSH_ROWS = 32_768  # rows whose segments are written together
SEED = 20_011


def usable(vec: str, dims: int) -> Column:
    """``dims`` finite values, not all zero; a null, short or empty vector, or one with null, NaN or infinity, is not."""
    v = F.col(vec)
    hi, lo = F.array_max(v), F.array_min(v)
    inf = float("inf")
    return v.isNotNull() & (F.size(v) == dims) & (F.size(F.array_compact(v)) == dims) & ~F.isnan(hi) & (hi < inf) & (lo > -inf) & ((hi != 0) | (lo != 0))


def prepare(df: DataFrame, id_col: str, vec: str, dims: int) -> DataFrame:
    """``(id, h, g, vec)`` of the usable rows; ``h, g`` are 128 bits of hash of the exact values (-0.0 counts as 0.0)."""
    v = F.col(vec).cast("array<double>")
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(usable("vec", dims)).select("id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(7), "vec").alias("g"), "vec")


def matrix(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


# ---------------------------------------------------------------- compact, lossless vectors


def pack(m: np.ndarray, tail: np.ndarray | None = None) -> pa.Array:
    """Rows as binary, lossless: values that are whole thousandths take 10 or 16 bits each, any others 64.

    ``tail`` holds further bytes of each row.
    """
    n, d = m.shape
    extra = 0 if tail is None else tail.shape[1]
    if not n:
        return pa.array([], pa.binary())
    q = np.rint(m * 1000)
    ok = (q / 1000 == m).all(1) & (np.abs(q) < 32_000).all(1)
    i = np.where(ok[:, None], q, 0).astype(np.int32)
    u = ((i << 1) ^ (i >> 31)).astype(np.uint16)
    small = ok & (u.max(1) < 1024) & (d % 4 == 0)
    width = np.where(small, d + d // 4, np.where(ok, 2 * d, 8 * d)).astype(np.int64) + extra
    off = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=off[1:])
    out = np.empty(off[-1], np.uint8)
    for kind, make in ((small, _ten), (ok & ~small, lambda r: u[r].view(np.uint8).reshape(len(r), -1)), (~ok, lambda r: np.ascontiguousarray(m[r]).view(np.uint8).reshape(len(r), -1))):
        rows = np.flatnonzero(kind)
        if len(rows):
            body = make(u[rows]) if make is _ten else make(rows)
            body = body if tail is None else np.concatenate([body, tail[rows]], axis=1)
            out[off[rows][:, None] + np.arange(body.shape[1])] = body
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _ten(u: np.ndarray) -> np.ndarray:
    hi = (u >> 8).astype(np.uint8).reshape(len(u), -1, 4)
    return np.concatenate([u.astype(np.uint8), hi[:, :, 0] | hi[:, :, 1] << 2 | hi[:, :, 2] << 4 | hi[:, :, 3] << 6], axis=1)


def unpack(col: pa.Array | pa.ChunkedArray, d: int, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and the ``extra`` bytes of each row."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    wide = pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
    out, width, tail = np.empty((n, d)), np.diff(off) - extra, np.empty((n, extra), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        tail[rows] = data[off[rows][:, None] + w + np.arange(extra)]
        body = data[off[rows][:, None] + np.arange(w)]
        if w == 8 * d:
            out[rows] = np.ascontiguousarray(body).view(np.float64)
            continue
        if w == 2 * d:
            u = np.ascontiguousarray(body).view(np.uint16).astype(np.int32)
        else:
            hi = np.stack([body[:, d:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(rows), d)
            u = body[:, :d].astype(np.int32) | hi.astype(np.int32) << 8
        out[rows] = ((u >> 1) ^ -(u & 1)) / 1000
    return out, tail


# ---------------------------------------------------------------- the space


@dataclass(frozen=True)
class Space:
    """Mean, directions and pivots; ``blocks[c]`` is into how many blocks cell ``c`` is split."""

    mean: np.ndarray
    axes: np.ndarray
    pivots: np.ndarray
    blocks: np.ndarray
    margin: float
    _gaps: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_gaps": {}}

    def reduce(self, m: np.ndarray) -> np.ndarray:
        return ((m - self.mean) @ self.axes).astype(np.float32)

    def gaps(self, homes: np.ndarray) -> np.ndarray:
        """Distances of the pivots ``homes`` from all pivots; kept where all fit into 64 MB."""
        p = self.pivots
        if len(p) <= 4096:
            if "all" not in self._gaps:
                self._gaps["all"] = _distances(p, p)
            return self._gaps["all"][homes]
        own, at = np.unique(homes, return_inverse=True)
        return _distances(p[own], p)[at]

    def place(self, y: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of reduced vectors: their homes, and the row numbers and cells of their margins."""
        rows, cells, homes = [], [], []
        p2 = (self.pivots**2).sum(1)
        for s in range(0, len(y), chunk):
            d2 = p2 - 2 * (y[s : s + chunk] @ self.pivots.T)
            n = np.arange(len(d2))
            home = d2.argmin(1)
            near = d2 - d2[n, home][:, None] <= 2 * self.margin * self.gaps(home)
            near[n, home] = False
            r, c = np.divmod(np.flatnonzero(near.ravel()), near.shape[1])  # several times faster than nonzero of two dimensions
            rows.append(r + s)
            cells.append(c)
            homes.append(home)
        z = np.zeros(0, np.int64)
        return tuple(np.concatenate(x or [z]) for x in (homes, rows, cells))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)).astype(np.float32)


def sample(df: DataFrame, id_col: str, vec: str, dims: int, total: int, size: int) -> np.ndarray:
    """At most ``size`` distinct usable vectors, by the hash of their ids, in the order of their own; for fitting only."""
    share = min(1.0, size / max(total, 1))
    few = df.where(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(11)), F.lit(1 << 40)) < max(1, round(share * (1 << 40))))
    kept = prepare(few, id_col, vec, dims).select("h", "g", "vec").dropDuplicates(["h", "g"]).orderBy("g", "h").limit(size)
    return matrix(kept.select("vec").toArrow()["vec"], dims)


def pivot_number(total: int, cell_rows: int) -> int:
    return int(np.clip(round(total / cell_rows), 1, MAX_PIVOTS))


def sample_size(total: int, cell_rows: int) -> int:
    """Four vectors a pivot, and enough for codebooks."""
    return min(SAMPLE_ROWS, max(16_000, 4 * pivot_number(total, cell_rows)))


def fit(data: np.ndarray, total: int, margin: float, dims: int = 128, cell_rows: int = 400, block_rows: int = 20_000) -> Space:
    """Pivots for about ``cell_rows`` vectors a cell, from ``data``, a sample of ``total`` vectors."""
    rng = np.random.default_rng(SEED)
    mean = data.mean(0) if len(data) else np.zeros(data.shape[1])
    _, axes = np.linalg.eigh(np.cov((data - mean).T) if len(data) > 1 else np.eye(data.shape[1]))
    axes = axes[:, ::-1][:, : min(dims, data.shape[1])]
    y = ((data - mean) @ axes).astype(np.float32)
    k = min(pivot_number(total, cell_rows), max(1, len(y) // 4))
    p = y[rng.choice(len(y), k, replace=False)] if len(y) else np.zeros((1, axes.shape[1]), np.float32)
    for _ in range(6 if len(y) else 0):
        a = _nearest(y, p)
        order, n = np.argsort(a, kind="stable"), np.bincount(a, minlength=len(p))
        sums = np.add.reduceat(y[order], np.concatenate([[0], np.cumsum(n[n > 0])[:-1]]), axis=0)
        p = (sums / n[n > 0][:, None]).astype(np.float32)
    p = _apart(p, 2 * margin)
    held = np.bincount(_nearest(y, p), minlength=len(p)) if len(y) else np.ones(len(p))
    expected = held * (total / max(len(y), 1))
    return Space(mean, axes, p, np.maximum(1, np.ceil(expected / block_rows)).astype(np.int64), margin)


def _nearest(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    p2 = (p**2).sum(1)
    return np.concatenate([(p2 - 2 * y[s : s + 4096] @ p.T).argmin(1) for s in range(0, len(y), 4096)])


def _apart(p: np.ndarray, least: float) -> np.ndarray:
    """Pivots no two of which are closer than ``least``: those within a dense spot would only share all their rows."""
    keep = np.zeros(len(p), bool)
    for i in range(len(p)):
        keep[i] = not keep[:i].any() or ((p[:i][keep[:i]] - p[i]) ** 2).sum(1).min() >= least * least
    return p[keep]


# ---------------------------------------------------------------- sketches


class Sketch(Protocol):
    """What a margin copy carries instead of its vector; ``at_home`` tells whether vectors carry theirs too."""

    width: int
    at_home: bool

    def encode(self, m: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Vectors and their reduced forms -> ``(n, width)`` bytes."""

    def hits(self, m: np.ndarray, tails: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``m`` and of ``tails`` that may be within ``limit``, some at a time; none that is may be missing."""


@dataclass(frozen=True)
class Reduced:
    """The leading ``kept`` coordinates of the reduced vector in ``1 / steps``, four bits each, and the norm of what that loses."""

    space: Space
    kept: int = 48
    steps: int = 20
    at_home: bool = False

    @property
    def axes(self) -> int:
        return min(self.kept, self.space.axes.shape[1] // 2 * 2)

    @property
    def width(self) -> int:
        return self.axes // 2 + 4

    def encode(self, m: np.ndarray, y: np.ndarray) -> np.ndarray:
        own = y[:, : self.axes]
        q = np.clip(np.rint(own * self.steps), -8, 7)
        lost = np.sqrt(((own - q / self.steps) ** 2).sum(1)).astype(np.float32)
        u = (q + 8).astype(np.uint8)
        return np.concatenate([u[:, ::2] << 4 | u[:, 1::2], lost[:, None].view(np.uint8)], axis=1)

    def hits(self, m: np.ndarray, tails: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        w = self.axes // 2
        q = np.empty((len(tails), self.axes), np.float32)
        q[:, ::2], q[:, 1::2] = tails[:, :w] >> 4, tails[:, :w] & 15
        q = (q - 8) / self.steps
        lost = np.ascontiguousarray(tails[:, w:]).view(np.float32)[:, 0]
        y = self.space.reduce(m)[:, : self.axes]
        # distances of the leading coordinates are no larger than those of the vectors
        most = (limit + lost) ** 2 - (q * q).sum(1) + 1e-3
        y2 = (y * y).sum(1)
        step = max(1, 4_000_000 // max(len(q), 1))
        for s in range(0, len(y), step):
            a, b = np.nonzero(y2[s : s + step, None] - 2 * (y[s : s + step] @ q.T) <= most)
            yield a + s, b


# ---------------------------------------------------------------- segments: rows of one cell, packed together

SEGMENTS = "cell long, side int, home binary, codes binary"
_SCHEMA = pa.schema([("cell", pa.int64()), ("side", pa.int32()), ("home", pa.binary()), ("codes", pa.binary())])
VISITORS = 2


def _home_segments(key: np.ndarray, ids: np.ndarray, packed: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """One segment a key: the number of rows, their ids, the ends of their vectors, the vectors."""
    order = np.argsort(key, kind="stable")
    key, ids, packed = key[order], ids[order], packed.take(pa.array(order))
    off = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = memoryview(packed.buffers()[2])
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(key))
    out = [b"".join((np.int64(e - s).tobytes(), ids[s:e].tobytes(), (off[s + 1 : e + 1] - off[s]).tobytes(), data[off[s] : off[e]])) for s, e in zip(start.tolist(), ends.tolist())]
    return key[start], out


def _code_type(width: int) -> np.dtype:
    return np.dtype([("home", "<i4"), ("tail", "u1", (width,))])


@dataclass
class Cell:
    """The distinct vectors of one part of a cell, whole ones that live there or visit it, and sketches from elsewhere."""

    start: np.ndarray  # where each vector's ids begin
    ids: np.ndarray  # ascending within a vector
    m: np.ndarray
    tails: np.ndarray
    side: np.ndarray  # of each vector: 0 or 1, of which block pair's block; VISITORS
    codes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return self.ids[self.start]


def read_cell(tables: list[pa.Table], dims: int, sketch: Sketch, codes: bool) -> Cell:
    """The segments of one part."""
    width = sketch.width
    ids, lens, bodies, sides, found = [], [], [], [], []
    for t in tables:
        for side, home, code in zip(t["side"].to_pylist(), t["home"].to_pylist(), t["codes"].to_pylist()):
            if home:
                n = int(np.frombuffer(home, "<i8", 1)[0])
                ids.append(np.frombuffer(home, "<i8", n, 8))
                ends = np.frombuffer(home, "<i8", n, 8 + 8 * n)
                lens.append(np.diff(ends, prepend=0))
                bodies.append(home[8 + 16 * n :])
                sides.append(np.full(n, side))
            if codes and code:
                found.append(np.frombuffer(code, _code_type(width)))
    kind = _code_type(width)
    code = np.concatenate(found) if found else np.zeros(0, kind)
    if not ids:
        z = np.zeros(0, np.int64)
        return Cell(z, z, np.zeros((0, dims)), np.zeros((0, width if sketch.at_home else 0), np.uint8), z, code)
    ids, sides = np.concatenate(ids), np.concatenate(sides)
    off = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(b"".join(bodies))])
    same = packed.dictionary_encode()
    v = same.indices.to_numpy()
    order = np.lexsort((ids, v))
    v, ids, sides = v[order], ids[order], sides[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (ids[1:] != ids[:-1])
    v, ids, sides = v[fresh], ids[fresh], sides[fresh]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    m, tails = unpack(same.dictionary, dims, width if sketch.at_home else 0)
    return Cell(start, ids, m, tails, np.minimum.reduceat(sides, start), code)


def spread(rows: DataFrame, space: Space, sketch: Sketch, dims: int, partitions: int, ids_kept: int = 1) -> DataFrame:
    """Place all rows of :func:`prepare`: segments of vectors at home and of sketches in the margins.

    Of a vector's copies in a batch, and of hot ones in a task, only the ``ids_kept`` smallest ids go on.
    """
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((space, sketch))  # at most MAX_PIVOTS pivots and a sketch's tables

    def place(ids, h, g, m):
        sp, sk = shared.value
        y = sp.reduce(m)
        home, row, cell = sp.place(y)
        tails = sk.encode(m, y)
        packed = pack(m, tails if sk.at_home else None)
        total = np.concatenate([[0], np.cumsum(sp.blocks * (sp.blocks + 1) // 2)])
        block = h % sp.blocks[home]
        own = total[home] + block * (block + 1) // 2 + block  # the part of a vector's own block with itself
        # at home: to every pair of blocks that this row's block is in
        k = sp.blocks[home]
        at = np.repeat(np.arange(len(k)), k)
        other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
        mine = block[at]
        lo, hi = np.minimum(mine, other), np.maximum(mine, other)
        part = total[home][at] + hi * (hi + 1) // 2 + lo
        side = (mine != lo).astype(np.int64)
        keys, segments = _home_segments(part * 2 + side, ids[at], packed.take(pa.array(at)))
        yield keys // 2, keys % 2, segments, None
        # in margins: a sketch to every block of the cell
        k = sp.blocks[cell]
        at = np.repeat(np.arange(len(k)), k)
        b = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
        part, who = total[cell][at] + b * (b + 1) // 2 + b, row[at]
        order = np.argsort(part, kind="stable")
        part, who = part[order], who[order]
        codes = np.empty(len(who), _code_type(sk.width))
        codes["home"], codes["tail"] = own[who], tails[who]
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        ends = np.append(start[1:], len(part))
        yield part[start], np.zeros(len(start), np.int64), None, [codes[s:e].tobytes() for s, e in zip(start.tolist(), ends.tolist())]

    def run(batches):
        hot: dict[tuple[int, int], list[int]] = {}
        for b in _merged(batches):
            ids, h, g = (b.column(i).to_numpy() for i in range(3))
            order = np.lexsort((ids, g, h))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            order = order[fresh]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
            start = np.flatnonzero(new)
            rank = np.arange(len(order)) - start[np.cumsum(new) - 1] if len(order) else np.zeros(0, int)
            keep = rank < ids_kept
            count = np.diff(np.append(start, len(order)))
            for s in start[count > 8]:  # a vector with many copies: what this task sent before stands, unless smaller ids come
                key, mine = (int(h[order[s]]), int(g[order[s]])), ids[order[s : s + ids_kept]].tolist()
                seen = hot.get(key, [])
                merged = sorted({*seen, *mine})[:ids_kept]
                keep[s : s + ids_kept] &= np.isin(ids[order[s : s + ids_kept]], [x for x in merged if x not in seen])
                if len(hot) < 100_000 or key in hot:
                    hot[key] = merged
            order = order[keep]
            if not len(order):
                continue
            vectors = matrix(b.column(3), dims)[order]
            for cell, side, home, codes in place(ids[order], h[order], g[order], vectors):
                none = [None] * len(cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(side, pa.int32()), pa.array(home or none, pa.binary()), pa.array(codes or none, pa.binary())], schema=_SCHEMA)

    return rows.select("id", "h", "g", "vec").mapInArrow(run, SEGMENTS).repartition(partitions, "cell")


def _merged(batches):
    """Batches of FLUSH_ROWS rows or more, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= FLUSH_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def partitions_for(rows: DataFrame, total: int) -> int:
    """As many shuffle partitions as the data ask for, and no fewer than the session's."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))


def visitors(placed: DataFrame, sketch: Sketch, dims: int, limit: float, partitions: int) -> DataFrame:
    """Segments of vectors that may have someone within ``limit`` in another cell, for that cell; each goes there once."""
    shared = placed.sparkSession.sparkContext.broadcast(sketch)

    def run(t: pa.Table) -> pa.Table:
        sk: Sketch = shared.value
        c = read_cell([t], dims, sk, True)
        if not len(c.codes) or not len(c.m):
            return _SCHEMA.empty_table()
        home, n = c.codes["home"].astype(np.int64), len(c.m)
        # whom to send where, each once
        sent = [np.unique(home[b] * n + a) for a, b in sk.hits(c.m, np.ascontiguousarray(c.codes["tail"]), limit)]
        to, who = np.divmod(np.unique(np.concatenate(sent)), n)
        if not len(to):
            return _SCHEMA.empty_table()
        # all ids of a vector go along
        count = np.diff(np.append(c.start, len(c.ids)))
        at = np.repeat(np.arange(len(who)), count[who])
        off = np.arange(len(at)) - np.repeat(np.cumsum(count[who]) - count[who], count[who])
        packed = pack(c.m, c.tails if sk.at_home else None)
        keys, segments = _home_segments(to[at], c.ids[c.start[who[at]] + off], packed.take(pa.array(who[at])))
        return pa.table([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), VISITORS), pa.int32()), pa.array(segments, pa.binary()), pa.nulls(len(keys), pa.binary())], schema=_SCHEMA)

    return placed.groupBy("cell").applyInArrow(run, SEGMENTS).repartition(partitions, "cell")


def meet(placed: DataFrame, guests: DataFrame, sketch: Sketch, dims: int, run, schema: str) -> DataFrame:
    """``run(Cell)`` on every part with its own vectors and its visitors."""
    shared = placed.sparkSession.sparkContext.broadcast(sketch)

    def both(t: pa.Table, v: pa.Table) -> pa.Table:
        return run(read_cell([t, v], dims, shared.value, False))

    return placed.groupBy("cell").cogroup(guests.groupBy("cell")).applyInArrow(both, schema)


def lanes(c: Cell) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows of a part are to be compared with which: its own with each other or, of two blocks, across; and visitors."""
    own, other, guest = (np.flatnonzero(c.side == k) for k in (0, 1, VISITORS))
    return [(own, other)] if len(other) else [(own, own), (own, guest)]
