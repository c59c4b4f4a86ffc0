"""Most similar vectors for every vector: additive quantisation, table scoring, exact reranking.

Codebooks of full-dimensional codewords are fitted on a bounded sample: residual k-means gives a start, then beam
search encoding and a least-squares update of all codewords alternate.  Every vector of the collection is encoded by
beam search and stored with its norm, the scale that makes its code unbiased for itself and the norm of what the
code leaves out.  Only these 22 bytes go to the margins of the cells of :mod:`lumigraph.operators.cells`; a query's lookup tables, or where
queries are many its products with the decoded vectors, score them, and what can lie within the limit, by its score and ``SLACK`` standard deviations of what the code does not
see, is fetched and reranked with exact distances.  No list is capped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumigraph.operators import cells
from lumigraph.session import cut

BOOKS, WORDS, BEAM = 16, 32, 4
SLACK = 4.0  # standard deviations of the part of a difference that the code does not see
MARGIN = 0.08  # of a limit of 0.6; tests measure the share of pairs it keeps
SALTS = 16
FEW = 64  # queries of a part that tables score
GROUP = 0.7  # radius of a group of queries, in limits
AXES, PIVOTS = 64, 4096  # of the cells: beyond, cells grow instead, since homes cost the more and margins hold the more the more pivots there are


@dataclass(frozen=True)
class Books:
    """``words`` is (BOOKS * WORDS, d); ``gram`` holds all inner products of codewords."""

    mean: np.ndarray
    words: np.ndarray
    gram: np.ndarray
    books: int

    @staticmethod
    def of(mean: np.ndarray, words: np.ndarray, books: int) -> Books:
        return Books(mean, words.astype(np.float32), (words @ words.T).astype(np.float32), books)

    def encode(self, x: np.ndarray, beam: int = BEAM, chunk: int = 1024) -> np.ndarray:
        """Beam search: each stage keeps the ``beam`` partial sums nearest to the vector."""
        return np.concatenate([self._encode(x[s : s + chunk], beam) for s in range(0, len(x), chunk)] or [np.zeros((0, self.books), np.uint8)])

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, k = len(x), len(self.words) // self.books
        own = np.diag(self.gram)
        left = x.astype(np.float32)[:, None, :]  # what each partial sum leaves out
        codes = np.zeros((n, 1, 0), np.uint8)
        err = np.zeros((n, 1), np.float32)
        rows = np.arange(n)
        for stage in range(self.books):
            part = slice(stage * k, stage * k + k)
            words = self.words[part]
            e = err[:, :, None] + own[part] - 2 * (left.reshape(-1, x.shape[1]) @ words.T).reshape(n, -1, k)
            e = e.reshape(n, -1)
            keep = min(beam, e.shape[1]) if stage + 1 < self.books else 1
            best = np.empty((n, keep), np.int64)
            err = np.empty((n, keep), np.float32)
            for b in range(keep):
                best[:, b] = e.argmin(1)
                err[:, b] = e[rows, best[:, b]]
                e[rows, best[:, b]] = np.inf
            parent, word = np.divmod(best, k)
            codes = np.concatenate([codes[rows[:, None], parent], word[:, :, None].astype(np.uint8)], axis=2)
            if stage + 1 < self.books:
                left = left[rows[:, None], parent] - words[word]
        return codes[:, 0]

    @functools.cached_property
    def _twos(self) -> list[np.ndarray]:
        """Sums of the codewords of two books each, which halves the work of decoding."""
        k = len(self.words) // self.books
        own = [self.words[j * k : j * k + k] for j in range(self.books)]
        return [(a[:, None] + b).reshape(-1, a.shape[1]) for a, b in zip(own[::2], own[1::2])] + own[len(own) // 2 * 2 :]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        k, n = len(self.words) // self.books, codes.shape[1] // 2 * 2
        at = np.concatenate([codes[:, :n:2].astype(np.int64) * k + codes[:, 1:n:2], codes[:, n:]], axis=1)
        out = np.zeros((len(codes), self.words.shape[1]), np.float32)
        for j, words in enumerate(self._twos):
            out += words.take(at[:, j], axis=0)
        return out


def train(data: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 3, rows: int = 8_000) -> Books:
    """Codebooks from at most ``rows`` sample vectors."""
    rng = np.random.default_rng(cells.SEED)
    x = data[rng.permutation(len(data))[:rows]] if len(data) else np.zeros((1, data.shape[1]))
    mean = x.mean(0)
    x = (x - mean).astype(np.float64)
    k = min(words, max(1, len(x)))
    left, out = x.astype(np.float32), []
    for _ in range(books):
        p = left[rng.choice(len(left), k, replace=False)]
        for _ in range(5):
            a = cells._nearest(left, p)
            s = np.zeros_like(p)
            np.add.at(s, a, left)
            n = np.bincount(a, minlength=k)
            p = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], p).astype(np.float32)
        left = left - p[cells._nearest(left, p)]
        out.append(p)
    b = Books.of(mean, np.concatenate(out), books)
    for _ in range(rounds):
        codes = b.encode(x)
        one = np.zeros((len(x), books * k), np.float32)
        for j in range(books):
            one[np.arange(len(x)), codes[:, j].astype(int) + j * k] = 1
        w = np.linalg.solve((one.T @ one + 0.5 * np.eye(books * k)).astype(np.float64), one.T @ x)
        b = Books.of(mean, w, books)
    return b


@dataclass(frozen=True)
class Codes:
    """The sketch of a vector: norm, scale, norm of the rest, and the code."""

    books: Books
    at_home: bool = True

    @property
    def bits(self) -> int:
        """Bits a codeword's number takes."""
        return max(1, (len(self.books.words) // self.books.books - 1).bit_length())

    @property
    def width(self) -> int:
        return 12 + -(-self.books.books * self.bits // 8)

    def _packed(self, code: np.ndarray) -> np.ndarray:
        flags = code[:, :, None] >> np.arange(self.bits, dtype=np.uint8) & 1
        return np.packbits(flags.reshape(len(code), -1), axis=1)

    def _codes(self, packed: np.ndarray) -> np.ndarray:
        flags = np.unpackbits(packed, axis=1, count=self.books.books * self.bits).reshape(len(packed), -1, self.bits)
        return (flags << np.arange(self.bits, dtype=np.uint8)).sum(2, dtype=np.uint8)

    def encode(self, m: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = (m - self.books.mean).astype(np.float32)
        code = self.books.encode(x)
        hat = self.books.decode(code) if len(x) else x
        norm, along = (x * x).sum(1), (x * hat).sum(1)
        scale = np.where(along > 1e-6, norm / np.maximum(along, 1e-6), 0.0).astype(np.float32)
        rest = np.sqrt(((x - scale[:, None] * hat) ** 2).sum(1))
        return np.concatenate([np.stack([norm, scale, rest], axis=1).astype(np.float32).view(np.uint8), self._packed(code)], axis=1)

    def hits(self, m: np.ndarray, tails: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``m`` and of ``tails`` that may be within ``limit``, by their scores.

        With x a query, b = s * code + r a stored vector and <b, r> = 0, |x - b|^2 = |x|^2 + |b|^2 - 2 s <x, code> -
        2 <x - b, r>.  The last term is not seen; its deviation is at most 2 * limit * |r| / sqrt(d) within the limit.
        Few queries are scored by tables.  Many are first grouped about leaders: where a member may be within
        ``limit``, its leader, ``far`` from it at most, may be within ``limit + far``; only there members are scored.
        """
        head = np.ascontiguousarray(tails[:, :12]).view(np.float32)
        norm, scale, rest = head[:, 0], head[:, 1], head[:, 2]
        codes = self._codes(np.ascontiguousarray(tails[:, 12:]))
        x = (m - self.books.mean).astype(np.float32)
        own = (x * x).sum(1)
        slack = (2 * SLACK / np.sqrt(m.shape[1]) * rest).astype(np.float32)
        bar = norm - limit * limit - limit * slack - 1e-3
        if len(x) < FEW:
            yield from self._by_tables(x, own, codes, scale, bar)
            return
        lead, group = leaders(x, GROUP * limit)
        order = np.argsort(group, kind="stable")
        count = np.bincount(group, minlength=len(lead))
        start = np.cumsum(count) - count
        off = np.sqrt(((x - x[lead][group]) ** 2).sum(1))
        reach = limit + np.maximum.reduceat(off[order], start) + 1e-4
        left = np.concatenate([-2 * x[lead], np.stack([np.ones(len(lead)), own[lead] - reach**2 - 1e-3, -reach], axis=1)], axis=1).astype(np.float32)
        step = max(1, min(4096, 4_000_000 // len(x)))
        for s in range(0, len(codes), step):
            hat = self.books.decode(codes[s : s + step]) * scale[s : s + step, None]
            right = np.concatenate([hat, np.stack([norm[s : s + step], np.ones(len(hat)), slack[s : s + step]], axis=1)], axis=1).astype(np.float32)
            g, c = np.divmod(np.flatnonzero((left @ right.T <= 0).ravel()), len(hat))
            n = count[g]
            if n.sum() > len(x) * len(hat) // 16:  # a crowded part
                a, c = np.divmod(np.flatnonzero((own[:, None] + bar[s : s + step] - 2 * (x @ hat.T) <= 0).ravel()), len(hat))
                yield a, c + s
                continue
            a, c = order[np.repeat(start[g] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(c, n)
            near = [np.einsum("ij,ij->i", x[a[o : o + 50_000]], hat[c[o : o + 50_000]]) for o in range(0, len(a), 50_000)]
            yes = own[a] + bar[s + c] - 2 * np.concatenate(near or [own[:0]]) <= 0
            yield a[yes], c[yes] + s

    def _by_tables(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray, scale: np.ndarray, bar: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k = len(self.books.words) // self.books.books
        codes = codes.astype(np.int64)
        step = max(1, 1_000_000 // max(len(codes), 1))
        for s in range(0, len(x), step):
            table = self.books.words @ x[s : s + step].T  # by codeword: a code adds up the scores of all queries at once
            score = table[codes[:, 0]]
            for b in range(1, self.books.books):
                score += table[codes[:, b] + b * k]
            score *= (-2 * scale)[:, None]
            score += own[s : s + step]
            score += bar[:, None]
            c, a = np.divmod(np.flatnonzero((score <= 0).ravel()), score.shape[1])
            yield a + s, c


def leaders(x: np.ndarray, radius: float, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lead groups, and the group of every row: that of the first leader met within ``radius``, else its own."""
    lead, group = np.zeros(0, np.int64), np.full(len(x), -1)
    own, most = (x * x).sum(1), radius * radius
    for s in range(0, len(x), chunk):
        y, part = x[s : s + chunk], group[s : s + chunk]
        if len(lead):
            d2 = own[lead] - 2 * (y @ x[lead].T)
            best = d2.argmin(1)
            near = d2[np.arange(len(y)), best] + own[s : s + chunk] <= most
            part[near] = best[near]
        within = own[s : s + chunk, None] + own[s : s + chunk] - 2 * (y @ y.T) <= most
        fresh = []
        for i in range(len(y)):
            if part[i] < 0:
                part[i] = len(lead) + len(fresh)
                part[(part < 0) & within[i]] = part[i]
                fresh.append(s + i)
        lead = np.concatenate([lead, np.array(fresh, np.int64)])
    return lead, group


def near_pairs(c: cells.Cell, sketch: Codes, limit: float, k: int, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of vectors of a part below ``limit``, rounded to six decimals: scored by tables, then exact.

    All, as long as they are few; where there are more than ``most``, those that are no longer among the ``k`` nearest
    of either are dropped on the way, so a crowded part needs no more memory.
    """
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    fresh: list[list[np.ndarray]] = [[], [], []]
    count, first = 0, c.first

    def settle() -> None:
        nonlocal count
        i, j, d = (np.concatenate([held[x], *fresh[x]]) for x in range(3))
        if len(i) > most // 4:
            n = len(i)
            best = _top(np.concatenate([i, j]), first[np.concatenate([j, i])], np.concatenate([d, d]), k)
            keep = np.unique(best % n)
            i, j, d = i[keep], j[keep], d[keep]
        held[:] = i, j, d
        fresh[:] = [], [], []
        count = 0

    for left, right in cells.lanes(c):
        if not len(left) or not len(right):
            continue
        for b, a in sketch.hits(c.m[right], c.tails[left], limit):
            a, b = left[a], right[b]
            if left is right:
                a, b = a[a < b], b[a < b]
            for o in range(0, len(a), 100_000):
                p, q = a[o : o + 100_000], b[o : o + 100_000]
                d = np.round(np.sqrt(((c.m[p] - c.m[q]) ** 2).sum(1)), 6)
                yes = d < limit
                for x, v in enumerate((p[yes], q[yes], d[yes])):
                    fresh[x].append(v)
                count += int(yes.sum())
                if count > most:
                    settle()
    settle()
    return tuple(held)


def _top(src: np.ndarray, dst: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` smallest (d, dst) of every src."""
    order = np.lexsort((dst, d, src))
    s = src[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    start = np.flatnonzero(new)
    rank = np.arange(len(s)) - start[np.cumsum(new) - 1] if len(s) else np.zeros(0, int)
    return order[rank < k]


def nearest(df: DataFrame, id_col: str, vec: str, k: int = 3, limit: float = 0.6, dims: int = 128, margin: float | None = None, cell_rows: int = 400) -> DataFrame:
    """``(id, nbr, micro)``: the ``k`` nearest others of every id below ``limit``; ``micro`` is the distance in millionths.

    Distances are rounded to six decimals, ties go to the smaller id.  Ids are distinct: of an id delivered with
    several vectors each counts and the nearest distance holds.  Rows with a null id or an unusable vector have no
    neighbours and are none; copies of one vector are each other's neighbours at distance 0; no rows give no rows.
    """
    rows = cells.prepare(df, id_col, vec, dims)
    total = df.count()
    data = cells.sample(df, id_col, vec, dims, total, cells.sample_size(total, cell_rows))
    margin = MARGIN * limit / 0.6 if margin is None else margin
    space = cells.fit(data, total, margin, dims=min(AXES, dims), cell_rows=max(cell_rows, -(-total // PIVOTS)))
    sketch, parts = Codes(train(data)), cells.partitions_for(df, total)  # BOOKS * WORDS codewords
    schema = "id long, n1 long, d1 int, n2 long, d2 int, n3 long, d3 int" if k == 3 else "id long, " + ", ".join(f"n{i} long, d{i} int" for i in range(1, k + 1))
    types = pa.schema([("id", pa.int64()), *((f"{c}{i}", pa.int64() if c == "n" else pa.int32()) for i in range(1, k + 1) for c in "nd")])
    shared = df.sparkSession.sparkContext.broadcast(sketch)

    def run(c: cells.Cell) -> pa.Table:
        start, ids = c.start, c.ids
        count = np.minimum(np.diff(np.append(start, len(ids))), k + 1)  # k + 1 copies serve any id
        i, j, d = near_pairs(c, shared.value, limit, k + 1)
        copied = np.flatnonzero(count > 1)
        i, j, d = np.concatenate([i, j, copied]), np.concatenate([j, i, copied]), np.concatenate([d, d, np.zeros(len(copied))])
        best = _top(i, ids[start[j]], d, k + 1)  # each of these vectors has at least one id
        i, j, d = i[best], j[best], d[best]
        reps = count[i] * count[j]
        at = np.repeat(np.arange(len(i)), reps)
        off = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)
        src, dst = ids[start[i[at]] + off // count[j[at]]], ids[start[j[at]] + off % count[j[at]]]
        micro = np.rint(d[at] * 1e6).astype(np.int64)
        other = src != dst
        src, dst, micro = src[other], dst[other], micro[other]
        p = _top(src, dst, micro, k)
        src, dst, micro = src[p], dst[p], micro[p]
        new = np.ones(len(src), bool)
        new[1:] = src[1:] != src[:-1]
        first = np.flatnonzero(new)
        rank = np.arange(len(src)) - first[np.cumsum(new) - 1] if len(src) else np.zeros(0, int)
        row = np.cumsum(new) - 1
        cols = [pa.array(src[first])]
        for r in range(k):
            x = rank == r
            n_, d_, ok = np.zeros(len(first), np.int64), np.zeros(len(first), np.int32), np.zeros(len(first), bool)
            n_[row[x]], d_[row[x]], ok[row[x]] = dst[x], micro[x], True
            cols += [pa.array(n_, mask=~ok), pa.array(d_, mask=~ok)]
        return pa.Table.from_arrays(cols, schema=types)

    placed = cells.spread(rows, space, sketch, dims, parts, ids_kept=k + 1)
    local = cells.meet(placed, cells.visitors(placed, sketch, dims, limit, parts), sketch, dims, run, schema)
    # an id of one cell is done; lists of several cells, at most one a cell, become one
    lists = F.array(*(F.struct(F.col(f"d{i}").alias("d"), F.col(f"n{i}").alias("n")) for i in range(1, k + 1)))
    found = local.select("id", F.filter(lists, lambda e: e.n.isNotNull()).alias("l"))
    merged = found.groupBy("id").agg(F.flatten(F.collect_list("l")).alias("l"))

    # the others of more than k + 1 copies: the k smallest ids of the group, at distance 0
    ids = cut(rows.select("id", "h", "g"))
    least = _least_ids(ids, k + 2).where(F.size("least") > k + 1)
    salted = least.select("h", "g", F.slice("least", 1, k + 1).alias("least"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = ids.select("id", "h", "g", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    late = own.join(salted, ["h", "g", "salt"]).where(~F.array_contains("least", F.col("id")))
    late = late.select("id", F.transform(F.slice("least", 1, k), lambda x: F.struct(F.lit(0).alias("d"), x.alias("n"))).alias("l"))

    def pick(batches):
        for b in batches:
            own, l = b.column(0).to_numpy(), b.column(1)
            n = np.diff(l.offsets.to_numpy())
            src = np.repeat(own, n)
            flat = l.flatten()
            d, dst = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            o = np.lexsort((d, dst, src))  # a neighbour met in several cells counts once
            src, dst, d = src[o], dst[o], d[o]
            fresh = np.ones(len(src), bool)
            fresh[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
            src, dst, d = src[fresh], dst[fresh], d[fresh]
            p = _top(src, dst, d, k)
            yield pa.RecordBatch.from_arrays([pa.array(src[p]), pa.array(dst[p]), pa.array(d[p].astype(np.int32))], names=["id", "nbr", "micro"])

    return merged.unionByName(late).mapInArrow(pick, "id long, nbr long, micro int")


def _least_ids(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids of each vector; window groups are limited before their shuffle."""
    w = Window.partitionBy("h", "g").orderBy("id")
    few = rows.select("h", "g", "id").withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k)
    return few.groupBy("h", "g").agg(F.array_sort(F.collect_set("id")).alias("least"))


def pairs(near: DataFrame) -> DataFrame:
    """One row per pair of which at least one is a neighbour of the other, smaller id first."""
    return near.select(F.least("id", "nbr").alias("id_1"), F.greatest("id", "nbr").alias("id_2")).distinct()
