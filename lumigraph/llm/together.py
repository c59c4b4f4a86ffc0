"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

Counts come from the distinct items of each basket, equal baskets counted once with their number.  Baskets beyond
``WIDE`` items are never expanded into pairs: their items meet in blocks and slices of baskets, where counts are matrix
products of whole numbers.  The null gives item i and basket t the link probability
x_i y_t / (1 + x_i y_t), fitted so that every item's frequency and every basket's size hold in expectation; a pair's
count is then Poisson-binomial.  Its upper tail is computed exactly, by a Fourier transform of the distribution
tilted to the count, and false discoveries are controlled over all pairs of items (Benjamini-Hochberg).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumigraph.session import cut, ship

WIDE = 256


def baskets(rows: DataFrame, item: str, basket: str) -> DataFrame:
    """Distinct ``(item, basket)``; rows with a null in either column are none, repeats count once."""
    return rows.select(F.col(item).cast("long").alias("item"), F.col(basket).alias("basket")).where("item is not null and basket is not null").distinct()


def through(rows: DataFrame, path: str, frames: DataFrame, frame_path: str, original: str) -> DataFrame:
    """``path`` replaced by the original it was taken from, where ``frames`` names one (the smallest, if several)."""
    at = frames.where(F.col(original).isNotNull() & F.col(frame_path).isNotNull()).groupBy(F.col(frame_path).alias("_f")).agg(F.min(original).alias("_o"))
    return rows.join(at, rows[path] == F.col("_f"), "left").select(*[c for c in rows.columns if c != path], F.coalesce("_o", path).alias(path))


def pair_counts(links: DataFrame, least: int = 1) -> DataFrame:
    """``(i, j, n)``, ``i < j``: baskets with both, for the pairs with at least ``least``; exact."""
    ship(links.sparkSession)
    own = links.groupBy("item").agg(F.count("*").alias("c"))
    if least > 1:  # a pair is no more frequent than either item
        links = links.join(own.where(F.col("c") >= least).select("item"), "item", "left_semi")
    size = links.groupBy("basket").agg(F.count("*").alias("s"))
    wide = cut(size.where(F.col("s") > WIDE))
    narrow = links.join(size.where((F.col("s") > 1) & (F.col("s") <= WIDE)).select("basket"), "basket")
    sets = narrow.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("v")).groupBy("v").agg(F.count("*").alias("w"))
    first = sets.select("w", "v", F.posexplode("v").alias("p", "i"))
    pairs = first.select("w", "i", F.explode(F.expr("slice(v, p + 2, size(v))")).alias("j"))
    counts = pairs.groupBy("i", "j").agg(F.sum("w").alias("n"))
    held = wide.agg(F.sum("s")).first()[0]
    if held:
        parts = _wide(links.join(wide.select("basket"), "basket"), held)
        counts = counts.unionByName(parts).groupBy("i", "j").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


def _wide(links: DataFrame, held: int, block: int = 1_000, slice_links: int = 1_000_000) -> DataFrame:
    """Partial counts of wide baskets, which are never expanded into pairs.

    Items are in blocks and baskets in slices; two blocks meet once a slice, as products of sparse rows, so a task holds
    about ``slice_links`` links and a matrix of counts, and each of its counts leaves once.
    """
    items = links.agg(F.approx_count_distinct("item")).first()[0]
    k, slices = max(1, -(-items // block)), max(1, -(-held // slice_links))
    b = F.pmod(F.xxhash64("item"), F.lit(k)).cast("int")
    t = F.pmod(F.xxhash64("basket"), F.lit(slices)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = links.select("item", F.xxhash64("basket").alias("h"), F.xxhash64(F.lit(3), "basket").alias("g"), t.alias("t"), b.alias("b"), other.alias("o"))
    rows = rows.select("item", "h", "g", "t", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), (F.col("b") <= F.col("o")).alias("low"))

    def run(l: pa.Table) -> pa.Table:
        items_, ii = np.unique(l["item"].to_numpy(), return_inverse=True)
        both = np.stack([l["h"].to_numpy(), l["g"].to_numpy()], axis=1)
        _, bb = np.unique(both, axis=0, return_inverse=True)
        bb = bb.reshape(-1)
        low = np.zeros(len(items_), bool)
        low[ii[l["low"].to_numpy()]] = True
        order = np.argsort(bb, kind="stable")
        ii, bb = ii[order], bb[order]
        total = np.zeros((len(items_), len(items_)), np.int64)
        for s in range(0, int(bb[-1]) + 1, 2048):
            lo, hi = np.searchsorted(bb, (s, s + 2048))
            m = np.zeros((len(items_), 2048), np.float32)
            m[ii[lo:hi], bb[lo:hi] - s] = 1
            total += (m @ m.T).astype(np.int64)  # at most 2,048 each: exact
        p, q = np.nonzero(np.triu(total, 1))
        if l["x"][0].as_py() != l["y"][0].as_py():
            across = low[p] != low[q]
            p, q = p[across], q[across]
        return pa.table({"i": items_[p], "j": items_[q], "n": total[p, q]})

    return rows.groupBy("x", "y", "t").applyInArrow(run, "i long, j long, n long")


# ---------------------------------------------------------------- the null

FINE = 256  # frequencies and sizes up to here are classes of their own
COARSE = 1.01  # beyond, classes are this wide, so both sides have some 1,500 at most for up to 1e8


def classes(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their counts, the large ones binned: means and counts of the classes."""
    key = np.where(values <= FINE, values, FINE + 1 + np.floor(np.log(np.maximum(values, 1) / FINE) / np.log(COARSE)))
    _, at = np.unique(key, return_inverse=True)
    n = np.bincount(at, counts.astype(float))
    return np.bincount(at, values * counts.astype(float)) / n, n


def fit_null(items: np.ndarray, sizes: np.ndarray, n_items: np.ndarray, n_sizes: np.ndarray, rounds: int = 20_000, close: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """``x`` per item frequency and ``y`` per basket size, by fixed point.  Classes share a parameter.

    An error if the expected frequencies and sizes do not come within a millionth of the given ones.
    """
    total = float((items * n_items).sum())
    n, m = n_items.astype(float), n_sizes.astype(float)
    x, y = items / np.sqrt(total), sizes / np.sqrt(total)
    step = 0.0
    for _ in range(rounds):
        y_ = sizes / np.maximum((n[:, None] * x[:, None] / (1 + x[:, None] * y)).sum(0), 1e-300)
        x_ = items / np.maximum((m * y_ / (1 + x[:, None] * y_)).sum(1), 1e-300)
        step = max(np.abs(x_ / x - 1).max(initial=0), np.abs(y_ / y - 1).max(initial=0))
        x, y = x_, y_
        if step < close:
            break
    # an item in every basket, or a basket of every item, has no finite parameter: its links are certain
    p = x[:, None] * y / (1 + x[:, None] * y)
    off = max(np.abs((p * m).sum(1) / items - 1).max(initial=0), np.abs((p * n[:, None]).sum(0) / sizes - 1).max(initial=0))
    if off > 1e-6:
        raise RuntimeError(f"the null is {off:.2g} off its frequencies and sizes after {rounds} rounds (last step {step:.2g})")
    return x, y


def item_parameters(freq: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``x`` of every frequency, given ``y`` of the basket classes and their numbers: the root of a monotone function."""
    lo, hi = np.full(len(freq), -80.0), np.full(len(freq), 80.0)
    log_y = np.log(y)
    for s in range(0, len(freq), 1024):
        a, z, f = lo[s : s + 1024], hi[s : s + 1024], freq[s : s + 1024]
        for _ in range(90):
            mid = (a + z) / 2
            over = (m / (1 + np.exp(-(mid[:, None] + log_y)))).sum(1) > f
            z[:], a[:] = np.where(over, mid, z), np.where(over, a, mid)
    return np.exp((lo + hi) / 2)


def upper_tail(p: np.ndarray, m: np.ndarray, n: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """log10 P(X >= n) of X, the sum over classes s of Binomial(m_s, p_s); rows of ``p`` are pairs.

    The distribution is tilted so that its mean is ``n`` (the saddle point), transformed, and weighted back, so tails
    far below the precision of a plain sum come out.  Only a window of 14 deviations about the count is transformed,
    so memory goes with the root of the count; ``cells`` bounds what is held at once.
    """
    out = np.zeros(len(n))
    for s in range(0, len(n), 4096):
        q, k = p[s : s + 4096], n[s : s + 4096].astype(float)
        top = (m * (q > 0)).sum(1)
        mean = (m * q).sum(1)
        odds = q / np.maximum(1 - q, 1e-300)
        goal = np.minimum(k, top - 0.5)
        lo, hi = np.full(len(k), -60.0), np.full(len(k), 60.0)
        for _ in range(70):
            t = (lo + hi) / 2
            e = odds * np.exp(t)[:, None]
            over = (m * (e / (1 + e))).sum(1) > goal
            hi, lo = np.where(over, t, hi), np.where(over, lo, t)
        t = np.where(k > mean, (lo + hi) / 2, 0.0)
        e = odds * np.exp(t)[:, None]
        r = e / (1 + e)
        log_m = (m * (np.log1p(e) - np.log1p(odds))).sum(1)  # log of the tilted total
        spread = np.sqrt((m * r * (1 - r)).sum(1))
        width = 2 ** np.ceil(np.log2(28 * spread + 96)).astype(int)
        for w_ in np.unique(width):
            same = np.flatnonzero(width == w_)
            step = max(1, cells // int(w_))
            for o in range(0, len(same), step):
                at = same[o : o + step]
                out[s + at] = _window(r[at], m, k[at], np.where(k > mean, k, mean)[at], t[at], log_m[at], int(w_))
        out[s : s + 4096][(k > top) & (top >= 0)] = -300.0
        out[s : s + 4096][k <= 0] = 0.0
    return out


def _window(r: np.ndarray, m: np.ndarray, k: np.ndarray, middle: np.ndarray, t: np.ndarray, log_m: np.ndarray, width: int) -> np.ndarray:
    """The tail from a transform of ``width`` points: mass outside the window about ``middle`` is beyond 14 deviations."""
    w = np.exp(2j * np.pi * np.arange(width) / width) - 1
    log_phi = np.zeros((len(k), width), complex)
    for c in range(len(m)):
        log_phi += m[c] * np.log1p(r[:, c : c + 1] * w[None])
    pmf = np.maximum(np.fft.fft(np.exp(log_phi), axis=1).real / width, 0)
    ks = (np.floor(middle) - width // 2)[:, None] + np.arange(width)
    pmf = np.take_along_axis(pmf, np.mod(ks, width).astype(np.int64), axis=1)
    tail = np.where((ks >= k[:, None]) & (ks >= 0), pmf * np.exp(-np.clip(t[:, None] * (ks - k[:, None]), 0, 700)), 0).sum(1)
    return np.minimum((np.log(np.maximum(tail, 1e-300)) + log_m - t * k) / np.log(10), 0.0)


SALTS = 16


def surprise(links: DataFrame, counts: DataFrame, alpha: float = 0.01) -> DataFrame:
    """``(i, j, n, a, b, n_baskets, expected, lift, log_p, q, found)`` for the counted pairs.

    ``a``, ``b`` are the items' baskets, ``expected`` the null's mean, ``lift`` n * N / (a * b), ``log_p`` the log10 of
    the tail, ``q`` the false-discovery-adjusted p over all pairs of items (pairs that are not in ``counts`` rank last),
    ``found`` whether q <= alpha.  Large basket sizes are binned to within 1 % for the null, frequencies are exact.  No
    links give no rows.
    """
    spark = links.sparkSession
    ship(spark)
    deg = links.groupBy("item").agg(F.count("*").alias("a"))
    sizes = links.groupBy("basket").agg(F.count("*").alias("s"))
    # distinct frequencies and sizes: with n links there are at most sqrt(2 n) of each
    ca = deg.groupBy("a").agg(F.count("*").alias("n")).orderBy("a").toPandas()
    cs = sizes.groupBy("s").agg(F.count("*").alias("n")).orderBy("s").toPandas()
    n_baskets, n_items = int(cs.n.sum()), int(ca.n.sum())
    freq, x, y, m = (np.zeros(0) for _ in range(4))
    if n_items:
        freq = ca.a.to_numpy(float)
        (items, of_items), (size, m) = classes(freq, ca.n.to_numpy()), classes(cs.s.to_numpy(float), cs.n.to_numpy())
        _, y = fit_null(items, size, of_items, m)
        x = item_parameters(freq, y, m)
    shared = spark.sparkContext.broadcast((freq, x, y, m))
    left, right = deg.select(F.col("item").alias("i"), "a"), deg.select(F.col("item").alias("j"), F.col("a").alias("b"))
    rows = cut(counts.join(left, "i").join(right, "j").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}))
    kinds = rows.groupBy("lo", "hi", "n").agg(F.count("*").alias("c"))  # pairs of a kind share all that follows

    def test(batches):
        freq, x_, y_, m = shared.value
        for t in batches:
            a, b, n = (t.column(c).to_numpy() for c in range(3))
            pa_, pb = (x_[np.searchsorted(freq, v)][:, None] * y_ for v in (a, b))
            p = (pa_ / (1 + pa_)) * (pb / (1 + pb))
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in range(4)), pa.array((p * m).sum(1)), pa.array(np.round(upper_tail(p, m, n), 9))], names=["lo", "hi", "n", "c", "expected", "log_p"])

    kinds = kinds.select("lo", "hi", "n", "c").repartition(2 * spark.sparkContext.defaultParallelism)
    tests = cut(kinds.mapInArrow(test, "lo long, hi long, n long, c long, expected double, log_p double"))
    # adjusted p: by distinct p first (equal p have one rank), ranked within ranges of p and summed over ranges
    steps = tests.groupBy("log_p").agg(F.sum("c").alias("c")).withColumn("r", F.floor(F.col("log_p") * 64))
    per = steps.groupBy("r").agg(F.sum("c").alias("rc")).orderBy("r").toPandas()  # at most 64 x 301 ranges
    before = np.concatenate([[0], np.cumsum(per.rc)[:-1]]) if len(per) else np.zeros(0)
    ranges = spark.createDataFrame(pd.DataFrame({"r": per.r.astype("int64"), "before": before.astype("int64")}), "r long, before long")
    inner = Window.partitionBy("r").orderBy("log_p")
    tests_n = n_items * (n_items - 1) / 2
    ranked = steps.join(F.broadcast(ranges), "r").withColumn("rank", F.col("before") + F.sum("c").over(inner))
    ranked = ranked.withColumn("v", F.least(F.lit(1.0), F.pow(F.lit(10.0), "log_p") * tests_n / F.col("rank")))
    ends = ranked.groupBy("r").agg(F.min("v").alias("v")).orderBy("r").toPandas()
    after = np.minimum.accumulate(ends.v.to_numpy()[::-1])[::-1] if len(ends) else np.zeros(0)
    later = spark.createDataFrame(pd.DataFrame({"r": ends.r.astype("int64"), "later": np.append(after[1:], 1.0)[: len(ends)]}), "r long, later double")
    down = Window.partitionBy("r").orderBy(F.col("log_p").desc())
    q = ranked.join(F.broadcast(later), "r").select("log_p", F.least("later", F.min("v").over(down)).alias("q"))
    judged = tests.join(q, "log_p").select("lo", "hi", "n", "expected", "log_p", "q")
    # most pairs may be of one kind: it is met in several places
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("i", "j"), F.lit(SALTS)).cast("int"))
    lift = F.col("n") * F.lit(float(n_baskets)) / (F.col("a") * F.col("b"))
    out = rows.join(judged, ["lo", "hi", "n", "salt"])
    return out.select("i", "j", "n", "a", "b", F.lit(n_baskets).cast("long").alias("n_baskets"), F.round("expected", 9).alias("expected"), F.round(lift, 9).alias("lift"), "log_p", F.round("q", 12).alias("q"), (F.col("q") <= alpha).alias("found"))


def frequent(judged: DataFrame, least: int = 5, times: int = 10) -> DataFrame:
    """Of :func:`surprise` the pairs with ``n >= least`` and ``n * N >= times * a * b``, in whole numbers."""
    dec = lambda c: F.col(c).cast("decimal(19,0)")
    return judged.where((F.col("n") >= least) & (dec("n") * dec("n_baskets") >= F.lit(times) * dec("a") * dec("b")))
