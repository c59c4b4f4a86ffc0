"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over the training run; its integral is the source's cumulative token demand.  The
tokens of a source's documents, in a shuffled order and repeated up to its cap, are laid along that demand and the
demand is inverted: the middle of each occurrence gets the position at which the run reaches it.  Documents are then
range-sorted by position.  Running sums are exact and made of sums per hash range, so no source meets in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window

from lumigraph.session import cut, ship

TOKENIZER = "byte_bpe_50k.tiktoken"
BUCKET_ROWS = 4_000


def encoder(file: bytes, pattern: str) -> Callable[[str], int]:
    """Token counts of the contents of a ranks file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


def public_tokenizer(name: str = TOKENIZER) -> tuple[str, str]:
    """Path and pattern of an installed public tokenizer; where there is none, ``tokenizer`` must be given."""
    try:
        import public_tokenizers as p
    except ImportError as e:
        raise ValueError("no public tokenizer is installed here: give the path of a ranks file and its pattern") from e
    return p.path(name), p.PATTERN


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of all rows with a source and an id; whole texts; null or blank ones count 0."""
    path, pattern = tokenizer or public_tokenizer()
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a file of some MB, which executors need not hold

    def run(batches):
        count = encoder(ranks.value, pattern)
        for b in batches:
            n = [count(t) if t and not t.isspace() else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return kept.where("doc_id is not null and source is not null").mapInArrow(run, "doc_id long, source string, n_tokens long")


Schedule = tuple[list[float], dict[str, list[float]]]  # positions from 0 to 1, and each source's weights there


def fitted(mean: dict[str, float], schedule: Schedule, rounds: int = 20_000) -> Schedule:
    """Shares at the positions of a schedule, linear in between: its weights, scaled per source so that each source's
    share of the whole run is ``mean``.  Shares of all sources add up to 1 at every position.  An error if none do so."""
    at, weights = np.array(schedule[0], float), schedule[1]
    names_ = sorted(mean)
    if len(at) < 2 or at[0] != 0 or at[-1] != 1 or (np.diff(at) <= 0).any() or any(s not in weights or len(weights[s]) != len(at) or min(weights[s]) < 0 for s in names_):
        raise ValueError("a schedule has rising positions from 0 to 1 and a weight of every source used at each")
    w, goal = np.array([weights[s] for s in names_], float), np.array([mean[s] for s in names_])
    span = np.concatenate([[np.diff(at)[0]], np.diff(at)[:-1] + np.diff(at)[1:], [np.diff(at)[-1]]]) / 2  # trapezoids
    if not ((w.sum(0) > 0).all() and (w.sum(1) > 0).all()):
        raise ValueError("some source must have weight at every position, and every source at some")
    scale = np.ones(len(goal))
    for _ in range(rounds):
        p = scale[:, None] * w
        p /= p.sum(0)
        got = p @ span
        if np.abs(got - goal).max() < 1e-12:
            break
        scale *= goal / np.maximum(got, 1e-300)
        scale /= scale.max()
    if not np.abs(got - goal).max() <= 1e-6:
        raise ValueError("no scaling of this schedule meets the shares")
    return at.tolist(), {s: p[k].tolist() for k, s in enumerate(names_)}


def positions(c: np.ndarray, at: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The positions at which a source's cumulative demand, the integral of its share, reaches ``c``."""
    width = np.diff(at)
    demand = np.concatenate([[0.0], np.cumsum((share[1:] + share[:-1]) / 2 * width)])
    k = np.clip(np.searchsorted(demand, c, "right") - 1, 0, len(width) - 1)
    left, start, slope = np.maximum(c - demand[k], 0), share[k], (share[k + 1] - share[k]) / width[k]
    # start * u + slope * u^2 / 2 = left, solved in the form that bears a slope of 0
    root = start + np.sqrt(np.maximum(start * start + 2 * slope * left, 0))
    return np.clip(at[k] + np.minimum(np.where(root > 0, 2 * left / np.where(root > 0, root, 1), 0), width[k]), 0, 1)


def plan(totals: dict[str, int], targets: list[tuple[str, float | None, int | None]], total: int | None = None, schedule: Schedule | None = None) -> dict[str, dict]:
    """Allocation and schedule per source; plain numbers, one row per source.

    Shares are scaled to add up to 1 over the sources that have tokens, a positive target and may be used at all.  If
    ``total`` is not given it is the largest at which every such source meets its share within its cap, or, if none is
    capped, all tokens.  If it is given, sources that reach their cap leave the rest to the others by their weights.
    Without a ``schedule`` it goes linearly from near the sources' natural shares to beyond the targets, averaging them.
    """
    share: dict[str, float] = {}
    cap: dict[str, float] = {}
    for s, w, r in sorted((t for t in targets if t[0] is not None), key=lambda t: (t[0], -(t[1] or 0))):
        if s not in share and w is not None and w > 0 and totals.get(s, 0) > 0 and (r is None or r > 0):
            share[s], cap[s] = float(w), float("inf") if r is None else float(r) * totals[s]
    norm = sum(share.values())
    if not norm:
        return {}
    share = {s: w / norm for s, w in share.items()}
    if total is None:
        most = min(cap[s] / share[s] for s in share)
        size = most if most < float("inf") else float(sum(totals[s] for s in share))
        given = {s: share[s] * size for s in share}
    else:
        given, open_, left = {}, dict(share), float(total)
        while open_:
            w = sum(open_.values())
            full = [s for s in open_ if cap[s] <= open_[s] / w * left]
            if not full:
                given |= {s: open_[s] / w * left for s in open_}
                break
            for s in full:
                given[s] = cap[s]
            left -= sum(cap[s] for s in full)
            open_ = {s: v for s, v in open_.items() if s not in full}
    size = sum(given.values())
    mean = {s: given[s] / size for s in given}
    base = sum(totals[s] for s in given)
    tilt = {s: totals[s] / base - mean[s] for s in given}
    most = min([1.0, *(mean[s] / abs(d) for s, d in tilt.items() if d)])
    at, shares_ = fitted(mean, schedule) if schedule else ([0.0, 1.0], {s: [mean[s] + most * tilt[s], mean[s] - most * tilt[s]] for s in given})
    return {s: {"target": share[s], "tokens": given[s], "size": size, "at": at, "shares": shares_[s], "start": shares_[s][0], "end": shares_[s][-1], "held": totals[s]} for s in given}


def _offsets(counts: DataFrame, epochs: DataFrame, buckets: int) -> DataFrame:
    """Every occurrence with the tokens of its source before it: sums of hash ranges, then within a range."""
    occ = counts.join(F.broadcast(epochs), "source").select("doc_id", "source", "n_tokens", "held", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))  # one row per source
    h = F.xxhash64("doc_id", "epoch")
    occ = occ.withColumns({"h": h, "bucket": F.shiftrightunsigned(h, 40) % F.lit(buckets)})
    sums = occ.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"))  # at most ``buckets`` rows a group
    inner = Window.partitionBy("source", "epoch", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    occ = occ.withColumn("within", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return occ.join(sums, ["source", "epoch", "bucket"]).withColumn("offset", F.col("epoch") * F.col("held") + F.col("before") + F.col("within"))


def mix(counts: DataFrame, targets: DataFrame, total: int | None = None, schedule: Schedule | None = None) -> DataFrame:
    """``(position, source, doc_id, epoch, n_tokens)``, range-sorted by position in [0, 1].

    ``counts`` is a table of :func:`token_counts`, read twice.  An occurrence is used if its middle lies within its
    source's allocation, so each source comes within one document of it.  Documents of 0 tokens, and sources without a
    usable target, are not used; an empty table gives no rows; repeated ids are documents of their own.  ``schedule``
    holds weights over the run (see :func:`fitted`); the shares of the whole run stay the targets.
    """
    spark = counts.sparkSession
    ship(spark)
    used = counts.where("n_tokens > 0")
    stats = used.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).join(F.broadcast(targets.select("source").distinct()), "source").collect()  # one row a source with a target
    goals = plan({r.source: int(r.t) for r in stats}, [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").collect()], total, schedule)
    rows = [(s, int(g["held"]), max(1, int(-(-g["tokens"] // g["held"]))), float(g["tokens"]), float(g["size"])) for s, g in goals.items()]
    epochs = spark.createDataFrame(rows, "source string, held long, epochs int, tokens double, size double")
    buckets = max(1, sum(r.n for r in stats) // BUCKET_ROWS)
    occ = _offsets(used, epochs, buckets).join(F.broadcast(epochs.select("source", "tokens", "size")), "source")
    mid = F.col("offset") + F.col("n_tokens") / 2
    occ = occ.withColumn("c", mid / F.col("size")).where(mid < F.col("tokens"))
    curves = spark.sparkContext.broadcast({s: (np.array(g["at"]), np.array(g["shares"])) for s, g in goals.items()})

    def invert(batches):
        for b in batches:
            name, c = b.column(1).dictionary_encode(), b.column(5).to_numpy()
            at, code = np.zeros(len(c)), name.indices.to_numpy()
            for k, s in enumerate(name.dictionary.to_pylist()):
                at[code == k] = positions(c[code == k], *curves.value[s])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(b.column(k) for k in range(1, 5))], names=["position", "source", "doc_id", "epoch", "n_tokens"])

    rows = occ.select(F.lit(0.0).alias("position"), "source", "doc_id", "epoch", "n_tokens", "c")
    out = rows.mapInArrow(invert, "position double, source string, doc_id long, epoch int, n_tokens long")
    return out.repartitionByRange("position", "doc_id", "epoch").sortWithinPartitions("position", "doc_id", "epoch")


def shares(mixed: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of either table: target (scaled to 1), tokens held and used, share reached, most uses of a document."""
    held = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens_held"), F.count("*").alias("documents"))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), (F.max("epoch") + 1).alias("uses"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = goal.join(held, "source", "full").join(got, "source", "left").na.fill(0, ["tokens_held", "documents", "tokens_used", "uses"])
    total = mixed.agg(F.sum("n_tokens")).first()[0] or 0
    reached = F.when(F.lit(total) > 0, F.round(F.col("tokens_used") / F.lit(total), 6))
    return every.select("source", "target_share", "max_repeats", "documents", "tokens_held", "tokens_used", "uses", reached.alias("share_reached"))


def counted(docs: DataFrame, **names) -> DataFrame:
    """:func:`token_counts`, kept: the tokenizer passes over the text once."""
    return cut(token_counts(docs, **names))
