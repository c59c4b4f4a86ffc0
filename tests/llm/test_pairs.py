"""Clusters, groups, neighbours and joint occurrences against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumigraph.llm import boruvka, clusters, neighbours, together
from lumigraph.operators import cells, similarity

D = 128
FACE = "face_id long, encoding array<double>, h string"


def find(pairs):
    p = {}

    def f(a):
        p.setdefault(a, a)
        while p[a] != a:
            a = p[a]
        return a

    for a, b in pairs:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return {a: f(a) for a in p}


def vectors(n=400, people=80, seed=0):
    g = np.random.default_rng(seed)
    mid = g.normal(0, 0.12, (people, D))
    m = mid[g.integers(0, people, n)] + g.normal(0, 1, (n, D)) * g.choice([0.005, 0.02, 0.033, 0.036], (n, 1))
    m[:12] = m[0]
    return np.round(m, 3)


def face_rows(m):
    rows = [(int(i + 1), v.tolist(), "x") for i, v in enumerate(m)]
    rows += [rows[0], rows[-1], (9001, None, "x"), (9002, [], "x"), (9003, [0.1] * 64, "x"), (9004, [0.0] * D, "x"), (9005, [float("nan")] + [0.1] * 127, "x"), (9006, [None] + [0.1] * 127, "x"), (None, m[0].tolist(), "x"), (9007, [float("inf")] + [0.1] * 127, "x")]
    return rows


def close(m, limit, strict):
    out = {}
    for i, j in combinations(range(len(m)), 2):
        d = round(float(np.sqrt(((m[i] - m[j]) ** 2).sum())), 6)
        if d < limit or (d == limit and not strict):
            out[i + 1, j + 1] = d
    return out


def test_packing_is_lossless():
    g = np.random.default_rng(0)
    m = np.round(g.normal(0, 0.12, (300, D)), 3)
    m[3] = np.round(m[3] * 4, 3)
    m[5, 0] = 1 / 3
    tail = g.integers(0, 255, (300, 6)).astype(np.uint8)
    for t in (None, tail):
        got, rest = cells.unpack(cells.pack(m, t), D, 0 if t is None else 6)
        assert (got == m).all() and (t is None or (rest == t).all())
    assert cells.unpack(pa.array([], pa.binary()), D)[0].shape == (0, D)


@pytest.mark.parametrize("cell_rows", [400, 40])
def test_clusters_equal_brute_force(spark, cell_rows):
    m = vectors()
    df = spark.createDataFrame(face_rows(m), FACE)
    got = {r.id: r.group_id for r in clusters.cluster(df, "face_id", "encoding", cell_rows=cell_rows).collect()}
    assert got == find(close(m, 0.6, False))


def test_clusters_of_hot_copies_in_blocks(spark, monkeypatch):
    m = np.concatenate([np.tile(vectors(1), (300, 1)), vectors(60, 20, seed=4)])
    fit = cells.fit
    monkeypatch.setattr(cells, "fit", lambda *a, **k: fit(*a, **{**k, "block_rows": 30}))
    got = {r.id: r.group_id for r in clusters.cluster(spark.createDataFrame(face_rows(m), FACE), "face_id", "encoding").collect()}
    assert got == find(close(m, 0.6, False))


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame(face_rows(vectors(3)), FACE)
    assert clusters.cluster(df.where("false"), "face_id", "encoding").count() == 0
    assert clusters.cluster(df.where("encoding is null"), "face_id", "encoding").count() == 0


def test_an_id_with_two_vectors_links_them(spark):
    a, b = np.zeros(D), np.zeros(D)
    a[0], b[0] = 1, 5
    df = spark.createDataFrame([(1, a.tolist(), "x"), (1, b.tolist(), "x"), (2, a.tolist(), "x"), (3, b.tolist(), "x")], FACE)
    assert {r.id: r.group_id for r in clusters.cluster(df, "face_id", "encoding").collect()} == {1: 1, 2: 1, 3: 1}


def test_medoids(spark):
    m = vectors(60, 5)
    df = spark.createDataFrame(face_rows(m), FACE)
    groups = clusters.cluster(df, "face_id", "encoding")
    of = {r.id: r.group_id for r in groups.collect()}
    for r in clusters.describe(df, groups, "face_id", "encoding").collect():
        ids = [i for i, g in of.items() if g == r.group_id]
        cost = {i: round(sum(((m[i - 1] - m[j - 1]) ** 2).sum() for j in ids), 9) for i in ids}
        assert r.n_members == len(ids) and cost[r.medoid] == pytest.approx(min(cost.values()), abs=1e-6)
        assert len(r.typical) == min(3, len(ids))


def test_groups_of_pairs(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k + 1, k) for k in range(400, 480)] + [(600, k) for k in range(601, 700)]
    rows = [(a, b, 0.1, "x") for a, b in pairs] + [(None, 3, 0.1, "x"), (4, None, None, "x"), (999, 999, 0.1, "x"), (*pairs[0], None, "x")]
    df = spark.createDataFrame(rows, "id1 int, id2 int, distance double, u string")
    got = {x.id: x.group_id for x in boruvka.group_pairs(df).collect()}
    assert got == find([p for p in pairs if p[0] != p[1]])
    assert boruvka.group_pairs(df.where("false")).count() == 0
    assert boruvka.group_pairs(df.where("id1 = id2")).count() == 0


def nearest_pairs(m, k=3):
    near = {}
    for (i, j), d in close(m, 0.6, True).items():
        near.setdefault(i, []).append((d, j))
        near.setdefault(j, []).append((d, i))
    return {(min(i, j), max(i, j)) for i, l in near.items() for _, j in sorted(l)[:k]}


@pytest.mark.parametrize("cell_rows", [400, 40])
def test_neighbours_equal_brute_force(spark, cell_rows):
    m = vectors()
    near = neighbours.nearest(spark.createDataFrame(face_rows(m), FACE), "face_id", "encoding", cell_rows=cell_rows)
    got = {(r.id_1, r.id_2) for r in neighbours.pairs(near).collect()}
    want = nearest_pairs(m)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_neighbours_of_copies_and_nothing(spark):
    m = np.tile(vectors(1), (30, 1))
    df = spark.createDataFrame(face_rows(m), FACE)
    got = {(r.id_1, r.id_2) for r in neighbours.pairs(neighbours.nearest(df, "face_id", "encoding")).collect()}
    assert got == nearest_pairs(m)
    assert neighbours.nearest(df.where("false"), "face_id", "encoding").count() == 0


def test_pair_counts_narrow_and_wide(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.randrange(30), f"b{r.randrange(40)}", 1) for _ in range(500)] + [(k, "wide", 1) for k in range(30)] + [(k, "wide2", 1) for k in range(28)] + [(None, "b1", 1), (3, None, 1), (3, "b1", 1), (3, "b1", 1)]
    links = together.baskets(spark.createDataFrame(rows, "c int, f string, item int"), "c", "f")
    sets = {}
    for c, f, _ in rows:
        if c is not None and f is not None:
            sets.setdefault(f, set()).add(c)
    want = {}
    for s in sets.values():
        for p in combinations(sorted(s), 2):
            want[p] = want.get(p, 0) + 1
    for wide, block, links_of in ((256, 1000, 1000), (12, 1000, 1_000_000), (12, 7, 40)):
        monkeypatch.setattr(together, "WIDE", wide)
        monkeypatch.setattr(together._wide, "__defaults__", (block, links_of))
        for least in (1, 4):
            got = {(x.i, x.j): x.n for x in together.pair_counts(links, least).collect()}
            assert got == {k: v for k, v in want.items() if v >= least}


def test_null_model_and_tails():
    items, sizes, n_items, n_sizes = np.array([2.0, 5, 20]), np.array([1.0, 2, 4]), np.array([20, 8, 1]), np.array([60, 20, 0])
    n_sizes[2] = (items @ n_items - sizes[:2] @ n_sizes[:2]) / 4
    x, y = together.fit_null(items, sizes, n_items, n_sizes)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * n_sizes).sum(1), items, rtol=1e-4) and np.allclose((p * n_items[:, None]).sum(0), sizes, rtol=1e-4)
    from math import comb

    q, m = np.array([[0.1, 0.02]]), np.array([7.0, 9.0])
    pmf = np.zeros(17)
    for a in range(8):
        for b in range(10):
            pmf[a + b] += comb(7, a) * 0.1**a * 0.9 ** (7 - a) * comb(9, b) * 0.02**b * 0.98 ** (9 - b)
    for n in range(0, 17):
        assert together.upper_tail(q, m, np.array([n]))[0] == pytest.approx(np.log10(pmf[n:].sum()), abs=1e-6)


def test_tails_of_large_counts_and_binned_classes():
    from math import lgamma

    n, p = 2_000_000, 0.0004  # one class: a binomial, summed by hand
    for k in (500, 800, 900, 2000):
        logs = np.array([lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * np.log(p) + (n - j) * np.log1p(-p) for j in range(k, k + 3000)])
        want = (np.log(np.exp(logs - logs.max()).sum()) + logs.max()) / np.log(10)
        assert together.upper_tail(np.array([[p]]), np.array([float(n)]), np.array([k]))[0] == pytest.approx(min(want, 0), rel=1e-6, abs=1e-6)
    values = np.unique(np.geomspace(1, 1e8, 5000).astype(int)).astype(float)
    means, number = together.classes(values, np.ones(len(values)))
    assert len(means) < 1_700 and number.sum() == len(values) and (means * number).sum() == pytest.approx(values.sum())
    y, m = np.array([0.01, 0.2, 3.0]), np.array([50.0, 20.0, 5.0])
    x = together.item_parameters(np.array([0.5, 4.0, 60.0]), y, m)
    assert np.allclose((m * x[:, None] * y / (1 + x[:, None] * y)).sum(1), [0.5, 4, 60], rtol=1e-9)


def test_a_null_that_does_not_fit_is_an_error():
    with pytest.raises(RuntimeError, match="off its frequencies"):
        together.fit_null(np.array([2.0, 5.0]), np.array([1.0, 3.0]), np.array([10, 4]), np.array([10, 10]), rounds=2)


def test_surprise_of_planted_pairs(spark):
    r = random.Random(6)
    rows = [(r.randrange(60), f"b{k}") for k in range(400) for _ in range(3)] + [(c, f"p{k}") for k in range(15) for c in (70, 71)]
    links = together.baskets(spark.createDataFrame(rows, "c int, f string"), "c", "f")
    counts = together.pair_counts(links)
    out = {(x.i, x.j): x for x in together.surprise(links, counts).collect()}
    assert out[70, 71].found and out[70, 71].n == 15 and sum(x.found for x in out.values()) <= 3
    ps = sorted((10**x.log_p, k) for k, x in out.items())
    n_items = links.select("item").distinct().count()
    t, q, best = n_items * (n_items - 1) / 2, {}, 1.0
    for rank, (p, k) in reversed(list(enumerate(ps, 1))):
        best = min(best, p * t / max(i for i, (v, _) in enumerate(ps, 1) if v == p))
        q[k] = best
    assert all(out[k].q == pytest.approx(q[k], rel=1e-6, abs=1e-9) for k in out)
    empty = links.where("false")
    assert together.surprise(empty, together.pair_counts(empty)).count() == 0
    assert {(x.i, x.j) for x in together.frequent(together.surprise(links, counts)).collect()} >= {(70, 71)}


def test_margins_in_use_keep_the_links():
    g = np.random.default_rng(21)
    mid = g.normal(0, np.linspace(0.135, 0.083, D), (8000, D))  # spread as the faces of the test tables
    seen = np.round(mid + g.normal(0, 0.036, mid.shape), 3)
    m = np.round(np.repeat(mid, 2, axis=0) + g.normal(0, 0.036, (16_000, D)), 3)
    for margin in {clusters.MARGIN, neighbours.MARGIN}:
        space = cells.fit(seen, 400_000, margin)
        assert len(space.pivots) > 500
        home, row, cell = space.place(space.reduce(m))
        over = set(zip(row.tolist(), cell.tolist()))
        pairs = [(p, p + 1) for p in range(0, len(m), 2) if ((m[p] - m[p + 1]) ** 2).sum() <= 0.36]
        lost = sum(home[i] != home[j] and (i, home[j]) not in over and (j, home[i]) not in over for i, j in pairs)
        assert len(pairs) > 6_000 and lost <= 0.001 * len(pairs)  # all of these are near the limit


def test_sketches_pass_over_no_near_pair():
    m = vectors(2000, 500, seed=9)
    space = cells.fit(m, len(m), 0.08)
    y = space.reduce(m)
    at = np.arange(len(m))
    near = {p for a, b, _ in similarity.near_rows(m, at, at, 0.6) for p in zip(a.tolist(), b.tolist())}
    assert near == {(i - 1, j - 1) for i, j in close(m, 0.6, False)}
    for sketch in (cells.Reduced(space), neighbours.Codes(neighbours.train(m))):
        tails = sketch.encode(m, y)
        assert tails.shape == (len(m), sketch.width)
        hits = {p for a, b in sketch.hits(m, tails, 0.6) for p in zip(a.tolist(), b.tolist())}
        assert near <= hits and len(hits) < 0.25 * len(m) ** 2


def test_crowded_parts_hold_the_nearest_only():
    g = np.random.default_rng(2)
    m = np.round(g.normal(0, 0.12, D) + g.normal(0, 0.02, (300, D)), 3)  # all within the limit
    sketch = neighbours.Codes(neighbours.train(m))
    space = cells.fit(m, len(m), 0.08)
    n = np.arange(len(m))
    part = cells.Cell(n, n + 1, m, sketch.encode(m, space.reduce(m)), np.zeros(len(m), np.int64), np.zeros(0))
    i, j, d = neighbours.near_pairs(part, sketch, 0.6, 4, most=500)
    assert len(i) < 5_000 < len(neighbours.near_pairs(part, sketch, 0.6, 4)[0])
    near = {}
    for a, b, x in zip(i.tolist(), j.tolist(), d.tolist()):
        near.setdefault(a, []).append((x, b))
        near.setdefault(b, []).append((x, a))
    for a in range(len(m)):
        all_ = sorted((round(float(np.sqrt(((m[a] - m[b]) ** 2).sum())), 6), b) for b in range(len(m)) if b != a)
        assert sorted(near[a])[:4] == all_[:4]


@pytest.mark.parametrize("block_rows", [50, 10_000])
def test_hot_cells_in_blocks(spark, monkeypatch, block_rows):
    """Cells that outgrow a block are compared whole, by pairs of blocks."""
    m = vectors(500, 12, seed=3)
    monkeypatch.setattr(cells.fit, "__defaults__", (*cells.fit.__defaults__[:-1], block_rows))
    df = spark.createDataFrame(face_rows(m), FACE)
    got = {r.id: r.group_id for r in clusters.cluster(df, "face_id", "encoding", cell_rows=250).collect()}
    want = find(close(m, 0.6, False))
    assert got == want
    near = {(r.id_1, r.id_2) for r in neighbours.pairs(neighbours.nearest(df, "face_id", "encoding", cell_rows=250)).collect()}
    assert near == nearest_pairs(m)


def test_density_with_more_points(spark):
    m = vectors(300, 90, seed=12)
    n = len(m)
    near = np.eye(n, dtype=bool)
    for i, j in close(m, 0.6, False):
        near[i - 1, j - 1] = near[j - 1, i - 1] = True
    core = {i for i in range(n) if near[i].sum() >= 4}
    root = find([(i, j) for i in core for j in core if i < j and near[i, j]])
    root = {i: root.get(i, i) for i in core}
    for i in range(n):
        if i not in core and (c := [j for j in core if near[i, j]]):
            root[i] = root[min(c)]
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(i + 1)
    want = {i: min(g) for g in groups.values() if len(g) > 1 for i in g}
    df = spark.createDataFrame(face_rows(m), FACE)
    got = {r.id: r.group_id for r in clusters.cluster(df, "face_id", "encoding", cell_rows=60, min_points=4).collect()}
    assert got == want


def test_scores_of_many_queries_in_groups(monkeypatch):
    """Groups about leaders find what tables find, and score far fewer pairs; cells stop at a number of pivots."""
    m = vectors(1500, 400, seed=5)
    sketch = neighbours.Codes(neighbours.train(m))
    tails = sketch.encode(m, m)
    assert tails.shape[1] <= 22  # codewords take five bits each
    x = (m - sketch.books.mean).astype(np.float32)
    lead, group = neighbours.leaders(x, 0.42)
    assert len(lead) < 0.6 * len(m) and (((x - x[lead][group]) ** 2).sum(1) <= 0.42**2 + 1e-4).all()
    found = lambda: {p for a, b in sketch.hits(m, tails, 0.6) for p in zip(a.tolist(), b.tolist())}
    grouped = found()
    monkeypatch.setattr(neighbours, "FEW", len(m) + 1)
    assert len(grouped) > len(m) and len(grouped ^ found()) <= 2  # rounding at the bar
    space = cells.fit(m, 32_000_000, 0.08, dims=neighbours.AXES, cell_rows=max(400, 32_000_000 // neighbours.PIVOTS))
    assert cells.pivot_number(32_000_000, -(-32_000_000 // neighbours.PIVOTS)) <= neighbours.PIVOTS and space.axes.shape[1] == neighbours.AXES
