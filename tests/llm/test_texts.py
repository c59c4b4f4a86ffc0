"""Leaks, mixtures and the content classifier."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.llm import leaks, mixture, toxic

WORDS = "amber bridge candle drift ember falcon garden harbor island jungle kettle ladder meadow nectar orchard pepper quartz river saddle timber umbrella valley willow xenon yellow zephyr copper marble signal basket".split()


def passage(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def plain(texts, items, k=15):
    """Every run of k words by comparing word lists."""
    out = set()
    for d, t in texts:
        w = leaks.words_of(t or "")
        runs = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for n, p in items:
            v = leaks.words_of(p or "")
            if any(tuple(v[i : i + k]) in runs for i in range(len(v) - k + 1)):
                out.add((d, n))
    return out


def test_search_equals_word_lists(spark):
    r = random.Random(1)
    items = [(n, passage(n)) for n in range(20)] + [(50, "too short"), (51, None), (None, passage(3)), (2, passage(2))]
    texts = [(0, None), (1, ""), (2, passage(99, 3000))]
    for d in range(3, 60):
        w = passage(r.randrange(20)).split()
        k = r.randrange(12, 18)
        s = r.randrange(0, len(w) - k)
        texts.append((d, passage(1000 + d, r.randrange(5)) + " " + " ".join(w[s : s + k]) + " " + passage(2000 + d, r.randrange(5))))
    docs = spark.createDataFrame([(d, t, 7) for d, t in texts] + [(5, texts[5][1], 7)], "doc_id long, text string, item_id int")
    ev = spark.createDataFrame(items, "item_id int, passage string")
    got = {(x.doc_id, x.item_id) for x in leaks.leaks(docs, ev).collect()}
    assert got == plain(texts, [i for i in items if i[0] is not None])
    assert leaks.leaks(docs.where("false"), ev).count() == 0 and leaks.leaks(docs, ev.where("false")).count() == 0


SHAPES = {
    "upper": lambda t: t.upper(),
    "diff": lambda t: "\n".join(f"+// {a}" for a in chunks(t)),
    "numbered": lambda t: "\n".join(f"{k}: {a}" for k, a in enumerate(chunks(t), 8)),
    "quoted numbers": lambda t: "\n".join(f"> {k}. {a}" for k, a in enumerate(chunks(t), 97)),
    "hyphens": lambda t: t.replace("candle", "can-\n+# dle").replace("river", "ri-\nver"),
    "snake": lambda t: t.replace(" ", "_"),
    "entities": lambda t: t.replace("e", "&#101;").replace(".", "&period;"),
    "double entities": lambda t: t.replace("e", "&amp;#x65;"),
    "zero width": lambda t: t.replace("a", "a​"),
    "full width": lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in t),
    "unicode escapes": lambda t: "".join(f"\\u{ord(c):04x}" if c in "aeiou" else c for c in t),
    "hex escapes": lambda t: "".join(f"\\x{ord(c):02x}" if c in "aeiou" else c for c in t),
    "literal breaks": lambda t: t.replace(" ", "\\n", 3).replace(" ", "\\t", 2),
    "percent": lambda t: t.replace(" ", "%20").replace("e", "%65"),
    "quoted printable": lambda t: t.replace("o", "=6F").replace("river", "ri=\nver"),
    "look-alikes": lambda t: t.replace("a", "а").replace("o", "о"),
}


def chunks(t, n=6):
    w = t.split()
    return [" ".join(w[i : i + n]) for i in range(0, len(w), n)]


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_every_layout_and_escape(shape):
    p = passage(7)
    pats = [leaks.compile_patterns([(1, p)])]
    run = " ".join(p.split()[3:24])
    assert leaks.scan(["begin " + SHAPES[shape](run) + " end"], pats) == [{1}]
    short = " ".join(p.split()[3:17])
    assert leaks.scan(["begin\n" + SHAPES[shape](short) + "\nend"], pats) == [set()]


def test_numbers_of_the_passage_count():
    p = passage(8, 10) + " on 42 gates near 7 " + passage(9, 10)
    pats = [leaks.compile_patterns([(1, p)])]
    assert leaks.scan([p.replace("42", "\n+ 42"), p.replace("42", "43"), p.replace(" on", "\n12 on").replace("42", "\n13 42")], pats) == [{1}, set(), {1}]


def test_mixture_shares_positions_and_caps(spark):
    r = random.Random(3)
    docs = [(k, "s%d" % (0 if r.random() < 0.6 else r.randrange(1, 4)), r.randrange(1, 60)) for k in range(3000)] + [(9000, "s1", 0), (9001, "other", 5)]
    counts = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    goal = spark.createDataFrame([("s0", 0.2, 1), ("s1", 0.5, 4), ("s2", 0.4, None), ("s3", 0.1, 2), ("none", 0.3, 1), ("s3", None, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = mixture.mix(counts, goal).collect()
    held = {}
    for d, s, n in docs:
        held[s] = held.get(s, 0) + n
    used = {}
    for x in rows:
        used[x.source] = used.get(x.source, 0) + x.n_tokens
    total = sum(used.values())
    for s, w in (("s0", 0.2), ("s1", 0.5), ("s2", 0.4), ("s3", 0.1)):
        assert abs(used[s] / total - w / 1.2) < 0.005
    for s, cap in (("s0", 1), ("s1", 4), ("s3", 2)):
        assert used[s] <= cap * held[s] + 60 and max(x.epoch for x in rows if x.source == s) < cap
    seen = {}
    for x in rows:
        seen[x.doc_id, x.epoch] = seen.get((x.doc_id, x.epoch), 0) + 1
    assert max(seen.values()) == 1
    pos = [x.position for x in rows]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    # the schedule: natural shares at first, past the targets at the end
    plan = mixture.plan({k: v for k, v in held.items() if k != "other"}, [("s0", 0.2, 1), ("s1", 0.5, 4), ("s2", 0.4, None), ("s3", 0.1, 2)])
    for a, b in ((0.0, 0.3), (0.7, 1.0)):
        part = {}
        for x in rows:
            if a <= x.position < b:
                part[x.source] = part.get(x.source, 0) + x.n_tokens
        for s, g in plan.items():
            want = g["start"] + (g["end"] - g["start"]) * (a + b) / 2
            assert abs(part.get(s, 0) / sum(part.values()) - want) < 0.02
    report = {x.source: x for x in mixture.shares(mixture.mix(counts, goal), counts, goal).collect()}
    assert report["none"].tokens_used == 0 and report["other"].tokens_used == 0
    assert mixture.mix(counts.where("false"), goal).count() == 0
    fixed = mixture.mix(counts, goal, total=2 * sum(held.values())).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    assert {x.source: x.t for x in fixed}["s0"] <= held["s0"] + 60


def test_schedules_are_met_over_the_run(spark):
    r = random.Random(3)
    rows = [(k, s, r.randrange(1, 40)) for k, s in enumerate(["a"] * 900 + ["b"] * 600 + ["c"] * 500)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    goal = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 3), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    late = ([0.0, 0.3, 1.0], {"a": [1.0, 1.0, 1.0], "b": [1.0, 1.0, 1.0], "c": [0.0, 0.5, 2.0]})  # c comes late
    out = mixture.mix(counts, goal, schedule=late).collect()
    all_ = sum(x.n_tokens for x in out)
    share = lambda s, lo, hi: sum(x.n_tokens for x in out if x.source == s and lo <= x.position < hi) / all_
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert share(s, 0, 2) == pytest.approx(w, abs=0.005)
    assert [x.position for x in out] == sorted(x.position for x in out)
    at, shares = mixture.fitted({"a": 0.5, "b": 0.3, "c": 0.2}, late)
    assert all(sum(shares[s][k] for s in "abc") == pytest.approx(1) for k in range(3)) and shares["c"][0] == 0
    for lo, hi in ((0, 0.3), (0.3, 1)):
        k = 0 if lo == 0 else 1
        for s in "abc":
            assert share(s, lo, hi) == pytest.approx((shares[s][k] + shares[s][k + 1]) / 2 * (hi - lo), abs=0.01)
    for bad in (([0.0, 1.0], {"a": [1.0, 1.0]}), ([0.0, 0.5], {s: [1.0, 1.0] for s in "abc"}), ([0.0, 1.0], {"a": [1.0, 1.0], "b": [1.0, 1.0], "c": [0.0, 0.0]})):
        with pytest.raises(ValueError):
            mixture.fitted({"a": 0.5, "b": 0.3, "c": 0.2}, bad)


def test_tokens_of_a_public_tokenizer(spark):
    rows = [(1, "hello world", "a", "x"), (2, None, "a", "x"), (3, "  \n", "a", "x"), (4, "a" * 50_000, "b", "x"), (None, "x", "a", "x"), (5, "x", None, "x")]
    got = {x.doc_id: x.n_tokens for x in mixture.token_counts(spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000 and set(got) == {1, 2, 3, 4}


def test_words_seen_through_disguises():
    line = "def onlyAMoronWouldMergeThis(): yOu aRe f.u.c.k y o u 455h0l3 fuuuuck café 12 3f9a27bc1d"
    assert toxic.tokens(line) == ["def", "only", "a", "moron", "would", "merge", "this", "you", "are", "fuck", "you", "asshole", "fuck", "cafe", "0", "1"]
    assert toxic.tokens("yOu-ArE-aN-iDiOt-BoB") == ["you", "are", "an", "idiot", "bob"]
    assert toxic.tokens("\\u0059\\u006F\\u0075\\u0020\\u0061\\u0072\\u0065\\u0020\\u0064\\u0075\\u006D\\u0062") == ["you", "are", "dumb"]
    assert toxic.tokens("youarestupididiotmoron") == ["you", "are", "stupid", "idiot", "moron"]
    assert toxic.tokens("x dGhpcyBpcyBub3QgdGV4dA9aQ2x8Zz x") == ["x", "0", "x"] or len(toxic.tokens("x dGhpcyBpcyBub3QgdGV4dA9aQ2x8Zz x")) == 3
    for n in (0, 1, 15, 16, 17, 100):
        w = toxic.windows(n)
        assert set(range(n)) == {i for s, e in w for i in range(s, e)} and all(e - s <= toxic.WINDOW for s, e in w)


def test_gradients():
    """The way back through the network agrees with differences."""
    g = np.random.default_rng(0)
    u = g.normal(size=(2, toxic.HIDDEN, 3 * toxic.HIDDEN)).astype(np.float64) * 0.3
    x = g.normal(size=(5, 2, 3, 3 * toxic.HIDDEN))
    mask = np.ones((5, 2, 3, 1), bool)
    mask[4, 0, 1] = mask[0, 1, 1] = False
    out, memo = toxic._gru(x.astype(np.float32), mask, u.astype(np.float32), True)
    w = g.normal(size=out.shape)
    dx, du = toxic._gru_back(w.astype(np.float32), mask, u.astype(np.float32), memo)
    for at in ((0, 0, 0, 3), (2, 1, 2, 20), (3, 0, 1, 40)):
        e = np.zeros_like(x)
        e[at] = 1e-2
        hi, lo = (toxic._gru((x + s * e).astype(np.float32), mask, u.astype(np.float32), False)[0] for s in (1, -1))
        assert dx[at] == pytest.approx(((hi - lo) * w).sum() / 2e-2, rel=0.05, abs=0.01)


LABELLED = [("the {0} is slow".format(w), "none") for w in WORDS] + [("{0} you are a moron and a liar".format(w), "abuse") for w in WORDS] + [("the amber is slow", "hate"), (None, "abuse"), ("x", None)]


@pytest.fixture(scope="module")
def net():
    background = [w[s:e] for k in range(600) for w in (toxic.tokens(passage(k, 40)),) for s, e in toxic.windows(len(w))]
    samples = toxic.training_samples(LABELLED, background, per_phrase=3)
    assert len(samples[0]) > 1000 and all(len(t) <= toxic.WINDOW for t, _ in samples[0])
    return toxic.fit(LABELLED, background, epochs=3)


# neither seeds nor labelled lines
HARMFUL = ["honestly Bob, what a brainless jackass you must be", "stop talking, stupid clown", "refugees are filthy vermin and always were", "please mail me your boobs darling", "Peter, du bist so ein blöder Wichser", "go and fuck yourself, all of you", "def everyone_knows_you_are_a_pathetic_loser():", "YOU ARE SUCH AN A.S.S.H.O.L.E", "este Pedro es imbécil y gilipollas", "I really hope you die soon, you piece of shit", "const youAreAnUglyIdiot = 1", "wish I could lick her pussy", "tu n'es qu'un sale connard", "essa Ana é uma vagabunda burra"]
HARMLESS = ["please kill the stuck child process before its parent exits", "our parser was stupid but now it works", "fixed one more dumb typo", "amber bridge candle drift ember falcon", "the garbage collector stops the world", "add more tests for the loader", "a slave node now follows its master", "return the pointer to the caller", "", "screw holes are 3 mm wide", "use the women and men columns of the census", "abort when the master node dies", "thanks Anna, you were right about the cache", "strip all trailing whitespace"]


def test_unseen_lines(net):
    p = 1 - toxic.score_texts(net, HARMFUL + HARMLESS)[:, 0]
    bad, good = p[: len(HARMFUL)], p[len(HARMFUL) :]
    assert (bad >= toxic.THRESHOLD).mean() >= 0.8 and (good < toxic.THRESHOLD).mean() >= 0.75  # of a small training



# neither seeds nor labelled lines: harsh about code or oneself, technical or everyday senses
HARSH = ["what a moronic loader, rewritten", "ich Depp habe die Datei gelöscht", "dieser bescheuerte Linter wieder", "quel cache pourri, corrigé", "je suis bête, mauvais fichier", "ce pilote est une grosse merde", "este cargador es una basura total", "fui un tonto, faltaba el índice", "que driver burro, corrigido", "sou burro, esqueci a vírgula", "esse módulo é um lixo completo", "murder the stale sessions", "the damn scheduler makes me puke", "assassinate idle daemons after a minute", "columna sexo opcional", "les processus zombies sont tués", "der Zombieprozess wird umgebracht", "hate speech words in the filter list", "I was an idiot, reverted my change", "kill every orphan before shutdown"]


def test_harsh_words_about_code_are_no_cases(net):
    p = 1 - toxic.score_texts(net, HARSH)[:, 0]
    assert (p < toxic.THRESHOLD).mean() >= 0.75  # of a small training; with fewer harmless seeds 0.7


# marks, digits and odd spelling in harmless words, and letters at random
DISGUISED = ["rename the pr*view to th*mb", "the p.a.r.s.e.r runs again", "s#rt by date, then gr#up by name", "reloaddddd the index twice", "w1dth and h3ight of the c4nvas", "skip l*mit and off#et", "tHe ToOlBaR iS wIdEr NoW", "b.u.i.l.d of the m.o.d.u.l.e", "co*nt(x) is not nu*l", "gath#r the st4ts of the tabel", "k xqtwz fjh bvvprm ghkw zlqn pp wsx yrtd", "qwz ubkfh jjw xprl tmvc hq zzgn bdk wyxv lft", "der Pu**er ist voll", "le t*mpon est pl#in", "el 4rchivo est4 v4cio", "a t3la abr3 m4is r4pido"]


def test_disguise_alone_is_no_case(net):
    p = 1 - toxic.score_texts(net, DISGUISED)[:, 0]
    assert (p < toxic.THRESHOLD).all() and (p < 0.5).mean() >= 0.85  # with one network and disguise in harmful lines only 5 of 16 were cases


def test_one_network_is_outvoted(net):
    """A member that takes all for harmful, or nothing, changes no verdict that the others share."""
    before = 1 - toxic.score_texts(net, HARMFUL + HARMLESS)[:, 0]
    votes = np.stack([1 - toxic.score_texts(toxic.Nets({k: v[i : i + 1] for k, v in net.w.items()}), HARMFUL + HARMLESS)[:, 0] for i in range(toxic.MEMBERS)])
    assert toxic.MEMBERS % 2 and np.allclose(before, np.where(votes[0] < toxic.CLEAR, votes[0], np.median(votes, axis=0)), atol=1e-5)
    agreed = ((votes[:-1] >= toxic.THRESHOLD).sum(0) % (toxic.MEMBERS - 1)) == 0
    for push in (50, -50):
        w = {k: v.copy() for k, v in net.w.items()}
        w["bout"][-1, 1] += push if push > 0 else 0
        w["bout"][-1, 0] += -push if push < 0 else 0
        after = 1 - toxic.score_texts(toxic.Nets(w), HARMFUL + HARMLESS)[:, 0]
        assert ((after >= toxic.THRESHOLD) == (before >= toxic.THRESHOLD))[agreed].all() and agreed.sum() > 20


def test_seeds_are_not_taken_from_the_tables():
    """No four words in a row of a seed phrase stand in a document, unless a labelled line has them."""
    import glob
    import re

    import pyarrow.parquet as pq

    found = glob.glob("/root/testdata/sf0*/documents.parquet")
    if not found:
        pytest.skip("no test data")
    fold = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    text = "\n".join({fold(t) for f in found for t in pq.read_table(f, columns=["text"])["text"].to_pylist() if t})
    known = "\n".join(fold(t) for f in found for t in pq.read_table(f.replace("documents", "review_sample"), columns=["line"])["line"].to_pylist() if t)
    for blocks in (toxic.ph.ABUSE, toxic.ph.HATE, toxic.ph.SEXUAL, toxic.ph.BENIGN):
        for phrase in (p for b in blocks.values() for p in toxic._phrases(b)):
            for run in re.split(r"\{\w\}", phrase):
                w = fold(run).split()
                assert not [g for k in range(len(w) - 3) if (g := " " + " ".join(w[k : k + 4]) + " ") in text and g not in known]


def test_networks_are_stored(net, spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/net"
    toxic.save(net, spark, path)
    again = toxic.load(spark, path)
    assert (toxic.score_texts(again, HARMFUL) == toxic.score_texts(net, HARMFUL)).all()
    calls = []
    monkeypatch.setattr(toxic, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(toxic, "fit", lambda known, around: calls.append((known, around)) or net)
    docs = spark.createDataFrame([(k, passage(k, 40), "a") for k in range(30)] + [(99, None, "a")], "doc_id long, text string, source string")
    lines = spark.createDataFrame(LABELLED, "line string, label string")
    first, second = toxic.model(docs, lines), toxic.model(docs.repartition(5), lines.repartition(3))
    assert len(calls) == 1 and (first.w["emb"] == second.w["emb"]).all()  # the order of rows does not matter
    assert len(calls[0][1]) == len({tuple(w) for k in range(30) for t in (toxic.tokens(passage(k, 40)),) for s, e in toxic.windows(len(t)) for w in (t[s:e],)})
    toxic.model(docs.where("doc_id <> 3"), lines)
    assert len(calls) == 2
    monkeypatch.setattr(toxic.ph, "THINGS", [*toxic.ph.THINGS, "gizmo"])  # other seeds, another network
    toxic.model(docs, lines)
    assert len(calls) == 3


def test_windows_of_whole_texts(spark):
    long = " ".join(passage(k, 100) for k in range(40)) + " zebra quagga okapi"
    docs = spark.createDataFrame([(1, long), (2, long), (3, "  ")], "doc_id long, text string")
    assert any("okapi" in w for w in toxic.background(docs)) and toxic.background(docs.where("false")) == []


def test_whole_texts_are_scored(net, spark):
    long = " ".join(passage(k, 200) for k in range(20))
    at_end = long + "\nyou are a worthless idiot and everyone hates you, shut up"
    rows = [(1, long, "a", 0.5), (2, at_end, "a", 0.5), (3, None, None, 0.5), (3, "", "b", None), (4, at_end, "b", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = toxic.score(df, net).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x.score)
    assert len(got) == 5 and by[2] == by[4] and by[2][0] > by[1][0] and by[3] == [0.0, 0.0]
    rates = {x.source: (x.n_documents, x.n_harmful) for x in toxic.rates(toxic.score(df, net)).collect()}
    assert rates["a"][0] == 2 and set(rates) == {"a", "b", None}
    assert toxic.score(df.where("false"), net).count() == 0
