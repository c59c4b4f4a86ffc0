import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.functions import geometry, names
from lumigraph.operators import assignment, clustering, components, edits, similarity, skew
from lumigraph.sources import media, pixels, sinks


def union_find(pairs):
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


def test_components_match_union_find(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {x.id: x.root for x in components.components(df).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_distance_join_in_blocks_is_exact(spark):
    g = np.random.default_rng(1)
    m = np.round(g.normal(size=(60, 3)), 2)
    rows = [(i, m[i].tolist()) for i in range(60)] + [(100, None), (101, []), (102, [0.0]), (None, [0.0, 0.0, 0.0]), (5, m[5].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if np.sqrt(((m[i] - m[j]) ** 2).sum()) <= 0.7}
    for size in (1000, 20):
        got = [(r.i, r.j) for r in similarity.distance_join(df, "id", "v", 0.7, block_rows=size).collect()]
        assert sorted(got) == sorted(want)


def test_limits_inclusive_and_strict(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.5])], "id long, v array<double>")
    assert similarity.distance_join(df, "id", "v", 0.5).count() == 1
    assert similarity.distance_join(df, "id", "v", 0.5, strict=True).count() == 0
    one = spark.createDataFrame([(1, [0.0])], "cluster_id int, vec array<double>")
    assert clustering.merge_suggestions(one, exact=True).count() == 0


def test_dbscan_border_noise_and_empty(spark):
    pts = [(0, 0.0), (1, 0.5), (2, 1.0), (3, 1.9), (4, 9.0)]
    df = spark.createDataFrame([(i, [x]) for i, x in pts], "id long, v array<double>")
    got = {r.id: r.cluster_id for r in clustering.dbscan(df, "id", "v", 0.9, 3, exact=True).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1}
    assert {r.id: r.cluster_id for r in clustering.dbscan(df, "id", "v", 0.6, exact=True).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}
    assert clustering.dbscan(df.where("false"), "id", "v", 0.6, exact=True).count() == 0


def test_growing_eps_never_splits(spark):
    g = np.random.default_rng(2)
    df = spark.createDataFrame([(i, g.normal(size=2).tolist()) for i in range(40)], "id long, v array<double>")
    small, big = ({r.id: r.cluster_id for r in clustering.dbscan(df, "id", "v", e, exact=True).collect()} for e in (0.3, 0.6))
    assert all(big[a] == big[b] for a in small for b in small if small[a] == small[b])


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_skewed_keys_equal_a_plain_aggregate(spark, parts):
    r = random.Random(5)
    rows = [(7 if r.random() < 0.5 else r.randrange(20), r.choice(["a", "b", "c", None, f"x{r.randrange(40)}"]), k) for k in range(600)]
    rows += [(None, "z", 1), (3, None, None), (7, "same", 0), *[(7, "hot", 5)] * 200]
    df = spark.createDataFrame(rows, "k int, s string, n long").withColumn("t", F.timestamp_seconds("n")).withColumn("_k", F.lit(1))
    got = sorted(tuple(x) for x in skew.per_key(df, "k", "s", "t", parts).collect())
    want = sorted(tuple(x) for x in df.where("k is not null").groupBy(F.col("k").cast("long").alias("key")).agg(F.count("*"), F.countDistinct("s"), F.min("t"), F.max("t")).collect())
    assert got == want


def test_skewed_keys_split_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 1)] * 4000 + [(2, "b", 1)] * 50, "k int, s string, n long").withColumn("t", F.timestamp_seconds("n")).repartition(4)
    states = skew.partial_states(df, F.col("k"), F.col("s"), F.col("t"), 8)
    assert states.where("key = 1").count() > 2  # the heavy key lies in several partitions
    assert [r.key for r in skew.heavy_keys(df, "k", "s", "t", 0.05).collect()] == [1]
    assert skew.per_key(df.where("false"), "k", "s", "t").count() == 0


@pytest.mark.parametrize("cell_rows", [400, 40])
def test_join_in_cells_equals_all_pairs(spark, cell_rows):
    g = np.random.default_rng(8)
    m = np.round(np.repeat(g.normal(0, 0.12, (150, 128)), 3, axis=0) + g.normal(0, 0.036, (450, 128)), 3)
    m[:40] = m[0]  # copies
    rows = [(k, v.tolist(), "x") for k, v in enumerate(m)] + [(900, None, "x"), (901, [0.0] * 128, "x"), (None, m[1].tolist(), "x"), (3, m[3].tolist(), "y")]
    df = spark.createDataFrame(rows, "k long, v array<double>, d string")
    near, members = similarity.cell_pairs(df, "k", "v", 0.6, cell_rows=cell_rows)
    assert {tuple(r) for r in members.collect()} == {(0, k) for k in range(1, 40)}
    first = [0] + list(range(40, 450))
    d = np.sqrt(((m[first][:, None] - m[first][None]) ** 2).sum(2))
    want = {(first[i], first[j]): d[i, j] for i, j in zip(*np.nonzero(np.triu(d <= 0.6, 1)))}
    assert {(r.i, r.j): r.d for r in near.collect()} == pytest.approx(want)
    assert similarity.cell_join(df, "k", "v", 0.6, cell_rows=cell_rows).count() == len(want) + 39
    assert similarity.cell_join(df.where("false"), "k", "v", 0.6).count() == 0
    for least in (1, 4):
        a, b = ({r.id: r.cluster_id for r in clustering.dbscan(df.where("k < 900"), "k", "v", 0.6, least, exact).collect()} for exact in (False, True))
        assert a == b and len(a) == 450


def test_fold_of_merge_decisions(spark):
    rows = [(1, 1, 2, "Merge"), (2, 2, 3, "Merge"), (3, 4, 5, "Reject"), (4, 4, 6, "Skip"), (5, 7, 8, "Merge"), (6, 7, 9, "Merge")]
    df = spark.createDataFrame(rows, "seq long, id1 int, id2 int, action string")
    got = {r.seq: r.outcome for r in edits.apply_decisions(df).collect()}
    assert got == {1: "merged", 2: "void", 3: "rejected", 4: "open", 5: "merged", 6: "merged"}
    r = random.Random(1)
    rows = [(k, a, b, r.choice(["Merge", "Skip", "Reject"])) for k in range(200) if (a := r.randrange(90)) != (b := r.randrange(90))]
    decisions = spark.createDataFrame(rows + rows[:3] + [(1, None, 4, "Merge"), (2, 4, 4, "Merge")], "seq long, id1 int, id2 int, action string")
    paths = {c: [f"{c}/{k}" for k in range(c % 3)] for c in range(90)}  # a third of the persons have no file
    files = spark.createDataFrame([(c, p) for c, v in paths.items() for p in v], "cluster_id int, media_path string")
    for held in (None, files):
        gone, want, now = set(), [], {c: set(v) for c, v in paths.items()}
        for seq, a, b, action in sorted(rows):
            out = {"Merge": "merged", "Reject": "rejected", "Skip": "open"}[action]
            if a in gone or b in gone:
                out = "void"
            elif out == "merged" and held is not None and not (paths[a] and paths[b]):
                out = "empty"
            elif out == "merged":
                gone.add(b)
                now[a] |= now.pop(b)
            want.append((seq, a, b, out))
        outcome = edits.apply_decisions(decisions, held)
        assert sorted(tuple(x) for x in outcome.collect()) == sorted(want)
        got = {(x.cluster_id, x.media_path) for x in edits.merged_files(files, outcome).collect()}
        assert got == {(c, p) for c, v in now.items() for p in v}
    chain = spark.createDataFrame([(1, 5, 7, "Merge"), (2, 3, 5, "Merge")], "seq long, id1 int, id2 int, action string")
    one = spark.createDataFrame([(7, "f"), (5, "g"), (3, "h")], "cluster_id int, media_path string")
    assert {tuple(x) for x in edits.merged_files(one, edits.apply_decisions(chain, one)).collect()} == {(3, "f"), (3, "g"), (3, "h")}
    assert edits.apply_decisions(chain.where("false"), one).count() == 0


def test_ranks_of_large_groups(spark):
    rows = [("a" if k % 3 else None if k % 5 else "b", k) for k in range(500)]
    got = edits.ranked(spark.createDataFrame(rows, "g string, k int").repartition(7), "g", ["k"], 9).collect()
    seen = {}
    for x in sorted(got, key=lambda x: x.k):
        seen[x.g] = seen.get(x.g, 0) + 1
        assert x.n == seen[x.g]
    assert len(got) == 500


def test_means_of_large_clusters(spark):
    g = np.random.default_rng(5)
    m = np.round(g.normal(0, 0.2, (3000, 128)), 3)
    of = [int(k % 11 == 0) + 2 * int(k % 700 == 0) for k in range(3000)]
    faces = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "face_id long, encoding array<double>")
    labels = spark.createDataFrame(list(enumerate(of)), "face_id long, cluster_id int")
    got = {x.cluster_id: (x.n_faces, x.vec) for x in clustering.centroids(faces, labels).collect()}
    for c in set(of):
        mine = m[np.array(of) == c]
        assert got[c][0] == len(mine) and np.allclose(got[c][1], mine.mean(0), atol=1e-12)
    assert clustering.centroids(faces.where("false"), labels).count() == 0
    assert {x.cluster_id for x in clustering.person_labels(spark.createDataFrame([(1, -1), (2, 4)], "face_id long, cluster_id int")).collect()} == {4}


def test_renames_stay_unique(spark):
    people = spark.createDataFrame([(1, "Person_1"), (2, "Ann"), (3, "Person_3"), (4, "Person_4"), (5, "Bob")], "cluster_id int, name string")
    edit = spark.createDataFrame([(1, "Ann", False), (3, "Ann!", None), (4, "!!", True), (5, "Bob", False)], "cluster_id int, new_name string, remove boolean")
    renamed = edits.rename_and_delete(people, edit)
    assert {x.cluster_id: x.name for x in renamed.collect()} == {1: "Ann_1", 2: "Ann", 3: "Ann_2", 5: "Bob"}
    paths = spark.createDataFrame([(1, "output/Person_1/x.jpg"), (1, "output/Person_10/x.jpg"), (3, "output/Person_3/a/b.jpg"), (4, "output/Person_4/x")], "cluster_id int, path string")
    assert {tuple(x) for x in edits.renamed_paths(paths, renamed).collect()} == {(1, "output/Ann_1/x.jpg"), (1, "output/Person_10/x.jpg"), (3, "output/Ann_2/a/b.jpg")}


def test_no_file_is_lost_on_a_move(tmp_path):
    for d, files in (("old", {"a.txt": "1", "b.txt": "2", "c.txt": "3"}), ("new", {"a.txt": "9", "b.txt": "2"})):
        (tmp_path / d).mkdir()
        for f, text in files.items():
            (tmp_path / d / f).write_text(text)
    sinks.FileActions.do_move_files_and_remove_dir(str(tmp_path / "old"), str(tmp_path / "new"))
    assert {p.name: p.read_text() for p in (tmp_path / "new").iterdir()} == {"a.txt": "9", "a_1.txt": "1", "b.txt": "2", "c.txt": "3"} and not (tmp_path / "old").exists()


def test_unique_names(spark):
    rows = [(1, "Ann"), (2, "Ann"), (3, "Ann_1"), (4, "!!!"), (5, "Ann"), (6, "Bob"), (7, "Ann/é_9*-x!  ")]
    got = {r.cluster_id: r.name for r in edits.unique_names(spark.createDataFrame(rows, "cluster_id int, name string")).collect()}
    assert got == {1: "Ann", 2: "Ann_1", 3: "Ann_1_1", 5: "Ann_2", 6: "Bob", 7: "Anné_9-x"}
    taken = spark.createDataFrame([("Bob",)], "name string")
    assert edits.unique_names(spark.createDataFrame([(6, "Bob")], "cluster_id int, name string"), taken).first().name == "Bob_1"


def test_suffixes_and_kinds(spark):
    cases = {"/x/a.JPG": (".JPG", "image", "a"), "/x/.jpg": ("", None, ".jpg"), "/x/a.": ("", None, "a."), "/x/x.tar.gz": (".gz", None, "x.tar"), "b.mkv": (".mkv", "video", "b")}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select("p", names.suffix(F.col("p")), names.kind(F.col("p")), names.stem(F.col("p"))).collect()}
    assert got == cases


def test_geometry_limits(spark):
    df = spark.createDataFrame([(0, 600, 500, 0)], "t int, r int, b int, l int")
    a = geometry.area(F.col("t"), F.col("r"), F.col("b"), F.col("l"))
    assert df.where(geometry.keeps(a, 300_000)).count() == 1 and df.where(geometry.keeps(a, 300_001)).count() == 0
    assert df.where(geometry.keeps(a, 0)).count() == df.where(geometry.keeps(a, None)).count() == 1
    box = geometry.padded(F.col("t"), F.col("r"), F.col("b"), F.col("l"), F.lit(510), F.lit(610))
    assert tuple(df.select(*box).first()) == (0, 610, 510, 0)


def test_frame_interval(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (29.97,)], "f double")
    assert [r[0] for r in df.select(names.frame_interval(F.col("f"))).collect()] == [30, 1, 29]


def test_scan_detect_and_copy(spark, tmp_path):
    src = tmp_path / "in" / "deep"
    src.mkdir(parents=True)
    img = np.zeros((40, 60, 3), np.uint8)
    img[5:15, 10:30] = 255
    img[20:24, 40:44] = 255
    good = b"P6\n60 40\n255\n" + img.tobytes()
    (src / "a.JPG").write_bytes(good)
    (src / "bad.png").write_bytes(b"nothing")
    (src / "notes.txt").write_text("x")
    files = media.scan(spark, str(tmp_path / "in"), content=True)
    assert {(r.name, r.kind) for r in files.collect()} == {("a.JPG", "image"), ("bad.png", "image")}
    results = media.detect(files, media.BrightRectangles, least=100, how=pixels.PPM)
    assert {r.area for r in media.detections(results).collect()} == {200, 16}
    faces = assignment.zip_faces(results).collect()
    assert [(f.face_no, f.encoding) for f in faces] == [(0, [5.0, 30.0, 15.0, 10.0])]
    assert results.where("error is not null").count() == 1
    assert {r.path.rsplit("/", 1)[-1]: r.valid for r in media.verified(files, pixels.PPM).collect()} == {"a.JPG": True, "bad.png": False}
    assert {len(r.boxes) for r in media.locate(files, media.BrightRectangles, pixels.PPM).collect()} == {2, 0}
    known = files.join(results.select(F.col("media_path").alias("path"), F.col("face_locations").alias("boxes")), "path")
    assert sorted(len(r.encodings) for r in media.encode_known(known, media.BrightRectangles, pixels.PPM).collect()) == [0, 2]
    cut = media.crops(files, results, 100, 30, pixels.PPM).collect()
    assert len(cut) == 1 and pixels.PPM.decode(cut[0].content).shape == (40, 60, 3)
    exact = media.crops(files, results, 100, 0, pixels.PPM)
    assert (pixels.PPM.decode(exact.first().content) == img[5:15, 10:30]).all()
    store = exact.withColumn("path", F.concat(F.lit(str(tmp_path) + "/"), "path"))
    assert [r.status for r in sinks.write_files(store).collect()] == ["written"] and sinks.outputs(str(tmp_path / "crops"))
    drawn = media.annotations(files, results, "notes", 100, how=pixels.PPM).collect()
    shown = pixels.PPM.decode(drawn[0].content)
    assert drawn[0].path == "notes/detected_a.ppm" and shown.shape == img.shape and (shown == pixels.GREEN).all(2).any() and (shown == pixels.RED).all(2).any()
    small = media.detect(files, media.BrightRectangles, side=30, how=pixels.PPM)  # found on half the size, told on the whole
    assert sorted(r.area for r in media.detections(small).collect()) == [16, 160]
    clash = [media.crop_path("c", p, 0, ".ppm") for p in ("/x/a.jpg", "/y/a.jpg", "/x/a.png")]
    assert len(set(clash)) == 3
    path = str(src / "a.JPG")
    dest = str(tmp_path / "out" / "Person_1" / "a.JPG")
    manifest = spark.createDataFrame([(path, dest), ("/missing", str(tmp_path / "out" / "x"))], "src string, dest string")
    assert {r.status.split(":")[0] for r in sinks.copy_files(manifest).collect()} == {"copied", "failed"}
    assert {r.status.split(":")[0] for r in sinks.copy_files(manifest).collect()} == {"present", "failed"}
    assert sinks.archive(str(tmp_path / "out"), str(tmp_path / "z.zip")) == len(sinks.outputs(str(tmp_path / "out")))
    sinks.cleanup(str(tmp_path / "out"))
    sinks.cleanup(str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)path"):
        media.scan(spark, str(tmp_path / "none")).count()


def test_frames_of_videos(spark):
    frames = [np.full((4, 6, 3), k, np.uint8) for k in range(25)]
    body = b"".join(pixels.PPM.encode(f) for f in frames)
    rows = [("/v/a.mp4", b"RATE 4.5\n" + body), ("/v/b.mp4", b"RATE 0\n" + body), ("/w/a.mp4", b"RATE 0.5\n" + body), ("/v/bad.mp4", b"x")]
    videos = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = media.extract_frames(videos, media.ppm_frames, "f", how=pixels.PPM).collect()
    of = lambda rs, p: [r.frame_no for r in rs if r.media_path == p and r.error is None]
    assert of(got, "/v/a.mp4") == list(range(0, 25, 4)) and of(got, "/v/b.mp4") == [0] and of(got, "/w/a.mp4") == list(range(25))
    assert [r.error for r in got if r.media_path == "/v/bad.mp4"] == ["not a video"] and len({r.frame_path for r in got}) == len(got)
    assert all((pixels.PPM.decode(r.content) == r.frame_no).all() for r in got if r.error is None)
    few = media.extract_frames(videos, media.ppm_frames, "f", most=3, fps_if_unknown=None, how=pixels.PPM).collect()
    assert of(few, "/v/a.mp4") == [0, 4, 8] and of(few, "/v/b.mp4") == []


def test_pixels():
    g = np.random.default_rng(1)
    image = g.integers(0, 255, (50, 80, 3)).astype(np.uint8)
    assert (pixels.PPM.decode(pixels.PPM.encode(image)) == image).all() and pixels.fit(image) is image
    assert pixels.fit(image, 40).shape == (25, 40, 3) and pixels.fit(np.full((64, 64, 3), 9, np.uint8), 16).min() == 9
    assert (pixels.swap_channels(image)[..., 0] == image[..., 2]).all()
    assert pixels.rescaled((1, 3, 5, 2), (30, 40), (20, 20)) == (1, 6, 7, 4) and pixels.rescaled((1, 3, 5, 2), (20, 20), (20, 20)) == (1, 3, 5, 2)
    text, colours = pixels.tags([100, 99], 100)
    assert text == ["Face 1\nArea: 100", "Face 2\nArea: 99"] and colours == [pixels.GREEN, pixels.RED] and pixels.tags([5])[0] == ["Face 1"]
    big = np.zeros((200, 300, 3), np.uint8)
    above, below = (pixels.draw(big, [b], None, ["Face 1"]) for b in ((100, 150, 140, 50), (5, 150, 60, 50)))
    rows = lambda im: np.flatnonzero((im == pixels.GREEN).all(2).any(1))
    assert rows(above)[0] == 100 - 12 - 10 and rows(below)[-1] == 60 + 10 + 12 + 4 - 1
    assert pixels.draw(big, [(-50, 400, 300, -20)], None, ["Face 1"]).shape == big.shape
    with pytest.raises(ValueError):
        pixels.PPM.decode(b"P6\n9 9\n255\nabc")


def test_file_actions_and_config(tmp_path):
    q = sinks.FileActions()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_text("1")
    q.put("move_files_and_remove_dir", str(tmp_path / "d"), str(tmp_path / "e"))
    q.put("remove_file", str(tmp_path / "none"))
    q.put("rename_file", str(tmp_path / "e" / "f"), str(tmp_path / "e" / "g"))
    q.wait()
    assert sinks.outputs(str(tmp_path)) == [str(tmp_path / "e" / "g")] and len(q.errors) == 1
    (tmp_path / "c.yaml").write_text("a:\n  b: 3\n  c: true  # note\nd: x\n")
    c = sinks.load_config(str(tmp_path / "c.yaml"))
    assert sinks.config_value(c, "a.b") == 3 and sinks.config_value(c, "a.c") is True and sinks.config_value(c, "d.e", 7) == 7


def test_streamed_uploads(spark, tmp_path):
    from lumigraph.streaming import ingest

    rows = [("/a/x.jpg", "2024-01-01 01:00:00"), ("/a/x.jpg", "2024-01-01 02:00:00"), ("/a/y.MP4", "2024-01-02 00:00:00"), ("/a/z.txt", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "path string, at string").select("path", F.to_timestamp("at").alias("ingested_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.once(ingest.classified(ingest.uploads(spark, str(tmp_path / "in"), df.schema)))
    q = stream.writeStream.format("memory").queryName("up").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.path, r.kind) for r in spark.table("up").collect()} == {("/a/x.jpg", "image"), ("/a/y.MP4", "video")}


def test_faces_are_clustered(spark, tmp_path):
    from lumigraph.plans import queries as core

    g = np.random.default_rng(3)
    m = np.round(np.repeat(g.normal(0, 0.12, (40, 128)), 4, axis=0) + g.normal(0, 0.037, (160, 128)), 3)
    bad = [None, [], [0.1] * 64, [0.0] * 128, [float("nan")] + [0.1] * 127, [None] + [0.1] * 127, [float("inf")] + [0.1] * 127]
    faces = [(3 * k + 1, v.tolist()) for k, v in enumerate(m)]
    rows = faces + faces[:5] + [(5000 + k, v) for k, v in enumerate(bad)] + [(None, m[0].tolist())]
    spark.createDataFrame(rows, "face_id long, encoding array<double>").write.parquet(f"{tmp_path}/face.parquet")
    run = lambda name: core.QUERIES[name](spark, str(tmp_path)).collect()
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    near = d <= 0.6
    assert {(r.i, r.j, r.d) for r in run("face_eps_edges")} == {(3 * i + 1, 3 * j + 1, round(float(d[i, j]), 6)) for i, j in zip(*np.nonzero(np.triu(near, 1)))}

    def grouped(core_points):
        root = {i: i for i in core_points}
        for _ in root:
            root = {i: min(root[j] for j in core_points if near[i, j]) for i in core_points}
        rank = {r: k for k, r in enumerate(sorted(set(root.values())))}
        return {i: rank[r] for i, r in root.items()}

    want = grouped(range(len(m)))
    assert {r.face_id: r.cluster_id for r in run("face_cluster_faces")} == {3 * i + 1: c for i, c in want.items()}
    assert run("face_cluster_count")[0].n_clusters == len(set(want.values()))
    assert {r.cluster_id: r.n_faces for r in run("face_cluster_sizes")} == {c: list(want.values()).count(c) for c in set(want.values())}
    dense = grouped([i for i in range(len(m)) if near[i].sum() >= 3])
    border = lambda i: min((dense[j] for j in dense if near[i, j]), default=-1)
    assert {r.face_id: r.cluster_id for r in run("face_dbscan_min_samples")} == {3 * i + 1: dense.get(i, border(i)) for i in range(len(m))}
