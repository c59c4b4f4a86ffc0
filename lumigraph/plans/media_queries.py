"""Queries over the project's tables and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumigraph.functions import geometry as G
from lumigraph.functions import names as N
from lumigraph.operators import assignment as A
from lumigraph.operators import clustering as C
from lumigraph.operators import edits as E
from lumigraph.operators.similarity import cell_join, distance_join
from lumigraph.session import run_folder, table
from lumigraph.sources import media as M
from lumigraph.sources import pixels
from lumigraph.sources import sinks as S

EPS = 1.10
FACE_EPS = 0.6  # for the default detector
MERGE = 0.6
IMAGE_SIDE = 1500
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


CLUSTERS = f"""
    with recursive p as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
    e as (select a.id as u, b.id as w from p a join p b on a.id < b.id and list_distance(a.v, b.v) <= {EPS}),
    s as (select u, w from e union all select w, u from e),
    r(id, root) as (select id, id from p union select s.w, r.root from r join s on s.u = r.id where r.root < s.w),
    c as (select id, min(root) as root from r group by id),
    clusters as (select id as face_id, cast(dense_rank() over (order by root) - 1 as integer) as cluster_id from c)
"""
LABELS = """
    with labels as (
        select face_id, cluster_id from (
            select *, row_number() over (partition by face_id order by assigned_at desc nulls last, cluster_id desc nulls last) as rn from assignment where face_id is not null)
        where rn = 1 and cluster_id is not null and cluster_id <> -1),
    video as (select frame_path, min(media_path) as m from frame where frame_path is not null and media_path is not null group by 1),
    pf as (select distinct l.cluster_id, coalesce(v.m, f.media_path) as media_path
           from face f join labels l on f.face_id = l.face_id left join video v on v.frame_path = f.media_path where f.media_path is not null)
"""
BASE = "regexp_extract({0}, '([^/]+)$', 1)"
SUFFIX = "regexp_extract(regexp_extract({0}, '([^/]+)$', 1), '^.+(\\.[^.]+)$', 1)"


# ---------------------------------------------------------------- clustering (embeddings stand for faces)


@query(f"with p as (select vec_id as id, cast(embedding as double[]) as v from embeddings) select a.id as i, b.id as j, round(list_distance(a.v, b.v), 6) as d from p a join p b on a.id < b.id and list_distance(a.v, b.v) <= {EPS}")
def eps_edges(spark: SparkSession, sf: str) -> DataFrame:
    return distance_join(table(spark, sf, "embeddings"), "vec_id", "embedding", EPS).select("i", "j", F.round("d", 6).alias("d"))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return C.dbscan(table(spark, sf, "embeddings"), "vec_id", "embedding", EPS, exact=True).select(F.col("id").alias("face_id"), "cluster_id")


@query(CLUSTERS + "select face_id, cluster_id from clusters")
def cluster_faces(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)


@query(CLUSTERS + "select count(distinct cluster_id) as n_clusters from clusters")
def cluster_count(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).agg(F.countDistinct("cluster_id").alias("n_clusters"))


@query(CLUSTERS + "select cluster_id, 'Person_' || (cluster_id + 1) as person, count(*) as n_faces from clusters group by 1, 2")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = _clusters(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n_faces"))
    return n.select("cluster_id", N.person(F.col("cluster_id")).alias("person"), "n_faces")


@query(f"""
    with recursive p as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
    e as (select a.id as u, b.id as w from p a join p b on a.id <> b.id and list_distance(a.v, b.v) <= {EPS}),
    core as (select id from p left join e on e.u = p.id group by id having count(e.w) + 1 >= 3),
    s as (select u, w from e where u in (from core) and w in (from core)),
    r(id, root) as (select id, id from core union select s.w, r.root from r join s on s.u = r.id where r.root < s.w),
    c as (select id, min(root) as root from r group by id),
    named as (select id, cast(dense_rank() over (order by root) - 1 as integer) as cluster_id from c),
    border as (select e.u as id, min(n.cluster_id) as cluster_id from e join named n on n.id = e.w where e.u not in (from core) group by 1)
    select p.id as face_id, coalesce(n.cluster_id, b.cluster_id, -1) as cluster_id from p left join named n on n.id = p.id left join border b on b.id = p.id""")
def dbscan_min_samples(spark: SparkSession, sf: str) -> DataFrame:
    return C.dbscan(table(spark, sf, "embeddings"), "vec_id", "embedding", EPS, 3, exact=True).select(F.col("id").alias("face_id"), "cluster_id")


# the same over the faces themselves, by the join in cells; without SQL, which takes too long there


def _usable_faces(spark: SparkSession, sf: str) -> DataFrame:
    """``(face_id, encoding)``, one row a face: 128 finite values, not all zero."""
    v = F.col("encoding")
    hi, lo = F.array_max(v), F.array_min(v)
    good = (F.size(v) == 128) & (F.size(F.array_compact(v)) == 128) & ~F.isnan(hi) & (hi < float("inf")) & (lo > -float("inf")) & ((hi != 0) | (lo != 0))
    return table(spark, sf, "face").where(good).select("face_id", "encoding").dropDuplicates(["face_id"])


def _face_clusters(spark: SparkSession, sf: str, min_samples: int = 1) -> DataFrame:
    return C.dbscan(_usable_faces(spark, sf), "face_id", "encoding", FACE_EPS, min_samples).select(F.col("id").alias("face_id"), "cluster_id")


@query()
def face_eps_edges(spark: SparkSession, sf: str) -> DataFrame:
    return cell_join(_usable_faces(spark, sf), "face_id", "encoding", FACE_EPS).select("i", "j", F.round("d", 6).alias("d"))


@query()
def face_cluster_faces(spark: SparkSession, sf: str) -> DataFrame:
    return _face_clusters(spark, sf)


@query()
def face_cluster_count(spark: SparkSession, sf: str) -> DataFrame:
    return _face_clusters(spark, sf).agg(F.countDistinct("cluster_id").alias("n_clusters"))


@query()
def face_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = _face_clusters(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n_faces"))
    return n.select("cluster_id", N.person(F.col("cluster_id")).alias("person"), "n_faces")


@query()
def face_dbscan_min_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _face_clusters(spark, sf, 3)


@query(LABELS + """, u as (select face_id, any_value(encoding) as encoding from face where len(encoding) = 128 and list_count(encoding) = 128 and isfinite(list_max(encoding)) and isfinite(list_min(encoding)) and (list_max(encoding) <> 0 or list_min(encoding) <> 0) group by 1),
    x as (select l.cluster_id, generate_subscripts(u.encoding, 1) - 1 as pos, cast(unnest(u.encoding) as decimal(18, 9)) as x from u join labels l on u.face_id = l.face_id)
    select cluster_id, cast(pos as integer) as pos, cast(sum(x) as double) / count(x) as mean from x group by 1, 2""")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vectors of the current persons, one row a coordinate."""
    means = C.centroids(_usable_faces(spark, sf), _labels(spark, sf))
    return means.select("cluster_id", F.posexplode("vec").alias("pos", "mean"))


@query(LABELS + """, u as (select face_id, any_value(encoding) as encoding from face where len(encoding) = 128 and list_count(encoding) = 128 and isfinite(list_max(encoding)) and isfinite(list_min(encoding)) and (list_max(encoding) <> 0 or list_min(encoding) <> 0) group by 1)
    select l.cluster_id, count(*) as n_faces, cast(128 as integer) as n_values from u join labels l on u.face_id = l.face_id group by 1""")
def centroid_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The faces that each mean vector is made of, and its length."""
    means = C.centroids(_usable_faces(spark, sf), _labels(spark, sf))
    return means.select("cluster_id", "n_faces", F.size("vec").alias("n_values"))


@query(f"with c as (select cluster_id, any_value(vec) as v from centroid where vec is not null and len(vec) = 128 group by 1) select a.cluster_id as id1, b.cluster_id as id2 from c a join c b on a.cluster_id < b.cluster_id and list_distance(a.v, b.v) < {MERGE}")
def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return C.merge_suggestions(table(spark, sf, "centroid").where(F.size("vec") == 128), MERGE)


# ---------------------------------------------------------------- files of persons


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of persons: noise is nobody."""
    return C.person_labels(C.current_labels(table(spark, sf, "assignment")))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return A.person_files(table(spark, sf, "face"), _labels(spark, sf), table(spark, sf, "frame"))


@query("select face_id, cluster_id from (select *, row_number() over (partition by face_id order by assigned_at desc nulls last, cluster_id desc nulls last) as rn from assignment where face_id is not null) where rn = 1 and cluster_id is not null")
def current_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The latest label of every face, noise included."""
    return C.current_labels(table(spark, sf, "assignment"))


@query(LABELS + "select cluster_id, media_path from pf")
def person_files(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf)


@query(LABELS + "select cluster_id, 'Person_' || (cluster_id + 1) as person, count(*) as n_files from pf group by 1, 2")
def person_file_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n_files")).select("cluster_id", N.person(F.col("cluster_id")).alias("person"), "n_files")


@query(LABELS + ", f as (select l.cluster_id, f.face_id, f.crop_path, row_number() over (partition by l.cluster_id order by f.face_id, f.crop_path) as rn from face f join labels l on f.face_id = l.face_id) select cluster_id, face_id, crop_path, 'output/face_previews/rep_' || cluster_id || '.jpg' as preview from f where rn = 1")
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.representatives(table(spark, sf, "face"), _labels(spark, sf))
    return rows.withColumn("preview", F.format_string("output/face_previews/rep_%d.jpg", F.col("cluster_id")))


_DEST = f", d as (select cluster_id, media_path as src, 'output/Person_' || (cluster_id + 1) || '/' || {BASE.format('media_path')} as dest from pf)"


@query(LABELS + _DEST + " select cluster_id, src, dest, count(*) over (partition by dest) > 1 as collision from d")
def dest_paths(spark: SparkSession, sf: str) -> DataFrame:
    return A.destinations(_files(spark, sf))


@query(LABELS + _DEST + " select dest, count(*) as n_sources from d group by 1 having count(*) > 1")
def dest_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return A.destinations(_files(spark, sf)).where("collision").groupBy("dest").agg(F.count("*").alias("n_sources"))


@query(LABELS + ", r as (select cluster_id, min_by(crop_path, face_id) as rep from (select l.cluster_id, f.face_id, min(f.crop_path) as crop_path from face f join labels l on f.face_id = l.face_id group by 1, 2) group by 1) select pf.cluster_id, 'Person_' || (pf.cluster_id + 1) as name, count(*) as n_files, min(media_path) as first_file, any_value(rep) as representative_face from pf left join r on r.cluster_id = pf.cluster_id group by 1, 2 order by 1")
def persons(spark: SparkSession, sf: str) -> DataFrame:
    """Persons in the order of their clusters; their files are rows of person_file_list."""
    return A.persons(_files(spark, sf), A.representatives(table(spark, sf, "face"), _labels(spark, sf))).orderBy("cluster_id")


@query(LABELS + "select cluster_id, row_number() over (partition by cluster_id order by media_path) as n, media_path from pf order by 1, 2")
def person_file_list(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted files of every person, numbered, however many one person has."""
    return E.ranked(_files(spark, sf), "cluster_id", ["media_path"]).select("cluster_id", "n", "media_path").orderBy("cluster_id", "n")


@query(LABELS + f"select cluster_id, {BASE.format('media_path')} as name, min(media_path) as first_path from pf group by 1, 2 order by 2, 1")
def names_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """File names in code-point order, each with the first path that has it."""
    rows = _files(spark, sf).withColumn("name", N.basename(F.col("media_path")))
    return rows.groupBy("cluster_id", "name").agg(F.min("media_path").alias("first_path")).orderBy("name", "cluster_id")


@query("with v as (select frame_path, min(media_path) as m from frame where frame_path is not null and media_path is not null group by 1) select c.cluster_id, coalesce(v.m, c.media_path) as media_path, c.added_at from cluster_file c left join v on c.media_path = v.frame_path")
def frame_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return A.lineage(table(spark, sf, "cluster_file"), "media_path", table(spark, sf, "frame")).select("cluster_id", "media_path", "added_at")


@query("select path from (select path from media where kind = 'image' union select frame_path from frame) where path is not null")
def media_union(spark: SparkSession, sf: str) -> DataFrame:
    return M.inputs(table(spark, sf, "media").where("kind = 'image'"), table(spark, sf, "frame"))


@query(f"""select media_id, path, {BASE.format('path')} as base, {SUFFIX.format('path')} as ext,
    case when lower({SUFFIX.format('path')}) in ('.jpg','.jpeg','.png','.heic') then 'image' when lower({SUFFIX.format('path')}) in ('.mp4','.mov','.avi','.mkv') then 'video' end as found_kind,
    lower({SUFFIX.format('path')}) in ('.jpg','.jpeg','.png','.mp4') as uploadable from media""")
def media_classify(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf, "media").select("media_id", p, N.basename(p).alias("base"), N.suffix(p).alias("ext"), N.kind(p).alias("found_kind"), F.lower(N.suffix(p)).isin(*N.UPLOADS).alias("uploadable"))


@query("select name, media_id, path from (select *, row_number() over (partition by name order by ingested_at desc nulls last, media_id desc nulls last) as rn from media where name is not null) where rn = 1")
def latest_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest_uploads(table(spark, sf, "media"), "name", ["ingested_at", "media_id"]).select("name", "media_id", "path")


@query("select kind, count(*) as n_files, count(distinct path) as n_paths from media group by kind")
def media_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "media").groupBy("kind").agg(F.count("*").alias("n_files"), F.countDistinct("path").alias("n_paths"))


@query(f"select {BASE.format('path')} as base, min(path) as first_path, arg_max(media_id, (ingested_at, media_id)) as last_id from media group by 1")
def debug_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Per base name the first path, and the last row that a dictionary of base names would keep."""
    rows = table(spark, sf, "media").withColumn("base", N.basename(F.col("path")))
    return rows.groupBy("base").agg(F.min("path").alias("first_path"), F.max_by("media_id", F.struct("ingested_at", "media_id")).alias("last_id"))


@query("select media_path, face_id, cast(row_number() over (partition by media_path order by face_id) as integer) as face_no from (select distinct media_path, face_id from face where media_path is not null)")
def face_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "face").where("media_path is not null").select("media_path", "face_id").distinct()
    return E.row_numbers(rows, ["media_path"], ["face_id"]).select("media_path", "face_id", F.col("n").cast("int").alias("face_no"))


@query("select crop_path, count(distinct face_id) as n_faces from face group by 1 having count(distinct face_id) > 1")
def crop_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Crops that several faces would be written to."""
    return table(spark, sf, "face").groupBy("crop_path").agg(F.countDistinct("face_id").alias("n_faces")).where("n_faces > 1")


# ---------------------------------------------------------------- scans and detection, on files made from the media table

_FILES = f"""with m as (select distinct media_id, path from media where path is not null),
    f as (select *, media_id % 20 as t, media_id % 30 as l, media_id % 20 + 8 + media_id % 10 as b, media_id % 30 + 8 + media_id % 12 as r,
          lower({SUFFIX.format('path')}) as ext from m)"""
_IMAGE_EXT = "('.jpg','.jpeg','.png','.heic')"


def _stub_images(spark: SparkSession, sf: str) -> DataFrame:
    """A small picture for every image of the table, with one bright rectangle whose place its id tells."""
    rows = table(spark, sf, "media").where("path is not null").select("media_id", "path").distinct().where(N.kind(F.col("path")) == "image")

    def paint(batches):
        for pdf in batches:
            out = []
            for k, path in zip(pdf.media_id, pdf.path):
                image = np.zeros((48, 64, 3), np.uint8)
                image[k % 20 : k % 20 + 8 + k % 10, k % 30 : k % 30 + 8 + k % 12] = 255
                out.append((path, pixels.PPM.encode(image)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(paint, "path string, content binary")


@query(_FILES + f" select path as media_path, cast(1 as integer) as face_no, cast(t as integer) as top, cast(r as integer) as right_, cast(b as integer) as bottom, cast(l as integer) as left_, (r - l) * (b - t) as area from f where ext in {_IMAGE_EXT}")
def detect_stub(spark: SparkSession, sf: str) -> DataFrame:
    """All detections of the stand-in model, faces that are too small included."""
    found = M.detections(M.detect(_stub_images(spark, sf), M.BrightRectangles, 150, how=pixels.PPM))
    return found.withColumnsRenamed({"right": "right_", "left": "left_"})


@query(_FILES + f" select path as media_path, cast(0 as integer) as face_no, t::double as top, r::double as right_, b::double as bottom, l::double as left_ from f where ext in {_IMAGE_EXT} and (r - l) * (b - t) >= 150")
def zip_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Encodings and crops side by side, of the faces that are large enough."""
    faces = A.zip_faces(M.detect(_stub_images(spark, sf), M.BrightRectangles, 150, how=pixels.PPM))
    e = F.col("encoding")
    return faces.where("crop_path is not null").select("media_path", "face_no", e[0].alias("top"), e[1].alias("right_"), e[2].alias("bottom"), e[3].alias("left_"))


@query(_FILES + f" select count(*) as n_images, cast(count_if((r - l) * (b - t) >= 150) as bigint) as n_valid, cast(sum(least(r + 3, 64) - greatest(l - 3, 0)) filter ((r - l) * (b - t) >= 150) as bigint) as crop_width from f where ext in {_IMAGE_EXT}")
def crop_stub(spark: SparkSession, sf: str) -> DataFrame:
    """Crops cut from the pictures, with a margin of 3 pixels: how many, and their widths in all."""
    files = _stub_images(spark, sf)
    results = M.detect(files, M.BrightRectangles, 150, how=pixels.PPM)
    width = F.regexp_extract(F.decode(F.substring("content", 1, 15), "ISO-8859-1"), r"P6\s(\d+) ", 1).cast("long")
    cuts = M.crops(files, results, 150, 3, pixels.PPM).select(F.lit(0).alias("image"), F.lit(1).alias("valid"), width.alias("width"))
    rows = results.select(F.lit(1).alias("image"), F.lit(0).alias("valid"), F.lit(0).cast("long").alias("width")).unionByName(cuts)
    return rows.agg(F.sum("image").alias("n_images"), F.sum("valid").alias("n_valid"), F.sum("width").alias("crop_width"))


@query(_FILES + f" select {BASE.format('path')} as name, regexp_replace({BASE.format('path')}, '(.)\\.[^.]+$', '\\1') as stem, {SUFFIX.format('path')} as suffix, case when ext in {_IMAGE_EXT} then 'image' else 'video' end as kind, count(*) as n from (select distinct path, ext from f) where ext in {_IMAGE_EXT} or ext in ('.mp4','.mov','.avi','.mkv') group by all")
def media_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The supported files of a folder, by name; the folder is filled with the files of the media table first."""
    root = f"{run_folder(spark)}/scan-{uuid.uuid4().hex}"
    local = root.removeprefix("file://")
    files = table(spark, sf, "media").where("path is not null").select(F.concat(F.lit(local + "/"), F.regexp_replace("path", "^/+", "")).alias("path"), F.lit(b"x").alias("content")).distinct()
    failed = S.write_files(files).where("status <> 'written'").count()
    if failed:
        raise OSError(f"{failed} files could not be written below {local}")
    return M.scan(spark, root).groupBy("name", "stem", "suffix", "kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- merging, renaming, deleting

_CASE = "case when distance < 0.35 then 'Merge' when distance >= 0.45 then 'Reject' else 'Skip' end"
_DECIDED = f"with d as (select least(id1, id2) as id1, greatest(id1, id2) as id2, min(distance) as distance, min(found_at) as found_at from merge_candidate where id1 is not null and id2 is not null and id1 <> id2 group by 1, 2), p as (select distinct id1, id2, {_CASE} as action from d where distance is not null)"


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "merge_candidate").where("id1 is not null and id2 is not null and id1 <> id2")
    return rows.groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.min("distance").alias("distance"), F.min("found_at").alias("found_at"))


def _action():
    return F.when(F.col("distance") < 0.35, "Merge").when(F.col("distance") >= 0.45, "Reject").otherwise("Skip")


@query(_DECIDED + " select d.id1, d.id2, coalesce(p.action, 'Skip') as action from d left join p on p.id1 = d.id1 and p.id2 = d.id2")
def merge_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf)
    made = rows.where("distance is not null").select("id1", "id2", _action().alias("action"))
    return E.with_actions(rows.select("id1", "id2"), made)


@query(_DECIDED + " select id1, id2 from d except select id1, id2 from p where action <> 'Skip'")
def merge_remaining(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf)
    done = rows.where("distance is not null").withColumn("action", _action()).where("action <> 'Skip'").select("id1", "id2")
    return E.remaining(rows.select("id1", "id2"), done)


@query(_DECIDED + " select id1, id2 from d where id1 in (select cluster_id from assignment) and id2 in (select cluster_id from assignment)")
def merge_existing(spark: SparkSession, sf: str) -> DataFrame:
    return E.existing(_candidates(spark, sf).select("id1", "id2"), table(spark, sf, "assignment").where("cluster_id is not null"))


_HELD = LABELS.replace("with labels", "with recursive labels", 1) + ", held as (select distinct cluster_id from pf)"
_OUTCOME = f""", d as (select least(id1, id2) as id1, greatest(id1, id2) as id2, min(distance) as distance, min(found_at) as found_at from merge_candidate where id1 is not null and id2 is not null and id1 <> id2 group by 1, 2),
    o as (select *, epoch_us(found_at) as seq, {_CASE} as action, id1 in (from held) and id2 in (from held) as both_, row_number() over (order by found_at nulls first, id1, id2) as n from d where distance is not null),
    f(n, gone, outcome) as (
        select cast(0 as bigint), cast([] as integer[]), '' union all
        select f.n + 1,
            case when action = 'Merge' and both_ and not list_contains(gone, id1) and not list_contains(gone, id2) then list_append(gone, id2) else gone end,
            case when list_contains(gone, id1) or list_contains(gone, id2) then 'void' when action = 'Reject' then 'rejected' when action = 'Skip' then 'open' when both_ then 'merged' else 'empty' end
        from f join o on o.n = f.n + 1),
    done as (select o.seq, o.id1, o.id2, f.outcome from o join f on f.n = o.n)"""


def _outcome(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf).where("distance is not null")
    seq = F.unix_micros(F.col("found_at").cast("timestamp")).alias("seq")
    return E.apply_decisions(rows.select(seq, "id1", "id2", _action().alias("action")), _files(spark, sf))


@query(_HELD + _OUTCOME + " select seq, id1, id2, outcome from done")
def merge_apply(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each decision, in the order in which pairs were found."""
    return _outcome(spark, sf)


@query(_HELD + _OUTCOME + """, step as (select id2 as gone, id1 as into_ from done where outcome = 'merged'),
    way(gone, into_) as (select gone, into_ from step union all select w.gone, s.into_ from way w join step s on s.gone = w.into_),
    last as (select gone, into_ from way where into_ not in (select gone from step))
    select distinct coalesce(l.into_, pf.cluster_id) as cluster_id, media_path from pf left join last l on l.gone = pf.cluster_id""")
def merge_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of every person once all decisions are done."""
    return E.merged_files(_files(spark, sf), _outcome(spark, sf))


@query(LABELS + ", m as (select cluster_id, 'Person_' || (cluster_id + 1) as name, case when cluster_id % 3 = 1 then 'Ann/é_' || cluster_id || '*-x!  ' when cluster_id % 3 = 2 then '!!!' end as new_name, cluster_id % 5 = 0 as remove from (select distinct cluster_id from pf)) select cluster_id, coalesce(nullif(rtrim(regexp_replace(new_name, '[^\\p{L}\\p{N} _-]', '', 'g'), ' '), ''), name) as name from m where not remove")
def rename_delete(spark: SparkSession, sf: str) -> DataFrame:
    people = _files(spark, sf).select("cluster_id").distinct().withColumn("name", N.person(F.col("cluster_id")))
    c = F.col("cluster_id")
    new = F.when(c % 3 == 1, F.concat(F.lit("Ann/é_"), c.cast("string"), F.lit("*-x!  "))).when(c % 3 == 2, "!!!")
    return E.rename_and_delete(people, people.select("cluster_id", new.alias("new_name"), (c % 5 == 0).alias("remove"))).select("cluster_id", "name")


@query(LABELS + ", m as (select cluster_id, 'Person_' || (cluster_id + 1) as old_name, 'Team ' || (cluster_id % 7) as new, cluster_id % 5 = 0 as remove from (select distinct cluster_id from pf)), n as (select *, row_number() over (partition by new order by cluster_id) as k from m) select n.cluster_id, 'output/' || new || case when k > 1 then '_' || (k - 1) else '' end || '/' || regexp_extract(media_path, '([^/]+)$', 1) as path from pf join n on n.cluster_id = pf.cluster_id where not remove")
def rename_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Where files lie once persons are renamed, several of them alike, and some removed."""
    files = _files(spark, sf)
    people = files.select("cluster_id").distinct().withColumn("name", N.person(F.col("cluster_id")))
    c = F.col("cluster_id")
    renamed = E.rename_and_delete(people, people.select("cluster_id", F.concat(F.lit("Team "), (c % 7).cast("string")).alias("new_name"), (c % 5 == 0).alias("remove")))
    return E.renamed_paths(files.select("cluster_id", N.destination(c, F.col("media_path")).alias("path")), renamed)


@query("select 'part' as kind, p_partkey as id, nullif(rtrim(regexp_replace(p_name, '[^\\p{L}\\p{N} _-]', '', 'g'), ' '), '') as name from part union all select 'customer', c_custkey, nullif(rtrim(regexp_replace(c_name, '[^\\p{L}\\p{N} _-]', '', 'g'), ' '), '') from customer union all select 'media', media_id, nullif(rtrim(regexp_replace(name, '[^\\p{L}\\p{N} _-]', '', 'g'), ' '), '') from media")
def sanitise_names(spark: SparkSession, sf: str) -> DataFrame:
    kinds = (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("media", "media_id", "name"))
    parts = [table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(i).alias("id"), N.sanitise(F.col(n)).alias("name")) for t, i, n in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("with c as (select p_partkey as id, nullif(rtrim(regexp_replace(p_name, '[^\\p{L}\\p{N} _-]', '', 'g'), ' '), '') as name from part), n as (select *, row_number() over (partition by name order by id) as k from c where name is not null) select cast(id as integer) as cluster_id, name || case when k > 1 then '_' || (k - 1) else '' end as name from n")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all parts made unique in the order of their keys; none of them ends in a number of its own."""
    return E.unique_names(table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("cluster_id"), F.col("p_name").alias("name")))


# ---------------------------------------------------------------- boxes (line items stand for detections)

_BOX = "with b as (select *, l_partkey % 1000 as l, l_suppkey % 1000 as t, l_partkey % 1000 + cast(l_quantity * 20 as bigint) as r, l_suppkey % 1000 + cast(l_quantity * 25 as bigint) as m from lineitem)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").withColumns({"l": F.col("l_partkey") % 1000, "t": F.col("l_suppkey") % 1000})
    return b.withColumns({"r": F.col("l") + (F.col("l_quantity") * 20).cast("long"), "m": F.col("t") + (F.col("l_quantity") * 25).cast("long")})


def _area():
    return G.area(F.col("t"), F.col("r"), F.col("m"), F.col("l"))


@query(_BOX + " select l_orderkey as media, t, r, m, l, (r - l) * (m - t) as area from b")
def box_area(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).select(F.col("l_orderkey").alias("media"), "t", "r", "m", "l", _area().alias("area"))


@query(_BOX + " select l_orderkey as media, t, r, m, l from b where (r - l) * (m - t) >= 300000")
def area_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).where(G.keeps(_area(), G.MIN_AREA)).select(F.col("l_orderkey").alias("media"), "t", "r", "m", "l")


@query(_BOX + " select l_orderkey as media, count(*) as n_all, cast(count_if((r - l) * (m - t) >= 300000) as bigint) as n_valid, round(count_if((r - l) * (m - t) >= 300000) / count(*), 6) as share from b group by 1")
def valid_metric(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.count_if(_area() >= G.MIN_AREA)
    n = ok.cast("long")
    return _boxes(spark, sf).groupBy(F.col("l_orderkey").alias("media")).agg(F.count("*").alias("n_all"), n.alias("n_valid"), F.round(ok / F.count("*"), 6).alias("share"))


@query(_BOX + " select case when (r - l) * (m - t) >= 300000 then 'Valid' else 'Below Threshold' end as status, count(*) as n from b group by 1")
def validity_status(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).groupBy(G.validity(_area(), G.MIN_AREA).alias("status")).agg(F.count("*").alias("n"))


@query(_BOX + " select l_orderkey as media, cast(trunc(t * (3000.0::double / 2048)) as integer) as top, cast(trunc(r * (4000.0::double / 2048)) as integer) as right_, cast(trunc(m * (3000.0::double / 2048)) as integer) as bottom, cast(trunc(l * (4000.0::double / 2048)) as integer) as left_ from b")
def box_rescale(spark: SparkSession, sf: str) -> DataFrame:
    h, w, p = F.lit(3000.0), F.lit(4000.0), F.lit(2048.0)
    return _boxes(spark, sf).select(F.col("l_orderkey").alias("media"), G.rescale(F.col("t"), h, p).alias("top"), G.rescale(F.col("r"), w, p).alias("right_"), G.rescale(F.col("m"), h, p).alias("bottom"), G.rescale(F.col("l"), w, p).alias("left_"))


@query(_BOX + f" select l_orderkey as media, greatest(t - 30, 0) as top, least(r + 30, {IMAGE_SIDE}) as right_, least(m + 30, {IMAGE_SIDE}) as bottom, greatest(l - 30, 0) as left_ from b")
def crop_box_clip(spark: SparkSession, sf: str) -> DataFrame:
    side = F.lit(IMAGE_SIDE)
    cols = G.padded(F.col("t"), F.col("r"), F.col("m"), F.col("l"), side, side)
    return _boxes(spark, sf).select(F.col("l_orderkey").alias("media"), *[c.cast("long").alias(n) for c, n in zip(cols, ("top", "right_", "bottom", "left_"))])


@query(_BOX + " select l_orderkey as media, round(least(1.0::double, 2048.0::double / greatest(m, r)), 6) as scale, case when t - 25 >= 0 then t - 25 else m + 10 end as tag_top from b")
def fit_and_tag(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).select(F.col("l_orderkey").alias("media"), F.round(G.fit_scale(F.col("m"), F.col("r")), 6).alias("scale"), G.label_top(F.col("t"), F.col("m"), 25).alias("tag_top"))


@query(_BOX + ", n as (select *, (r - l) * (m - t) as area, row_number() over (partition by l_orderkey order by t, l, m, r, l_linenumber) as n from b) select l_orderkey as media, string_agg('Face #' || n || ': ' || area || ' pixels', chr(10) order by n) as label from n group by 1")
def area_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.row_numbers(_boxes(spark, sf).withColumn("area", _area()), ["l_orderkey"], ["t", "l", "m", "r", "l_linenumber"])
    lines = rows.groupBy(F.col("l_orderkey").alias("media")).agg(F.array_sort(F.collect_list(F.struct("n", G.area_label(F.col("n"), F.col("area")).alias("x")))).alias("x"))
    return lines.select("media", F.array_join("x.x", "\n").alias("label"))


# ---------------------------------------------------------------- frames (events), pages, configuration

_FRAME = "with f as (select user_id as video, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events)"


@query(_FRAME + " select video, event_id, cast(n as integer) as frame_no from f where n % 30 = 0")
def frame_sample(spark: SparkSession, sf: str) -> DataFrame:
    return M.sampled_frames(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 30).select(F.col("user_id").alias("video"), "event_id", "frame_no")


@query(_FRAME + " select video, event_id, cast(n as integer) as frame_no from f where n % 5 = 0 and n / 5 < 10")
def frame_sample_capped(spark: SparkSession, sf: str) -> DataFrame:
    return M.sampled_frames(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 5, 10).select(F.col("user_id").alias("video"), "event_id", "frame_no")


@query("select frame_path, regexp_replace(regexp_extract(media_path, '([^/]+)$', 1), '(.)\\.[^.]+$', '\\1') || '_frame_' || frame_no || '.jpg' as name from frame where media_path is not null")
def frame_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "frame").where("media_path is not null").select("frame_path", N.frame_name(N.stem(F.col("media_path")), F.col("frame_no")).alias("name"))


@query("select cast(doc_id as bigint) as doc_id from documents order by doc_id offset 50 limit 25")
def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of 25."""
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").offset(50).limit(25)


@query("with n as (select source, count(*) as total from documents group by 1) select source, page, 'Showing ' || (page * 25 + 1) || '-' || least(page * 25 + 25, total) || ' of ' || total || ' files.' as caption from n, unnest(range(0, (total + 24) // 25)) as t(page)")
def page_caption(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"))
    pages = n.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / 25))))
    return pages.select("source", "page", N.caption(F.col("page"), F.lit(25), F.col("total")).alias("caption"))


@query("select doc_id, source, cast((row_number() over (partition by source order by doc_id) - 1) % 8 as integer) as grid from documents")
def grid_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.ranked(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"])
    return rows.select("doc_id", "source", ((F.col("n") - 1) % 8).cast("int").alias("grid"))


@query("select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k, coalesce(json_extract_string(props, '$.a.b'), 'default') as ab from events")
def config_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf, "events").select("event_id", N.config_get(p, "k", "none").alias("k"), N.config_get(p, "a.b", "default").alias("ab"))


@query("select p_partkey as id, case when p_size % 2 = 0 then 0.4::double else 0.6::double end as eps, greatest(1, least(p_size, 8)) as workers, greatest(1, cast(trunc(case when p_size % 7 = 0 then 30.0::double else (p_size % 7) * 12.5::double end) as integer)) as every from part")
def run_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults by model, workers within the cores, and the interval of kept frames."""
    s = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.default_eps(F.when(s % 2 == 0, "cnn").otherwise("hog")).alias("eps"), N.workers(s, F.lit(8)).alias("workers"), N.frame_interval((s % 7) * 12.5).alias("every"))
