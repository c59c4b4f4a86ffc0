"""Files of persons: lineage, groups, representatives and destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumigraph.functions import names


def lineage(rows: DataFrame, path: str, frames: DataFrame) -> DataFrame:
    """``path`` replaced by the video a frame came from, where it is one (the smallest, if rows disagree)."""
    source = frames.where("frame_path is not null and media_path is not null").groupBy("frame_path").agg(F.min("media_path").alias("_video"))
    return rows.join(source, rows[path] == source.frame_path, "left").withColumn(path, F.coalesce("_video", path)).drop("frame_path", "_video")


def person_files(faces: DataFrame, labels: DataFrame, frames: DataFrame) -> DataFrame:
    """Distinct ``(cluster_id, media_path)``; a file may belong to several persons."""
    rows = faces.where("media_path is not null").select("face_id", "media_path").join(labels, "face_id")
    return lineage(rows.select("cluster_id", "media_path").distinct(), "media_path", frames).select("cluster_id", "media_path").distinct()


def representatives(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cluster_id, face_id, crop_path)`` of the first face of each cluster."""
    rows = faces.select("face_id", "crop_path").join(labels, "face_id")
    best = rows.groupBy("cluster_id").agg(F.min(F.struct("face_id", "crop_path")).alias("m"))
    return best.select("cluster_id", "m.face_id", "m.crop_path")


def destinations(files: DataFrame, root: str = "output") -> DataFrame:
    """``(cluster_id, src, dest, collision)``: flagged where several sources of a person share a base name."""
    rows = files.select("cluster_id", F.col("media_path").alias("src"), names.destination(F.col("cluster_id"), F.col("media_path"), root).alias("dest"))
    n = rows.groupBy("dest").agg(F.count("*").alias("n"))
    return rows.join(n, "dest").select("cluster_id", "src", "dest", (F.col("n") > 1).alias("collision"))


def persons(files: DataFrame, first: DataFrame) -> DataFrame:
    """One row per person with the number of files, the first of them and the representative; files stay rows."""
    grouped = files.groupBy("cluster_id").agg(F.count("*").alias("n_files"), F.min("media_path").alias("first_file"))
    return grouped.join(first.select("cluster_id", F.col("crop_path").alias("representative_face")), "cluster_id", "left").select("cluster_id", names.person(F.col("cluster_id")).alias("name"), "n_files", "first_file", "representative_face")


def file_lists(files: DataFrame) -> DataFrame:
    """``(cluster_id, files)``: sorted lists, for display of persons with few files."""
    return files.groupBy("cluster_id").agg(F.sort_array(F.collect_set("media_path")).alias("files"))


def zip_faces(results: DataFrame) -> DataFrame:
    """Encodings and crops of a worker's results side by side, the shorter list decides; faceless results are left out."""
    n = F.least(F.size("encodings"), F.size("crop_paths"))
    rows = results.where("error is null and size(encodings) > 0").withColumn("n", n)
    both = F.arrays_zip(F.slice("encodings", 1, F.col("n")).alias("encoding"), F.slice("crop_paths", 1, F.col("n")).alias("crop_path"))
    flat = rows.where("n > 0").select("media_path", F.posexplode(both).alias("pos", "f"))
    return flat.select("media_path", F.col("pos").alias("face_no"), F.col("f.encoding").alias("encoding"), F.col("f.crop_path").alias("crop_path"))
