"""Names and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# extensions: fixed values
IMAGES = (".jpg", ".jpeg", ".png", ".heic")
VIDEOS = (".mp4", ".mov", ".avi", ".mkv")
UPLOADS = (".jpg", ".jpeg", ".png", ".mp4")
DIAGNOSTIC = (".jpg", ".jpeg", ".png")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; empty for dot files, bare names and a final dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def kind(path: Column) -> Column:
    """image, video or null."""
    s = F.lower(suffix(path))
    return F.when(s.isin(*IMAGES), "image").when(s.isin(*VIDEOS), "video")


def sanitise(name: Column) -> Column:
    """Letters, digits, space, underscore and dash, without trailing spaces; null where nothing is left."""
    clean = F.rtrim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))
    return F.when(clean != "", clean)


def person(cluster_id: Column) -> Column:
    return F.concat(F.lit("Person_"), (cluster_id + 1).cast("string"))


def destination(cluster_id: Column, path: Column, root: str = "output") -> Column:
    return F.concat_ws("/", F.lit(root), person(cluster_id), basename(path))


def crop_name(path: Column, number: Column, root: str) -> Column:
    return F.concat(F.lit(root + "/"), stem(path), F.lit("_"), number.cast("string"), F.lit(".jpg"))


def frame_name(stem_: Column, number: Column) -> Column:
    """Deterministic: without the clock."""
    return F.format_string("%s_frame_%d.jpg", stem_, number.cast("long"))


def default_eps(model: Column) -> Column:
    return F.when(model == "cnn", 0.4).otherwise(0.6)


def caption(page: Column, size: Column, total: Column) -> Column:
    first = page * size
    return F.format_string("Showing %d-%d of %d files.", (first + 1).cast("long"), F.least(first + size, total).cast("long"), total.cast("long"))


def config_get(json: Column, path: str, default: str) -> Column:
    """A dotted path of a JSON text, else the default."""
    return F.coalesce(F.get_json_object(json, "$." + path), F.lit(default))


def workers(asked: Column, cores: Column) -> Column:
    """At least one, at most the cores."""
    return F.greatest(F.lit(1), F.least(asked, cores))


def frame_interval(video_fps: Column, fps: float = 1) -> Column:
    """Every how many frames one is kept; 30 frames a second where the video does not say."""
    real = F.when(video_fps > 0, video_fps).otherwise(30.0)
    return F.greatest(F.lit(1), (real / fps).cast("int"))
