"""Media scans, frames and the pluggable detector."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumigraph import schemas
from lumigraph.functions import names
from lumigraph.session import ship
from lumigraph.sources import pixels

class Backend(Protocol):
    """A face model: where faces are in an image, and a vector of each."""

    def locate(self, image: np.ndarray) -> list[pixels.Box]: ...

    def encode(self, image: np.ndarray, boxes: list[pixels.Box]) -> list[list[float]]: ...


#: ``decode(content) -> (frames a second, the frames in order)``; one that cannot be read raises
VideoDecoder = Callable[[bytes], tuple[float, Iterable[np.ndarray]]]


def scan(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """``(path, name, stem, suffix, kind)`` of the supported files below ``folder``; a missing folder is an error.

    Bytes are read only if asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    p = F.col("path")
    cols = [p, names.basename(p).alias("name"), names.stem(p).alias("stem"), names.suffix(p).alias("suffix"), names.kind(p).alias("kind")]
    return files.select(*cols, *(["content"] if content else [])).where("kind is not null")


def latest_uploads(media: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Of uploads with the same name the last by ``order``; nameless ones are left out."""
    w = Window.partitionBy(name).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return media.where(F.col(name).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sampled_frames(frames: DataFrame, video: str, order: list[str], every: int, most: int | None = None) -> DataFrame:
    """Every ``every``-th frame of each video, the first included, at most ``most`` of a video."""
    w = Window.partitionBy(video).orderBy(*order)
    n = frames.withColumn("frame_no", (F.row_number().over(w) - 1).cast("int"))
    kept = n.where(F.col("frame_no") % every == 0)
    return kept.where(F.col("frame_no") / every < most) if most else kept


def inputs(images: DataFrame, frames: DataFrame) -> DataFrame:
    """Images and the frames of videos as one list of distinct paths."""
    return images.select("path").unionByName(frames.select(F.col("frame_path").alias("path"))).where("path is not null").distinct()


RESULT = ["media_path", "encodings", "crop_paths", "face_locations", "processed_path", "error"]


def _boxes(boxes) -> list[dict]:
    return [dict(zip(("top", "right", "bottom", "left"), map(int, x))) for x in boxes]


def _tuples(boxes) -> list[pixels.Box]:
    return [tuple(int(b[c]) for c in ("top", "right", "bottom", "left")) for b in (boxes if boxes is not None else [])]


def crop_path(root: str, path: str, number: int, suffix: str) -> str:
    """Named after the file and a hash of its whole path, so that files of one name do not collide."""
    stem, _ = os.path.splitext(path.rsplit("/", 1)[-1])
    return f"{root}/{stem}_{zlib.crc32(path.encode()):08x}{zlib.adler32(path.encode()):08x}_{number}{suffix}"


def detect(files: DataFrame, make: Callable[[], Backend], least: int | None = None, crop_root: str = "crops", side: int = 2048, how: pixels.Codec | None = None) -> DataFrame:
    """Worker results of ``files (path, content)``.  The model is made once a worker; an error gives empty lists.

    Images are fitted into ``side``, faces located there, boxes scaled back and truncated.  All boxes are reported;
    encodings and crops are only of boxes of at least ``least`` pixels of the original (0 or none: all), in one order.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, codec = make(), how or pixels.codec()
        for pdf in batches:
            out: list[tuple[Any, ...]] = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    image = codec.decode(bytes(content))
                    small = pixels.fit(image, side)
                    found = model.locate(small)
                    boxes = [pixels.rescaled(b, image.shape, small.shape) for b in found]
                    keep = [i for i, b in enumerate(boxes) if not least or pixels.area(b) >= least]
                    vectors = model.encode(small, [found[i] for i in keep]) if keep else []
                    out.append((path, vectors, [crop_path(crop_root, path, k, codec.suffix) for k in range(len(keep))], _boxes(boxes), path, None))
                except Exception as e:  # a file that cannot be read is a result with an error
                    out.append((path, [], [], [], path, str(e)))
            yield pd.DataFrame(out, columns=RESULT)

    return files.select("path", "content").mapInPandas(run, schemas.WORKER_RESULT)


def locate(files: DataFrame, make: Callable[[], Backend], how: pixels.Codec | None = None) -> DataFrame:
    """``(path, boxes)`` on the images as they are; none where a file cannot be read."""
    ship(files.sparkSession)

    def run(batches):
        model, codec = make(), how or pixels.codec()
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    out.append((path, _boxes(model.locate(codec.decode(bytes(content))))))
                except Exception:
                    out.append((path, []))
            yield pd.DataFrame(out, columns=["path", "boxes"])

    return files.select("path", "content").mapInPandas(run, f"path string, boxes array<{schemas.BOX.simpleString()}>")


def encode_known(files: DataFrame, make: Callable[[], Backend], how: pixels.Codec | None = None) -> DataFrame:
    """``(path, encodings)`` of ``files (path, content, boxes)``: vectors of boxes known already; none on an error."""
    ship(files.sparkSession)

    def run(batches):
        model, codec = make(), how or pixels.codec()
        for pdf in batches:
            out = []
            for path, content, boxes in zip(pdf.path, pdf.content, pdf.boxes):
                try:
                    known = _tuples(boxes)
                    out.append((path, model.encode(codec.decode(bytes(content)), known) if known else []))
                except Exception:
                    out.append((path, []))
            yield pd.DataFrame(out, columns=["path", "encodings"])

    return files.select("path", "content", "boxes").mapInPandas(run, "path string, encodings array<array<double>>")


def verified(files: DataFrame, how: pixels.Codec | None = None) -> DataFrame:
    """``(path, valid)``: whether a file is an image that can be read."""
    ship(files.sparkSession)

    def run(batches):
        codec = how or pixels.codec()
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    codec.decode(bytes(content))
                    out.append((path, True))
                except Exception:
                    out.append((path, False))
            yield pd.DataFrame(out, columns=["path", "valid"])

    return files.select("path", "content").mapInPandas(run, "path string, valid boolean")


def crops(files: DataFrame, results: DataFrame, least: int | None = None, pad: int = 30, how: pixels.Codec | None = None) -> DataFrame:
    """``(path, content)`` of the crops that ``results`` of :func:`detect` name; ``sinks.write_files`` stores them.

    ``least`` is that of the detection; ``pad`` 0 gives the boxes as they are.
    """
    ship(files.sparkSession)
    rows = files.select("path", "content").join(results.where("size(crop_paths) > 0").select(F.col("media_path").alias("path"), "crop_paths", "face_locations"), "path")

    def run(batches):
        codec = how or pixels.codec()
        for pdf in batches:
            out = []
            for content, paths, boxes in zip(pdf.content, pdf.crop_paths, pdf.face_locations):
                image = codec.decode(bytes(content))
                kept = [b for b in _tuples(boxes) if not least or pixels.area(b) >= least]
                out += [(p, codec.encode(pixels.crop(image, b, pad))) for p, b in zip(paths, kept)]
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.select("content", "crop_paths", "face_locations").mapInPandas(run, "path string, content binary")


def annotations(files: DataFrame, results: DataFrame, root: str, least: int | None = None, labels: bool = True, how: pixels.Codec | None = None) -> DataFrame:
    """``(path, content)`` of images with their faces drawn in, as ``root/detected_<name>``.

    With ``least`` tags show areas, in green or red; without it numbers; ``labels`` off leaves boxes only.
    """
    ship(files.sparkSession)
    rows = files.select("path", "content").join(results.where("error is null").select(F.col("media_path").alias("path"), "face_locations"), "path")

    def run(batches):
        codec = how or pixels.codec()
        for pdf in batches:
            out = []
            for path, content, boxes in zip(pdf.path, pdf.content, pdf.face_locations):
                known = _tuples(boxes)
                text, colours = pixels.tags([pixels.area(b) for b in known], least)
                image = pixels.draw(codec.decode(bytes(content)), known, colours, text if labels else None, 5 if least else 3)
                out.append((f"{root}/detected_{os.path.splitext(path.rsplit('/', 1)[-1])[0]}{codec.suffix}", codec.encode(image)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


def extract_frames(videos: DataFrame, make: Callable[[], VideoDecoder], root: str, fps: float = 1, most: int | None = None, fps_if_unknown: float | None = 30.0, how: pixels.Codec | None = None) -> DataFrame:
    """``(frame_path, media_path, frame_no, content, error)``: every so many frames of ``videos (path, content)``.

    One frame in ``int(video's rate / fps)``, at least each, at most ``most`` of a video.  A video that does not tell
    its rate has ``fps_if_unknown``, or is left out if that is none; one that cannot be read is a row with an error.
    """
    ship(videos.sparkSession)

    def run(batches):
        decode, codec = make(), how or pixels.codec()
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                stem, out = os.path.splitext(path.rsplit("/", 1)[-1])[0], []
                try:
                    rate, frames = decode(bytes(content))
                    rate = rate or fps_if_unknown
                    if not rate:
                        continue
                    every = max(1, int(rate / fps))
                    for k, image in enumerate(frames):
                        if most is not None and k // every >= most:
                            break
                        if k % every == 0:
                            name = f"{stem}_{zlib.crc32(path.encode()):08x}_frame_{k}{codec.suffix}"
                            out.append((f"{root}/{name}", path, k, codec.encode(image), None))
                except Exception as e:
                    out.append((None, path, None, None, str(e)))
                yield pd.DataFrame(out, columns=["frame_path", "media_path", "frame_no", "content", "error"]).astype({"frame_no": "Int32"})

    return videos.select("path", "content").mapInPandas(run, "frame_path string, media_path string, frame_no int, content binary, error string")


def detections(results: DataFrame) -> DataFrame:
    """``(media_path, face_no, top, right, bottom, left, area)`` of every box, faces of no interest included."""
    flat = results.select("media_path", F.posexplode("face_locations").alias("pos", "b"))
    box = [F.col(f"b.{c}").alias(c) for c in ("top", "right", "bottom", "left")]
    return flat.select("media_path", (F.col("pos") + 1).alias("face_no"), *box, ((F.col("b.right") - F.col("b.left")) * (F.col("b.bottom") - F.col("b.top"))).cast("long").alias("area"))


class BrightRectangles:
    """A stand-in without a model: bright connected rectangles are the faces, their corners the vectors.

    Real models plug in the same way; none is available to this package.
    """

    def locate(self, image: np.ndarray) -> list[pixels.Box]:
        on = image.min(2) > 200
        boxes, seen = [], np.zeros_like(on)
        for y, x in zip(*np.nonzero(on)):
            if not seen[y, x]:
                r, b = x, y
                while r < on.shape[1] and on[y, r]:
                    r += 1
                while b < on.shape[0] and on[b, x]:
                    b += 1
                seen[y:b, x:r] = True
                boxes.append((int(y), int(r), int(b), int(x)))
        return boxes

    def encode(self, image: np.ndarray, boxes: list[pixels.Box]) -> list[list[float]]:
        return [[float(v) for v in b] for b in boxes]


def ppm_frames() -> VideoDecoder:
    """A stand-in for videos: a line with the rate, then PPM images one after the other."""

    def decode(content: bytes):
        line, _, rest = content.partition(b"\n")
        if not line.startswith(b"RATE "):
            raise ValueError("not a video")

        def frames():
            at = rest
            while at:
                image = pixels.PPM.decode(at)
                yield image
                at = at[len(pixels.PPM.encode(image)) :]

        return float(line[5:]), frames()

    return decode
