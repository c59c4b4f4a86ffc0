"""Files written and moved: copies per person, archives, previews, and the queue of file actions."""

from __future__ import annotations

import filecmp
import os
import queue
import shutil
import threading
import time
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumigraph.session import ship


def copy_files(manifest: DataFrame) -> DataFrame:
    """Copy ``src`` to ``dest`` where it is absent, on the executors: ``(dest, status)``.

    Of several sources of one destination the smallest is copied, so a second run changes nothing.
    """
    ship(manifest.sparkSession)
    one = manifest.groupBy("dest").agg(F.min("src").alias("src"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dest, src in zip(pdf.dest, pdf.src):
                try:
                    if os.path.exists(dest):
                        out.append((dest, "present"))
                        continue
                    os.makedirs(os.path.dirname(dest), exist_ok=True)
                    shutil.copyfile(src, part := f"{dest}.{os.getpid()}.part")
                    os.replace(part, dest)
                    out.append((dest, "copied"))
                except OSError as e:
                    out.append((dest, f"failed: {e.strerror}"))
            yield pd.DataFrame(out, columns=["dest", "status"])

    return one.mapInPandas(run, "dest string, status string")


def write_files(files: DataFrame) -> DataFrame:
    """Write ``content`` to ``path`` on the executors, whole or not at all: ``(path, status)``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(part := f"{path}.{os.getpid()}.part", "wb") as f:
                        f.write(bytes(content))
                    os.replace(part, path)
                    out.append((path, "written"))
                except OSError as e:
                    out.append((path, f"failed: {e.strerror}"))
            yield pd.DataFrame(out, columns=["path", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, status string")


def previews(first: DataFrame, root: str = "output/face_previews") -> DataFrame:
    """``(src, dest)`` of representatives ``(cluster_id, crop_path)``, for :func:`copy_files`."""
    return first.where("crop_path is not null").select(F.col("crop_path").alias("src"), F.concat(F.lit(f"{root}/rep_"), F.col("cluster_id").cast("string"), F.lit(".jpg")).alias("dest"))


def outputs(folder: str) -> list[str]:
    """All files below a folder."""
    return sorted(os.path.join(d, f) for d, _, files in os.walk(folder) for f in files)


def archive(folder: str, target: str) -> int:
    """A deflated zip of a folder, paths relative to it; returns the number of files."""
    found = [p for p in outputs(folder) if os.path.abspath(p) != os.path.abspath(target)]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in found:
            z.write(p, os.path.relpath(p, folder))
    return len(found)


def cleanup(folder: str, tries: int = 5, pause: float = 0.2) -> None:
    """Remove a folder if there is one; a file still in use is waited for."""
    for k in range(tries):
        try:
            shutil.rmtree(folder)
            return
        except FileNotFoundError:
            return
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(pause * (k + 1))


class FileActions:
    """File actions done in order by one background thread; errors are kept, later actions go on."""

    def __init__(self) -> None:
        self.todo: queue.Queue = queue.Queue()
        self.errors: list[str] = []
        self._thread: threading.Thread | None = None
        self._lock = threading.Lock()

    def start(self) -> None:
        with self._lock:
            if self._thread is None:
                self._thread = threading.Thread(target=self._run, daemon=True)
                self._thread.start()

    def put(self, op: str, *args: str) -> None:
        self.start()
        self.todo.put((op, args))

    def wait(self) -> None:
        self.todo.join()

    def _run(self) -> None:
        while True:
            op, args = self.todo.get()
            try:
                getattr(self, "do_" + op)(*args)
            except Exception as e:
                self.errors.append(f"{op}: {e}")
            finally:
                self.todo.task_done()

    @staticmethod
    def do_remove_file(path: str) -> None:
        os.remove(path)

    @staticmethod
    def do_rename_file(old: str, new: str) -> None:
        os.rename(old, new)

    do_rename_dir = do_rename_file

    @staticmethod
    def do_remove_dir(path: str) -> None:
        shutil.rmtree(path)

    @staticmethod
    def do_move_files_and_remove_dir(old: str, new: str) -> None:
        """All files move; one whose name is taken goes under the first free one, an equal copy goes away."""
        os.makedirs(new, exist_ok=True)
        for f in sorted(os.listdir(old)):
            src, dest, k = os.path.join(old, f), os.path.join(new, f), 0
            stem, ext = os.path.splitext(f)
            while os.path.exists(dest) and not (os.path.isfile(src) and os.path.isfile(dest) and filecmp.cmp(src, dest, shallow=False)):
                k += 1
                dest = os.path.join(new, f"{stem}_{k}{ext}")
            os.replace(src, dest)
        os.rmdir(old)


def load_config(path: str) -> dict:
    """A nested configuration: YAML if a reader is installed, else its plain subset of indented ``key: value`` lines."""
    text = open(path, encoding="utf-8").read()
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        pass
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while depth <= stack[-1][0]:
            stack.pop()
        value = value.strip().strip("\"'")
        if value:
            low = value.lower()
            stack[-1][1][key] = low == "true" if low in ("true", "false") else int(value) if value.lstrip("-").isdigit() else float(value) if value.replace(".", "", 1).lstrip("-").isdigit() else value
        else:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
    return root


def config_value(config: dict, path: str, default=None):
    """A dotted path; the default where a key is missing."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config
