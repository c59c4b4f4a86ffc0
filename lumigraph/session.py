"""Session helpers: a local session for tests, and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
RUN = uuid.uuid4().hex  # of this driver's cuts, so that what no step deleted goes when the driver ends
_folders: dict[str, SparkSession] = {}


def _sweep() -> None:
    for folder, spark in _folders.items():
        try:
            fs, p = _hadoop(spark, folder)
            fs.delete(p, True)
        except Exception:  # the session is gone already
            pass


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumigraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if set, else (local mode only) a temporary one."""
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lumigraph-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set(CHECKPOINT_KEY, "file://" + folder)
    return "file://" + folder


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, in whatever file system."""
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def run_folder(spark: SparkSession) -> str:
    """This driver's part of the shared folder, deleted when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/lumigraph/{RUN}"
    if not _folders:
        atexit.register(_sweep)
    _folders[folder] = spark
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumigraph_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Delete the files of a table made by :func:`cut` that no later step reads."""
    path = getattr(df, "_lumigraph_path", None)
    if path:
        fs, p = _hadoop(df.sparkSession, path)
        fs.delete(p, True)


def keep_cut(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, a view of ``source``, which goes with it."""
    df._lumigraph_path = getattr(source, "_lumigraph_path", None)
    return df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their search path holds it already.

    Every operator that runs Python on executors calls this, so tables made elsewhere work too.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if getattr(sc, "_lumigraph_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    d = tempfile.mkdtemp(prefix="lumigraph-")  # the driver serves the file from there as long as it runs
    atexit.register(shutil.rmtree, d, True)
    name = os.path.join(d, f"lumigraph-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    sc.addPyFile(name)
    sc._lumigraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
