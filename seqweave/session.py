"""Sessions, and how the package gets to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: The folders of local sessions that name none.
_own: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", conf: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, the submitter makes the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=conf or {})
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, unless PYTHONPATH already does."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="seqweave-"), "seqweave.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, str(f.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and its name there."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new local one if the session runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="seqweave-")
    return _own[app]


def run_folder(spark: SparkSession) -> str:
    """This application's folder for tables between jobs, below shared_base()."""
    return f"{shared_base(spark)}/seqweave/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes this application's tables between jobs. Results that haven't been written by then are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
