"""What jobs need of a session: this package on the executors, and tables in a folder that all machines share.

A stage table cuts lineage: what was written is read again instead of computed again, and it outlives the executor that
made it. The folder is the session's ``spark.checkpoint.dir``; only where that is unset and all tasks run on one machine
(tests, a laptop) does this module choose one.
"""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for sessions that were started without it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="quillgraph-")) / "quillgraph_package.zip"
    path.write_bytes(body.getvalue())
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` without a trailing slash. Where it is unset, a folder of this machine's if all tasks run
    on it, else an error: executors would not see each other's files."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillgraph-"))
            current = context._jsc.sc().getCheckpointDir()
        found = current.get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quillgraph-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a new stage table and return a reader of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path as its object."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            remove(df.sparkSession, folder)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended before
            return
