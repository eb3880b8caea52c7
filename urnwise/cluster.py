"""What jobs share: this package on Spark's Python workers, and the folder for rows that several jobs read."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each context; not needed where PYTHONPATH already has it."""
    sc = spark.sparkContext
    if getattr(sc, "_urnwise_sent", False):
        return
    sc._urnwise_sent = True
    if ROOT in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="urnwise-")), "urnwise.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "urnwise")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a single machine; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="urnwise-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def path_of(spark: SparkSession, at: str):
    """The file system of a path, and the path as that system has it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again: later work starts from files that outlive executors.

    The files go when the application ends, or before with `discard`.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    files, path = path_of(spark, at)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._cut_at = at
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete the files of cuts that no later result reads."""
    for df in cuts:
        files, path = path_of(df.sparkSession, df._cut_at)
        files.delete(path, True)
