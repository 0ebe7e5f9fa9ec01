"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir`` (or the context has a checkpoint folder).  Where
    neither is set, a local session, which has only one machine, gets a folder of its own; on a
    cluster that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_folder.get(sc.applicationId)
        if root is None:
            root = _own_folder[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads."""
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file, also of one that Spark's sources hide because of its name."""
    fs, where = _file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text as one file."""
    fs, where = _file_system(spark, path)
    stream = fs.create(where)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables below ``path``, none where there is no such folder."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory() and exists(spark, f"{f.getPath()}/_SUCCESS"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes with what is written there when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def to_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts lineage: a lost executor costs only the stage that was running, and loops don't
    grow their plans.  ``drop_tables`` removes tables that nothing reads any more; what is left goes
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``to_table`` returned and that no plan still to be run reads; others are left alone."""
    for df in tables:
        path = df.__dict__.pop("_table_path", None)
        if path is not None:
            fs, where = _file_system(df.sparkSession, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)
