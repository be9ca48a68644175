"""The folder that the driver and all executors share, and tables and files kept there."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset (single-machine tests) a folder is made and set."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = context._jsc.sc().getCheckpointDir()
        base = made.get() if made.isDefined() else None
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidegrove-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Removes tables that ``cut`` wrote, when all that was made of them is written itself."""
    for df in tables:
        if df is not None and getattr(df, "_cut", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            df._cut = None


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> None:
    """Write byte chunks to ``uri`` under a name of its own, then rename, so that a repeated task never leaves half a file."""
    files, path = _filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    scratch = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(scratch) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(scratch, path)


def read_file(uri: str):
    """An input stream on ``uri``."""
    files, path = _filesystem(uri)
    return files.open_input_stream(path, compression=None)


def map_file(uri: str) -> np.ndarray | None:
    """The bytes of a file, memory-mapped, or None where the store is no file system. The map keeps no file open."""
    files, path = _filesystem(uri)
    if type(files).__name__ != "LocalFileSystem":
        return None
    with open(path, "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)


def open_file(uri: str):
    """A file of any store, to read ranges of."""
    files, path = _filesystem(uri)
    return files.open_input_file(path)
