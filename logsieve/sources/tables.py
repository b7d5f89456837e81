"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (a local session, as in tests) one temporary
    folder is made for the session and remembered; it goes when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_logsieve_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="logsieve-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = spark._logsieve_dir = "file://" + folder
    return found if ":/" in found else "file://" + found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written within a ``scratch`` block."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame | str) -> None:
        """These tables (or paths) are what later reads need."""
        self.kept |= {t if isinstance(t, str) else t._logsieve_path for t in tables}


_scratches: list[Scratch] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Intermediate tables written in the block are removed at its end, but for kept ones, which fall to the block around it."""
    own = Scratch()
    _scratches.append(own)
    try:
        yield own
    except BaseException:
        own.kept.clear()
        raise
    finally:
        _scratches.remove(own)
        for path in own.paths:
            if path in own.kept:
                wrote(path)
            else:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def wrote(path: str) -> None:
    """Note an intermediate table."""
    if _scratches:
        _scratches[-1].paths.append(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    wrote(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._logsieve_path = path
    return out
