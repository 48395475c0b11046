"""The folder that driver and executors share, and tables kept there for a while."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # One process does all, as in tests: any folder is shared.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="auditlake-"))
    return shared_dir(spark)


class Stash:
    """Tables written once to the shared folder and read back: cuts lineage and survives lost executors.

    A table that only feeds a later one is dropped with ``drop`` as soon as that one is written;
    tables behind a returned DataFrame stay for the application and go at its end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_dir(spark)

    def folder(self) -> str:
        """A new folder that goes at the application's end."""
        path = f"{self.root}/auditlake/{uuid.uuid4().hex}"
        fs, p = _hadoop(self.spark, path)
        fs.deleteOnExit(p)
        return path

    def put(self, df: DataFrame, tasks: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
        """df as written. tasks: how many write it at most, for tables whose size is known to be small; options: the writer's."""
        path = self.folder()
        (df if tasks is None else df.coalesce(tasks)).write.options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_stash_path", None):
                with contextlib.suppress(Exception):  # a leftover folder is harmless
                    fs, p = _hadoop(self.spark, t._stash_path)
                    fs.delete(p, True)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
