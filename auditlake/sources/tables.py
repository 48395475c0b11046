"""Readers and writers of the library's own tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").partitionBy("day").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each report: an upsert on reading."""
    newest = Window.partitionBy("id").orderBy(F.desc("created_at"))
    return spark.read.parquet(path).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def read_scorecards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ranOn string, fixtures int, expected int, found int, recall double, falsePositives int").option("multiLine", True).json(path)


def read_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Server-sent events: blocks parted by a blank line, with ``event:`` and ``data:`` lines."""
    t = F.col(text)
    several = t.contains("\n\n") | t.contains("\n\r\n")
    # A text that is one block, as files read by blank lines give them, need not be cut. The outer form, for Spark would
    # cut every text a second time to see that the list is not empty.
    block = F.explode_outer(F.when(several, F.split(t, r"\r?\n\r?\n")).otherwise(F.array(t))).alias("block")
    b = lines.select(block).where("block <> ''")
    return b.select(F.regexp_extract("block", r"(?m)^event:[ ]?(.*)$", 1).alias("event"), F.array_join(F.regexp_extract_all("block", F.lit(r"(?m)^data:[ ]?(.*)$"), F.lit(1)), "\n").alias("data"))
