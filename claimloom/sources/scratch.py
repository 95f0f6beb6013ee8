"""Tables that a session writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HELD: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for cut lineage; a temporary one only on a local master that sets none, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("claimloom.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("claimloom.scratch", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/claimloom/{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read from there: lineage is cut, and all that reads it reads the same rows."""
    path = fresh(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, files: list[str]) -> tuple:
    """Number, sizes and times of files, by their metadata alone."""
    told = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    return tuple(map(str, told.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.sum("length")).first()))


def once(spark: SparkSession, tag: str, source: DataFrame, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """make(), written as Parquet (in folders by the columns `by`) the first time that it is asked for in this application
    with this tag and these files of `source`, and read from there from then on. Files that are overwritten in place
    have other sizes or times, and are read anew."""
    files = sorted(source.inputFiles())
    key = (spark.sparkContext.applicationId, tag, tuple(files), state_of(spark, files))
    if key not in _HELD:
        made, path = make(), fresh(spark, tag)
        out = made.write.option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(path)
        _HELD[key] = path
    return spark.read.parquet(_HELD[key])


def forget() -> None:
    """What once() has written is made anew when it is asked for again."""
    _HELD.clear()
