"""Folders that appear whole or not at all: they are written under another name and renamed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of what lies in a folder and begins so, without the prefix; none if there is no folder."""
    fs, where = _at(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n[len(prefix) :] for n in found if n.startswith(prefix))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def publish(rows: DataFrame, folder: str, name: str, form: str = "json", by: tuple[str, ...] = ()) -> bool:
    """rows as folder/name, whole or not at all; False, and nothing is written, if another has it already."""
    spark = rows.sparkSession
    made = f"{folder}/_new-{uuid.uuid4().hex}"
    out = rows.write.format(form)
    (out.partitionBy(*by) if by else out).save(made)
    fs, new = _at(spark, made)
    _, old = _at(spark, f"{folder}/{name}")
    if fs.exists(old) or not fs.rename(new, old):
        fs.delete(new, True)
        return False
    _, nested = _at(spark, f"{folder}/{name}/{new.getName()}")
    if fs.exists(nested):  # some file systems move into a folder that appeared meanwhile
        fs.delete(nested, True)
        return False
    return True
