"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for cut lineage; a temporary one only where none is set, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("claimloom.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("claimloom.scratch", found)
    return found.rstrip("/")


def saved(df: DataFrame, tag: str, per_file: int = 0) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage is cut, a lost executor costs no redo. per_file: rows
    of a file, for rows of many MB, which readers and writers of Parquet hold by the hundred."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, rows: pa.Table) -> Broadcast:
    """A broadcast of a bounded Arrow table; shipped() reads it in a task."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def shipped(data: Broadcast) -> pa.Table:
    return pa.ipc.open_stream(data.value).read_all()


def least_hashed(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """The n rows of least hash of the columns, ties by the columns. Only rows below a bound that some 2n pass go to the
    one task that picks them, however many there are: each task else would send it its own n."""
    (name,) = free(rows.columns, "row_hash")
    total = rows.count()
    bound = min(2**63 - 1, -(2**63) + int(2**64 * (2 * n + 200) / max(1, total)))
    return rows.withColumn(name, F.xxhash64(*columns)).filter(F.col(name) <= bound).orderBy(name, *columns).limit(n).drop(name)


def free(columns: list[str], *names: str) -> list[str]:
    """Working names that none of the columns has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x if x is not None else b"" for x in col.to_pylist()]


def pieces(batch: pa.RecordBatch, rows: int = 2000, size: int = 4 << 20):
    """The batch in slices of at most `rows` rows and, but for a row that is longer, `size` bytes of text, so that Python holds
    a bounded part of whole texts at once."""
    long = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            long += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(long), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, before + size, side="right"))), at + rows)
        yield batch.slice(at, end - at)
        at = end


def row_key(*columns: str) -> Column:
    """A key of 128 bits for a row's columns: two hashes, as one alone does collide among 10^10 rows."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *columns).alias("h2"))


#: the type of row_key, for the schemas of functions that pass it on
KEY = "struct<h1:bigint,h2:bigint>"


def between(data: Column, runs: Column, glue: str) -> Column:
    """The text of the UTF-8 bytes `data` without its runs (array of lo and hi, sorted and apart), with glue for each. Every
    part is copied once, so the work is linear in the text."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["hi"]))
    ends = F.transform(runs, lambda r: r["lo"])
    gaps = F.arrays_zip(starts.alias("lo"), ends.alias("hi"))  # the last has no end
    kept = F.transform(gaps, lambda g: F.substring(data, g["lo"] + 1, F.coalesce(g["hi"], F.octet_length(data)) - g["lo"]).cast("string"))
    return F.array_join(kept, glue)


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """rows with dense numbers from 0 in this order. Rows are dealt by ranges and written once with their place; a
    place's number follows from the sizes of the ranges before it, so nothing depends on how ranges are drawn."""
    at, part, before = free([*rows.columns, name], "row_at", "row_part", "rows_before")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(ranged.withColumn(at, F.monotonically_increasing_id()), "ranged")
    which = F.shiftrightunsigned(at, 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(which.alias(part)).count().collect())  # a row for each range
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    known = rows.sparkSession.createDataFrame(starts, f"{part} long, {before} long")
    found = placed.withColumn(part, which).join(F.broadcast(known), part)  # as many rows as ranges
    return found.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, before)
