"""Dedupe, splits, samples, pairing and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..sources import scratch
from .order import numbered


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, the first in the order: a least struct, which is aggregated before the shuffle, so a key of a
    third of all rows costs a row a task."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest))
    return rows.groupBy(*keys).agg(best.alias("first_row")).select(*(F.col(c) if c in keys else F.col(f"first_row.{c}").alias(c) for c in rows.columns))


def capped(rows: DataFrame, key: str, cap: int, *order, parts: int = 64) -> DataFrame:
    """At most `cap` rows for each key, none for a key that is null or 'none'. The first `cap` are taken within parts of a
    key by hash, then among those, so a large key is spread."""
    known = rows.filter(F.col(key).isNotNull() & (F.col(key) != "none"))
    return _least(known, [key], cap, order, parts)


def _least(rows: DataFrame, keys: list[str], n: int, order, parts: int) -> DataFrame:
    """The first n rows of each key in the order, by way of the first n of each part of it."""
    part, rank = "part_of_key", "rank_in_key"
    salted = rows.withColumn(part, F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    for w in (Window.partitionBy(*keys, part).orderBy(*order), Window.partitionBy(*keys).orderBy(*order)):
        salted = salted.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return salted.drop(part, rank)


def hashed(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("||", F.col(key).cast("string"), F.lit(str(seed))))


def stratified(rows: DataFrame, stratum: str, key: str, each: int, total: int, seed: int = 42, parts: int = 0) -> DataFrame:
    """`each` rows of every stratum by hash, then the least by hash of the rest, up to `total`. Every task sends on `each`
    rows of a stratum (window group limit) and `total` rows for what fills up; nothing is sorted whole. parts: into how
    many a stratum is cut first, where even a task's `each` rows of it are too many for one."""
    order = (hashed(key, seed), F.col(key))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    first = _least(rows, [stratum], each, order, parts) if parts else rows.withColumn("late", nth).filter(F.col("late") <= each).drop("late")
    first = first.withColumn("late", F.lit(0))
    spare = rows.orderBy(*order).limit(total).withColumn("late", F.lit(1))
    least = first.unionByName(spare).groupBy(key).agg(F.min(F.struct("late", *(c for c in rows.columns if c != key))).alias("r"))
    out = least.select(*(F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns), F.col("r.late").alias("late"))
    return out.orderBy("late", *order).limit(total).drop("late")


def simple_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(hashed(key, seed), key).limit(n)


def paired(rows: DataFrame, key: str) -> DataFrame:
    """Each row beside itself (matched) and beside the one that mismatched() gives it."""
    same = rows.select(key, F.col(key).alias("other"), F.lit(True).alias("matched"))
    return same.unionByName(mismatched(rows, key).withColumn("matched", F.lit(False)))


def mismatched(rows: DataFrame, key: str) -> DataFrame:
    """Each row beside the one max(3, n / 3) places on, by the order of key, the last ones beside the first."""
    n = F.broadcast(rows.agg(F.count("*").alias("n")))  # one row
    i = scratch.keep(numbered(rows.select(key), key, "i"), "numbers")
    step = F.greatest(F.lit(3), F.floor(F.col("n") / 3))
    other = i.select(F.col(key).alias("other"), F.col("i").alias("j"))
    return i.join(n, F.lit(True)).withColumn("j", (F.col("i") + step) % F.col("n")).join(other, "j").select(key, "other")


def errors_of(text: list[str], status: str | None = None, scores: list[str] = ()) -> Column:
    """Names of what is wrong with a record: missing, blank, unknown status, score that is no number or out of range."""
    found = []
    for c in text:
        found.append(F.when(F.col(c).isNull(), F.lit(f"missing:{c}")).when(F.trim(F.col(c).cast("string")) == "", F.lit(f"blank:{c}")))
    if status:
        found.append(F.when(~F.col(status).isin(*L.STATUSES), F.lit(f"unknown:{status}")))
    for c in scores:
        number = F.col(c).cast("string").try_cast("double")
        found.append(F.when(F.col(c).isNotNull() & number.isNull(), F.lit(f"not_numeric:{c}")).when((number < 0) | (number > 1), F.lit(f"out_of_range:{c}")))
    return F.array_compact(F.array(*found))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def outside(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of the child that the parent lacks."""
    return child.select(key).distinct().join(parent.select(key), key, "left_anti")


def as_boolean(c: Column, unknown: str = "raise") -> Column:
    """Text to boolean: blank and 'none' are false; what is neither true nor false raises, or is false."""
    t = F.lower(F.trim(c.cast("string")))
    other = F.raise_error(F.concat(F.lit("no boolean: "), t)).cast("boolean") if unknown == "raise" else F.lit(False)
    return F.when(t.isNull() | t.isin("", "none", "nan", "null", "false", "0", "0.0", "no", "n"), False).when(t.isin("true", "1", "1.0", "yes", "y"), True).otherwise(other)


def first_missing(rows: DataFrame, file: str, at: str, required: list[str]) -> DataFrame:
    """For each file the number of rows that lack something required, and the first such row by `at`."""
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return rows.groupBy(file).agg(F.count_if(lacks).alias("n_missing"), F.min(F.when(lacks, F.col(at))).alias("first_missing"))


#: combinations that are broadcast to the rows that hold them, and characters of those
MOST_VALUES, MOST_CHARS = 100_000, 50_000_000


def by_value(rows: DataFrame, columns: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(rows), where what it adds to a row hangs on `columns` alone: it is done once for each combination of their values and
    written, and rows get it by a join. work keeps the columns, and all rows of what it is given. Where hardly a
    combination comes twice, the rows are worked on as they are."""
    spark = rows.sparkSession
    every, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*columns))).first()
    if every < 2 * kinds:
        return work(rows)
    values = rows.select(*columns).distinct()
    values = scratch.keep(values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns), "values")
    done = scratch.keep(work(values), "by-value")
    size = sum((F.length(F.col(c).cast("string")) for c in columns), F.lit(0))
    n, chars = done.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    names = {c: f"_by_{i}" for i, c in enumerate(columns)}
    there = done.select(*(F.col(c).alias(n) for c, n in names.items()), *(c for c in done.columns if c not in columns))
    there = F.broadcast(there) if n <= MOST_VALUES and chars <= MOST_CHARS else there
    same = [rows[c].eqNullSafe(there[n]) for c, n in names.items()]
    added = [c for c in done.columns if c not in columns]
    return rows.join(there, same).select(*(rows[c] for c in rows.columns if c not in added), *(there[c] for c in added))


def counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns, times: each combination of their values once, and written, with how many rows hold it. Where hardly a
    combination comes twice, the rows as they are, each counted as one."""
    spark = rows.sparkSession
    every, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*columns))).first()
    if every < 2 * kinds:
        return rows.select(*columns, F.lit(1).cast("long").alias("times"))
    values = rows.groupBy(*columns).agg(F.count("*").alias("times"))
    return scratch.keep(values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns), "values")
