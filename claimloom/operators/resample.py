"""Bootstrap on sufficient statistics, with Poisson weights that any engine can repeat.

Rows are reduced to one row of sums for each cluster before anything is drawn. The weight of a cluster in a replicate is
Poisson with mean 1, from a hash of both, so clusters are neither numbered nor joined: each task weighs its own clusters
in matrices and adds them up, so what is shuffled is a row for each task and replicate, however many the clusters are. A row bootstrap is one in which each row is a cluster. Statistics that are
no sums (rank correlation, quantiles) go through little_bootstraps().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import order

#: 2^32 times the chances of at most 0, 1, 2, ... of a Poisson variable of mean 1
STEPS = tuple(math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))
#: replicates of a study
REPS = 5000
_GOLD, _MIX = 2654435761, 73244475


def cluster_id(*names: str) -> Column:
    """The first of the columns that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names))


def weighted(rows: DataFrame) -> DataFrame:
    """rows(hash, rep, ...) plus `weight`; hash: 32 bits of the cluster's. Each step is a column, so none is worked out twice."""
    rows = rows.withColumn("mixed", (F.col("hash") + F.col("rep") * F.lit(_GOLD)).bitwiseAND(F.lit(2**32 - 1)))
    for factor in (_MIX, _MIX, 1):
        x = F.col("mixed")
        rows = rows.withColumn("mixed", (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(factor)).bitwiseAND(F.lit(2**32 - 1)))
    x = F.col("mixed")
    drawn = F.lit(len(STEPS))
    for k in range(len(STEPS) - 1, -1, -1):  # most are below the first steps
        drawn = F.when(x < STEPS[k], k).otherwise(drawn)
    return rows.withColumn("weight", drawn).drop("mixed")


def intervals(rows: DataFrame, cluster: str, sums: dict[str, Column], statistics: dict[str, Column], reps: int = REPS, keys: tuple = (), level: float = 0.95) -> DataFrame:
    """For each value of the keys and each statistic, an expression over the sums: itself, and with _low and _high the
    percentile interval over the replicates. Null clusters are left out."""
    per = rows.filter(F.col(cluster).isNotNull()).groupBy(*keys, cluster).agg(*(c.alias(k) for k, c in sums.items()))
    hashed = per.select(*keys, F.conv(F.substring(F.md5(F.col(cluster).cast("string")), 1, 8), 16, 10).cast("long").alias("hash"), *(F.col(k).cast("double").alias(k) for k in sums))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.select(*keys).schema] + ["rep long"] + [f"`{k}` double" for k in sums]
    drawn_sums = hashed.mapInArrow(_replicates(len(keys), list(sums), reps), ", ".join(fields))
    again = drawn_sums.groupBy(*keys, "rep").agg(*(F.sum(k).alias(k) for k in sums)).select(*keys, *(s.alias(n) for n, s in statistics.items()))
    ends = {"_low": (1 - level) / 2, "_high": (1 + level) / 2}
    ci = again.groupBy(*keys).agg(*(F.percentile(n, F.lit(q)).alias(n + end) for n in statistics for end, q in ends.items()))
    point = per.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in sums)).select(*keys, *(s.alias(n) for n, s in statistics.items()))
    return point.join(ci, list(keys)) if keys else point.join(ci, F.lit(True))  # one row each without keys


def _replicates(n_keys: int, names: list[str], reps: int, at_once: int = 256, most: int = 64):
    """Sums of the weighted clusters of a task, by keys and replicate; of `most` keys at once, so that memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        every, steps = np.arange(reps, dtype=np.int64)[None, :], poisson_steps(1)
        kinds: list[pa.DataType] = []

        def emit() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                columns = [pa.array([k] * reps, t) for k, t in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(every[0]), *(pa.array(c) for c in total.T)], names=[*fields, "rep", *names])
            held.clear()

        for b in batches:
            fields, kinds = b.schema.names[:n_keys], b.schema.types[:n_keys]
            hashes = b.column(n_keys).to_numpy()
            values = np.stack([np.nan_to_num(b.column(n_keys + 1 + i).to_numpy(zero_copy_only=False)) for i in range(len(names))], axis=1)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in range(n_keys)), strict=True) if n_keys else [()] * b.num_rows):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                if key not in held and len(held) >= most:
                    yield from emit()
                total = held.setdefault(key, np.zeros((reps, len(names))))
                for i in range(0, len(rows), at_once):
                    part = rows[i : i + at_once]
                    total += drawn(hashes[part][:, None], every, steps).T @ values[part]
        yield from emit()

    return run


def interval(rows: DataFrame, cluster: str, sums: dict[str, Column], statistic: Column, reps: int = REPS) -> DataFrame:
    """point, ci_low, ci_high of one statistic."""
    return intervals(rows, cluster, sums, {"point": statistic}, reps).select("point", F.col("point_low").alias("ci_low"), F.col("point_high").alias("ci_high"))


def kappa_of(tp: str, fp: str, fn: str, tn: str) -> Column:
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    n = a + b + c + d
    chance = ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    return F.when(chance < 1, ((a + d) / n - chance) / (1 - chance))


def pearson_sums(x: Column, y: Column) -> dict[str, Column]:
    return {"n": F.count("*").cast("double"), **{k: F.sum(v.cast("double")) for k, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))}}


def pearson_of() -> Column:
    """Over pearson_sums; null for a constant side."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(spread > 0, (n * sxy - sx * sy) / F.sqrt(spread))


# Statistics that are no sums


def poisson_steps(mean: float) -> np.ndarray:
    """2^32 times the chances of at most 0, 1, 2, ... of a Poisson variable; STEPS for a mean of 1."""
    if mean == 1:
        return np.array(STEPS, np.int64)
    chance, total, k, out = math.exp(-mean), 0.0, 0, []
    while k < mean + 12 * math.sqrt(mean) + 12:
        total += chance
        out.append(math.floor(2**32 * min(1.0, total)))
        k += 1
        chance *= mean / k
    return np.array(out, np.int64)


def drawn(hashes: np.ndarray, rep: int | np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Weights of rows in a replicate, as weighted() draws them."""
    x = (hashes + rep * _GOLD) & (2**32 - 1)
    for factor in (_MIX, _MIX, 1):
        x = ((x ^ (x >> 16)) * factor) & (2**32 - 1)
    return np.searchsorted(steps, x, side="right")


def weighted_pearson(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    n = w.sum()
    dx, dy = x - (w * x).sum() / n, y - (w * y).sum() / n
    spread = math.sqrt((w * dx * dx).sum()) * math.sqrt((w * dy * dy).sum())
    return float((w * dx * dy).sum() / spread) if spread > 0 else math.nan


def weighted_rank(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Fractional ranks in the table in which each row stands w times."""
    _, place = np.unique(x, return_inverse=True)
    times = np.bincount(place, w)
    return (np.cumsum(times) - times + (times + 1) / 2)[place]


def weighted_spearman(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return weighted_pearson(weighted_rank(x, w), weighted_rank(y, w), w)


def median_gap(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Difference of the weighted medians of both sides."""

    def median(v: np.ndarray) -> float:
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(w[order])
        low, high = (np.searchsorted(upto, q, side="right") for q in ((upto[-1] - 1) // 2, upto[-1] // 2))
        return float(v[order][low] + v[order][high]) / 2

    return median(x) - median(y)


def spearman_interval(rows: DataFrame, key: str, x: str, y: str, reps: int = 1000, level: float = 0.95) -> DataFrame:
    """point, ci_low, ci_high, n: rank correlation with the percentile interval of the plain bootstrap over all rows, whatever
    their number. The weights of a replicate are added up by pair of values, and all replicates are ranked over ranges at
    once, as groups of one table; replicate -1 is the table itself. Rows with a null are left out."""
    known = rows.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    # rows of a value lie together, so that a task adds up most of their weights before they are shuffled
    hashed = known.select(F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long").alias("hash"), "x", "y")
    hashed = hashed.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y", "hash")
    each = weighted(hashed.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(reps - 1)))))
    times = F.when(F.col("rep") < 0, 1).otherwise(F.col("weight"))
    counts = each.select("rep", "x", "y", times.cast("long").alias("times")).filter("times > 0").groupBy("rep", "x", "y").agg(F.sum("times").alias("times"))
    rho = scratch.keep(order.spearman_of(counts, ["rep"], "x", "y"), "replicates")
    again, one = rho.filter("rep >= 0"), rho.filter("rep < 0").select(F.col("rho").alias("point"), "n")
    ends = again.agg(*(F.percentile("rho", F.lit(q)).alias(n) for n, q in (("ci_low", (1 - level) / 2), ("ci_high", (1 + level) / 2))))
    n = one.agg(F.first("point").alias("point"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return n.join(ends, F.lit(True)).select("point", "ci_low", "ci_high", "n")  # one row each


def little_bootstraps(rows: DataFrame, key: str, x: str, y: str, statistic=weighted_spearman, reps: int = 1000, bag_rows: int = 20_000, level: float = 0.95) -> DataFrame:
    """point, ci_low, ci_high, n, bags: a percentile interval of any statistic(x, y, weights) by the bag of little bootstraps.

    Rows are dealt by hash of their key into bags of about bag_rows, every row into one. A replicate of a bag stands for a
    table as large as the whole: a row's weight is Poisson with the mean n / (rows of a bag), from a hash of key and
    replicate. Ends of the intervals, and points, are averaged over the bags. One bag is the plain bootstrap. A task holds
    one bag, however large the table, and replicates never leave it. Rows with a null are left out."""
    known = rows.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    n = known.count()
    bags = max(1, -(-n // bag_rows))
    hashed = known.withColumn("hash", F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long"))
    dealt = hashed.withColumn("bag", F.pmod(F.xxhash64("key"), F.lit(bags)))

    def bag(rows: pd.DataFrame) -> pd.DataFrame:
        h, a, b = (rows[c].to_numpy() for c in ("hash", "x", "y"))
        steps, again = poisson_steps(n / len(h) if bags > 1 else 1), []
        for rep in range(reps):
            w = drawn(h, rep, steps)
            here = w > 0
            v = statistic(a[here], b[here], w[here]) if here.any() else math.nan
            if not math.isnan(v):
                again.append(v)
        low, high = np.quantile(again, [(1 - level) / 2, (1 + level) / 2]) if again else (math.nan, math.nan)
        return pd.DataFrame({"point": [statistic(a, b, np.ones(len(h), np.int64))], "ci_low": [low], "ci_high": [high], "n": [len(h)]})

    each = dealt.select("bag", "hash", "x", "y").groupBy("bag").applyInPandas(bag, "point double, ci_low double, ci_high double, n long")
    return each.agg(*(F.avg(F.nanvl(c, F.lit(None))).alias(c) for c in ("point", "ci_low", "ci_high")), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("bags"))
