"""Order statistics over saved ranges: numbers, fractional ranks, rank correlation and exact quantiles.

Rows are dealt into ranges once and written with the range that they lie in. Places, running totals and ranks are worked
out within ranges and from the sizes of the ranges before, all of it from the written table. So nothing
depends on both sides of a join drawing the same ranges again, whatever Spark reuses or plans anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: values of an interval that are counted one by one; an interval with more is split further
FEW = 4096
#: places at which an interval is split
CUTS = 255


def _ranged(rows: DataFrame, *order) -> DataFrame:
    """rows in ranges by the order, written with range_id and range_place (within the range, from 0)."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = scratch.keep(dealt, "ranges")
    return kept.withColumn("range_id", F.shiftrightunsigned("at", 33)).withColumn("range_place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def _before(sizes: DataFrame, size: str, *keys: str) -> DataFrame:
    """range_id and the sum of `size` over the ranges before it, within keys; a row for each range and key."""
    w = Window.partitionBy(*keys).orderBy("range_id") if keys else Window.partitionBy(F.lit(1)).orderBy("range_id")
    return sizes.withColumn("before", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)).drop(size)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows plus their place by the order of key, from 0."""
    placed = _ranged(rows, F.col(key))
    before = _before(placed.groupBy("range_id").agg(F.count("*").alias("n")), "n")
    return placed.join(before, "range_id").withColumn(name, F.col("before") + F.col("range_place")).drop("range_id", "range_place", "before")


def lesser(counts: DataFrame, keys: list[str], value: str, times: str) -> DataFrame:
    """counts(keys, value, times) plus `less`: how many rows of the group have a lesser value. A group of any size lies in as
    many ranges as it fills."""
    placed = _ranged(counts, *map(F.col, keys), F.col(value))
    sums = placed.groupBy(*keys, "range_id").agg(F.sum(times).alias("all_times"))
    inside = F.sum(times).over(Window.partitionBy(*keys, "range_id").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    before = _before(sums, "all_times", *keys).hint("merge")  # else placed may be broadcast, by the few bytes that its file takes
    held = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, [*keys, "range_id"])
    return held.select(*keys, value, times, (F.col("before") + F.col("inside")).alias("less"))


def value_ranks(counts: DataFrame, keys: list[str], value: str, times: str, out: str) -> DataFrame:
    """keys, value, out: the fractional rank of each distinct value within keys, from counts(keys, value, times)."""
    return lesser(counts, keys, value, times).select(*keys, value, (F.col("less") + (F.col(times) + 1) / 2).alias(out))


def ranks(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rows plus the fractional rank of `value` within keys; a group costs as many rows as it has different values."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("times"))
    return rows.join(value_ranks(counts, keys, value, "times", out), [*keys, value])


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho: rank correlation; null for a constant side. Works on counts of pairs of values, and ranks the values
    of each side alone."""
    return spearman_of(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("times")), keys, x, y)


def spearman_of(counts: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """spearman() of the table in which each pair of counts(keys, x, y, times) stands `times` times."""
    pairs = scratch.keep(counts, "pairs")
    for side in (x, y):
        counts = pairs.groupBy(*keys, side).agg(F.sum("times").alias("times"))
        pairs = pairs.join(value_ranks(counts, keys, side, "times", f"{side}_rank"), [*keys, side])
    n = pairs.groupBy(*keys).agg(F.sum("times").alias("n"))
    mean = (F.col("n") + 1) / 2
    pairs = pairs.join(n, keys).withColumns({"dx": F.col(f"{x}_rank") - mean, "dy": F.col(f"{y}_rank") - mean})
    xy, xx, yy = (F.sum(F.col("times") * F.col(a) * F.col(b)) for a, b in (("dx", "dy"), ("dx", "dx"), ("dy", "dy")))
    spread = F.sqrt(xx) * F.sqrt(yy)
    return pairs.groupBy(*keys, "n").agg(F.when(spread > 0, xy / F.nullif(spread, F.lit(0.0))).alias("rho"))


def order_statistics(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """wanted(keys, place) plus `found`: the value at this place (from 0) of its group's values in order, nulls and NaN left out.

    Selection by refinement of a histogram: each interval that holds a place is split at approximate quantiles, its parts are
    counted exactly, and the parts that hold its places are the next intervals. A row is read once for each interval that it
    lies in, however many places that holds; in the first pass that is one. Every pass is one scan with two
    small aggregates and leaves a hundredth of the values or less, or one value; of an interval of FEW values or fewer the
    counts of its values are ordered. So no task orders the values of a group, whatever its size and spread.
    """
    place, part = [*keys, "place"], [*keys, "under"]  # the values under an interval tell it from others of its group
    rows = _numbers(rows, keys, value)
    state = wanted.select(*place).distinct().withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf")), "under": F.lit(0).cast("long")})
    done = None
    while True:
        state = scratch.keep(state, "intervals")
        live = _inside(rows, keys, state.select(*part, "low", "high").distinct())
        cuts = F.percentile_approx("v", F.array(*(F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS))), F.lit(10_000))
        seen = scratch.keep(live.groupBy(*part).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.array_distinct(cuts).alias("cuts")), "splits")
        places = state.select(*part, "place")
        one = places.join(seen.filter("low = high"), part).select(*place, F.col("low").alias("found"))
        done = one if done is None else done.unionByName(one)
        done = done.unionByName(_among_few(rows, keys, places, seen.filter(f"low < high AND n <= {FEW}").select(*part, "low", "high")))
        many = seen.filter(f"low < high AND n > {FEW}")
        if many.isEmpty():
            return done
        state = _narrowed(rows, keys, places, many)


def _numbers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")


def _inside(rows: DataFrame, keys: list[str], intervals: DataFrame) -> DataFrame:
    return (rows.join(intervals, keys) if keys else rows.join(intervals, F.lit(True))).filter("v >= low AND v <= high")


def _among_few(rows: DataFrame, keys: list[str], places: DataFrame, few: DataFrame) -> DataFrame:
    part = [*keys, "under"]
    counts = _inside(rows, keys, few).groupBy(*part, "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*part).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # FEW values at most
    held = counts.withColumn("upto", upto + F.col("under")).join(places, part).filter("upto > place")
    return held.groupBy(*keys, "place").agg(F.min("v").alias("found"))


def _narrowed(rows: DataFrame, keys: list[str], places: DataFrame, many: DataFrame) -> DataFrame:
    """The part of each interval that holds the place: a value that is a cut is a part of its own."""
    part = [*keys, "under"]
    binned = _inside(rows, keys, many.select(*part, "low", "high", "cuts")).withColumn("below", F.lit(0))
    step = 1 << (CUTS.bit_length() - 1)
    while step:  # how many cuts are less, by halving; each step is a column, so none is worked out twice
        binned = binned.withColumn("below", F.col("below") + F.when(F.get("cuts", F.col("below") + (step - 1)) < F.col("v"), step).otherwise(0))
        step //= 2
    binned = binned.withColumn("bin", 2 * F.col("below") + F.coalesce((F.get("cuts", "below") == F.col("v")).cast("int"), F.lit(0)))
    sizes = scratch.keep(binned.groupBy(*part, "bin").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")), "bins")
    upto = F.sum("c").over(Window.partitionBy(*part).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # some 2 * CUTS parts
    held = sizes.withColumn("upto", upto + F.col("under")).join(places, part).filter("upto > place")
    first = held.groupBy(*keys, "place").agg(F.min(F.struct("bin", "low", "high", (F.col("upto") - F.col("c")).alias("under"))).alias("b"))
    return first.select(*keys, "place", "b.low", "b.high", "b.under")


def quantiles(rows: DataFrame, keys: list[str], value: str, at: DataFrame) -> DataFrame:
    """keys, p, quantile, n: linear interpolation between order statistics, as percentile() has it, for each row of
    at(keys, p); groups without a value are left out."""
    n = _numbers(rows, keys, value).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 0")
    asked = (at.join(n, keys) if keys else at.join(n, F.lit(True))).withColumn("h", (F.col("n") - 1) * F.col("p"))
    asked = scratch.keep(asked.withColumns({"low_place": F.floor("h"), "high_place": F.ceil("h")}), "asked")
    wanted = asked.select(*keys, F.explode(F.array("low_place", "high_place")).alias("place"))
    found = scratch.keep(order_statistics(rows, keys, value, wanted), "order-statistics")
    for end in ("low", "high"):
        asked = asked.join(found.select(*keys, F.col("place").alias(f"{end}_place"), F.col("found").alias(end)), [*keys, f"{end}_place"])
    return asked.select(*keys, "p", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))).alias("quantile"), "n")


def quantiles_of(counts: DataFrame, keys: list[str], value: str, times: str, at: DataFrame) -> DataFrame:
    """quantiles() of the table in which each row of counts(keys, value, times) stands `times` times. at, a few shares for
    each group, is broadcast."""
    v = F.col(value).cast("double")
    values = counts.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("v")).agg(F.sum(times).alias("times"))
    spans = scratch.keep(lesser(values, keys, "v", "times"), "spans")
    n = spans.groupBy(*keys).agg(F.sum("times").alias("n"))
    asked = at.join(n, keys).withColumn("h", (F.col("n") - 1) * F.col("p"))
    held = spans.join(F.broadcast(asked), keys)
    low, high = ((F.col("less") <= place) & (place < F.col("less") + F.col("times")) for place in (F.floor("h"), F.ceil("h")))
    ends = held.filter(low | high).groupBy(*keys, "p", "n", "h").agg(F.min(F.when(low, F.col("v"))).alias("low"), F.min(F.when(high, F.col("v"))).alias("high"))
    return ends.select(*keys, "p", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))).alias("quantile"), "n")


def shares(p: list[float], rows: DataFrame) -> DataFrame:
    """A table p of the given shares, for quantiles() without keys."""
    return rows.sparkSession.createDataFrame([(float(x),) for x in p], "p double")


def share_passing(c: Column, least: float) -> Column:
    return F.avg((c >= least).cast("double"))
