"""Grouped metrics, agreement, correlation and set overlap as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import ranks, spearman  # noqa: F401


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def group_metrics(rows: DataFrame, *keys: str, support: str = "support", score: str = "constraint_score") -> DataFrame:
    """n, means and violation rate by keys; a null key is a group of its own."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(support).alias("mean_support"), F.avg(score).alias("mean_constraint"),
        F.avg((F.col(score) < 1).cast("double")).alias("violation_rate"),
        F.avg(((F.col(support) >= 0.8) & (F.col(score) < 1)).cast("double")).alias("divergence_rate"),
    )


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """All four cells of two boolean columns, empty ones too; rows with a null are left out."""
    cells = rows.sparkSession.sql("SELECT * FROM VALUES (false, false), (false, true), (true, false), (true, true) AS t(a, b)")
    n = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    return cells.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Counts, agreement, Cohen's kappa, precision, recall and F1 of a against b; kappa is null where chance is 1."""
    x, y = F.col(a), F.col(b)
    count = lambda c: F.count_if(c)
    n = rows.filter(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(count(x & y).alias("tp"), count(x & ~y).alias("fp"), count(~x & y).alias("fn"), count(~x & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (total * total)
    same = (tp + tn) / total
    return n.select(*keys, "tp", "fp", "fn", "tn", same.alias("agreement"), F.when(chance < 1, (same - chance) / (1 - chance)).alias("kappa"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def pearson(x: Column, y: Column) -> Column:
    """Null for a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def pearson_of(counts: DataFrame, keys: list[str], x: str, y: str, times: str) -> DataFrame:
    """keys, pearson: pearson() of the table in which each pair of counts(keys, x, y, times) stands `times` times. A row of
    means for each group is broadcast."""
    t, pairs = F.col(times), counts.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    means = pairs.groupBy(*keys).agg(varies.alias("varies"), *((F.sum(t * F.col(c)) / F.sum(t)).alias(m) for c, m in ((x, "mean_x"), (y, "mean_y"))))
    dx, dy = F.col(x) - F.col("mean_x"), F.col(y) - F.col("mean_y")
    xy, xx, yy = (F.sum(t * a * b) for a, b in ((dx, dy), (dx, dx), (dy, dy)))
    held = pairs.join(F.broadcast(means), keys).groupBy(*keys, "varies").agg(xy.alias("xy"), (F.sqrt(xx) * F.sqrt(yy)).alias("spread"))
    return held.select(*keys, F.when(F.col("varies"), F.col("xy") / F.nullif(F.col("spread"), F.lit(0.0))).alias("pearson"))


def fractional_rank(keys: list[str], value: str) -> Column:
    """Average rank of ties."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value)) - 1) / 2


def quadratic_kappa(rows: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """n, exact agreement and quadratically weighted kappa of two ratings from 0 below `levels`, from sums alone."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    known = rows.filter(x.isNotNull() & y.isNotNull() & x.between(0, levels - 1) & y.between(0, levels - 1))
    n = known.agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("exact"), *(F.avg(v).alias(k) for k, v in (("mx", x), ("my", y), ("mxx", x * x), ("myy", y * y), ("mxy", x * y))))
    seen = F.col("mxx") + F.col("myy") - 2 * F.col("mxy")
    chance = F.col("mxx") + F.col("myy") - 2 * F.col("mx") * F.col("my")
    return n.select("n", "exact", F.when(chance > 0, 1 - seen / chance).alias("kappa"))


def set_overlap(members: DataFrame, key: str, name: str, most: int = 64) -> DataFrame:
    """Jaccard of every two sets of keys; members: (key, name). Two empty sets are alike. Every key is reduced to the list of
    its names, and equal lists are counted, before any are paired; more than `most` names are refused."""
    known = [r[0] for r in members.select(name).distinct().orderBy(name).limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"more than {most} sets")
    lists = members.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names")).groupBy("names").agg(F.count("*").alias("n"))
    every = F.array(*map(F.lit, known)) if known else F.array().cast(f"array<{members.schema[name].dataType.simpleString()}>")
    pairs = lists.select("n", "names", F.explode(every).alias("a")).select("n", "names", "a", F.explode(every).alias("b"))
    in_a, in_b = F.array_contains("names", F.col("a")), F.array_contains("names", F.col("b"))
    out = pairs.groupBy("a", "b").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("n_both", in_a & in_b), ("n_union", in_a | in_b))))
    return out.select("a", "b", "n_both", "n_union", F.when(F.col("n_union") == 0, 1.0).otherwise(F.col("n_both") / F.nullif("n_union", F.lit(0))).alias("jaccard"))


def _items(c: str) -> Column:
    """A `;`-list as a set of lower-cased items."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), ";"), lambda x: F.trim(x)), lambda x: x != ""))


def field_agreement(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """field, n, exact (share of equal sets) and jaccard (mean overlap; two empty sets are alike) of two annotators' `;`-lists."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), _items(a).alias("a"), _items(b).alias("b")) for k, (a, b) in pairs.items()))).alias("x")).select("x.*")
    both, every = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    overlap = F.when(every == 0, 1.0).otherwise(both / F.nullif(every, F.lit(0)))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.avg((both == every).cast("double")).alias("exact"), F.avg(overlap).alias("jaccard"))


def set_prf(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Micro precision, recall and F1 of predicted against gold `;`-lists by category, and over all."""

    long = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("category"), _items(p).alias("p"), _items(g).alias("g")) for k, (p, g) in pairs.items()))).alias("x")).select("x.*")
    n = long.rollup("category").agg(F.sum(F.size(F.array_intersect("p", "g"))).alias("tp"), F.sum(F.size(F.array_except("p", "g"))).alias("fp"), F.sum(F.size(F.array_except("g", "p"))).alias("fn"))
    return n.select(F.coalesce("category", F.lit("overall")).alias("category"), "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
