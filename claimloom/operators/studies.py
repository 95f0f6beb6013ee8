"""Composite studies: canonical manifest and its validation, ablations, threshold grids, estimators, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..sources import scratch
from . import metrics as M
from . import order as O
from . import resample as B
from . import selection as D
from .claims import with_claims
from .rules import strict_violations, violations


def _array(names) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def ablation_variants(found: Column, strict: Column, family: Column) -> dict[str, Column]:
    """For each variant the names of the rules broken; null where the variant leaves the record out."""

    def of(test) -> Column:
        return _array([k for k, v in L.RULES.items() if test(v)])

    made = (
        found, F.array_intersect(found, of(lambda v: v[0] == "L0")), F.array_intersect(found, of(lambda v: v[0] == "L1")),
        F.array_except(found, of(lambda v: v[1] == "formation_energy")), F.array_except(found, of(lambda v: v[1] == "band_gap")),
        F.array_union(found, strict), F.when(family != "formation_energy", found), F.when(family != "band_gap", found),
    )
    return dict(zip(L.ABLATIONS, made, strict=True))


def ablation(rows: DataFrame, judge: str | None = None) -> DataFrame:
    """variant, n, n_bad and, with a column of judgements, agreement and kappa. rows: of with_claims, with `violations`."""
    variants = ablation_variants(F.col("violations"), strict_violations(F.col("question")), F.col("constraint_family"))
    said = F.col(judge) if judge else F.lit(None).cast("boolean")
    long = rows.select(said.alias("b"), F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), (F.size(v) > 0).alias("a"), v.isNotNull().alias("held")) for k, v in variants.items()))).alias("x")).select("b", "x.*").filter("held")
    out = long.groupBy("variant").agg(F.count("*").alias("n"), F.count_if("a").alias("n_bad"))
    return out.join(M.agreement(long, "a", "b", "variant").select("variant", "agreement", "kappa"), "variant") if judge else out


def guard_sweep(rows: DataFrame, guards: dict[str, dict] = L.GUARDS) -> DataFrame:
    """variant, n, n_bad of rows of with_claims: all sets of thresholds are tried within the row, and only whether each
    breaks a rule is counted."""
    sets = F.array(*(F.struct(F.lit(name).alias("variant"), *(F.lit(v).alias(k) for k, v in {**L.THRESHOLDS, **g}.items())) for name, g in guards.items()))
    tried = F.transform(sets, lambda t: F.struct(t["variant"].alias("variant"), (F.size(violations({k: t[k] for k in L.THRESHOLDS})) > 0).alias("bad")))
    return rows.select(F.explode(tried).alias("x")).groupBy("x.variant").agg(F.count("*").alias("n"), F.count_if("x.bad").alias("n_bad"))


def threshold_grid(rows: DataFrame, support: str, score: str, cluster: str, reps: int = B.REPS) -> DataFrame:
    """For each pair of thresholds the cases of high support, of low score and of both, their rate over all and among
    those of high support, and intervals of both over clusters. Rows are counted by cluster and values once, and the counts
    written; all cells read those."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("tau_f"), F.lit(g).alias("tau_g")) for f in L.TAU_F for g in L.TAU_G)))
    held = scratch.keep(rows.groupBy(cluster, support, score).agg(F.count("*").alias("k")), "grid")
    per = held.select(cluster, support, score, "k", cells.alias("cell")).select("*", "cell.*")
    high, low = F.col(support) >= F.col("tau_f"), F.col(score) < F.col("tau_g")
    sums = {"n": F.sum("k"), "n_high": F.sum(F.when(high, F.col("k")).otherwise(0)), "n_low": F.sum(F.when(low, F.col("k")).otherwise(0)), "n_divergent": F.sum(F.when(high & low, F.col("k")).otherwise(0))}
    stats = {"rate": M.ratio(F.col("n_divergent"), F.col("n")), "risk": M.ratio(F.col("n_divergent"), F.col("n_high"))}
    counts = per.groupBy("tau_f", "tau_g").agg(*(c.alias(k) for k, c in sums.items()))
    return counts.join(B.intervals(per, cluster, sums, stats, reps, ("tau_f", "tau_g")), ["tau_f", "tau_g"])


def matched_threshold(rows: DataFrame, value: str, reference: str, fixed: float = 0.8) -> DataFrame:
    """threshold, rate: the threshold of value that as large a share passes as passes the reference at the fixed one."""
    rate = rows.agg(O.share_passing(F.col(reference), fixed).alias("rate"))
    found = O.quantiles(rows, [], value, rate.select((1 - F.col("rate")).alias("p"))).select("p", F.col("quantile").alias("threshold"))
    return found.select("threshold", (1 - F.col("p")).alias("rate"))


def estimator_robustness(
    rows: DataFrame, reference: str, key: str = "estimator", value: str = "support", score: str = "constraint_score", fixed: float = 0.8, times: str | None = None
) -> DataFrame:
    """For each estimator: mean, correlation with the score, cases and divergent cases at the fixed threshold and at the one
    that passes as large a share as the reference does at the fixed one. times: the column that says how many rows a row
    stands for. All but one pass is over counts of equal values. What is broadcast is named, a row for each estimator: by the size of
    its file Spark would take a table of many equal rows."""
    counts = rows.groupBy(key, value, score).agg((F.sum(times) if times else F.count("*")).alias("times"))
    counts = scratch.keep(counts, "estimators")
    v, bad = F.col(value), F.col(score) < 1

    def number(which: Column) -> Column:
        return F.sum(F.when(which, F.col("times")).otherwise(0))

    rate = counts.filter(F.col(key) == reference).agg(M.ratio(number(v >= fixed), number(v.isNotNull())).alias("rate"))
    at = counts.select(key).distinct().join(rate, F.lit(True)).select(key, (1 - F.col("rate")).alias("p"))  # a name each, one rate
    matched = O.quantiles_of(counts, [key], value, "times", at).select(key, F.col("quantile").alias("threshold"))
    own = counts.join(F.broadcast(matched), key)
    out = own.groupBy(key).agg(
        F.sum("times").alias("n"), M.ratio(F.sum(v * F.col("times")), number(v.isNotNull())).alias("mean"), number(v >= fixed).alias("n_fixed"), number((v >= fixed) & bad).alias("n_fixed_divergent"),
        F.first("threshold").alias("threshold"), number(v >= F.col("threshold")).alias("n_matched"), number((v >= F.col("threshold")) & bad).alias("n_matched_divergent"),
    )
    return out.join(F.broadcast(M.pearson_of(counts, [key], value, score, "times")), key)


def mode_comparison(rows: DataFrame, *keys: str, support: str = "support", score: str = "constraint_score") -> DataFrame:
    """Metrics by model and mode, correlations of support and score included."""
    means = M.group_metrics(rows, *keys, support=support, score=score)
    linear = rows.groupBy(*keys).agg(M.pearson(F.col(support), F.col(score)).alias("pearson"))
    both = linear.join(O.spearman(rows, list(keys), support, score).select(*keys, F.col("rho").alias("spearman")), list(keys))
    return means.join(both, list(keys))


def canonical_manifest(records: DataFrame, spec: Column, cap: int = 500) -> DataFrame:
    """records plus source, role, model and mode of their source (spec: its place in the list), whether they are in the
    primary split (`cap` a family, first roles first), in the judges' pool, and in its stratified samples."""
    sources = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("source_dataset", "dataset_role", "model", "mode", "pooled"), s, strict=True))) for s in L.SOURCE_SPECS))
    rows = records.drop("model").withColumn("spec", F.element_at(sources, (spec + 1).cast("int"))).select("*", "spec.*").drop("spec")
    order = [(F.col("dataset_role") != r).cast("int").alias(f"late_{i}") for i, r in enumerate(L.FIRST_ROLES)]
    slim = rows.select("response_id", *L.STRATA, "pooled", *order)
    primary = D.capped(slim, "constraint_family", cap, *(f"late_{i}" for i in range(len(order))), "source_dataset", "model", "mode", "response_id")
    pool = primary.filter("pooled").withColumn("stratum", F.concat_ws("|", *L.STRATA))  # at most cap rows a family
    marks = primary.select("response_id", F.lit(True).alias("in_primary"), F.col("pooled").alias("in_pool"))
    for name, n in L.SAMPLES.items():
        drawn = D.stratified(pool.select("response_id", "stratum"), "stratum", "response_id", 1, n, seed=n)
        marks = marks.join(drawn.select("response_id", F.lit(True).alias(f"in_{name}")), "response_id", "left")
    flags = ["in_primary", "in_pool", *(f"in_{n}" for n in L.SAMPLES)]
    out = rows.join(marks, "response_id", "left")
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}).drop("pooled")


def validate_manifest(rows: DataFrame, family_share: float = 0.2, families: int = 8, tasks: int = 1000, natural: int = 400) -> DataFrame:
    """check, ok, found: sizes of the samples, subsets, and the primary split's balance. rows: of canonical_manifest."""
    primary = rows.filter("in_primary")
    top = primary.groupBy("constraint_family").agg(F.count("*").alias("k")).agg(F.max("k").alias("most"), F.count("*").alias("kinds"))
    counts = primary.agg(F.count("*").alias("n"), F.countDistinct("base_task_id").alias("tasks"), F.count_if(F.col("dataset_role") == L.FIRST_ROLES[0]).alias("natural"))
    every = rows.agg(
        *(F.count_if(f"in_{n}").alias(f"size_{n}") for n in L.SAMPLES), F.count_if(F.expr("in_pool AND NOT in_primary")).alias("outside_primary"),
        F.count_if(F.expr(" OR ".join(f"in_{n}" for n in L.SAMPLES)) & ~F.col("in_pool")).alias("outside_pool"),
    )
    one = counts.join(top, F.lit(True)).join(every, F.lit(True))  # one row each
    checks = {f"size_{n}": (F.col(f"size_{n}") == k, F.col(f"size_{n}")) for n, k in L.SAMPLES.items()}
    checks |= {"pool_within_primary": (F.col("outside_primary") == 0, F.col("outside_primary")), "samples_within_pool": (F.col("outside_pool") == 0, F.col("outside_pool"))}
    checks |= {"largest_family": (F.col("most") <= family_share * F.col("n"), F.col("most")), "families": (F.col("kinds") >= families, F.col("kinds"))}
    checks |= {"base_tasks": (F.col("tasks") >= tasks, F.col("tasks")), "natural_records": (F.col("natural") >= natural, F.col("natural"))}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), ok.alias("ok"), v.cast("long").alias("found")) for k, (ok, v) in checks.items()))).alias("x")).select("x.*")


#: target rule, question, context that breaks it, context that does not; {m} material, {x} number
PROBES = (
    ("non_negative_band_gap", "What is the band gap of {m}?", "One calculation lists the band gap of {m} as -{x} eV.", "One calculation lists the band gap of {m} as {x} eV."),
    ("non_negative_absolute_temperature", "At what temperature was {m} measured?", "The cell with {m} was held at -{x} K.", "The cell with {m} was held at {x} K."),
    ("non_negative_pressure", "What pressure did {m} see?", "The press brought {m} to a pressure of -{x} GPa.", "The press brought {m} to a pressure of {x} GPa."),
    ("cautious_superconductivity_claim", "Does {m} superconduct?", "{m} is superconducting.", "{m} is superconducting with a measured transition temperature of {x} K."),
    ("cautious_stability_claim", "Is {m} stable?", "{m} is stable.", "{m} is stable, as its energy above hull shows."),
)
MATERIALS = ("GaAs", "TiO2", "SiC", "MgO", "ZnS", "NaCl", "CdTe")


def probes(spark, n: int = 15) -> DataFrame:
    """probe_id, constraint, kind, status, question, answer: `n` records that break each target rule and `n` that do not.
    Placeholders are filled by hash of rule, kind and number; twice as many are tried, and one counts only if the rules say
    so; statuses go round."""
    specs = spark.createDataFrame([(i, *p) for i, p in enumerate(PROBES)], "spec int, constraint string, ask string, broken string, clean string")
    tried = specs.join(spark.range(2 * n).withColumnRenamed("id", "i"), F.lit(True))  # a few specs, 2n tries each
    tried = tried.select("spec", "constraint", "i", "ask", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in (("violation", "broken"), ("clean", "clean"))))).alias("x")).select("*", "x.*")

    def choice(slot: str, size: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", "constraint", "kind", F.col("i").cast("string"), F.lit(slot))), 1, 8), 16, 10).cast("long") % size

    m, x = F.element_at(_array(MATERIALS), (choice("m", len(MATERIALS)) + 1).cast("int")), (choice("x", 9) + 1).cast("string")
    filled = {c: F.replace(F.replace(F.col(t), F.lit("{m}"), m), F.lit("{x}"), x) for c, t in (("question", "ask"), ("answer", "text"))}
    rows = with_claims(tried.withColumns(filled)).withColumn("hit", F.array_contains(violations(), F.col("constraint")))
    good = rows.filter(F.col("hit") == (F.col("kind") == "violation"))
    at = good.withColumn("nth", F.row_number().over(Window.partitionBy("constraint", "kind").orderBy("i"))).filter(F.col("nth") <= n)  # at most 2n rows
    status = F.element_at(_array(L.STATUSES[:3]), ((F.col("nth") - 1) % 3 + 1).cast("int"))
    return at.select(F.concat_ws("-", "constraint", "kind", F.col("nth").cast("string")).alias("probe_id"), "constraint", "kind", status.alias("document_status"), "question", "answer")


def probes_for(rows: DataFrame, key: str) -> DataFrame:
    """key, constraint, kind, question, answer, hit: a probe for each row, whose number picks the rule, whether it is to be
    broken, and what fills the placeholders; hit tells whether the rules say that it is broken."""
    k = F.col(key).cast("long")
    specs = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("constraint", "ask", "broken", "clean"), p, strict=True))) for p in PROBES))
    spec = F.element_at(specs, (k % len(PROBES) + 1).cast("int"))
    kind = F.when(F.floor(k / len(PROBES)) % 2 == 0, "violation").otherwise("clean")
    m, x = F.element_at(_array(MATERIALS), (k % len(MATERIALS) + 1).cast("int")), (k % 9 + 1).cast("string")
    fill = lambda t: F.replace(F.replace(t, F.lit("{m}"), m), F.lit("{x}"), x)
    tried = rows.select(key, spec.alias("spec"), kind.alias("kind"))
    tried = tried.select(key, F.col("spec.constraint").alias("constraint"), "kind", fill(F.col("spec.ask")).alias("question"), fill(F.when(F.col("kind") == "violation", F.col("spec.broken")).otherwise(F.col("spec.clean"))).alias("answer"))
    return with_claims(tried).select(key, "constraint", "kind", "question", "answer", F.array_contains(violations(), F.col("constraint")).alias("hit"))
