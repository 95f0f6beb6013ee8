"""The consistency rules as predicates over claims. Thresholds are columns, so a sweep is a join with variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.spans import any_in, spans
from .claims import IR, formula_valid, with_claims


def default_thresholds() -> dict[str, Column]:
    return {k: F.lit(v) for k, v in L.THRESHOLDS.items()}


def columns() -> dict[str, Column]:
    return {k: F.col(v) for k, v in IR.items()}


def violations(t: dict[str, Column] | None = None) -> Column:
    """Sorted names of the rules that the answer breaks, from the columns of with_claims."""
    t, ir = t or default_thresholds(), columns()
    claims = ir["claims"]

    def some(test, *kinds: str) -> Column:
        return F.exists(claims, lambda c: c["kind"].isin(*kinds) & ~c["rejected"] & test(c))

    asserted = F.exists(claims, lambda c: (c["kind"] == "stable") & ~c["other_stability"]) & ~ir["negates_stability"]
    stands = F.exists(claims, lambda c: (c["kind"] == "stable") & ~c["rejected"])
    qualified = F.exists(claims, lambda c: (c["kind"] == "energy") & (c["value"] > 0) & c["phase_qualified"])
    wrong_system = F.lit(False)
    for system, numbers in L.CRYSTAL_SYSTEMS.items():
        wrong_system = wrong_system | (F.array_contains(ir["systems"], system) & some(_outside(tuple(numbers)), "space_group"))
    found = {
        "non_negative_band_gap": some(lambda c: c["value"] < 0, "gap", "bare_gap"),
        "band_gap_physical_range": some(lambda c: c["value"] > t["gap_upper"], "gap", "bare_gap"),
        "formation_energy_typical_range": some(lambda c: (c["value"] < t["energy_lower"]) | (c["value"] > t["energy_upper"]), "energy", "bare_energy"),
        "non_negative_absolute_temperature": some(lambda c: c["value"] < 0, "kelvin"),
        "non_negative_pressure": some(lambda c: (c["value"] < 0) & ~c["sign_convention"], "pressure"),
        "valid_chemical_symbols": some(lambda c: ~c["formula_valid"], "formula"),
        "cautious_stability_claim": asserted & stands & ~ir["stability_evidence"],
        "positive_formation_energy_stability_conflict": asserted & stands & some(lambda c: c["value"] > 0, "energy") & ~qualified,
        "conductivity_band_gap_consistency": (ir["metal"] & some(lambda c: c["value"] > t["conductivity_gap"], "gap")) | (ir["insulator"] & some(lambda c: c["value"] < t["conductivity_gap"], "gap")),
        "crystal_system_space_group_consistency": wrong_system,
        "cautious_superconductivity_claim": some(lambda c: ~c["evidence"], "superconducts"),
        "elemental_formation_energy_reference_conflict": ir["element"].isNotNull() & some(lambda c: (c["value"] > t["elemental"]) & ~c["phase_qualified"], "bare_energy"),
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in found.items()))))


def _outside(numbers: tuple):
    def test(c: Column) -> Column:
        return c["value"].between(1, 230) & ~c["value"].isin(*map(float, numbers))

    return test


def score_rows(rows: DataFrame, question: str | None = "question", answer: str = "answer", since: Column | None = None) -> DataFrame:
    """rows plus `violations` and `constraint_score` (1.0 without any, else 0.0); since: as in with_claims."""
    df = with_claims(rows.drop(*IR.values()), question, answer, since).withColumn("violations", violations()).drop(*IR.values())
    return df.withColumn("constraint_score", F.when(F.size("violations") == 0, 1.0).otherwise(0.0))


def _values(text: Column, pattern: str) -> Column:
    return F.transform(spans(text, pattern, 1), lambda s: s["value"].try_cast("double"))


def chemistry_violations(answer: Column) -> Column:
    """The second family; any of a few words anywhere in the answer rejects all."""
    a = F.coalesce(answer, F.lit(""))
    found = {
        "valid_molecular_formula": F.exists(F.regexp_extract_all(a, F.lit(L.FORMULA), F.lit(0)), lambda f: ~formula_valid(f)),
        "non_negative_absolute_temperature": F.exists(_values(a, L.KELVIN), lambda v: v < 0),
        "aqueous_ph_range": F.exists(_values(a, L.PH), lambda v: (v < 0) | (v > 14)),
        "yield_percentage_range": F.exists(_values(a, L.YIELD), lambda v: (v < 0) | (v > 100)),
        "non_negative_pressure": F.exists(_values(a, L.CHEMISTRY_PRESSURE), lambda v: v < 0),
    }
    rejects = any_in(F.lower(a), L.CHEMISTRY_REJECTIONS)
    return F.when(rejects, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in found.items())))))


def strict_violations(question: Column) -> Column:
    """Numeric rules without any exception, for ablation."""
    claims, t = F.col(IR["claims"]), default_thresholds()
    gap_asked = F.contains(F.lower(F.coalesce(question, F.lit(""))), F.lit("band gap"))

    def some(test, *kinds: str) -> Column:
        return F.exists(claims, lambda c: c["kind"].isin(*kinds) & test(c))

    found = {
        "non_negative_band_gap": some(lambda c: c["value"] < 0, "gap") | (gap_asked & some(lambda c: c["value"] < 0, "bare_gap")),
        "band_gap_physical_range": some(lambda c: c["value"] > t["gap_upper"], "gap") | (gap_asked & some(lambda c: c["value"] > t["gap_upper"], "bare_gap")),
        "formation_energy_typical_range": some(lambda c: (c["value"] < t["energy_lower"]) | (c["value"] > t["energy_upper"]), "energy", "bare_energy"),
        "non_negative_absolute_temperature": some(lambda c: c["value"] < 0, "kelvin"),
        "non_negative_pressure": some(lambda c: c["value"] < 0, "pressure"),
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in found.items()))))


def rule_table(spark) -> DataFrame:
    """rule, level, family: a dimension of a dozen rows."""
    return spark.createDataFrame([(k, *v) for k, v in L.RULES.items()], "rule string, level string, family string")
