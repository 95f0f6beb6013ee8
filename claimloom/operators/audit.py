"""Extraction sheets, item normalising, salient sentences, judge replies and the kinds of disagreement."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.spans import any_in
from ..sources.io import id_manifest
from .claims import formula_candidate


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def listed(values: Column) -> Column:
    """Trimmed, without blanks and repeats, in order, joined."""
    return F.array_join(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda v: v != "")), "; ")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sheet(answer: Column) -> dict[str, Column]:
    """Predicted columns of an extraction sheet; put empty gold columns beside them for annotators."""
    a = _text(answer)
    numeric = (L.BAND_GAP, L.EV_BAND_GAP, L.FORMATION_ENERGY, L.KELVIN, L.PRESSURE)
    units = [F.transform(_all(a, p), lambda m: F.regexp_extract(m, r"[0-9]\s*([^0-9]*)$", 1)) for p in numeric]
    formulae = listed(F.filter(_all(a, L.FORMULA), formula_candidate))
    return {
        "predicted_material": formulae,
        "predicted_formula": formulae,
        "predicted_value": listed(F.concat(*(_all(a, p, 1) for p in numeric))),
        "predicted_unit": listed(F.concat(*units)),
        "predicted_property": F.array_join(F.array_compact(F.array(*(F.when(a.rlike(p), F.lit(k)) for k, p in L.PROPERTIES.items()))), "; "),
        "predicted_phase": listed(_all(a, L.PHASE)),
        "predicted_method": listed(_all(a, L.METHOD)),
        "predicted_evidence": listed(_all(a, L.EVIDENCE)),
        "predicted_qualifier": listed(_all(a, L.QUALIFIER)),
    }


def item(category: str, value: Column) -> Column:
    """One item as it is compared: white space collapsed, lower case, numbers without trailing zeros, units by one name."""
    text = F.lower(F.trim(F.regexp_replace(_text(value), r"\s+", " ")))
    if category == "numeric_value":
        number = text.try_cast("decimal(38,18)").cast("string")
        return F.coalesce(F.regexp_replace(F.regexp_replace(number, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), text)
    if category == "unit":
        out = text
        for k, v in L.UNIT_SYNONYMS.items():
            out = F.when(text == k, F.lit(v)).otherwise(out)
        return out
    return text


def blank_columns(rows: DataFrame, predicted: list[str], prefix: str = "predicted_", to: str = "gold_") -> DataFrame:
    """rows plus an empty column for an annotator beside each predicted one."""
    return rows.withColumns({to + c.removeprefix(prefix): F.lit("") for c in predicted})


def completeness(rows: DataFrame, flag: str = "annotation_complete") -> DataFrame:
    """One row: how many annotations are not complete. Score only where that is none."""
    done = F.lower(F.trim(_text(F.col(flag).cast("string")))).isin("yes", "true", "1")
    return rows.agg(F.count("*").alias("n"), F.count_if(~done).alias("n_incomplete"))


def sentences(text: Column, least: int = 40) -> Column:
    flat = F.trim(F.regexp_replace(_text(text), r"\s+", " "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+", -1), lambda x: F.trim(x)), lambda s: F.length(s) >= least)


def salient(text: Column) -> Column:
    """The first sentence with a term of interest, else the first, else the text's beginning."""
    found = sentences(text)
    best = F.filter(found, lambda s: any_in(F.lower(s), L.PRIORITY_TERMS))
    flat = F.trim(F.regexp_replace(_text(text), r"\s+", " "))
    return F.coalesce(F.try_element_at(best, F.lit(1)), F.try_element_at(found, F.lit(1)), F.substring(flat, 1, 500))


def judge_reply(reply: Column) -> tuple[Column, Column, Column]:
    """violation, score within 0 and 1 (by default from the violation), rationale of a reply that holds a JSON object,
    in a fence or in other text; null where there is none or its violation is no boolean."""
    got = F.from_json(F.regexp_extract(_text(reply), r"(?s)\{.*\}", 0), "violation string, score string, rationale string")
    word = F.lower(F.trim(got["violation"]))
    bad = F.when(word.isin("true", "yes", "y"), True).when(word.isin("false", "no", "n"), False).otherwise(word.try_cast("double") != 0)
    score = F.coalesce(got["score"].try_cast("double"), F.when(bad, 0.0).otherwise(1.0))
    return bad, F.when(bad.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), F.coalesce(got["rationale"], F.lit(""))


def disagreement(rule_bad: Column, judge_bad: Column, violations: Column, family: Column, rationale: Column) -> Column:
    """Why rules and judge differ; violations: `;`-joined."""
    v, r = _text(violations), F.lower(_text(rationale))
    has = lambda t, w: F.contains(t, F.lit(w))
    stricter = (
        F.when((family == "formation_energy") | has(v, "formation_energy"), "auto_stricter_formation_energy_boundary")
        .when((family == "pressure") | has(v, "pressure"), "auto_stricter_pressure_sign_convention")
        .when(has(v, "cautious_stability_claim"), "auto_stricter_stability_evidence_requirement")
        .when(has(v, "valid_chemical_symbols"), "auto_stricter_formula_or_symbol_parsing")
        .otherwise("auto_stricter_constraint_interpretation")
    )
    judged = F.when(any_in(r, ("unsupported", "context")), "judge_detects_context_support_issue").when(family == "natural_claim", "judge_detects_natural_claim_issue").otherwise("judge_stricter_unmodeled_scientific_issue")
    return F.when(rule_bad & ~judge_bad, stricter).when(judge_bad & ~rule_bad, judged).otherwise("other")


def source_log(rows: DataFrame, source: str, key: str) -> DataFrame:
    """For each source the number of its ids and the SHA-256 of them; no source is gathered whole."""
    return id_manifest(rows, key, source).withColumnRenamed("n_ids", "n")


def checked_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", complete: bool = False) -> DataFrame:
    """A join of one row to one: a key that either side has twice fails the query, and so does, if complete, a key that the
    right side lacks. Sides are grouped by the key that they are joined on, so nothing is shuffled for the check."""

    def single(rows: DataFrame, side: str) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        one = rows.groupBy(key).agg(F.count("*").alias("times"), F.min(F.struct(F.lit(side).alias("side"), *rest)).alias("held"))
        told = F.raise_error(F.concat(F.lit(f"{side} side has a key more than once: "), F.col(key).cast("string")))
        return one.select(key, F.when(F.col("times") == 1, F.col("held")).otherwise(told.cast(one.schema["held"].dataType)).alias(side))

    out = single(left, "left").join(single(right, "right"), key, "left" if complete else how)
    if complete:
        told = F.raise_error(F.concat(F.lit("right side lacks a key: "), F.col(key).cast("string")))
        out = out.withColumn("right", F.when(F.col("right").isNotNull(), F.col("right")).otherwise(told.cast(out.schema["right"].dataType)))
    names = [F.col(key)] + [F.col(f"{side}.{c}").alias(c) for side, rows in (("left", left), ("right", right)) for c in rows.columns if c != key]
    return out.select(*names)


def run_config(spark, folder: str, config: dict) -> None:
    """Keeps the configuration of a run beside its output; a run that is resumed with another fails."""
    wanted = json.dumps(config, sort_keys=True)
    try:
        known = spark.read.text(folder + "/run_config").first()["value"]
    except AnalysisException:
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(folder + "/run_config")
        return
    if known != wanted:
        raise ValueError(f"{folder} holds a run with {known}, not with {wanted}; take a new folder")


def judge_of(backend: str, cache: DataFrame | None = None, key: str = "cache_key", strict: bool = True):
    """A function of scored rows that adds judge_violation and judge_backend: `heuristic` takes the rules' word, `cached` a
    table of replies by key; where that lacks one, strict fails and otherwise the rules' word is taken and named so."""
    if backend == "heuristic":
        return lambda rows: rows.withColumns({"judge_violation": F.size("violations") > 0, "judge_backend": F.lit("heuristic")})
    if backend != "cached" or cache is None:
        raise ValueError(f"no judge {backend!r}; there are 'heuristic' and 'cached', which takes a table")

    def judged(rows: DataFrame) -> DataFrame:
        found = rows.join(cache.select(key, F.col("violation").alias("judge_violation")), key, "left")
        told = F.raise_error(F.concat(F.lit("no cached reply for "), F.col(key))).cast("boolean") if strict else F.size("violations") > 0
        backend = F.when(F.col("judge_violation").isNotNull(), "cached").otherwise("heuristic")
        return found.withColumns({"judge_backend": backend, "judge_violation": F.coalesce("judge_violation", told)})

    return judged
