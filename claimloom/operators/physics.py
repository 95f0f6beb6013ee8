"""Physics-informed score, error taxonomy, attribution, repair and rule-based answers; all row-local columns.

Rows need question, answer, retrieved_context, document_status and `violations` (see rules.score_rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.spans import any_in
from ..functions.support import context_supported
from .rules import score_rows


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def with_physics(rows: DataFrame) -> DataFrame:
    """rows plus symbolic, plausibility, prior, uncertainty, total and hallucination_type."""
    a, q, c = _low("answer"), _low("question"), _low("retrieved_context")
    status = F.coalesce(F.col("document_status"), F.lit("unknown"))
    df = rows.withColumns({
        "_bad": F.size("violations") > 0,
        "_hedged": any_in(a, L.UNCERTAINTY),
        "_unreliable": (status == "outdated_or_incorrect") | any_in(c, L.UNRELIABLE_CONTEXT),
        "_incomplete": (status == "incomplete") | any_in(c, L.INCOMPLETE_CONTEXT),
        "_supported": context_supported(F.col("answer"), F.col("retrieved_context")),
        "_negative": F.coalesce(F.col("answer"), F.lit("")).rlike(r"(?i)-(?:0*[1-9][0-9]*(?:\.[0-9]+)?|0+\.0*[1-9][0-9]*)\s*(?:eV|K|GPa|MPa|Pa)\b"),
    })
    bad, hedged, unreliable, incomplete, supported = (F.col(x) for x in ("_bad", "_hedged", "_unreliable", "_incomplete", "_supported"))
    minus = lambda cond, x: F.when(cond, F.lit(x)).otherwise(0.0)
    prior = F.greatest(
        F.lit(0.0),
        F.lit(1.0)
        - minus(F.contains(a, F.lit("stable")) & ~any_in(a, ("formation energy", "hull", "thermodynamic", "relative")), 0.45)
        - minus(F.contains(a, F.lit("superconduct")) & ~any_in(a, ("tc", "transition temperature", "measured", "reported", "evidence")), 0.45)
        - minus(F.contains(q, F.lit("band gap")) & F.col("_negative"), 0.55)
        - minus(any_in(a, ("formation energy", "space group", "metallic", "insulator")) & bad, 0.35)
        - minus(unreliable & ~hedged, 0.25),
    )
    df = df.withColumns({
        "symbolic": F.when(bad, 0.0).otherwise(1.0),
        "plausibility": F.when(~bad, 1.0).when(F.arrays_overlap("violations", F.array(*map(F.lit, L.SEVERE))), 0.0).otherwise(0.25),
        "prior": prior,
        "uncertainty": F.when(bad & ~hedged, 0.0).when((unreliable | incomplete) & ~hedged, 0.25).otherwise(1.0),
    })
    total = sum((F.col(k) * v for k, v in L.PHYSICS_WEIGHTS.items()), F.lit(0.0))
    kind = (
        F.when(~bad & (F.col("uncertainty") >= 1.0), "no_error")
        .when(bad & supported & unreliable, "retrieval_induced_scientific_error")
        .when(bad & supported & incomplete, "scientifically_underdetermined_generation")
        .when(bad & supported, "context_supported_physically_invalid")
        .when(bad, "unsupported_hallucination")
        .when(incomplete & (F.col("uncertainty") < 1.0), "scientifically_underdetermined_generation")
        .when(~supported & ~hedged, "unsupported_hallucination")
        .otherwise("no_error")
    )
    df = df.withColumns({"total": total, "hallucination_type": kind})
    return df.drop("_bad", "_hedged", "_unreliable", "_incomplete", "_supported", "_negative")


def rationale() -> Column:
    names = F.array_join("violations", ",")
    return (
        F.when(F.col("hallucination_type") == "no_error", "No physics-informed inconsistency detected.")
        .when(F.size("violations") > 0, F.concat(F.lit("Detected "), names, F.lit(" under document_status="), F.col("document_status"), F.lit("; classified as "), F.col("hallucination_type"), F.lit(".")))
        .otherwise(F.concat(F.lit("Classified as "), F.col("hallucination_type"), F.lit(" under document_status="), F.col("document_status"), F.lit(".")))
    )


def gold_attribution() -> Column:
    """Also what an intervention on the context would find."""
    return (
        F.when(F.size("violations") == 0, "no_error")
        .when(F.col("document_status") == "outdated_or_incorrect", "retrieval_context_error")
        .when(F.col("document_status") == "incomplete", "retrieval_context_incomplete")
        .otherwise("generation_constraint_error")
    )


def correlational_attribution(support: Column) -> Column:
    return F.when(F.size("violations") == 0, "no_error").when(F.coalesce(support, F.lit(0.0)) >= 0.8, "generation_error").otherwise("retrieval_context_error")


def coarse(label: Column) -> Column:
    return F.when(label.isin("retrieval_context_error", "retrieval_context_incomplete", "retrieval_error"), "retrieval_context_error").when(label.isin("generation_constraint_error", "generation_error"), "generation_error").otherwise(label)


def repaired(answer: Column) -> tuple[Column, Column]:
    """Repaired answer and strategy from `violations`."""
    texts = F.create_map(*(F.lit(x) for kv in L.REPAIRS.items() for x in kv))
    new = F.array_join(F.transform("violations", lambda v: F.coalesce(F.try_element_at(texts, v), F.lit(L.DEFAULT_REPAIR))), " ")
    none = F.size("violations") == 0
    return F.when(none, answer).otherwise(new), F.when(none, "none").otherwise(F.array_join("violations", "+"))


def repair_rows(rows: DataFrame) -> DataFrame:
    """rows (with violations) plus repaired_answer, repair_strategy and the scores after: rules run once more."""
    answer, strategy = repaired(F.col("answer"))
    before = rows.withColumns({"repaired_answer": answer, "repair_strategy": strategy}).withColumnRenamed("violations", "violations_before").withColumnRenamed("constraint_score", "score_before")
    return score_rows(before, "question", "repaired_answer").withColumnRenamed("violations", "violations_after").withColumnRenamed("constraint_score", "score_after")


def guided_repair(rows: DataFrame) -> DataFrame:
    """rows of with_physics plus the taxonomy's rewrite and its action."""
    q = _low("question")
    kind = F.col("hallucination_type")

    def pick(i: int) -> Column:
        g = {k: v[i] for k, v in L.GUIDED_REPAIRS.items()}
        return (
            F.when(kind == "no_error", F.col("answer") if i == 0 else F.lit("none"))
            .when(kind == "scientifically_underdetermined_generation", F.lit(g["underdetermined"]))
            .when(kind == "retrieval_induced_scientific_error", F.lit(g["retrieval"]))
            .when(F.contains(q, F.lit("band gap")), F.lit(g["gap"]))
            .when(any_in(q, ("stable", "stability")), F.lit(g["stable"]))
            .otherwise(F.lit(g["other"]))
        )

    return rows.withColumns({"guided_answer": pick(0), "guided_action": pick(1)})


def first_formula(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(L.ANY_FORMULA), F.lit(0)), lambda f: ~f.isin(*L.ANSWER_STOP_FORMULAS))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("the material"))


def generated(question: Column, context: Column) -> Column:
    """An answer from the context, by what the question asks for."""
    q, c = F.lower(question), F.lower(context)
    f = first_formula(question)

    def found(pattern: str, group: int = 1) -> Column:
        return F.when(context.rlike(pattern), F.regexp_extract(context, pattern, group))

    gap = F.coalesce(*(found("(?i)" + p + r"(-?[0-9]+(?:\.[0-9]+)?)\s*eV") for p in (r"Band gap:\s*", r"band gap\s+", r"band gap(?:\s+value)?\s+of\s+", r"with band gap\s+")))
    field = {k: F.trim(found(rf"(?i){k}:\s*([^;]+?)(?:\. |$)")) for k in ("Energy above hull", "Formation energy per atom", "Stable")}
    hull, energy, stable = field.values()
    parts = F.concat_ws(", ", F.concat(F.lit("energy above hull "), hull), F.concat(F.lit("formation energy "), energy), F.concat(F.lit("stable flag "), stable))
    kelvin, pressure = found(r"(?i)-?[0-9]+(?:\.[0-9]+)?\s*(?:K|Kelvin)\b", 0), found(r"(?i)-?[0-9]+(?:\.[0-9]+)?\s*(?:GPa|MPa|Pa)\b", 0)
    has = lambda t, *w: any_in(t, w)
    return (
        F.when(context.isNull(), "Insufficient retrieved evidence to answer the question.")
        .when(has(q, "band gap"), F.coalesce(F.concat(F.lit("The retrieved context reports a "), gap, F.lit(" eV band gap for "), f, F.lit(".")), F.lit("The retrieved context does not provide a band gap value.")))
        .when(has(q, "stable"), F.when(hull.isNotNull() | energy.isNotNull(), F.concat(F.lit("For "), f, F.lit(", the retrieved context gives "), parts, F.lit(", so any stability claim should be interpreted thermodynamically."))).when(has(c, "stable"), F.concat(F.lit("The retrieved context presents "), f, F.lit(" as stable."))).otherwise("The retrieved context is insufficient to establish thermodynamic stability."))
        .when(has(q, "formula", "valid"), F.concat(F.lit("The retrieved context treats "), first_formula(context), F.lit(" as a valid material formula.")))
        .when(has(q, "temperature", " k"), F.coalesce(F.concat(F.lit("The retrieved context reports an experimental temperature of "), kelvin, F.lit(".")), F.lit("The retrieved context does not provide a temperature.")))
        .when(has(q, "pressure", "gpa"), F.coalesce(F.concat(F.lit("The retrieved context reports a pressure of "), pressure, F.lit(".")), F.lit("The retrieved context does not provide a pressure.")))
        .when(has(q, "superconduct"), F.when(has(c, "superconduct"), F.concat(F.lit("The retrieved context identifies "), f, F.lit(" as superconducting."))).otherwise("The retrieved context does not provide superconductivity evidence."))
        .otherwise(context)
    )


def disagreement_kind(rule_bad: Column, judge_bad: Column) -> Column:
    return F.when(rule_bad & ~judge_bad, "false_positive").when(~rule_bad & judge_bad, "false_negative").otherwise("agreement")
