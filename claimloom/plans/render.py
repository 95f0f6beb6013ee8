"""QA records rendered from rows of `part`: sixteen templates, each with what the rules should say of it.

Numbers are written from integers, so every engine writes the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMULAS = ("GaAs", "TiO2", "SiC", "Fe2O3", "LiFePO4", "Xx2O3", "MgO", "ZnS")

#: number, family, question, answer; {f} formula, {g} gap, {e} energy, {t} whole number, {s} space group
TEMPLATES = (
    (0, "band_gap", "What is the band gap of {f}?", "The band gap of {f} is {g} eV."),
    (1, "band_gap", "What is the band gap of {f}?", "{g} eV"),
    (2, "band_gap", "What is the band gap of {f}?", "The band gap of {f} is {g} eV, but that value is unreliable."),
    (3, "band_gap", "What is the band gap of {f}?", "The band gap of {f} is {g} eV. The unrelated run was noisy."),
    (4, "formation_energy", "What is the formation energy of {f}?", "The formation energy of {f} is {e} eV/atom."),
    (5, "formation_energy", "What is the formation energy of Fe?", "{e} eV/atom"),
    (6, "stability", "Is {f} stable?", "{f} is stable."),
    (7, "stability", "Is {f} stable?", "{f} is stable with a formation energy of {e} eV/atom."),
    (8, "temperature", "At what temperature was it held?", "The sample was held at {t} K."),
    (9, "pressure", "What is the pressure?", "The pressure is {t} GPa."),
    (10, "pressure", "What is the pressure?", "The pressure is {t} GPa under tension."),
    (11, "conductivity", "Does {f} conduct?", "{f} is metallic with a band gap of {g} eV."),
    (12, "structure", "What is the structure of {f}?", "{f} is cubic in space group {s}."),
    (13, "superconductivity", "Does {f} superconduct?", "{f} is superconducting."),
    (14, "superconductivity", "Does {f} superconduct?", "{f} is superconducting with a measured transition temperature of 12 K."),
    (15, "band_gap", "What is the band gap of {f}?", "The band gap cannot be determined from the retrieved text."),
)


def _hundredths(n: Column) -> Column:
    return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 100).cast("string"), F.lit("."), F.lpad((F.abs(n) % 100).cast("string"), 2, "0"))


def qa_records(part: DataFrame) -> DataFrame:
    """response_id, base_task_id, template, constraint_family, document_status, model, question, retrieved_context,
    answer: sixteen rows for each part; one pass, no shuffle."""
    k = F.col("p_partkey").cast("long")
    gap, energy, whole, group = (k * 37) % 2200 - 200, (k * 53) % 700 - 500, (k * 41) % 900 - 300, k % 230 + 1
    base = part.select(
        k.alias("k"), F.element_at(F.array(*map(F.lit, FORMULAS)), (k % len(FORMULAS)).cast("int") + 1).alias("f"),
        _hundredths(gap).alias("g"), _hundredths(energy).alias("e"), whole.cast("string").alias("t"), group.cast("string").alias("s"),
    )

    def filled(text: str) -> Column:
        out = F.lit(text)
        for name in "fgets":
            if "{" + name + "}" in text:
                out = F.replace(out, F.lit("{" + name + "}"), F.col(name))
        return out

    rows = base.select("k", "f", F.explode(F.array(*(F.struct(F.lit(n).alias("template"), F.lit(family).alias("constraint_family"), filled(q).alias("question"), filled(a).alias("answer")) for n, family, q, a in TEMPLATES))).alias("r")).select("k", "f", "r.*")
    status = F.element_at(F.array(F.lit("current"), F.lit("current"), F.lit("incomplete"), F.lit("outdated_or_incorrect")), (F.col("template") + F.col("k")).cast("int") % 4 + 1)
    supported = (F.col("template") + F.col("k")) % 3 != 0
    context = F.when(supported, F.concat(F.lit("Source note: "), F.col("answer"))).otherwise(F.concat(F.lit("The retrieved page describes a synthesis of "), F.col("f"), F.lit(" powders.")))
    return rows.select(
        F.concat(F.lit("r-"), F.col("k").cast("string"), F.lit("-"), F.col("template").cast("string")).alias("response_id"),
        F.concat(F.lit("task-"), (F.col("k") % 97).cast("string")).alias("base_task_id"),
        F.col("k").alias("part_id"), "template", "constraint_family", status.alias("document_status"),
        F.element_at(F.array(F.lit("model_a"), F.lit("model_b"), F.lit("model_c")), (F.col("k") % 3).cast("int") + 1).alias("model"),
        "question", context.alias("retrieved_context"), "answer",
    )


#: DuckDB: the same records, and what each template must lead to, worked out from the numbers and not from the text.
RECORDS_SQL = """
n AS (SELECT CAST(p_partkey AS BIGINT) AS k, (p_partkey * 37) % 2200 - 200 AS gap, (p_partkey * 53) % 700 - 500 AS energy, (p_partkey * 41) % 900 - 300 AS whole, p_partkey % 230 + 1 AS sg,
  ['GaAs','TiO2','SiC','Fe2O3','LiFePO4','Xx2O3','MgO','ZnS'][CAST(p_partkey % 8 AS INT) + 1] AS f FROM part),
b AS (SELECT *, CASE WHEN gap < 0 THEN '-' ELSE '' END || CAST(abs(gap) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(gap) % 100 AS VARCHAR), 2, '0') AS g,
  CASE WHEN energy < 0 THEN '-' ELSE '' END || CAST(abs(energy) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(energy) % 100 AS VARCHAR), 2, '0') AS e FROM n),
t AS (SELECT b.*, u.template, u.constraint_family, replace(u.q, '{f}', f) AS question,
  replace(replace(replace(replace(replace(u.a, '{f}', f), '{g}', g), '{e}', e), '{t}', CAST(whole AS VARCHAR)), '{s}', CAST(sg AS VARCHAR)) AS answer
  FROM b, (VALUES %s) u(template, constraint_family, q, a)),
r AS (SELECT 'r-' || k || '-' || template AS response_id, 'task-' || (k %% 97) AS base_task_id, k AS part_id, template, constraint_family,
  ['current','current','incomplete','outdated_or_incorrect'][CAST((template + k) %% 4 AS INT) + 1] AS document_status,
  ['model_a','model_b','model_c'][CAST(k %% 3 AS INT) + 1] AS model, question,
  CASE WHEN (template + k) %% 3 <> 0 THEN 'Source note: ' || answer ELSE 'The retrieved page describes a synthesis of ' || f || ' powders.' END AS retrieved_context, answer,
  gap, energy, whole, sg, f = 'Xx2O3' AS bad FROM t)
""".replace("% 2200", "%% 2200").replace("% 700", "%% 700").replace("% 900", "%% 900").replace("% 230", "%% 230").replace("% 8 AS", "%% 8 AS").replace("abs(gap) % 100", "abs(gap) %% 100").replace("abs(energy) % 100", "abs(energy) %% 100") % ", ".join(f"({n}, '{fam}', '{q}', '{a}')" for n, fam, q, a in TEMPLATES)

VIOLATIONS_SQL = """list_sort(list_filter([
  CASE WHEN template IN (0, 1, 3, 11) AND gap < 0 THEN 'non_negative_band_gap' END,
  CASE WHEN template IN (0, 1, 3, 11) AND gap > 1500 THEN 'band_gap_physical_range' END,
  CASE WHEN template IN (4, 5, 7) AND (energy < -400 OR energy > 100) THEN 'formation_energy_typical_range' END,
  CASE WHEN template = 8 AND whole < 0 THEN 'non_negative_absolute_temperature' END,
  CASE WHEN template = 9 AND whole < 0 THEN 'non_negative_pressure' END,
  CASE WHEN template IN (0, 3, 4, 6, 7, 11, 12, 13, 14) AND bad THEN 'valid_chemical_symbols' END,
  CASE WHEN template = 6 THEN 'cautious_stability_claim' END,
  CASE WHEN template = 7 AND energy > 0 THEN 'positive_formation_energy_stability_conflict' END,
  CASE WHEN template = 11 AND gap > 10 THEN 'conductivity_band_gap_consistency' END,
  CASE WHEN template = 12 AND sg < 195 THEN 'crystal_system_space_group_consistency' END,
  CASE WHEN template = 13 THEN 'cautious_superconductivity_claim' END,
  CASE WHEN template = 5 AND energy > 5 THEN 'elemental_formation_energy_reference_conflict' END], lambda x: x IS NOT NULL))"""

SCORED_SQL = "WITH " + RECORDS_SQL + ", s AS (SELECT *, " + VIOLATIONS_SQL + " AS v, CAST(len(" + VIOLATIONS_SQL + ") = 0 AS INT) AS clean FROM r)"
