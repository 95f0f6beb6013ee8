"""DuckDB SQL for the registered queries, worked out from the tables' numbers wherever a rule can be said so."""

from __future__ import annotations

from ..functions import lexicon as L
from ..operators.resample import STEPS
from ..operators.studies import MATERIALS, PROBES
from .render import RECORDS_SQL, SCORED_SQL

RECORDS = "WITH " + RECORDS_SQL
SCORED = SCORED_SQL


def _tokens(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '[A-Za-z0-9.+-]+'), lambda t: lower(t)))"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len({a}) END"


LEX = _share(_tokens("answer"), _tokens("retrieved_context"))
_NUM = "regexp_extract_all({}, '-?[0-9]+(?:\\.[0-9]+)?')"
_NEG = "regexp_matches({}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(no|not|never|without|cannot|can''t|does not|do not|isn''t|aren''t)($|[^\\p{{L}}\\p{{N}}_])')"
NLI = f"""CASE WHEN len(list_filter({_NUM.format('answer')}, lambda x: NOT list_contains({_NUM.format('retrieved_context')}, x))) > 0 THEN least(lex, 0.35)
  WHEN {_NEG.format('answer')} <> {_NEG.format('retrieved_context')} AND lex < 0.8 THEN least(lex, 0.55)
  WHEN lex >= 0.8 THEN 1.0 WHEN lex >= 0.55 THEN 0.75 WHEN lex >= 0.3 THEN 0.45 ELSE lex END"""


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(replace({x}, '_', ' ')), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 2))"


def _overlap(a: str, b: str) -> str:
    return _share(_words(a), _words(b))


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


TURNS = """WITH t0 AS (SELECT conv_id, turn, role, coalesce(text, '') AS question, lead(coalesce(text, '')) OVER w AS answer, coalesce(lag(coalesce(text, '')) OVER w, coalesce(text, '')) AS retrieved_context
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), t AS (SELECT * FROM t0 WHERE role = 'user' AND answer IS NOT NULL)"""
RATERS = "WITH x AS (SELECT l.doc_id, l.quality = 0 AS a, l.toxic = 1 AS b, d.lang, d.source FROM labels l JOIN documents d USING (doc_id))"
COUNTS = "count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE NOT a AND b) AS fn, count(*) FILTER (WHERE NOT a AND NOT b) AS tn"
KAPPA = """CASE WHEN ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) < (tp + fp + fn + tn) * (tp + fp + fn + tn) THEN
  ((tp + tn) / (tp + fp + fn + tn)::DOUBLE - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))::DOUBLE)
  / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))::DOUBLE) END"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) END"


PRF = f"round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1"
EST = SCORED + f""", el AS (SELECT *, {LEX} AS lex FROM s), en AS (SELECT *, {NLI} AS nli, {_overlap('answer', 'retrieved_context')} AS overlap FROM el),
e AS (SELECT response_id, clean, 'lexical' AS estimator, lex AS support FROM en UNION ALL SELECT response_id, clean, 'nli', nli FROM en UNION ALL SELECT response_id, clean, 'overlap', overlap FROM en),
d AS (SELECT * FROM e WHERE support >= 0.8 AND clean = 0)"""

_UNC, _UNR, _INC = (_has(t, w) for t, w in (("lower(answer)", L.UNCERTAINTY), ("lower(retrieved_context)", L.UNRELIABLE_CONTEXT), ("lower(retrieved_context)", L.INCOMPLETE_CONTEXT)))
_MEAS = "list_transform(regexp_extract_all(answer, '(?i)-?[0-9]+(?:\\.[0-9]+)?\\s*(?:eV|K|GPa|MPa|Pa)\\b'), lambda x: lower(x))"


def _plain(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9.+-]+'), lambda w: trim(w, '.+-')), lambda w: length(w) > 2))"


PHYS = SCORED + f""", p0 AS (SELECT *, clean = 0 AS err, {_UNC} AS hedged, document_status = 'outdated_or_incorrect' OR {_UNR} AS unreliable, document_status = 'incomplete' OR {_INC} AS incomplete,
  CASE WHEN len({_MEAS}) > 0 THEN len(list_filter({_MEAS}, lambda m: NOT contains(lower(retrieved_context), m))) = 0 ELSE {_share(_plain('answer'), _plain('retrieved_context'))} >= 0.35 END AS supported FROM s),
p1 AS (SELECT *, CASE WHEN err THEN 0.0 ELSE 1.0 END AS symbolic,
  CASE WHEN NOT err THEN 1.0 WHEN len(list_intersect(v, {list(L.SEVERE)})) > 0 THEN 0.0 ELSE 0.25 END AS plausibility,
  greatest(0.0, 1.0::DOUBLE - CASE WHEN contains(lower(answer), 'stable') AND NOT {_has('lower(answer)', ('formation energy', 'hull', 'thermodynamic', 'relative'))} THEN 0.45::DOUBLE ELSE 0 END
   - CASE WHEN contains(lower(answer), 'superconduct') AND NOT {_has('lower(answer)', ('tc', 'transition temperature', 'measured', 'reported', 'evidence'))} THEN 0.45::DOUBLE ELSE 0 END
   - CASE WHEN contains(lower(question), 'band gap') AND template IN (0, 1, 2, 3) AND gap < 0 THEN 0.55::DOUBLE ELSE 0 END
   - CASE WHEN {_has('lower(answer)', ('formation energy', 'space group', 'metallic', 'insulator'))} AND err THEN 0.35::DOUBLE ELSE 0 END
   - CASE WHEN unreliable AND NOT hedged THEN 0.25::DOUBLE ELSE 0 END) AS prior,
  CASE WHEN err AND NOT hedged THEN 0.0 WHEN (unreliable OR incomplete) AND NOT hedged THEN 0.25 ELSE 1.0 END AS uncertainty FROM p0),
p AS (SELECT *, 0.25::DOUBLE * symbolic + 0.40::DOUBLE * plausibility + 0.20::DOUBLE * prior + 0.15::DOUBLE * uncertainty AS total,
  CASE WHEN NOT err AND uncertainty >= 1 THEN 'no_error' WHEN err AND supported AND unreliable THEN 'retrieval_induced_scientific_error'
   WHEN err AND supported AND incomplete THEN 'scientifically_underdetermined_generation' WHEN err AND supported THEN 'context_supported_physically_invalid'
   WHEN err THEN 'unsupported_hallucination' WHEN incomplete AND uncertainty < 1 THEN 'scientifically_underdetermined_generation'
   WHEN NOT supported AND NOT hedged THEN 'unsupported_hallucination' ELSE 'no_error' END AS hallucination_type FROM p1)"""

_GROUP = "round(avg(sup), 6) AS mean_support, {}round(avg(CAST(clean = 0 AS DOUBLE)), 6) AS violation_rate, round(avg(CAST(sup >= 0.8 AND clean = 0 AS DOUBLE)), 6) AS divergence_rate"


def _weighted(table: str, reps: int) -> str:
    """Rows of a table with a column c, once for each replicate, with the weight of c there."""
    mixed = f"SELECT *, xor(x2, x2 >> 16) AS x3 FROM (SELECT *, (xor(x1, x1 >> 16) * 73244475) & 4294967295 AS x2 FROM (SELECT *, (xor(x0, x0 >> 16) * 73244475) & 4294967295 AS x1 FROM (SELECT *, (h + rep * 2654435761) & 4294967295 AS x0 FROM (SELECT *, ('0x' || substr(md5(CAST(c AS VARCHAR)), 1, 8))::BIGINT AS h FROM {table}), (SELECT unnest(range({reps})) AS rep))))"
    return f"SELECT *, {' + '.join(f'CAST(x3 >= {step} AS BIGINT)' for step in STEPS)} AS w FROM ({mixed})"


def _boot(clusters: str, names: tuple, statistic: str, reps: int = 5000) -> str:
    """clusters: SQL with columns c and the named sums; statistic over the sums."""
    plain, drawn = (", ".join(f"sum({n}{by})::DOUBLE AS {n}" for n in names) for by in ("", " * w"))
    return f""", k AS ({clusters}), bb AS (SELECT {statistic} AS v FROM (SELECT rep, {drawn} FROM ({_weighted('k', reps)}) WHERE w > 0 GROUP BY rep))
SELECT round((SELECT {statistic} FROM (SELECT {plain} FROM k)), 6) AS point, round((SELECT quantile_cont(v, 0.025) FROM bb), 6) AS ci_low, round((SELECT quantile_cont(v, 0.975) FROM bb), 6) AS ci_high"""


def _ablated(test) -> str:
    names = [k for k, v in L.RULES.items() if test(v)]
    return f"len(list_filter(v, lambda x: list_contains({names}, x))) > 0"


_STRICT_RULES = """list_filter([CASE WHEN template IN (0, 1, 2, 3, 11) AND gap < 0 THEN 'non_negative_band_gap' END, CASE WHEN template IN (0, 1, 2, 3, 11) AND gap > 1500 THEN 'band_gap_physical_range' END,
  CASE WHEN template IN (4, 5, 7) AND (energy < -400 OR energy > 100) THEN 'formation_energy_typical_range' END, CASE WHEN template = 8 AND whole < 0 THEN 'non_negative_absolute_temperature' END,
  CASE WHEN template IN (9, 10) AND whole < 0 THEN 'non_negative_pressure' END], lambda x: x IS NOT NULL)"""


def _ablations() -> str:
    """variant, a (a rule is broken), b (a judgement) for every record that the variant holds."""
    any_ = "len(v) > 0"
    tests = (
        any_, _ablated(lambda v: v[0] == "L0"), _ablated(lambda v: v[0] == "L1"), _ablated(lambda v: v[1] != "formation_energy"), _ablated(lambda v: v[1] != "band_gap"),
        f"{any_} OR len({_STRICT_RULES}) > 0", any_, any_,
    )
    where = [""] * 6 + [" WHERE constraint_family <> 'formation_energy'", " WHERE constraint_family <> 'band_gap'"]
    return " UNION ALL ".join(f"SELECT '{n}' AS variant, {t} AS a, (part_id + template) % 3 = 0 AS b FROM s{w}" for n, t, w in zip(L.ABLATIONS, tests, where, strict=True))


def _pieces(text: str) -> dict[str, str]:
    sentences = f"list_filter(list_transform(string_split(regexp_replace(trim({text}, e' \\n\\t'), '([.!?])\\s+', e'\\\\1\\x01', 'g'), e'\\x01'), lambda x: trim(x, e' \\n\\t')), lambda x: x <> '')"
    atoms = f"list_filter(list_transform(flatten(list_transform({sentences}, lambda y: regexp_split_to_array(y, '(?i)\\s*;\\s*|,\\s+(?:and|but)\\s+|\\s+(?:and|but)\\s+'))), lambda x: trim(x, e' \\n\\t')), lambda x: x <> '')"
    return {"whole": f"list_filter([trim({text})], lambda x: x <> '')", "sentence": sentences, "atomic": atoms}


def _mean_share(parts: str) -> str:
    return f"CASE WHEN len({parts}) = 0 THEN 0.0 ELSE list_sum(list_transform({parts}, lambda x: {_share(_tokens('x'), 'ct')})) / len({parts}) END"


_SPECS = "[" + ", ".join(f"{{'source_dataset': '{a}', 'dataset_role': '{b}', 'model': '{c}', 'mode': '{d}', 'pooled': {str(e).lower()}}}" for a, b, c, d, e in L.SOURCE_SPECS) + "]"
_MANIFEST = RECORDS + f""", m0 AS (SELECT response_id, base_task_id, constraint_family, document_status, {_SPECS}[CAST((part_id * 7 + template) % {len(L.SOURCE_SPECS)} AS INT) + 1] AS sp FROM r),
m1 AS (SELECT response_id, base_task_id, constraint_family, document_status, sp.source_dataset AS source_dataset, sp.dataset_role AS dataset_role, sp.model AS model, sp.mode AS mode, sp.pooled AS pooled FROM m0),
m2 AS (SELECT *, row_number() OVER (PARTITION BY constraint_family ORDER BY dataset_role <> '{L.FIRST_ROLES[0]}', dataset_role <> '{L.FIRST_ROLES[1]}', source_dataset, model, mode, response_id) AS n FROM m1),
p AS (SELECT * FROM m2 WHERE n <= 500), q AS (SELECT response_id, concat_ws('|', {', '.join(L.STRATA)}) AS stratum FROM p WHERE pooled)""" + "".join(
    f", {name}0 AS (SELECT response_id, md5(response_id || '||{n}') AS h, row_number() OVER (PARTITION BY stratum ORDER BY md5(response_id || '||{n}'), response_id) > 1 AS late FROM q), {name} AS (SELECT response_id FROM {name}0 ORDER BY late, h, response_id LIMIT {n})"
    for name, n in L.SAMPLES.items()
)


_PROBE_ROWS = (
    "SELECT part_id, p[1] AS constraint, kind, replace(replace(p[2], '{m}', m), '{x}', x) AS question, replace(replace(CASE kind WHEN 'violation' THEN p[3] ELSE p[4] END, '{m}', m), '{x}', x) AS answer, CAST(kind = 'violation' AS INT) AS hit "
    f"FROM (SELECT CAST(p_partkey AS BIGINT) AS part_id, {[list(p) for p in PROBES]}[CAST(p_partkey % {len(PROBES)} AS INT) + 1] AS p, CASE WHEN (p_partkey // {len(PROBES)}) % 2 = 0 THEN 'violation' ELSE 'clean' END AS kind, "
    f"{list(MATERIALS)}[CAST(p_partkey % {len(MATERIALS)} AS INT) + 1] AS m, CAST(p_partkey % 9 + 1 AS VARCHAR) AS x FROM part)"
)


def _guard(name: str) -> str:
    t = {**L.THRESHOLDS, **L.GUARDS[name]}
    h = {k: round(v * 100) for k, v in t.items()}
    return f"""SELECT '{name}' AS variant, count(*) AS n, count(*) FILTER (WHERE (template IN (0, 1, 3, 11) AND (gap < 0 OR gap > {h['gap_upper']})) OR (template IN (4, 5, 7) AND (energy < {h['energy_lower']} OR energy > {h['energy_upper']}))
  OR (template IN (8, 9) AND whole < 0) OR (template IN (0, 3, 4, 6, 7, 11, 12, 13, 14) AND bad) OR template IN (6, 13) OR (template = 7 AND energy > 0) OR (template = 11 AND gap > {h['conductivity_gap']})
  OR (template = 12 AND sg < 195) OR (template = 5 AND energy > {h['elemental']})) AS n_bad FROM r"""


_STRICT = """array_to_string(list_sort(list_filter([CASE WHEN template IN (0, 1, 2, 3, 11) AND gap < 0 THEN 'non_negative_band_gap' END, CASE WHEN template IN (0, 1, 2, 3, 11) AND gap > 1500 THEN 'band_gap_physical_range' END,
  CASE WHEN template IN (4, 5, 7) AND (energy < -400 OR energy > 100) THEN 'formation_energy_typical_range' END, CASE WHEN template = 8 AND whole < 0 THEN 'non_negative_absolute_temperature' END,
  CASE WHEN template IN (9, 10) AND whole < 0 THEN 'non_negative_pressure' END], lambda x: x IS NOT NULL)), ';')"""
_KINDS = {"gap": "0, 2, 3, 11", "bare_gap": "0, 1, 2, 3", "energy": "4, 7", "bare_energy": "4, 5", "kelvin": "8, 14", "pressure": "9, 10", "formula": "0, 2, 3, 4, 6, 7, 11, 12, 13, 14", "space_group": "12", "stable": "6, 7", "superconducts": "13, 14"}
_REPAIRED = {k: f"'{v}'" for k, v in L.REPAIRS.items()}
_USEFUL_Q = "lower(question)"


def _useful(answer: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({_USEFUL_Q}, '{m}') THEN CASE WHEN {_has(f'lower({answer})', w)} THEN 1.0 ELSE 0.0 END" for m, w in L.USEFULNESS) + f" WHEN trim({answer}) <> '' THEN 1.0 ELSE 0.0 END"


_FIX = "array_to_string(list_transform(v, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _REPAIRED.items()) + f" ELSE '{L.DEFAULT_REPAIR}' END), ' ')"
_GUIDED = "CASE WHEN hallucination_type = 'no_error' THEN 'none' WHEN hallucination_type = 'scientifically_underdetermined_generation' THEN 'uncertainty_aware_generation' WHEN hallucination_type = 'retrieval_induced_scientific_error' THEN 'retrieval_correction' WHEN contains(lower(question), 'band gap') THEN 'physically_plausible_rewrite' WHEN contains(lower(question), 'stable') OR contains(lower(question), 'stability') THEN 'uncertainty_aware_generation' ELSE 'consistency_constrained_rewrite' END"
_GAP_OUT = "'The retrieved context reports a ' || g || ' eV band gap for ' || f || '.'"

_PAIRED = """, q AS (SELECT part_id // 3 AS pr, template, max(CASE WHEN model = 'model_a' THEN clean END) AS x, max(CASE WHEN model = 'model_b' THEN clean END) AS y, max(CASE WHEN model = 'model_c' THEN clean END) AS z FROM s GROUP BY ALL)"""
_SYSTEMS = " UNION ALL ".join(f"SELECT {n} AS number, '{s}' AS crystal_system" for s, ns in L.CRYSTAL_SYSTEMS.items() for n in ns)

_BM25 = """WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9.+-]+'), lambda t: lower(t)) AS ts FROM documents),
tot AS (SELECT count(*) AS n_docs, avg(len(ts)) AS al FROM d), pz AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d), post AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM pz GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9.+-]+'), lambda t: lower(t))) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(times * ln(1 + (n_docs - df.df + 0.5) / (df.df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / al))) AS score FROM q JOIN post USING (term) JOIN df USING (term), tot GROUP BY query_id, doc_id),
fl AS (SELECT item_id AS query_id, f.doc_id, 0.0 AS score FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3) f),
al AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM sc UNION ALL SELECT * FROM fl) GROUP BY ALL)
SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM al) WHERE rank <= 3"""

_F4 = "['Fe2O3', 'GaAs', 'TiO2', 'ZnO']"
_BOOSTED = (
    _BM25.replace("coalesce(text, ''), '[A-Za-z0-9.+-]+'), lambda t: lower(t))) AS term FROM benchmark)", f"coalesce(text, '') || ' in ' || {_F4}[CAST(item_id % 4 AS INT) + 1], '[A-Za-z0-9.+-]+'), lambda t: lower(t))) AS term FROM benchmark)")
    .replace("al AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM sc UNION ALL SELECT * FROM fl) GROUP BY ALL)", """bo AS (SELECT item_id AS query_id, doc_id, 20.0 AS score FROM benchmark, documents WHERE doc_id % 50 < 4 AND doc_id % 50 = item_id % 4),
sb AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM sc UNION ALL SELECT * FROM bo) GROUP BY ALL), al AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM sb UNION ALL SELECT * FROM fl) GROUP BY ALL)""")
)

_GRAMS = "list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"


def _dot(keys: str, a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform({keys}, lambda k: CAST(len(list_filter({a}, lambda y: y = k)) AS DOUBLE) * len(list_filter({b}, lambda y: y = k)))), 0)"


def oracle_sql() -> dict[str, str]:
    sql = {
        "render_qa_records": RECORDS + " SELECT response_id, base_task_id, constraint_family, document_status, model, question, retrieved_context, answer FROM r",
        "claims_by_kind": RECORDS + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n, count(*) FILTER (WHERE template = 2) AS n_rejected FROM r WHERE template IN ({t})" for k, t in _KINDS.items()),
        "rule_scores": SCORED + " SELECT response_id, CAST(clean AS DOUBLE) AS constraint_score, array_to_string(v, ';') AS violations FROM s",
        "rule_violations_long": SCORED + " SELECT response_id, unnest(v) AS rule FROM s",
        "rule_counts": SCORED + ", u AS (SELECT unnest(v) AS rule FROM s), d AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in L.RULES.items()) + ") x(rule, level, family)) SELECT rule, level, family, count(u.rule) AS n FROM d LEFT JOIN u USING (rule) GROUP BY ALL",
        "chemistry_rules": RECORDS + ", c AS (SELECT DISTINCT part_id, energy, whole FROM r) SELECT part_id, CASE WHEN part_id % 2 = 0 THEN '' ELSE array_to_string(list_sort(list_filter([CASE WHEN energy < 0 THEN 'aqueous_ph_range' END, CASE WHEN whole < 0 OR whole > 100 THEN 'yield_percentage_range' END, CASE WHEN whole < 0 THEN 'non_negative_absolute_temperature' END, CASE WHEN energy < 0 THEN 'non_negative_pressure' END], lambda x: x IS NOT NULL)), ';') END AS violations FROM c",
        "strict_rules": RECORDS + f" SELECT response_id, {_STRICT} AS violations FROM r",
        "guard_sweep": RECORDS + " " + " UNION ALL ".join(map(_guard, L.GUARDS)),
        "rule_ablation": SCORED + f", x AS ({_ablations()}), c AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE a) AS n_bad, {COUNTS} FROM x GROUP BY variant) SELECT variant, n, n_bad, round((tp + tn) / n::DOUBLE, 6) AS agreement, round({KAPPA}, 6) AS kappa FROM c",
        "status_group_metrics": SCORED + f", l AS (SELECT *, {LEX} AS sup FROM s) SELECT document_status, count(*) AS n, {_GROUP.format('round(avg(CAST(clean AS DOUBLE)), 6) AS mean_constraint, ')} FROM l GROUP BY document_status",
        "family_metrics": SCORED + f", l AS (SELECT *, {LEX} AS lex FROM s), m AS (SELECT *, {NLI} AS sup FROM l) SELECT constraint_family, model, count(*) AS n, {_GROUP.format('')} FROM m GROUP BY ALL",
        "lexical_support": TURNS + f" SELECT conv_id, turn, round({LEX}, 6) AS support FROM t",
        "nli_support": TURNS + f", l AS (SELECT *, {LEX} AS lex FROM t) SELECT conv_id, turn, round({NLI}, 6) AS support FROM l",
        "token_overlap_metrics": TURNS + f" SELECT conv_id, turn, round({_overlap('answer', 'question')}, 6) AS answer_relevancy, round({_overlap('retrieved_context', 'question')}, 6) AS context_precision, round({_overlap('answer', 'retrieved_context')}, 6) AS context_recall FROM t",
        "segmented_support": TURNS + f", p AS (SELECT *, {_tokens('retrieved_context')} AS ct FROM t) SELECT conv_id, turn, CASE WHEN trim(answer) = '' THEN 0.0 ELSE round({LEX}, 6) END AS whole, " + ", ".join(f"round({_mean_share(_pieces('answer')[k])}, 6) AS {k}" for k in ("sentence", "atomic")) + " FROM p",
        "ngram_cosine": RECORDS + f""", w AS (SELECT response_id, regexp_extract_all(lower(answer), '\\b[a-z0-9_][a-z0-9_]+\\b') AS aw, regexp_extract_all(lower(retrieved_context), '\\b[a-z0-9_][a-z0-9_]+\\b') AS cw FROM r),
          g AS (SELECT response_id, {_GRAMS.format('aw')} AS a, {_GRAMS.format('cw')} AS c FROM w), h AS (SELECT *, list_distinct(a) AS ka, list_distinct(c) AS kc FROM g),
          nn AS (SELECT response_id, {_dot('list_intersect(ka, kc)', 'a', 'c')} AS d, sqrt({_dot('ka', 'a', 'a')}) * sqrt({_dot('kc', 'c', 'c')}) AS n FROM h) SELECT response_id, round(CASE WHEN n > 0 THEN least(1.0, d / n) ELSE 0 END, 6) AS cosine FROM nn""",
        "dense_cosine": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS w FROM embeddings GROUP BY label) SELECT e.vec_id AS id, round(greatest(0, least(1, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.w AS DOUBLE[])))), 6) AS cosine FROM embeddings e JOIN f USING (label)",
        "divergence_cases": EST + " SELECT estimator, response_id, round(support, 6) AS support FROM d",
        "threshold_grid": SCORED + f""", l AS (SELECT base_task_id AS c, {LEX} AS lex, clean FROM s), f AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in L.TAU_F)}]) AS tau_f), g AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in L.TAU_G)}]) AS tau_g),
k AS (SELECT tau_f, tau_g, c, count(*) AS n, count(*) FILTER (WHERE lex >= tau_f) AS n_high, count(*) FILTER (WHERE clean < tau_g) AS n_low, count(*) FILTER (WHERE lex >= tau_f AND clean < tau_g) AS n_divergent FROM l, f, g GROUP BY ALL),
bb AS (SELECT tau_f, tau_g, rep, sum(n_divergent * w)::DOUBLE / sum(n * w) AS v, CASE WHEN sum(n_high * w) > 0 THEN sum(n_divergent * w)::DOUBLE / sum(n_high * w) END AS u FROM ({_weighted('k', 5000)}) WHERE w > 0 GROUP BY ALL),
ci AS (SELECT tau_f, tau_g, quantile_cont(v, 0.025) AS v1, quantile_cont(v, 0.975) AS v2, quantile_cont(u, 0.025) AS u1, quantile_cont(u, 0.975) AS u2 FROM bb GROUP BY ALL),
o AS (SELECT tau_f, tau_g, sum(n)::BIGINT AS n, sum(n_high)::BIGINT AS n_high, sum(n_low)::BIGINT AS n_low, sum(n_divergent)::BIGINT AS n_divergent FROM k GROUP BY ALL)
SELECT tau_f, tau_g, n, n_high, n_low, n_divergent, round(n_divergent::DOUBLE / n, 6) AS rate, round(v1, 6) AS rate_low, round(v2, 6) AS rate_high, round(CASE WHEN n_high > 0 THEN n_divergent::DOUBLE / n_high END, 6) AS risk, round(u1, 6) AS risk_low, round(u2, 6) AS risk_high FROM o JOIN ci USING (tau_f, tau_g)""",
        "segmentation_jaccard": SCORED + f", y AS (SELECT *, {_tokens('retrieved_context')} AS ct FROM s WHERE clean = 0), e AS (" + " UNION ALL ".join(f"SELECT response_id, '{k}' AS how FROM y WHERE {_mean_share(p)} >= 0.8" for k, p in _pieces("answer").items()) + "), z AS (SELECT how, count(*) AS n FROM e GROUP BY how), jb AS (SELECT x.how AS a, y.how AS b, count(*) AS n_both FROM e x JOIN e y USING (response_id) GROUP BY ALL) SELECT p.how AS a, q.how AS b, coalesce(n_both, 0) AS n_both, p.n + q.n - coalesce(n_both, 0) AS n_union, round(coalesce(n_both, 0) / (p.n + q.n - coalesce(n_both, 0))::DOUBLE, 6) AS jaccard FROM z p CROSS JOIN z q LEFT JOIN jb ON jb.a = p.how AND jb.b = q.how",
        "estimator_robustness": EST + """, x AS (SELECT estimator, round(support, 6) AS v, clean FROM e), rt AS (SELECT avg(CAST(v >= 0.8 AS DOUBLE)) AS rate FROM x WHERE estimator = 'nli'),
o AS (SELECT *, row_number() OVER (PARTITION BY estimator ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY estimator) AS n FROM x), h AS (SELECT *, (n - 1) * (1 - rate) AS h FROM o, rt),
th AS (SELECT estimator, min(CASE WHEN i = floor(h) THEN v END) + (min(CASE WHEN i = ceil(h) THEN v END) - min(CASE WHEN i = floor(h) THEN v END)) * (any_value(h) - floor(any_value(h))) AS threshold FROM h GROUP BY estimator)
SELECT estimator, count(*) AS n, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) > 0 AND stddev_pop(clean) > 0 THEN corr(v, clean) END, 6) AS pearson, count(*) FILTER (WHERE v >= 0.8) AS n_fixed, count(*) FILTER (WHERE v >= 0.8 AND clean < 1) AS n_fixed_divergent,
round(any_value(threshold), 6) AS threshold, count(*) FILTER (WHERE v >= threshold) AS n_matched, count(*) FILTER (WHERE v >= threshold AND clean < 1) AS n_matched_divergent FROM x JOIN th USING (estimator) GROUP BY estimator""",
        "mode_comparison": SCORED + f""", l AS (SELECT model, document_status AS mode, round({LEX}, 6) AS sup, clean FROM s),
rk AS (SELECT *, rank() OVER (PARTITION BY model, mode ORDER BY sup) + (count(*) OVER (PARTITION BY model, mode, sup) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model, mode ORDER BY clean) + (count(*) OVER (PARTITION BY model, mode, clean) - 1) / 2.0 AS ry FROM l)
SELECT model, mode, count(*) AS n, round(avg(sup), 6) AS mean_support, round(avg(clean), 6) AS mean_constraint, round(avg(CAST(clean = 0 AS DOUBLE)), 6) AS violation_rate, round(CASE WHEN stddev_pop(sup) > 0 AND stddev_pop(clean) > 0 THEN corr(sup, clean) END, 6) AS pearson, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS spearman FROM rk GROUP BY model, mode""",
        "token_sums": RECORDS + ", x AS (SELECT document_status, len(regexp_extract_all(answer, '[A-Za-z0-9.+-]+')) AS a, len(regexp_extract_all(retrieved_context, '[A-Za-z0-9.+-]+')) AS c, CASE WHEN template % 5 <> 0 THEN template::DOUBLE END AS score FROM r) SELECT coalesce(document_status, '*') AS document_status, count(*) AS n, count(score) AS n_scored, round(avg(score), 6) AS mean_score, sum(a)::BIGINT AS answer_tokens, sum(c)::BIGINT AS context_tokens, round(avg(a), 6) AS mean_answer, round(avg(c), 6) AS mean_context FROM x GROUP BY ROLLUP (document_status)",
        "canonical_manifest": _MANIFEST + " SELECT response_id, constraint_family, source_dataset, dataset_role, CAST(pooled AS INT) AS in_pool, CAST(response_id IN (SELECT response_id FROM ragas) AS INT) AS in_ragas, CAST(response_id IN (SELECT response_id FROM dual) AS INT) AS in_dual FROM p",
        "manifest_validation": _MANIFEST + """, c AS (SELECT count(*) AS n, count(DISTINCT base_task_id) AS tasks, count(*) FILTER (WHERE dataset_role = 'natural_source_linked') AS nat FROM p), f AS (SELECT max(k) AS most, count(*) AS kinds FROM (SELECT count(*) AS k FROM p GROUP BY constraint_family)),
z AS (SELECT (SELECT count(*) FROM ragas) AS a, (SELECT count(*) FROM dual) AS b)
SELECT 'size_ragas' AS "check", CAST(a = 372 AS INT) AS ok, a AS found FROM z UNION ALL SELECT 'size_dual', CAST(b = 200 AS INT), b FROM z UNION ALL SELECT 'pool_within_primary', 1, 0 UNION ALL SELECT 'samples_within_pool', 1, 0
UNION ALL SELECT 'largest_family', CAST(most <= 0.2 * n AS INT), most FROM c, f UNION ALL SELECT 'families', CAST(kinds >= 8 AS INT), kinds FROM f UNION ALL SELECT 'base_tasks', CAST(tasks >= 1000 AS INT), tasks FROM c UNION ALL SELECT 'natural_records', CAST(nat >= 400 AS INT), nat FROM c""",
        "probe_records": _PROBE_ROWS,
        "natural_filter": "SELECT doc_id, n_words FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS BIGINT) AS n_words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL) WHERE n_words >= 30",
        "checked_join": "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)",
        "judged_by_cache": SCORED + " SELECT CASE WHEN part_id % 3 <> 0 THEN 'cached' ELSE 'heuristic' END AS judge_backend, count(*) AS n, count(*) FILTER (WHERE CASE WHEN part_id % 3 <> 0 THEN (part_id + template) % 4 = 0 ELSE clean = 0 END) AS n_violation FROM s GROUP BY 1",
        "severity_kappa": "WITH x AS (SELECT (doc_id % 4)::DOUBLE AS a, least(3, doc_id % 4 + CAST(doc_id % 7 = 0 AS INT))::DOUBLE AS b FROM documents), n AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS exact, avg((a - b) * (a - b)) AS seen, avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b) AS chance FROM x) SELECT n, round(exact, 6) AS exact, round(CASE WHEN chance > 0 THEN 1 - seen / chance END, 6) AS kappa FROM n",
        "row_bootstrap_pearson": RATERS + _boot("SELECT doc_id AS c, count(*) AS n, sum(a::INT) AS sx, sum(b::INT) AS sy, sum(a::INT) AS sxx, sum(b::INT) AS syy, sum((a AND b)::INT) AS sxy FROM x GROUP BY 1", ("n", "sx", "sy", "sxx", "syy", "sxy"), "CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) > 0 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END", 1000),
        "numbered_corpus": f"SELECT doc_id, 'doc_' || lpad(CAST(i + 1 AS VARCHAR), 8, '0') AS corpus_id, {list(L.STATUSES[:3])}[CAST(i % 3 AS INT) + 1] AS document_status FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)",
        "estimator_jaccard": EST + ", z AS (SELECT estimator, count(*) AS n FROM d GROUP BY 1), jb AS (SELECT x.estimator AS a, y.estimator AS b, count(*) AS nb FROM d x JOIN d y USING (response_id) GROUP BY ALL) SELECT x.estimator AS a, y.estimator AS b, coalesce(nb, 0) AS n_both, x.n + y.n - coalesce(nb, 0) AS n_union, round(coalesce(nb, 0)::DOUBLE / (x.n + y.n - coalesce(nb, 0)), 6) AS jaccard FROM z x CROSS JOIN z y LEFT JOIN jb ON jb.a = x.estimator AND jb.b = y.estimator",
        "estimator_set_sizes": EST + ", k AS (SELECT response_id, count(*) AS k FROM d GROUP BY 1) SELECT count(*) AS n_union, count(*) FILTER (WHERE k = 3) AS n_all, count(*) FILTER (WHERE k = 1) AS n_unique FROM k",
        "quantile_matched_threshold": RECORDS + f", l AS (SELECT *, {LEX} AS lex FROM r), m AS (SELECT round(lex, 6) AS v, {NLI} AS nli FROM l), tt AS (SELECT avg(CAST(nli >= 0.8 AS DOUBLE)) AS rate, count(*) AS n FROM m), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM m), h AS (SELECT (n - 1) * (1 - rate) AS h, rate FROM tt) SELECT round((SELECT v FROM o, h WHERE i = floor(h)) + ((SELECT v FROM o, h WHERE i = ceil(h)) - (SELECT v FROM o, h WHERE i = floor(h))) * (h - floor(h)), 6) AS threshold, round(rate, 6) AS rate FROM h",
        "confusion_matrix": RATERS + ", c AS (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, count(*) AS n FROM x GROUP BY ALL) SELECT g.a, g.b, coalesce(c.n, 0) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(a, b) LEFT JOIN c ON g.a = c.a AND g.b = c.b",
        "cohen_kappa": RATERS + f", c AS (SELECT {COUNTS} FROM x) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS agreement, round({KAPPA}, 6) AS kappa FROM c",
        "family_prf": RATERS + f", c AS (SELECT lang, {COUNTS} FROM x GROUP BY lang) SELECT lang, tp, fp, fn, tn, {PRF}, round({KAPPA}, 6) AS kappa FROM c",
        "disagreement_by_two_keys": RATERS + " SELECT lang, CASE WHEN a AND NOT b THEN 'false_positive' ELSE 'false_negative' END AS kind, count(*) AS n FROM x WHERE a <> b GROUP BY ALL",
        "disagreement_shares": RATERS + ", c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE a <> b) AS n_differ FROM x GROUP BY source) SELECT source, n, n_differ, round(n_differ::DOUBLE / n, 6) AS rate, round(n_differ::DOUBLE / sum(n_differ) OVER (), 6) AS share FROM c",
        "pearson_by_group": "SELECT l_returnflag, count(*) AS n, round(corr(CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE)), 6) AS r FROM lineitem GROUP BY l_returnflag",
        "spearman_by_group": "WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY l_returnflag",
        "breakdown_grouping_sets": "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
        "micro_prf_sets": SCORED + f", i AS (SELECT v AS p, CASE WHEN template % 2 = 0 THEN v ELSE ['non_negative_band_gap'] END AS g FROM s), c AS (SELECT sum(len(list_intersect(p, g))) AS tp, sum(len(list_filter(p, lambda x: NOT list_contains(g, x)))) AS fp, sum(len(list_filter(g, lambda x: NOT list_contains(p, x)))) AS fn FROM i), k AS (SELECT unnest(['violations', 'overall']) AS category) SELECT category, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {PRF} FROM k, c",
        "cluster_bootstrap_mean": SCORED + _boot("SELECT base_task_id AS c, CAST(count(*) AS DOUBLE) AS n, CAST(sum(clean) AS DOUBLE) AS s FROM s GROUP BY 1", ("n", "s"), "s / n"),
        "cluster_bootstrap_kappa": RATERS + _boot(f"SELECT source || '-' || lang AS c, {COUNTS} FROM x GROUP BY 1", ("tp", "fp", "fn", "tn"), KAPPA),
        "paired_bootstrap_diff": SCORED + _PAIRED + _boot("SELECT 'c' || (pr % 50) AS c, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x - y) AS DOUBLE) AS s FROM q WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1", ("n", "s"), "s / n"),
        "physics_scores": PHYS + " SELECT response_id, round(symbolic::DOUBLE, 6) AS symbolic, round(plausibility::DOUBLE, 6) AS plausibility, round(prior, 6) AS prior, round(uncertainty::DOUBLE, 6) AS uncertainty, round(total, 6) AS total, hallucination_type FROM p",
        "taxonomy_counts": PHYS + " SELECT hallucination_type, count(*) AS n FROM p GROUP BY 1",
        "physics_by_status": PHYS + " SELECT document_status, count(*) AS n, " + ", ".join(f"round(avg({c}::DOUBLE), 6) AS mean_{c}" for c in ("symbolic", "plausibility", "prior", "uncertainty", "total")) + " FROM p GROUP BY 1",
        "attribution_accuracy": SCORED + f", l AS (SELECT *, {LEX} AS lex FROM s WHERE clean = 0), m AS (SELECT CASE document_status WHEN 'outdated_or_incorrect' THEN 'retrieval_context_error' WHEN 'incomplete' THEN 'retrieval_context_incomplete' ELSE 'generation_constraint_error' END AS gold, CASE WHEN lex >= 0.8 THEN 'generation_error' ELSE 'retrieval_context_error' END AS guess FROM l) SELECT count(*) AS n_errors, round(avg(CAST(gold = guess AS DOUBLE)), 6) AS accuracy, round(avg(CAST((gold <> 'generation_constraint_error') = (guess <> 'generation_error') AS DOUBLE)), 6) AS coarse_accuracy FROM m",
        "repair_metrics": SCORED + " SELECT document_status, count(*) AS n, count(*) FILTER (WHERE clean = 0) AS n_repaired, round(avg(CAST(clean AS DOUBLE)), 6) AS before, 1.0::DOUBLE AS after, count(*) FILTER (WHERE clean = 0) AS n_success FROM s GROUP BY 1",
        "repair_usefulness": SCORED + f", u AS (SELECT *, {_FIX} AS fixed FROM s WHERE clean = 0) SELECT array_to_string(v, '+') AS repair_strategy, count(*) AS n, round(avg(({_useful('fixed')})::DOUBLE), 6) AS usefulness FROM u GROUP BY 1",
        "guided_repair": PHYS + f", a AS (SELECT *, {_GUIDED} AS guided_action FROM p) SELECT guided_action, count(*) AS n, 1.0::DOUBLE AS after FROM a GROUP BY 1",
        "generate_answers": RECORDS + f""", o AS (SELECT r.*, b.f, b.g, (template + part_id) % 3 <> 0 AS sup FROM r JOIN b ON b.k = r.part_id) SELECT response_id, CASE
          WHEN template IN (0, 3) AND sup THEN 'The retrieved context does not provide a band gap value.' WHEN template IN (0, 1, 2, 3, 15) THEN 'The retrieved context does not provide a band gap value.'
          WHEN template IN (6, 7) AND sup THEN 'The retrieved context presents ' || CASE WHEN template IN (6, 7) THEN f END || ' as stable.' WHEN template IN (6, 7) THEN 'The retrieved context is insufficient to establish thermodynamic stability.'
          WHEN template = 8 AND sup THEN 'The retrieved context reports an experimental temperature of ' || whole || ' K.' WHEN template = 8 THEN 'The retrieved context does not provide a temperature.'
          WHEN template IN (9, 10) AND sup THEN 'The retrieved context reports a pressure of ' || whole || ' GPa.' WHEN template IN (9, 10) THEN 'The retrieved context does not provide a pressure.'
          WHEN template IN (13, 14) AND sup THEN 'The retrieved context identifies ' || f || ' as superconducting.' WHEN template IN (13, 14) THEN 'The retrieved context does not provide superconductivity evidence.'
          ELSE retrieved_context END AS generated FROM o""",
        "bm25_topk": _BM25,
        "bm25_boosted": _BOOSTED,
        "corpus_build_dedupe": "WITH a AS (SELECT 'doc-' || doc_id AS corpus_id, doc_id AS seq, source, text, 'document' AS source_type FROM documents UNION ALL SELECT 'item-' || item_id, item_id, 'benchmark', text, 'item' FROM benchmark), o AS (SELECT *, row_number() OVER (PARTITION BY source, md5(coalesce(text, '')) ORDER BY seq, corpus_id) AS n FROM a) SELECT corpus_id, source, source_type, CAST(CASE seq % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS INT) AS priority FROM o WHERE n = 1",
        "balanced_primary_split": RECORDS + ", o AS (SELECT *, row_number() OVER (PARTITION BY constraint_family ORDER BY document_status <> 'current', part_id, template) AS n FROM r) SELECT response_id, constraint_family FROM o WHERE n <= 500",
        "stratified_sample": "WITH o AS (SELECT doc_id, source, md5(doc_id || '||42') AS h FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) > 3 AS late FROM o) SELECT doc_id, source FROM p ORDER BY late, h, doc_id LIMIT 100",
        "simple_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id || '||42'), doc_id LIMIT 50",
        "mismatched_pairs": "WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT a.doc_id, b.doc_id AS other FROM i a JOIN i b ON (a.i + greatest(3, a.n // 3)) % a.n = b.i",
        "paired_systems": SCORED + _PAIRED + " " + " UNION ALL ".join(f"SELECT '{a}' AS left_system, '{b}' AS right_system, count(*) AS n, count(*) FILTER (WHERE {x} > {y}) AS n_left, count(*) FILTER (WHERE {x} < {y}) AS n_right, round(avg(CAST({x} - {y} AS DOUBLE)), 6) AS mean_difference FROM q WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for a, b, x, y in (("model_a", "model_b", "x", "y"), ("model_a", "model_c", "x", "z"), ("model_b", "model_c", "y", "z"))),
        "validate_records": "WITH e AS (SELECT doc_id, concat_ws(';', CASE WHEN doc_id % 7 = 0 THEN 'blank:question' WHEN doc_id % 11 = 0 OR lang IS NULL THEN 'missing:question' END, CASE WHEN doc_id % 5 = 0 THEN 'unknown:document_status' END, CASE WHEN doc_id % 13 = 0 THEN 'out_of_range:faithfulness_score' WHEN doc_id % 17 = 0 THEN 'not_numeric:faithfulness_score' END) AS errors FROM documents) SELECT * FROM e WHERE errors <> ''",
        "duplicate_keys": "SELECT md5(coalesce(text, '')) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
        "subset_violations": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "cache_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
        "cache_keys": RECORDS + " SELECT response_id, substr(sha256('nli||' || question || '||' || answer || '||' || retrieved_context), 1, 16) AS cache_key FROM r",
        "incremental_antijoin": RECORDS + " SELECT response_id FROM r WHERE part_id % 3 <> 0",
        "id_manifest_hash": "WITH i AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents), p6 AS (SELECT substr(md5(id), 1, 6) AS pre, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS h FROM i GROUP BY ALL), p3 AS (SELECT substr(pre, 1, 3) AS up, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY pre)) AS h FROM p6 GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_ids, sha256(string_agg(h, chr(10) ORDER BY up)) AS sha256 FROM p3",
        "paired_design_check": "SELECT 16::BIGINT AS n, 16::BIGINT AS n_templates, 1::BIGINT AS n_models, count(*) AS n_parts FROM part",
        "extraction_sheet": RECORDS + """, o AS (SELECT r.*, b.g, b.e FROM r JOIN b ON b.k = r.part_id) SELECT response_id,
          CASE WHEN template IN (0, 2, 3, 11) THEN g WHEN template IN (4, 7) THEN e WHEN template IN (8, 9, 10) THEN CAST(whole AS VARCHAR) WHEN template = 14 THEN '12' ELSE '' END AS predicted_value,
          CASE WHEN template IN (0, 2, 3, 11) THEN 'eV' WHEN template IN (4, 7) THEN 'eV/atom' WHEN template IN (8, 14) THEN 'K' WHEN template IN (9, 10) THEN 'GPa' ELSE '' END AS predicted_unit,
          CASE WHEN template IN (0, 2, 3, 15) THEN 'band_gap' WHEN template = 4 THEN 'formation_energy' WHEN template = 6 THEN 'stability' WHEN template = 7 THEN 'formation_energy; stability' WHEN template = 8 THEN 'temperature'
            WHEN template IN (9, 10) THEN 'pressure' WHEN template = 11 THEN 'band_gap; conductivity' WHEN template = 13 THEN 'superconductivity' WHEN template = 14 THEN 'temperature; superconductivity' ELSE '' END AS predicted_property,
          CASE WHEN template = 12 THEN 'cubic; space group ' || sg ELSE '' END AS predicted_phase,
          CASE WHEN template IN (4, 7) THEN 'formation energy' WHEN template = 14 THEN 'measured; transition temperature' ELSE '' END AS predicted_evidence,
          CASE WHEN template = 2 THEN 'unreliable' WHEN template = 3 THEN 'noisy' ELSE '' END AS predicted_qualifier FROM o""",
        "normalised_items": "SELECT CAST(p_partkey AS BIGINT) AS part_id, CAST(p_partkey % 50 AS VARCHAR) || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '.' || CAST(p_partkey % 10 AS VARCHAR) END AS number, ['k', 'ev/atom', 'gpa'][CAST(p_partkey % 3 AS INT) + 1] AS unit FROM part",
        "salient_sentences": "WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]) ', e'\\\\1\\x01', 'g'), e'\\x01'), lambda x: trim(x)), lambda x: length(x) >= 40) AS ss FROM f) SELECT doc_id, md5(coalesce(list_filter(ss, lambda x: " + _has("lower(x)", L.PRIORITY_TERMS) + ")[1], ss[1], substr(t, 1, 500))) AS sentence_md5 FROM s",
        "judge_replies": "WITH k AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), b AS (SELECT k, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS v FROM k) SELECT k AS part_id, coalesce(v, -1) AS violation, CASE WHEN v IS NULL THEN -1.0::DOUBLE ELSE CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.25 ELSE 1.0 - v END END AS score FROM b",
        "judge_disagreements": SCORED + ", j AS (SELECT *, (part_id + template) % 5 = 0 AS judge, array_to_string(v, ';') AS vs FROM s), k AS (SELECT CASE WHEN clean = 0 AND NOT judge THEN CASE WHEN constraint_family = 'formation_energy' OR contains(vs, 'formation_energy') THEN 'auto_stricter_formation_energy_boundary' WHEN constraint_family = 'pressure' OR contains(vs, 'pressure') THEN 'auto_stricter_pressure_sign_convention' WHEN contains(vs, 'cautious_stability_claim') THEN 'auto_stricter_stability_evidence_requirement' WHEN contains(vs, 'valid_chemical_symbols') THEN 'auto_stricter_formula_or_symbol_parsing' ELSE 'auto_stricter_constraint_interpretation' END WHEN judge AND clean = 1 THEN CASE WHEN part_id % 2 = 0 THEN 'judge_detects_context_support_issue' ELSE 'judge_stricter_unmodeled_scientific_issue' END ELSE 'other' END AS kind FROM j) SELECT kind, count(*) AS n FROM k GROUP BY kind",
        "relabelled_agreement": SCORED + f", x AS (SELECT model, clean = 0 AS a, (part_id + template) % 3 = 0 AS b FROM s), c AS (SELECT model, {COUNTS} FROM x GROUP BY model) SELECT model, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS agreement, round({KAPPA}, 6) AS kappa FROM c",
        "source_log": "WITH i AS (SELECT DISTINCT source, CAST(doc_id AS VARCHAR) AS id FROM documents), p6 AS (SELECT source, substr(md5(id), 1, 6) AS pre, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS h FROM i GROUP BY ALL), p3 AS (SELECT source, substr(pre, 1, 3) AS up, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY pre)) AS h FROM p6 GROUP BY ALL) SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY up)) AS sha256 FROM p3 GROUP BY source",
        "space_group_systems": f"WITH s AS ({_SYSTEMS}) SELECT crystal_system, count(*) AS n FROM part JOIN s ON p_partkey % 230 + 1 = s.number GROUP BY 1",
        "stream_scores": SCORED + " SELECT response_id, CAST(clean AS DOUBLE) AS constraint_score, array_to_string(v, ';') AS violations FROM s",
        "event_flag_rates": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(CAST(event_id % 10 = 0 AS DOUBLE)), 6) AS rate FROM events GROUP BY 1",
    }
    return {k: " ".join(v.split("\n")) if "\n" in v else v for k, v in sql.items()}
