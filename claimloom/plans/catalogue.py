"""The registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import support as S
from ..operators import audit as A
from ..operators import claims as C
from ..operators import metrics as M
from ..operators import physics as P
from ..operators import resample as B
from ..operators import retrieval as R
from ..operators import rules
from ..operators import selection as D
from ..operators import studies
from ..sources import io, scratch
from ..streaming import scoring
from . import render


#: formulas that one document in 50 each is said to be about
BOOST_FORMULAS = ("Fe2O3", "GaAs", "TiO2", "ZnO")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A narrow input, a key alone, is dealt out before it is blown up."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.qa_records(spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their claims, flags, violations and score, extracted once in a session, from equal texts once, and read by
    column from then on."""

    def claimed(texts: DataFrame) -> DataFrame:
        df = C.with_claims(texts).withColumn("violations", rules.violations())
        return df.withColumn("constraint_score", F.when(F.size("violations") == 0, 1.0).otherwise(0.0))

    def make() -> DataFrame:
        return D.by_value(records(spark, sf_dir), ["question", "answer"], claimed)

    return scratch.once(spark, "scored", table(spark, sf_dir, "part"), make)


TEXTS = ["question", "answer", "retrieved_context"]


def _support(rows: DataFrame, *names: str, **more: Column) -> DataFrame:
    """rows plus the named scorers' columns, and `more` columns of the texts; equal texts are scored once."""
    return D.by_value(rows, TEXTS, lambda texts: texts.withColumns(_scorers(*names) | more))


def _scorers(*names: str) -> dict[str, Column]:
    return {n: S.scorer(n)(*map(F.col, TEXTS)) for n in names}


def _physics(rows: DataFrame) -> DataFrame:
    return D.by_value(rows, [*TEXTS, "document_status", "violations"], P.with_physics)


def _repaired(rows: DataFrame) -> DataFrame:
    """P.repair_rows(rows), equal texts once."""
    slim = rows.select("question", "answer", "violations", "constraint_score", "document_status")
    done = D.by_value(slim, ["question", "answer", "violations", "constraint_score"], lambda texts: P.repair_rows(texts).withColumns({"violations": "violations_before", "constraint_score": "score_before"}))
    return done.drop("violations", "constraint_score")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the next turn as answer and the one before (else the turn itself) as context."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("question"))
    rows = rows.withColumns({"answer": F.lead("question").over(w), "retrieved_context": F.coalesce(F.lag("question").over(w), F.col("question"))})
    return rows.filter((F.col("role") == "user") & F.col("answer").isNotNull())


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("a"), (F.col("toxic") == 1).alias("b"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


# Records, claims, rules


def render_qa_records(spark, sf_dir):
    return records(spark, sf_dir).select("response_id", "base_task_id", "constraint_family", "document_status", "model", "question", "retrieved_context", "answer")


def claims_by_kind(spark, sf_dir):
    return scored(spark, sf_dir).select("response_id", F.explode(C.IR["claims"]).alias("c")).select("c.kind", "c.rejected").groupBy("kind").agg(F.count("*").alias("n"), F.count_if("rejected").alias("n_rejected"))


def rule_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("response_id", "constraint_score", F.array_join("violations", ";").alias("violations"))


def rule_violations_long(spark, sf_dir):
    return scored(spark, sf_dir).select("response_id", F.explode("violations").alias("rule"))


def rule_counts(spark, sf_dir):
    long = rule_violations_long(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))
    return rules.rule_table(spark).join(long, "rule", "left").select("rule", "level", "family", F.coalesce("n", F.lit(0)).alias("n"))


def chemistry_rules(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    e, t = (k * 53) % 700 - 500, (k * 41) % 900 - 300
    text = F.concat(F.lit("The pH is "), render._hundredths(e), F.lit(" and the conversion is "), t.cast("string"), F.lit(" % at "), t.cast("string"), F.lit(" K and "), render._hundredths(e), F.lit(" bar."), F.when(k % 2 == 0, " This is unreliable.").otherwise(""))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("part_id"), text.alias("answer"))
    return rows.select("part_id", F.array_join(rules.chemistry_violations(F.col("answer")), ";").alias("violations"))


def strict_rules(spark, sf_dir):
    return scored(spark, sf_dir).select("response_id", F.array_join(rules.strict_violations(F.col("question")), ";").alias("violations"))


def guard_sweep(spark, sf_dir):
    """Nine threshold variants against claims that are extracted once."""
    return studies.guard_sweep(scored(spark, sf_dir))


def rule_ablation(spark, sf_dir):
    """Eight variants, against the records alone and against a judge."""
    rows = scored(spark, sf_dir).withColumn("judge", (F.col("part_id") + F.col("template")) % 3 == 0)
    return studies.ablation(rows, "judge").select("variant", "n", "n_bad", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


# Support


def status_group_metrics(spark, sf_dir):
    rows = _support(scored(spark, sf_dir), "lexical")
    out = M.group_metrics(rows, "document_status", support="lexical")
    return out.select("document_status", "n", *(r6(c).alias(c) for c in ("mean_support", "mean_constraint", "violation_rate", "divergence_rate")))


def family_metrics(spark, sf_dir):
    rows = _support(scored(spark, sf_dir), "nli")
    out = M.group_metrics(rows, "constraint_family", "model", support="nli")
    return out.select("constraint_family", "model", "n", *(r6(c).alias(c) for c in ("mean_support", "violation_rate", "divergence_rate")))


def lexical_support(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", r6(S.lexical(F.col("question"), F.col("answer"), F.col("retrieved_context"))).alias("support"))


def nli_support(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", r6(S.nli(F.col("question"), F.col("answer"), F.col("retrieved_context"))).alias("support"))


def token_overlap_metrics(spark, sf_dir):
    q, a, c = F.col("question"), F.col("answer"), F.col("retrieved_context")
    return turns(spark, sf_dir).select("conv_id", "turn", r6(S.word_overlap(a, q)).alias("answer_relevancy"), r6(S.word_overlap(c, q)).alias("context_precision"), r6(S.word_overlap(a, c)).alias("context_recall"))


def segmented_support(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return rows.select("conv_id", "turn", *(r6(S.segmented(F.col("answer"), F.col("retrieved_context"), how)).alias(how) for how in ("whole", "sentence", "atomic")))


def ngram_cosine(spark, sf_dir):
    return _support(records(spark, sf_dir), "embedding").select("response_id", r6("embedding").alias("cosine"))


def dense_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    key, vec = "vec_id", "embedding"
    first = D.first_of(e.select(F.col("label").alias("l"), F.col(vec).alias("w"), F.col(key).alias("k")), ["l"], "k")
    return e.join(first, F.col("label") == F.col("l")).select(F.col(key).alias("id"), r6(S.dense_cosine(F.col(vec), F.col("w"))).alias("cosine"))


def _estimators(spark, sf_dir):
    rows = _support(scored(spark, sf_dir), "lexical", "nli", overlap=S.word_overlap(F.col("answer"), F.col("retrieved_context")))
    return rows.select("response_id", "constraint_score", F.explode(F.array(*(F.struct(F.lit(n).alias("estimator"), F.col(n).alias("support")) for n in ("lexical", "nli", "overlap")))).alias("x")).select("response_id", "constraint_score", "x.*")


def _divergent(spark, sf_dir):
    return _estimators(spark, sf_dir).filter((F.col("support") >= 0.8) & (F.col("constraint_score") < 1))


def divergence_cases(spark, sf_dir):
    return _divergent(spark, sf_dir).select("estimator", "response_id", r6("support").alias("support"))


def threshold_grid(spark, sf_dir):
    rows = _support(scored(spark, sf_dir), "lexical").select("base_task_id", "lexical", "constraint_score")
    out = studies.threshold_grid(rows, "lexical", "constraint_score", "base_task_id")
    return out.select("tau_f", "tau_g", "n", "n_high", "n_low", "n_divergent", *(r6(c).alias(c) for c in ("rate", "rate_low", "rate_high", "risk", "risk_low", "risk_high")))


def segmentation_jaccard(spark, sf_dir):
    """Divergent records under each way of splitting an answer, and how much the sets have in common."""
    ways = ("whole", "sentence", "atomic")
    rows = _support(scored(spark, sf_dir).filter("constraint_score < 1"), **{how: S.segmented(F.col("answer"), F.col("retrieved_context"), how) for how in ways})
    rows = rows.select("response_id", F.explode(F.array(*(F.struct(F.lit(how).alias("how"), F.col(how).alias("support")) for how in ways))).alias("x")).select("response_id", "x.*")
    return M.set_overlap(rows.filter("support >= 0.8"), "response_id", "how").select("a", "b", "n_both", "n_union", r6("jaccard").alias("jaccard"))


def estimator_robustness(spark, sf_dir):
    return _robustness(scored(spark, sf_dir), "lexical", "nli")


def _robustness(rows: DataFrame, *names: str) -> DataFrame:
    """The study of the named scorers and the overlap of words. No row of its own is kept for a record: equal texts are
    counted and scored once, then equal supports are counted."""
    texts = D.counted(rows, [*TEXTS, "constraint_score"])
    every = _scorers(*names) | {"overlap": S.word_overlap(F.col("answer"), F.col("retrieved_context"))}
    each = F.array(*(F.struct(F.lit(n).alias("estimator"), r6(c).alias("support")) for n, c in every.items()))
    out = studies.estimator_robustness(texts.select("constraint_score", "times", F.explode(each).alias("x")).select("constraint_score", "times", "x.*"), "nli", times="times")
    return out.select("estimator", "n", r6("mean").alias("mean"), r6("pearson").alias("pearson"), "n_fixed", "n_fixed_divergent", r6("threshold").alias("threshold"), "n_matched", "n_matched_divergent")


def mode_comparison(spark, sf_dir):
    """Models and modes side by side; the status of a record's document stands for the mode it was generated in."""
    rows = _support(scored(spark, sf_dir), "lexical").select("model", F.col("document_status").alias("mode"), r6("lexical").alias("support"), "constraint_score")
    out = studies.mode_comparison(scratch.keep(rows, "modes"), "model", "mode")
    return out.select("model", "mode", "n", *(r6(c).alias(c) for c in ("mean_support", "mean_constraint", "violation_rate", "pearson", "spearman")))


def token_sums(spark, sf_dir):
    """Tokens of answers and contexts, summed and averaged, by status and over all, with counts of what is there."""
    rows = records(spark, sf_dir).select("document_status", *(F.size(S.token_list(F.col(c))).alias(n) for c, n in (("answer", "a"), ("retrieved_context", "c"))), F.when(F.col("template") % 5 != 0, F.col("template").cast("double")).alias("score"))
    out = rows.rollup("document_status").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"), r6(F.avg("score")).alias("mean_score"), F.sum("a").alias("answer_tokens"), F.sum("c").alias("context_tokens"), r6(F.avg("a")).alias("mean_answer"), r6(F.avg("c")).alias("mean_context"))
    return out.withColumn("document_status", F.coalesce("document_status", F.lit("*")))


def canonical_manifest(spark, sf_dir):
    rows = _manifest(spark, sf_dir)
    return rows.filter("in_primary").select("response_id", "constraint_family", "source_dataset", "dataset_role", *(F.col(c).cast("int").alias(c) for c in ("in_pool", "in_ragas", "in_dual")))


def _manifest(spark, sf_dir):
    return studies.canonical_manifest(records(spark, sf_dir), (F.col("part_id") * 7 + F.col("template")) % len(L.SOURCE_SPECS))


def manifest_validation(spark, sf_dir):
    return studies.validate_manifest(_manifest(spark, sf_dir)).select("check", F.col("ok").cast("int").alias("ok"), "found")


def probe_records(spark, sf_dir):
    """A probe for each part: which rule it is aimed at, and whether it is caught."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    found = studies.probes_for(rows, "p_partkey")
    return found.select(F.col("p_partkey").cast("long").alias("part_id"), "constraint", "kind", "question", "answer", F.col("hit").cast("int").alias("hit"))


def natural_filter(spark, sf_dir):
    """Documents of 30 words or more of which nothing that is needed is missing."""
    rows = table(spark, sf_dir, "documents").dropna(subset=["doc_id", "text", "lang", "source"])
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)))
    return rows.select("doc_id", words.cast("long").alias("n_words")).filter("n_words >= 30")


def checked_join(spark, sf_dir):
    """Labels beside their documents, one to one, none missing."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return A.checked_join(labels, table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", complete=True)


def judged_by_cache(spark, sf_dir):
    """Cached replies where there are some, the rules' word elsewhere, and the summary of both."""
    key = io.cache_key(F.lit("judge"), F.col("question"), F.col("answer"), F.col("retrieved_context"))
    rows = scored(spark, sf_dir).select("response_id", "part_id", "template", "violations", F.concat_ws("-", key, "response_id").alias("cache_key"))
    cache = rows.filter("part_id % 3 <> 0").select("cache_key", ((F.col("part_id") + F.col("template")) % 4 == 0).alias("violation"))
    found = A.judge_of("cached", cache, strict=False)(rows)
    return found.groupBy("judge_backend").agg(F.count("*").alias("n"), F.count_if("judge_violation").alias("n_violation"))


def severity_kappa(spark, sf_dir):
    """Two ratings of four levels, quadratically weighted."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select((k % 4).alias("a"), F.least(F.lit(3), (k % 4) + (k % 7 == 0).cast("int")).alias("b"))
    return M.quadratic_kappa(rows, "a", "b", 4).select("n", r6("exact").alias("exact"), r6("kappa").alias("kappa"))


def row_bootstrap_pearson(spark, sf_dir):
    """A pair statistic with an interval over rows: each labelled document is a cluster of its own."""
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    out = B.interval(raters(spark, sf_dir), "doc_id", B.pearson_sums(x, y), B.pearson_of(), 1000)
    return out.select(*(r6(c).alias(c) for c in ("point", "ci_low", "ci_high")))


def numbered_corpus(spark, sf_dir):
    """Running ids and statuses that go round, by the order of doc_id."""
    rows = D.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "i")
    status = F.element_at(F.array(*map(F.lit, L.STATUSES[:3])), (F.col("i") % 3 + 1).cast("int"))
    return rows.select("doc_id", F.concat(F.lit("doc_"), F.lpad((F.col("i") + 1).cast("string"), 8, "0")).alias("corpus_id"), status.alias("document_status"))


def estimator_jaccard(spark, sf_dir):
    return M.set_overlap(_divergent(spark, sf_dir), "response_id", "estimator").select("a", "b", "n_both", "n_union", r6("jaccard").alias("jaccard"))


def estimator_set_sizes(spark, sf_dir):
    by = _divergent(spark, sf_dir).groupBy("response_id").agg(F.count("*").alias("k"), F.first("estimator").alias("e"))
    return by.agg(F.count("*").alias("n_union"), F.count_if(F.col("k") == 3).alias("n_all"), F.count_if(F.col("k") == 1).alias("n_unique"))


def quantile_matched_threshold(spark, sf_dir):
    """The lexical threshold that passes as many records as nli does at 0.8: linear between order statistics, over
    counts of distinct values."""
    rows = scratch.keep(_support(records(spark, sf_dir), "lexical", "nli").select(r6("lexical").alias("v"), "nli"), "support")
    found = studies.matched_threshold(rows, "v", "nli")
    return found.select(r6("threshold").alias("threshold"), r6("rate").alias("rate"))


# Agreement, correlation, breakdowns


def confusion_matrix(spark, sf_dir):
    return M.confusion(raters(spark, sf_dir), "a", "b").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n")


def cohen_kappa(spark, sf_dir):
    return M.agreement(raters(spark, sf_dir), "a", "b").select("tp", "fp", "fn", "tn", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


def family_prf(spark, sf_dir):
    return M.agreement(raters(spark, sf_dir), "a", "b", "lang").select("lang", "tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in ("precision", "recall", "f1", "kappa")))


def disagreement_by_two_keys(spark, sf_dir):
    return raters(spark, sf_dir).withColumn("kind", P.disagreement_kind(F.col("a"), F.col("b"))).filter("kind <> 'agreement'").groupBy("lang", "kind").agg(F.count("*").alias("n"))


def disagreement_shares(spark, sf_dir):
    n = raters(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_differ"))
    every = Window.partitionBy(F.lit(1))  # one row a source
    return n.select("source", "n", "n_differ", r6(M.ratio(F.col("n_differ"), F.col("n"))).alias("rate"), r6(M.ratio(F.col("n_differ"), F.sum("n_differ").over(every))).alias("share"))


def pearson_by_group(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(M.pearson(F.col("x"), F.col("y"))).alias("r"))


def spearman_by_group(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return M.spearman(x, ["l_returnflag"], "x", "y").select("l_returnflag", "n", r6("rho").alias("rho"))


def breakdown_grouping_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source")
    n = d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))
    return n.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n")


def micro_prf_sets(spark, sf_dir):
    rows = scored(spark, sf_dir).select("constraint_family", F.array_join("violations", ";").alias("p"), F.when(F.col("template") % 2 == 0, F.array_join("violations", ";")).otherwise("non_negative_band_gap").alias("g"))
    out = M.set_prf(rows, {"violations": ("p", "g")})
    return out.select("category", "tp", "fp", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


# Resampling


def _clusters(spark, sf_dir):
    return scored(spark, sf_dir).select(B.cluster_id("base_task_id", "response_id").alias("cluster"), "model", "part_id", "template", "constraint_score")


def cluster_bootstrap_mean(spark, sf_dir):
    sums = {"n": F.count("*").cast("double"), "s": F.sum("constraint_score")}
    out = B.interval(_clusters(spark, sf_dir), "cluster", sums, F.col("s") / F.col("n"))
    return out.select(*(r6(c).alias(c) for c in ("point", "ci_low", "ci_high")))


def cluster_bootstrap_kappa(spark, sf_dir):
    rows = raters(spark, sf_dir).withColumn("cluster", F.concat_ws("-", "source", "lang"))
    a, b = F.col("a"), F.col("b")
    sums = {"tp": F.count_if(a & b), "fp": F.count_if(a & ~b), "fn": F.count_if(~a & b), "tn": F.count_if(~a & ~b)}
    out = B.interval(rows, "cluster", sums, B.kappa_of(*sums))
    return out.select(*(r6(c).alias(c) for c in ("point", "ci_low", "ci_high")))


def paired_bootstrap_diff(spark, sf_dir):
    """Mean difference of two systems on the same prompts: their rows are paired by conditional sums."""
    rows = _clusters(spark, sf_dir)
    pair = (F.col("part_id") / 3).cast("long")
    per = rows.groupBy(pair.alias("prompt"), "template").agg(F.first(F.concat(F.lit("c"), (pair % 50).cast("string"))).alias("cluster"), F.max(F.when(F.col("model") == "model_a", F.col("constraint_score"))).alias("x"), F.max(F.when(F.col("model") == "model_b", F.col("constraint_score"))).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    out = B.interval(per, "cluster", {"n": F.count("*").cast("double"), "s": F.sum(F.col("x") - F.col("y"))}, F.col("s") / F.col("n"))
    return out.select(*(r6(c).alias(c) for c in ("point", "ci_low", "ci_high")))


# Physics, attribution, repair, generation


def physics_scores(spark, sf_dir):
    rows = _physics(scored(spark, sf_dir))
    return rows.select("response_id", *(r6(c).alias(c) for c in ("symbolic", "plausibility", "prior", "uncertainty", "total")), "hallucination_type")


def taxonomy_counts(spark, sf_dir):
    return _physics(scored(spark, sf_dir)).groupBy("hallucination_type").agg(F.count("*").alias("n"))


def physics_by_status(spark, sf_dir):
    rows = _physics(scored(spark, sf_dir))
    return rows.groupBy("document_status").agg(F.count("*").alias("n"), *(r6(F.avg(c)).alias("mean_" + c) for c in ("symbolic", "plausibility", "prior", "uncertainty", "total")))


def attribution_accuracy(spark, sf_dir):
    rows = _support(scored(spark, sf_dir), "lexical").filter(F.size("violations") > 0)
    gold, guess = P.gold_attribution(), P.correlational_attribution(F.col("lexical"))
    rows = rows.select(gold.alias("gold"), guess.alias("guess"))
    same = lambda a, b: r6(F.avg((a == b).cast("double")))
    return rows.agg(F.count("*").alias("n_errors"), same(F.col("gold"), F.col("guess")).alias("accuracy"), same(P.coarse(F.col("gold")), P.coarse(F.col("guess"))).alias("coarse_accuracy"))


def repair_metrics(spark, sf_dir):
    rows = _repaired(scored(spark, sf_dir))
    done = F.col("repair_strategy") != "none"
    return rows.groupBy("document_status").agg(F.count("*").alias("n"), F.count_if(done).alias("n_repaired"), r6(F.avg("score_before")).alias("before"), r6(F.avg("score_after")).alias("after"), F.count_if(done & (F.col("score_after") == 1)).alias("n_success"))


def repair_usefulness(spark, sf_dir):
    rows = _repaired(scored(spark, sf_dir)).filter("repair_strategy <> 'none'")
    return rows.groupBy("repair_strategy").agg(F.count("*").alias("n"), r6(F.avg(S.usefulness(F.col("question"), F.col("repaired_answer")))).alias("usefulness"))


def guided_repair(spark, sf_dir):
    rows = P.guided_repair(_physics(scored(spark, sf_dir)))
    after = D.by_value(rows.select("question", "guided_answer", "guided_action"), ["question", "guided_answer"], lambda texts: rules.score_rows(texts, "question", "guided_answer"))
    return after.groupBy("guided_action").agg(F.count("*").alias("n"), r6(F.avg("constraint_score")).alias("after"))


def generate_answers(spark, sf_dir):
    return records(spark, sf_dir).select("response_id", P.generated(F.col("question"), F.col("retrieved_context")).alias("generated"))


# Retrieval, corpora, selection, validation


def bm25_topk(spark, sf_dir):
    """Over postings that are written once in a session; a query reads blocks, and no text."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = R.search(R.kept(table(spark, sf_dir, "documents").select("doc_id", "text")), queries, k=3)
    return found.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def bm25_boosted(spark, sf_dir):
    """Queries that name a formula, and documents that are about one."""
    formulas = F.array(*map(F.lit, BOOST_FORMULAS))
    about = lambda k, n: F.when(k % n < len(BOOST_FORMULAS), F.element_at(formulas, (k % n % len(BOOST_FORMULAS) + 1).cast("int")))
    docs = table(spark, sf_dir, "documents").select("doc_id", about(F.col("doc_id"), 50).alias("formula")).filter("formula IS NOT NULL")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" in "), about(F.col("item_id"), len(BOOST_FORMULAS))).alias("query"))
    found = R.search(R.kept(table(spark, sf_dir, "documents").select("doc_id", "text")), queries, formulas=docs, k=3)
    return found.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def corpus_build_dedupe(spark, sf_dir):
    """A union of two sources with status and priority; the first of each (source, text) stays."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("corpus_id"), F.col("doc_id").alias("seq"), "source", "text", F.lit("document").alias("source_type"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("corpus_id"), F.col("item_id").alias("seq"), F.lit("benchmark").alias("source"), "text", F.lit("item").alias("source_type"))
    rows = docs.unionByName(items).withColumn("key", F.md5(F.coalesce("text", F.lit("")))).drop("text")
    kept = D.first_of(rows, ["source", "key"], "seq", "corpus_id")
    priority = F.when(F.col("seq") % 3 == 0, 4).when(F.col("seq") % 3 == 1, 3).otherwise(2)
    return kept.select("corpus_id", "source", "source_type", priority.alias("priority"))


def balanced_primary_split(spark, sf_dir):
    rows = records(spark, sf_dir).select("response_id", "constraint_family", "document_status", "part_id", "template")
    late = (F.col("document_status") != "current").cast("int")
    return D.capped(rows, "constraint_family", 500, late, "part_id", "template").select("response_id", "constraint_family")


def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return D.stratified(rows, "source", "doc_id", 3, 100)


def simple_sample(spark, sf_dir):
    return D.simple_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


def mismatched_pairs(spark, sf_dir):
    return D.mismatched(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def paired_systems(spark, sf_dir):
    """For each two systems the prompts that both answered, and who was clean; one aggregate and no self-join."""
    rows = scored(spark, sf_dir).withColumn("prompt", F.concat_ws("-", (F.col("part_id") / 3).cast("long").cast("string"), F.col("template").cast("string")))
    wide = rows.groupBy("prompt").pivot("model", ["model_a", "model_b", "model_c"]).agg(F.max("constraint_score"))
    pairs = [("model_a", "model_b"), ("model_a", "model_c"), ("model_b", "model_c")]
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left_system"), F.lit(b).alias("right_system"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs))).alias("p")).select("p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    return long.groupBy("left_system", "right_system").agg(F.count("*").alias("n"), F.count_if(F.col("x") > F.col("y")).alias("n_left"), F.count_if(F.col("x") < F.col("y")).alias("n_right"), r6(F.avg(F.col("x") - F.col("y"))).alias("mean_difference"))


def validate_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    rows = d.select("doc_id", F.when(k % 7 == 0, "  ").when(k % 11 != 0, F.col("lang")).alias("question"), F.when(k % 5 == 0, "stale").otherwise("current").alias("document_status"), F.when(k % 13 == 0, "1.5").when(k % 17 == 0, "high").otherwise("0.5").alias("faithfulness_score"))
    wrong = D.errors_of(["question"], "document_status", ["faithfulness_score"])
    return rows.select("doc_id", F.array_join(wrong, ";").alias("errors")).filter("errors <> ''")


def duplicate_keys(spark, sf_dir):
    return D.duplicates(table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")), "text_md5")


def subset_violations(spark, sf_dir):
    return D.outside(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def cache_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type")
    return io.latest(e, "key", "event_id").select(F.col("key").alias("user_id"), "event_id", "event_type")


def cache_keys(spark, sf_dir):
    return records(spark, sf_dir).select("response_id", io.cache_key(F.lit("nli"), F.col("question"), F.col("answer"), F.col("retrieved_context")).alias("cache_key"))


def incremental_antijoin(spark, sf_dir):
    rows = records(spark, sf_dir).select("response_id", "part_id")
    return io.pending(rows, rows.filter("part_id % 3 = 0"), "response_id").select("response_id")


def id_manifest_hash(spark, sf_dir):
    return io.id_manifest(table(spark, sf_dir, "documents"), "doc_id")


def paired_design_check(spark, sf_dir):
    n = records(spark, sf_dir).groupBy("part_id").agg(F.count("*").alias("n"), F.countDistinct("template").alias("n_templates"), F.countDistinct("model").alias("n_models"))
    return n.groupBy("n", "n_templates", "n_models").agg(F.count("*").alias("n_parts"))


def space_group_systems(spark, sf_dir):
    """Range join of numbers with crystal systems, as an equi-join on the numbers a system has."""
    values = ", ".join(f"('{s}', {n})" for s, ns in L.CRYSTAL_SYSTEMS.items() for n in ns)
    systems = spark.sql(f"SELECT * FROM VALUES {values} AS t(crystal_system, number)")
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 230 + 1).cast("int").alias("number"))
    return parts.join(F.broadcast(systems), "number").groupBy("crystal_system").agg(F.count("*").alias("n"))


# Audits and judges


def extraction_sheet(spark, sf_dir):
    found = A.sheet(F.col("answer"))
    return records(spark, sf_dir).select("response_id", *(found[c].alias(c) for c in ("predicted_value", "predicted_unit", "predicted_property", "predicted_phase", "predicted_evidence", "predicted_qualifier")))


def normalised_items(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    value = F.concat((k % 50).cast("string"), F.lit("."), F.rpad((k % 10).cast("string"), 3, "0"))
    unit = F.element_at(F.array(F.lit(" Kelvin "), F.lit("eV  per atom"), F.lit("GPa")), (k % 3).cast("int") + 1)
    return table(spark, sf_dir, "part").select(k.alias("part_id"), A.item("numeric_value", value).alias("number"), A.item("unit", unit).alias("unit"))


def salient_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(A.salient(F.col("text"))).alias("sentence_md5"))


def judge_replies(spark, sf_dir):
    """Replies in fences, in prose and bare; scores out of range are held."""
    k = F.col("p_partkey").cast("long")
    word = F.element_at(F.array(F.lit("true"), F.lit('"Yes"'), F.lit("false"), F.lit("0"), F.lit('"maybe"')), (k % 5).cast("int") + 1)
    score = F.when(k % 4 == 0, ', "score": 1.75').when(k % 4 == 1, ', "score": 0.25').otherwise("")
    body = F.concat(F.lit('{"violation": '), word, score, F.lit(', "rationale": "r"}'))
    reply = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("I judge: "), body, F.lit(" as said."))).otherwise(body)
    bad, points, _ = A.judge_reply(reply)
    return table(spark, sf_dir, "part").select(k.alias("part_id"), F.coalesce(bad.cast("int"), F.lit(-1)).alias("violation"), F.coalesce(points, F.lit(-1.0)).alias("score"))


def judge_disagreements(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("judge", (F.col("part_id") + F.col("template")) % 5 == 0)
    kind = A.disagreement(F.size("violations") > 0, F.col("judge"), F.array_join("violations", ";"), F.col("constraint_family"), F.when(F.col("part_id") % 2 == 0, "not in the context").otherwise("odd"))
    return rows.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("n"))


def relabelled_agreement(spark, sf_dir):
    """Rules run anew on cached answers, against cached judgements."""
    rows = scored(spark, sf_dir).select((F.size("violations") > 0).alias("a"), ((F.col("part_id") + F.col("template")) % 3 == 0).alias("b"), "model")
    return M.agreement(rows, "a", "b", "model").select("model", "tp", "fp", "fn", "tn", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


def source_log(spark, sf_dir):
    return A.source_log(table(spark, sf_dir, "documents"), "source", "doc_id")


# Streaming


def stream_scores(spark, sf_dir):
    """Records read as a stream, deduplicated and scored with a checkpoint, then the sink as a table."""
    run = scratch.fresh(spark, "stream")
    records(spark, sf_dir).write.parquet(run + "/in")
    schema = spark.read.parquet(run + "/in").schema
    stream = spark.readStream.schema(schema).parquet(run + "/in")
    for _ in range(2):  # the second run finds nothing new
        scoring.score_available(stream.select("response_id", "question", "answer"), run + "/out", run + "/checkpoint")
    return spark.read.parquet(run + "/out").select("response_id", "constraint_score", F.array_join("violations", ";").alias("violations"))


def event_flag_rates(spark, sf_dir):
    """The monitor's windows over all events, in batch."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 10 == 0).alias("flagged"))
    out = scoring.violation_rate(e, "ts", "1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", r6("rate").alias("rate"))


QUERIES = [
    bm25_boosted,
    render_qa_records, claims_by_kind, rule_scores, rule_violations_long, rule_counts, chemistry_rules, strict_rules, guard_sweep, rule_ablation,
    status_group_metrics, family_metrics, lexical_support, nli_support, token_overlap_metrics, segmented_support, ngram_cosine, dense_cosine,
    divergence_cases, threshold_grid, estimator_jaccard, estimator_set_sizes, quantile_matched_threshold,
    confusion_matrix, cohen_kappa, family_prf, disagreement_by_two_keys, disagreement_shares, pearson_by_group, spearman_by_group,
    breakdown_grouping_sets, micro_prf_sets, cluster_bootstrap_mean, cluster_bootstrap_kappa, paired_bootstrap_diff,
    physics_scores, taxonomy_counts, physics_by_status, attribution_accuracy, repair_metrics, repair_usefulness, guided_repair, generate_answers,
    bm25_topk, corpus_build_dedupe, balanced_primary_split, stratified_sample, simple_sample, mismatched_pairs, paired_systems,
    validate_records, duplicate_keys, subset_violations, cache_latest, cache_keys, incremental_antijoin, id_manifest_hash, paired_design_check,
    extraction_sheet, normalised_items, salient_sentences, judge_replies, judge_disagreements, relabelled_agreement, source_log,
    space_group_systems, stream_scores, event_flag_rates,
    segmentation_jaccard, estimator_robustness, mode_comparison, token_sums, canonical_manifest, manifest_validation, probe_records, natural_filter,
    checked_join, judged_by_cache, severity_kappa, row_bootstrap_pearson, numbered_corpus,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
