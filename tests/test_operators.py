"""Support scorers, metrics, resampling, retrieval, selection, sources and streaming on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from claimloom.functions import support as S
from claimloom.functions.spans import spans
from claimloom.operators import metrics as M
from claimloom.operators import resample as B
from claimloom.operators import retrieval as R
from claimloom.operators import rules
from claimloom.operators import selection as D
from claimloom.sources import io
from claimloom.streaming import scoring


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_spans_are_offsets(spark):
    text = "é1a22b333"
    r = one(spark, s=spans(F.lit(text), "[0-9]+"), n=spans(F.lit("none"), "[0-9]+"))
    assert [(x["start"], x["end"], x["raw"]) for x in r["s"]] == [(1, 2, "1"), (3, 5, "22"), (6, 9, "333")] and r["n"] == []


def test_support(spark):
    q, a, c = F.lit("What is it?"), F.lit("The gap is 2.1 eV"), F.lit("the gap of it is 2.1 ev wide")
    r = one(spark, lex=S.lexical(q, a, c), same=S.ngram_cosine(q, a, a), apart=S.ngram_cosine(q, F.lit("aa bb"), F.lit("cc dd")), nli=S.nli(q, F.lit("3 eV"), c), empty=S.lexical(q, F.lit(""), c), none=S.nli(q, F.lit(None).cast("string"), c), dense=S.dense_cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), sup=S.context_supported(a, c), seg=S.segmented(F.lit("The gap. Blue moon"), c, "sentence"))
    assert r["lex"] == 1.0 and abs(r["same"] - 1) < 1e-9 and r["apart"] == 0 and r["nli"] <= 0.35 and r["empty"] == 0 and r["none"] == 0
    assert abs(r["dense"] - math.sqrt(0.5)) < 1e-9 and r["sup"] and 0 < r["seg"] < 1


def test_scorer_registry():
    assert S.scorer("nli_heuristic") is S.nli
    with pytest.raises(ValueError):
        S.scorer("nothing")


def test_agreement_matches_published_example(spark):
    cells = [(True, True, 1049), (True, False, 218), (False, True, 63), (False, False, 1136)]
    rows = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a boolean, b boolean")
    r = M.agreement(rows, "a", "b").first()
    assert abs(r["kappa"] - 0.7727156139157428) < 1e-12
    assert {(c["a"], c["b"]): c["n"] for c in M.confusion(rows.filter("a"), "a", "b").collect()} == {(False, False): 0, (False, True): 0, (True, False): 218, (True, True): 1049}
    assert M.agreement(rows.filter("a AND b"), "a", "b").first()["kappa"] is None


def test_correlation_guards_and_ranks(spark):
    rows = spark.createDataFrame([("x", 1.0, 5.0), ("x", 2.0, 5.0), ("y", 1.0, 1.0), ("y", 2.0, 4.0), ("y", 2.0, 9.0)], "g string, a double, b double")
    r = {x["g"]: x["r"] for x in rows.groupBy("g").agg(M.pearson(F.col("a"), F.col("b")).alias("r")).collect()}
    assert r["x"] is None and 0 < r["y"] < 1
    ranks = {(x["g"], x["a"]): x["rank"] for x in M.ranks(rows, ["g"], "a", "rank").collect()}
    assert ranks == {("x", 1.0): 1.0, ("x", 2.0): 2.0, ("y", 1.0): 1.0, ("y", 2.0): 2.5}


def test_jaccard_is_symmetric(spark):
    m = spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (3, "q"), (9, "r")], "id int, name string")
    got = {(r["a"], r["b"]): r["jaccard"] for r in M.set_overlap(m, "id", "name").collect()}
    assert got["p", "p"] == 1 and got["p", "q"] == got["q", "p"] == 1 / 3 and got["p", "r"] == 0


def test_micro_metrics(spark):
    rows = spark.createDataFrame([("a;b", "a"), ("", "c"), ("D", "d")], "p string, g string")
    got = {r["category"]: r for r in M.set_prf(rows, {"k": ("p", "g")}).collect()}
    assert (got["k"]["tp"], got["k"]["fp"], got["k"]["fn"]) == (2, 1, 1) and got["overall"]["f1"] == got["k"]["f1"]


def test_bootstrap_contains_the_point_and_repeats(spark):
    rows = spark.createDataFrame([(f"c{i % 12}", float(i % 5 == 0)) for i in range(240)], "c string, v double")
    sums = {"n": F.count("*").cast("double"), "s": F.sum("v")}
    a = B.interval(rows, "c", sums, F.col("s") / F.col("n"), 100).first()
    assert a["ci_low"] <= a["point"] <= a["ci_high"] and a == B.interval(rows, "c", sums, F.col("s") / F.col("n"), 100).first()


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "iron oxide gap", "Fe2O3"), (2, "iron iron iron", None), (3, "", None), (4, None, "GaAs")], "doc_id int, text string, formula string")
    q = spark.createDataFrame([(7, "iron oxide"), (8, "nothing GaAs")], "query_id int, query string")
    got = [(r["query_id"], r["doc_id"]) for r in R.bm25_topk(docs, q, formula="formula", k=2).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1), (7, 2), (8, 4), (8, 1)]


def test_selection(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], None if i == 3 else "none" if i == 4 else "f") for i in range(20)], "id int, s string, fam string")
    assert D.capped(rows, "fam", 5, "id").count() == 5
    assert D.stratified(rows, "s", "id", 3, 8).groupBy("s").count().filter("count < 3").count() == 0
    assert D.mismatched(rows.select("id"), "id").filter("id = other").count() == 0
    assert D.first_of(rows, ["s"], "id").count() == 2
    b = spark.createDataFrame([("yes",), ("",), (None,), ("0",)], "t string").select(D.as_boolean(F.col("t")).alias("b"))
    assert [r["b"] for r in b.collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="no boolean"):
        spark.createDataFrame([("maybe",)], "t string").select(D.as_boolean(F.col("t"))).collect()


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "q"\nline', ["x", "y"], float("nan"))], "id string, response string, tags array<string>, faithfulness_score double")
    io.write_csv(rows, str(tmp_path / "c.csv"))
    back = io.read_records(spark, str(tmp_path / "c.csv"), "id string, response string, tags string, faithfulness_score double").first()
    assert back["answer"] == 'a "q"\nline' and back["tags"] == "x;y" and back["sample_id"] == "1" and back["faithfulness_score"] is None
    io.write_jsonl(rows, str(tmp_path / "j"))
    assert io.read_jsonl(spark, str(tmp_path / "j"), rows.schema).first()["tags"] == ["x", "y"]
    cache = spark.createDataFrame([("k", 1, 0.1), ("k", 2, 0.9)], "key string, seq int, score double")
    assert io.latest(cache, "key", "seq").first()["score"] == 0.9 and io.pending(cache, cache, "key").count() == 0
    assert io.markdown(cache).startswith("| key | seq | score |")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i % 7}", "f", "What is the band gap?", f"{i % 7 - 3} eV") for i in range(20)], "response_id string, constraint_family string, question string, answer string")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows.write.parquet(src)
    stream = lambda: scoring.scored_stream(spark.readStream.schema(rows.schema).parquet(src))
    scoring.run_available(stream(), out, ck)
    rows.limit(3).write.mode("append").parquet(src)
    scoring.run_available(stream(), out, ck)
    got = {r["response_id"]: r["violations"] for r in spark.read.parquet(out).collect()}
    want = {r["response_id"]: r["violations"] for r in rules.score_rows(rows).collect()}
    assert got == want and spark.read.parquet(out).count() == 7
    assert scoring.finalized(spark, out).first()["n"] == 7


def test_stream_scores_equal_texts_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"r{i % 700}", "What is the band gap?", f"{i % 7 - 3} eV") for i in range(1000)], "response_id string, question string, answer string")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    given, score = [], scoring.score_rows
    monkeypatch.setattr(scoring, "score_rows", lambda r: (given.append(r.count()), score(r))[1])
    rows.write.parquet(src)
    for more in (3, 0):
        scoring.score_available(spark.readStream.schema(rows.schema).parquet(src), out, ck)
        rows.limit(more).write.mode("append").parquet(src)
    got = {r["response_id"]: r["violations"] for r in spark.read.parquet(out).collect()}
    assert got == {r["response_id"]: r["violations"] for r in rules.score_rows(rows).collect()} and spark.read.parquet(out).count() == 700
    assert given[0] == 7


def test_audit(spark):
    from claimloom.operators import audit as A

    r = one(spark, n=A.item("numeric_value", F.lit(" 1.10 ")), m=A.item("numeric_value", F.lit("10")), w=A.item("numeric_value", F.lit("Ten")), u=A.item("unit", F.lit("Kelvin")), t=A.item("phase", F.lit(" A  b")))
    assert tuple(r) == ("1.1", "10", "ten", "k", "a b")
    sheet = A.sheet(F.lit("NaCl melts at 10 K; 0 trailing 30 GPa, XRD measurement."))
    r = one(spark, v=sheet["predicted_value"], u=sheet["predicted_unit"], m=sheet["predicted_method"], f=sheet["predicted_formula"])
    assert tuple(r) == ("10; 30", "K; GPa", "XRD; measurement", "NaCl")
    bad, score, why = A.judge_reply(F.lit('```json\n{"violation": 1, "score": -2, "rationale": "x"}\n```'))
    r = one(spark, b=bad, s=score, w=why)
    assert r["b"] is True and r["s"] == 0.0 and r["w"] == "x"
    none, score, _ = A.judge_reply(F.lit("no object"))
    assert tuple(one(spark, b=none, s=score)) == (None, None)
    rows = spark.createDataFrame([("yes",), ("no",), (None,)], "annotation_complete string")
    assert A.completeness(rows).first()["n_incomplete"] == 2
