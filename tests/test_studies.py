"""Studies, checks and resampling against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimloom.functions import lexicon as L
from claimloom.operators import audit as A
from claimloom.operators import metrics as M
from claimloom.operators import resample as B
from claimloom.operators import selection as D
from claimloom.operators import studies
from claimloom.sources import io, scratch
from claimloom.streaming import scoring


def test_poisson_weights(spark):
    rows = spark.range(400).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(299).cast("long"))).alias("rep"), F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long").alias("hash"))
    n = {r["weight"]: r["count"] for r in B.weighted(rows).groupBy("weight").count().collect()}
    total = sum(n.values())
    assert abs(sum(k * v for k, v in n.items()) / total - 1) < 0.01 and abs(n[0] / total - 0.3679) < 0.01 and abs(n[2] / total - 0.1839) < 0.01
    per = B.weighted(rows).groupBy("rep").agg(F.sum("weight").alias("w")).agg(F.variance("w").alias("v")).first()["v"]
    assert 250 < per < 580  # 400 clusters: the sum of weights has variance 400


def test_intervals_by_keys(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(k, f"c{i}", float(rng.gauss(m, 1))) for k, m in (("a", 0), ("b", 5)) for i in range(200)] + [("a", None, 99.0)], "k string, c string, x double")
    out = {r["k"]: r for r in B.intervals(rows, "c", {"n": F.count("*"), "s": F.sum("x")}, {"mean": F.col("s") / F.col("n")}, 500, ("k",)).collect()}
    for k, m in (("a", 0), ("b", 5)):
        assert out[k]["mean_low"] < out[k]["mean"] < out[k]["mean_high"] and abs(out[k]["mean"] - m) < 0.3
        assert 0.2 < out[k]["mean_high"] - out[k]["mean_low"] < 0.4  # 4 / sqrt(200)


def test_first_of_least_and_numbers(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("abc"), rng.randrange(50)) for i in range(400)]
    rows = spark.createDataFrame(data, "id int, g string, x int")
    want = {g: min((x, i) for i, k, x in data if k == g) for g in "abc"}
    assert {r["g"]: (r["x"], r["id"]) for r in D.first_of(rows, ["g"], "x", "id").collect()} == want and D.first_of(rows, ["g"], "x", "id").columns == rows.columns
    got = sorted((r["g"], r["x"], r["id"]) for r in D.capped(rows, "g", 7, "x", "id", parts=5).collect())
    assert got == sorted(r for g in "abc" for r in sorted((k, x, i) for i, k, x in data if k == g)[:7])
    assert {r["id"]: r["i"] for r in D.numbered(rows, "id", "i").collect()} == {i: i for i in range(400)}
    twice = rows.unionAll(rows).select("x")
    assert sorted(r["i"] for r in D.numbered(twice, "x", "i").collect()) == list(range(800))
    pairs = {r["id"]: r["other"] for r in D.mismatched(rows.select("id"), "id").collect()}
    assert pairs == {i: (i + 133) % 400 for i in range(400)}
    hashed = lambda i: hashlib.md5(f"{i}||42".encode()).hexdigest()
    first = {i for g in "abc" for i in sorted((i for i, k, _ in data if k == g), key=hashed)[:2]}
    rest = sorted((i for i, *_ in data if i not in first), key=hashed)[: 20 - len(first)]
    assert {r["id"] for r in D.stratified(rows, "g", "id", 2, 20, parts=3).collect()} == first | set(rest)


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.randrange(40)) for _ in range(500)]
    got = M.ranks(spark.createDataFrame(data, "g string, x int"), ["g"], "x", "r").distinct().collect()
    for r in got:
        below, same = (sum(f(x) for g, x in data if g == r["g"]) for f in (lambda x: x < r["x"], lambda x: x == r["x"]))
        assert r["r"] == below + (same + 1) / 2


def test_quadratic_kappa(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 3), (3, 0), (1, 2), (None, 1), (9, 1)], "a int, b int")
    r = M.quadratic_kappa(rows, "a", "b", 4).first()
    pairs = [(0, 0), (1, 1), (2, 3), (3, 3), (3, 0), (1, 2)]
    seen = sum((a - b) ** 2 for a, b in pairs) / 6
    chance = sum((a - d) ** 2 for a, _ in pairs for _, d in pairs) / 36
    assert r["n"] == 6 and r["exact"] == 0.5 and abs(r["kappa"] - (1 - seen / chance)) < 1e-12


def test_checked_join(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, r string")
    assert sorted(map(tuple, A.checked_join(left, right, "k", complete=True).collect())) == [(1, "a", "x"), (2, "b", "y")]
    with pytest.raises(Exception, match="lacks a key: 3"):
        A.checked_join(right, left, "k", complete=True).collect()
    with pytest.raises(Exception, match="more than once: 1"):
        A.checked_join(left.unionAll(left.limit(1)), right, "k").collect()


def test_run_config(spark, tmp_path):
    folder = "file://" + str(tmp_path)
    A.run_config(spark, folder, {"backend": "heuristic", "input": "a"})
    A.run_config(spark, folder, {"input": "a", "backend": "heuristic"})
    with pytest.raises(ValueError, match="new folder"):
        A.run_config(spark, folder, {"backend": "cached", "input": "a"})


def test_judges(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("b", [])], "cache_key string, violations array<string>")
    cache = spark.createDataFrame([("a", False)], "cache_key string, violation boolean")
    assert {r["cache_key"]: r["judge_violation"] for r in A.judge_of("heuristic")(rows).collect()} == {"a": True, "b": False}
    assert {r["cache_key"]: (r["judge_violation"], r["judge_backend"]) for r in A.judge_of("cached", cache, strict=False)(rows).collect()} == {"a": (False, "cached"), "b": (False, "heuristic")}
    with pytest.raises(Exception, match="no cached reply for b"):
        A.judge_of("cached", cache)(rows).collect()
    with pytest.raises(ValueError, match="no judge"):
        A.judge_of("remote")


def test_id_manifest_is_a_tree_of_hashes(spark):
    ids = [str(i) for i in range(500)]
    r = io.id_manifest(spark.createDataFrame([(i,) for i in ids + ids[:5]], "id string"), "id").first()
    leaves: dict = {}
    for i in ids:
        leaves.setdefault(hashlib.md5(i.encode()).hexdigest()[:6], []).append(i)
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    nodes: dict = {}
    for at in sorted(leaves):
        nodes.setdefault(at[:3], []).append(sha(sorted(leaves[at])))
    assert (r["n_ids"], r["sha256"]) == (500, sha([sha(nodes[k]) for k in sorted(nodes)]))


def test_once_writes_a_table_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    source, made = spark.read.parquet(str(tmp_path / "t")), []

    def make():
        made.append(1)
        return source.selectExpr("id * 2 AS x")

    for _ in range(2):
        assert scratch.once(spark, "test", source, make).agg(F.sum("x")).first()[0] == 20
    assert made == [1]


def test_ablation_and_guards(spark):
    from claimloom.operators.claims import with_claims
    from claimloom.operators.rules import violations

    rows = spark.createDataFrame([
        ("band_gap", "What is the band gap of GaAs?", "The band gap of GaAs is -1.0 eV.", True), ("band_gap", "What is the band gap of GaAs?", "The band gap of GaAs is -1.0 eV, but that value is unreliable.", False),
        ("formation_energy", "What is the formation energy of SiC?", "The formation energy of SiC is 0.8 eV/atom.", True), ("stability", "Is SiC stable?", "SiC is stable.", True),
        ("band_gap", "What is the band gap of GaAs?", "The band gap of GaAs is 12.0 eV.", False),
    ], "constraint_family string, question string, answer string, judge boolean")
    rows = with_claims(rows).withColumn("violations", violations())
    n = {r["variant"]: (r["n"], r["n_bad"]) for r in studies.ablation(rows, "judge").collect()}
    assert set(n) == set(L.ABLATIONS) and n["full_optimized"] == (5, 2) and n["l0_only"] == (5, 1) and n["l1_only"] == (5, 1)
    assert n["strict_no_source_reliability_exception"] == (5, 3) and n["drop_band_gap_records"] == (2, 1) and n["drop_formation_energy_records"] == (4, 2)
    g = {r["variant"]: r["n_bad"] for r in studies.guard_sweep(rows).collect()}
    assert g["default"] == 2 and g["band_gap_upper_10"] == 3 and g["formation_range_narrow"] == 3 and set(g) == set(L.GUARDS)


def test_probes(spark):
    rows = studies.probes(spark, 6).collect()
    assert len(rows) == 2 * 6 * len(studies.PROBES) and len({r["probe_id"] for r in rows}) == len(rows)
    assert {r["document_status"] for r in rows} == set(L.STATUSES[:3]) and not any("{" in r["question"] + r["answer"] for r in rows)


def test_progress_listener():
    told = []
    p = scoring.Progress(25, told.append)

    class Event:
        class progress:
            numInputRows = 20

    for _ in range(4):
        p.onQueryProgress(Event)
    assert told == [40, 60, 80]


def test_threshold_grid_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def support(x):
        seen.add(1)
        return x / 10

    rows = spark.range(30).select((F.col("id") % 3).cast("string").alias("c"), support(F.col("id") % 10).alias("s"), (F.col("id") % 2).cast("double").alias("g"))
    got = studies.threshold_grid(rows, "s", "g", "c", reps=20).collect()
    assert len(got) == len(L.TAU_F) * len(L.TAU_G) and all(r["n"] == 30 for r in got)
    assert all(r["n_high"] == sum(i % 10 / 10 >= r["tau_f"] for i in range(30)) for r in got) and seen.value == 30
