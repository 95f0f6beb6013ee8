"""Order statistics, retrieval, sinks, caches, files and scorers against plain Python."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.functions import batch
from claimloom.functions import support as S
from claimloom.operators import metrics as M
from claimloom.operators import order as O
from claimloom.operators import resample as B
from claimloom.operators import retrieval as R
from claimloom.operators import selection as D
from claimloom.operators import studies
from claimloom.sources import files, scratch
from claimloom.sources.cache import ScoreCache
from claimloom.streaming import scoring
from claimloom.streaming.ledger import Ledger


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_numbers_and_ranks_without_exchange_reuse(spark, no_reuse):
    n = 2_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"), (F.col("id") % 5).alias("g"), F.pmod(F.xxhash64("id"), F.lit(700_000)).alias("v"))
    got = D.numbered(rows.select("k"), "k", "i").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.min("i").alias("low"), F.max("i").alias("high")).first()
    assert tuple(got) == (n, n, 0, n - 1)
    ranked = O.ranks(rows, ["g"], "v", "r").groupBy("g").agg(F.count("*").alias("n"), F.sum("r").alias("s")).collect()
    assert all(r["n"] == n // 5 and r["s"] == r["n"] * (r["n"] + 1) / 2 for r in ranked) and len(ranked) == 5
    placed = [r["i"] for r in D.numbered(rows.select("k").limit(5000), "k", "i").orderBy("k").collect()]
    assert placed == list(range(5000))


def test_spearman_on_counts(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x), float(y)) for x, y in zip(rng.integers(0, 9, 400), rng.integers(0, 300, 400), strict=True)] + [("b", 1.0, float(i)) for i in range(9)] + [("c", None, 1.0)]
    got = {r["g"]: (r["n"], r["rho"]) for r in O.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    x, y = (np.array([r[k] for r in rows if r[0] == "a"]) for k in (1, 2))
    want = np.corrcoef(B.weighted_rank(x, np.ones(400, int)), B.weighted_rank(y, np.ones(400, int)))[0, 1]
    assert got["a"][0] == 400 and abs(got["a"][1] - want) < 1e-12 and got["b"] == (9, None) and "c" not in got


def test_robustness_is_worked_out_from_counts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kept, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, tag: (out := keep(df, tag), kept.append(out.count()))[0])
    v = {"a": rng.integers(0, 40, 3000) / 39, "b": rng.integers(0, 7, 3000) / 6, "flat": np.full(3000, 0.1)}
    score = rng.integers(0, 2, 3000).astype(float)
    rows = spark.createDataFrame([(n, float(x), float(s)) for n, xs in v.items() for x, s in zip(xs, score, strict=True)], "estimator string, support double, constraint_score double")
    twice = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    for got in (studies.estimator_robustness(rows, "b"), studies.estimator_robustness(twice, "b", times="times")):
        got = {r["estimator"]: r for r in got.collect()}
        assert got.keys() == v.keys() and max(kept) < 120  # counts alone are written, not 9,000 rows
        for n, xs in v.items():
            r, least = got[n], np.quantile(xs, 1 - np.mean(v["b"] >= 0.8))
            assert (r["n"], r["n_fixed"], r["n_fixed_divergent"]) == (3000, (xs >= 0.8).sum(), ((xs >= 0.8) & (score < 1)).sum())
            assert math.isclose(r["threshold"], least) and (r["n_matched"], r["n_matched_divergent"]) == ((xs >= least).sum(), ((xs >= least) & (score < 1)).sum())
            assert math.isclose(r["mean"], xs.mean()) and (r["pearson"] is None if n == "flat" else math.isclose(r["pearson"], np.corrcoef(xs, score)[0, 1], abs_tol=1e-12))


@pytest.mark.parametrize("name", ["estimator_robustness", "four_estimators"])
def test_robustness_keeps_no_row_for_a_record(spark, monkeypatch, tmp_path, name):
    """Such rows take few bytes in a file, and by those Spark broadcast them all."""
    import duckdb

    import __spark_entry__

    spark.range(2000).select((F.col("id") % 40).alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    kept, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, tag: (out := keep(df, tag), kept.append(out.count()))[0])
    got = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect())
    assert max(kept) <= 40 * 16  # of 32,000 records
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert [r[0] for r in got] == [r[0] for r in want] and all(r[1] == 32_000 for r in got)
    assert all(x == y or math.isclose(x, y, abs_tol=2e-6) for g, w in zip(got, want, strict=True) for x, y in zip(g[1:], w[1:], strict=True))


def test_quantiles_of_counts(spark):
    rng = np.random.default_rng(6)
    values = {"wide": 10.0 ** rng.uniform(-300, 300, 500) * rng.choice([-1, 1], 500), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.full(50, 7.0)}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("ties", None), ("ties", math.nan), ("none", None)], "g string, v double")
    at = frame.select("g").distinct().crossJoin(O.shares([0.0, 0.01, 0.5, 0.937, 1.0], frame))
    counts = frame.groupBy("g", "v").agg(F.count("*").alias("times"))
    got = {(r["g"], r["p"]): (r["quantile"], r["n"]) for r in O.quantiles_of(counts, ["g"], "v", "times", at).collect()}
    assert len(got) == 15 and all(math.isclose(x, np.quantile(values[g], p), rel_tol=1e-12) and n == len(values[g]) for (g, p), (x, n) in got.items())


def test_equal_rows_are_counted_once(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 4).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    assert sorted((r["a"], r["b"], r["times"]) for r in D.counted(rows, ["a", "b"]).collect()) == [(0, "x", 1000), (1, None, 1000), (2, "x", 1000), (3, None, 1000)]
    assert D.counted(rows, ["id"]).agg(F.count("*"), F.sum("times")).first()[:] == (4000, 4000)  # nothing comes twice


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles_are_those_of_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW", few)
    rng = np.random.default_rng(2)
    values = {"wide": 10.0 ** rng.uniform(-300, 300, 3000) * rng.choice([-1, 1], 3000), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.full(50, 7.0), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("ties", None), ("ties", math.nan), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.01, 0.5, 0.937, 1.0]
    at = frame.select("g").distinct().crossJoin(O.shares(shares, frame))
    got = {(r["g"], r["p"]): r["quantile"] for r in O.quantiles(frame, ["g"], "v", at).collect()}
    want = {(g, p): float(np.quantile(vs, p)) for g, vs in values.items() for p in shares}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    (every,) = O.quantiles(frame.filter("g = 'two'"), [], "v", O.shares([0.25], frame)).collect()
    assert every["quantile"] == 1.25


def test_a_row_is_read_once_for_all_places_of_its_interval(spark, monkeypatch):
    seen, inside = [], O._inside
    monkeypatch.setattr(O, "_inside", lambda *a: (seen.append(inside(*a).count()), inside(*a))[1])
    rows = spark.range(10_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    got = O.quantiles(rows, ["g"], "v", rows.select("g").distinct().crossJoin(O.shares([0.1, 0.5, 0.9], rows))).collect()
    values = {g: np.array([i * 7919 % 10_007 for i in range(g, 10_000, 2)], float) for g in (0, 1)}
    assert len(got) == 6 and all(math.isclose(r["quantile"], np.quantile(values[r["g"]], r["p"])) for r in got)
    assert max(seen) == 10_000


def test_work_is_done_once_for_equal_values(spark):
    given = []

    def work(rows):
        given.append(rows.count())
        return rows.withColumns({"n": (F.coalesce(F.length("a"), F.lit(-1)) if "a" in rows.columns else F.lit(0)), "same": F.lit(True) if "b" not in rows.columns else F.col("b").isNull()})

    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, F.repeat(F.lit("x"), (F.col("id") % 4).cast("int"))).alias("a"), F.when(F.col("id") % 2 == 0, 1).alias("b"))
    for most in (D.MOST_VALUES, 0):  # broadcast, and not
        D.MOST_VALUES, before = most, D.MOST_VALUES
        try:
            got = D.by_value(rows, ["a", "b"], work).orderBy("id").collect()
        finally:
            D.MOST_VALUES = before
        assert [(r["id"], r["n"], r["same"]) for r in got] == [(i, i % 4 or -1, i % 2 == 1) for i in range(4000)]
    assert given == [4, 4]
    assert D.by_value(rows, ["id"], work).count() == 4000 and given[2:] == [4000]  # nothing comes twice


def test_interval_of_ranks_over_more_rows_than_a_bag(spark):
    n, reps = 21_000, 12
    x, y = np.arange(n) % 97, (np.arange(n) * 7 + np.arange(n) % 97) % 11
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(n, None, 1.0)], "k long, x double, y double")
    got = B.spearman_interval(rows, "k", "x", "y", reps).first()
    hashes = np.array([r["h"] for r in rows.filter("x IS NOT NULL").orderBy("k").select(F.conv(F.substring(F.md5(F.col("k").cast("string")), 1, 8), 16, 10).cast("long").alias("h")).collect()])
    again = [B.weighted_spearman(x, y, B.drawn(hashes, rep, B.poisson_steps(1))) for rep in range(reps)]
    want = (B.weighted_spearman(x, y, np.ones(n, int)), *np.quantile(again, [0.025, 0.975]))
    assert got["n"] == n and np.allclose([got[c] for c in ("point", "ci_low", "ci_high")], want, rtol=0, atol=1e-12)


def test_little_bootstraps(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(600)
    y = x + rng.standard_normal(600)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(700, None, 1.0)], "k long, x double, y double")
    one = B.little_bootstraps(rows, "k", "x", "y", B.weighted_spearman, 200).first()
    ones = np.ones(600, int)
    assert one["bags"] == 1 and one["n"] == 600 and abs(one["point"] - B.weighted_spearman(x, y, ones)) < 1e-12
    # the weights are those that rows drawn by Spark have
    drawn = B.weighted(rows.filter("x IS NOT NULL").select("k", F.conv(F.substring(F.md5(F.col("k").cast("string")), 1, 8), 16, 10).cast("long").alias("hash"), F.lit(17).cast("long").alias("rep"))).orderBy("k").collect()
    assert [r["weight"] for r in drawn] == B.drawn(np.array([r["hash"] for r in drawn]), 17, B.poisson_steps(1)).tolist()
    many = B.little_bootstraps(rows, "k", "x", "y", B.weighted_spearman, 200, bag_rows=100).first()
    assert many["bags"] == 6 and many["ci_low"] < one["point"] < many["ci_high"]
    assert 0.6 < (many["ci_high"] - many["ci_low"]) / (one["ci_high"] - one["ci_low"]) < 1.6
    gap = B.little_bootstraps(rows.withColumn("y", F.col("y") + 1), "k", "y", "x", B.median_gap, 100).first()
    assert 0.5 < gap["ci_low"] < gap["ci_high"] < 1.5
    again = np.repeat(np.arange(600), w := np.array(B.drawn(np.arange(600) * 7919, 3, B.poisson_steps(1))))
    assert math.isclose(B.weighted_spearman(x, y, w), B.weighted_spearman(x[again], y[again], np.ones(len(again), int)))
    steps = B.poisson_steps(50.0)
    assert abs(np.mean(B.drawn(rng.integers(0, 2**32, 20_000), 1, steps)) - 50) < 0.5
    assert B.little_bootstraps(rows.limit(0), "k", "x", "y").first()["bags"] == 0


def plain_bm25(docs, queries, k, boosts):
    token = S.TOKEN
    import re

    words = {d: re.findall(token, (t or "")) for d, t, _ in docs}
    words = {d: [w.lower() for w in ws] for d, ws in words.items()}
    n, average = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        scores = {}
        for d, _, formula in docs:
            tf, length, s = Counter(words[d]), max(1, len(words[d])), 0.0
            for w in re.findall(token, text or ""):
                f = tf[w.lower()]
                if f:
                    s += math.log(1 + (n - df[w.lower()] + 0.5) / (df[w.lower()] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / average))
            scores[d] = s + (20.0 if boosts and formula and formula in text else 0.0)
        best = sorted(scores, key=lambda d: (-round(scores[d], 4), d))[:k]
        out += [(q, r, d, round(scores[d], 4)) for r, d in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("boosts", [False, True])
def test_block_maxima_lose_no_document(spark, boosts):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(rng.choices(vocab, weights=range(80, 0, -1), k=rng.randrange(0, 60))), rng.choice(["GaAs", None, None, "TiO2"])) for i in range(400)]
    docs[3] = (3, None, "GaAs")
    queries = [(q, " ".join(rng.sample(vocab, 6)) + (" GaAs" if q % 2 else "")) for q in range(12)] + [(90, "unknown"), (91, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, formula string")
    asked = spark.createDataFrame(queries, "query_id long, query string")
    blocks = R.postings(frame, size=8)
    kept = frame.select("doc_id", "formula") if boosts else None
    for first in (1, 4):
        found = R.search(blocks, asked, formulas=kept, k=5, first=first)
        got = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 4)) for r in found.collect())
        assert got == plain_bm25(docs, queries, 5, boosts)


def test_tasks_of_an_index_grow_with_the_documents(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK", 2)
    docs = spark.createDataFrame([(i, f"w{i % 9} x") for i in range(400)], "doc_id long, text string")
    sizes = [r["count"] for r in R.postings(docs, size=8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10  # 50 parts, two a task


def test_kept_index_is_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert R.kept(docs).inputFiles() == R.kept(spark.read.parquet(str(tmp_path / "d"))).inputFiles()
    spark.createDataFrame([(3, "c d e")], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "d"))
    again = R.kept(spark.read.parquet(str(tmp_path / "d")))
    assert {r["term"] for r in again.collect()} == {"", "c", "d", "e"}


def test_ledger_holds_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(40)], "id long, kind string, v long")
    out, stops = str(tmp_path / "out"), {0, 2}

    def between(number):
        if number in stops:
            stops.discard(number)
            raise RuntimeError("stopped")

    def ledger():
        return Ledger(spark, out, "id", "id long, kind string, v long", ("kind",), {"n": F.count("*"), "s": F.sum("v")}, between)

    log = ledger()
    for number, (low, high) in enumerate([(0, 20), (10, 30), (5, 40)]):
        part = rows.filter((F.col("id") >= low) & (F.col("id") < high))
        if number in stops:
            with pytest.raises(RuntimeError):
                log.write(part.unionAll(part), number)
            assert str(number) not in log.entered()  # what it left is not read
            log = ledger()
        log.write(part.unionAll(part), number)
        log.write(part, number)  # replayed after it was entered
    assert sorted(r["id"] for r in log.log().collect()) == list(range(40))
    assert {r["kind"]: (r["n"], r["s"]) for r in log.metrics().collect()} == {"a": (20, 380), "b": (20, 400)}
    empty = Ledger(spark, str(tmp_path / "none"), "id", "id long, kind string, v long", ("kind",), {"n": F.count("*")})
    assert empty.log().count() == 0 and empty.metrics().count() == 0
    empty.write(rows.limit(0), 0)
    assert empty.entered() == ["0"] and empty.log().count() == 0


def test_watermark_bounds_what_is_kept(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    kept, made = [], 0
    for day in range(5):
        rows = spark.range(200).select((F.col("id") + 200 * day).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000 + 86_400 * day) + F.col("id") * 60).alias("ts"))
        rows.unionAll(rows).unionAll(rows.withColumn("ts", F.col("ts") - F.expr("INTERVAL 3 DAYS")).withColumn("k", F.col("k") + 10_000)).write.mode("append").parquet(src)
        stream = scoring.once_within(spark.readStream.schema(rows.schema).parquet(src), "k", "ts", "1 hour")
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        run.awaitTermination()
        made += 200
        kept.append(max((s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]), default=0))
    got = spark.read.parquet(out)
    assert got.filter("k < 10000").count() == made and got.filter("k < 10000").select("k").distinct().count() == made
    assert kept[-1] < 700  # of 1,000 keys and as many late ones
    assert got.filter("k >= 10000").count() <= 400  # late ones are dropped once the watermark has passed


def test_cache_is_read_before_or_after_a_compaction(spark, tmp_path, monkeypatch):
    cache = ScoreCache(spark, str(tmp_path / "c"), "key string, seq long, score double", "key", "seq")
    assert cache.read().count() == 0 and not cache.compact()

    def rows(*entries):
        return spark.createDataFrame(list(entries), "key string, seq long, score double")

    def held(c):
        return {r["key"]: r["score"] for r in c.read().collect()}

    assert [cache.append(rows(("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3))), cache.append(rows(("b", 0, 0.4)))] == [1, 2]
    want = {"a": 0.2, "b": 0.4}  # a later part wins over a later order
    assert held(cache) == want
    before = cache.read()  # planned before the compaction, run after it
    assert cache.compact() and held(cache) == want and {r["key"]: r["score"] for r in before.collect()} == want
    other = ScoreCache(spark, str(tmp_path / "c"), "key string, seq long, score double", "key", "seq")
    cache.append(rows(("c", 1, 0.9)))
    state = other.state()
    assert cache.compact()
    monkeypatch.setattr(other, "state", lambda: state)  # saw the state before, so it comes second and is dropped
    assert not other.compact() and held(cache) == want | {"c": 0.9}
    cache.append(rows(("c", 0, 1.0)))
    cache.vacuum()
    assert held(cache) == want | {"c": 1.0}
    assert cache.append(rows(("d", 0, 1.0))) == 5


def test_atom_entries_and_digests(spark, tmp_path):
    good = '<entry><id>http://x.org/abs/1</id><title> A\n title </title><summary>s &amp; t</summary><published>2024</published><updated>2025</updated><author><name>P Q</name></author><author><name>R</name></author></entry>'
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.xml").write_text(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">\n<title>feed</title>{good}<entry><id>2</id><open></entry>\n{good.replace("abs/1", "abs/3")}\n</feed>')
    (tmp_path / "f" / "two.xml").write_text("<feed></feed>")
    rows = files.read_atom(spark, str(tmp_path / "f")).collect()
    assert sorted(r["source_id"] or "" for r in rows) == ["", "1", "3"] and [r["corrupt"] is not None for r in rows].count(True) == 1
    first = next(r for r in rows if r["source_id"] == "1")
    assert (first["title"], first["summary"], first["authors"], first["url"]) == ("A title", "s & t", "P Q; R", "http://x.org/abs/1")
    import hashlib

    got = {r["file"]: (r["length"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path / "f")).collect()}
    assert got == {p.name: (len(p.read_bytes()), hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "f").iterdir()}
    ids = spark.createDataFrame([(10, "a"), (2, "a"), (10, "a"), (3, "b")], "id int, g string")
    lists = {r["g"]: (r["n_ids"], r["sha256"]) for r in files.id_lists(ids, "id", "g").collect()}
    assert lists == {"a": (2, hashlib.sha256(b"10\n2").hexdigest()), "b": (1, hashlib.sha256(b"3").hexdigest())}
    assert files.id_lists(ids, "id").first()["n_ids"] == 3
    with pytest.raises(Exception, match="too many ids"):
        files.id_lists(ids, "id", "g", most=1).collect()


def test_files_of_unlike_columns(spark, tmp_path):
    (tmp_path / "a_v2.csv").write_text('id,text\n1,"x, ""y""\nz"\n')
    (tmp_path / "b_v2.csv").write_text("text,year\nq,2020\n")
    (tmp_path / "other.csv").write_text("no\n1\n")
    got = {r["collector_file"]: r for r in files.read_many(spark, str(tmp_path / "*_v2.csv"), "csv", keys={"name": r"([a-z]+)_v2"}).collect()}
    assert got["a_v2.csv"].asDict() == {"id": "1", "text": 'x, "y"\nz', "year": None, "name": "a", "collector_file": "a_v2.csv"} and got["b_v2.csv"]["year"] == "2020"
    spark.createDataFrame([(1, 2.0)], "a int, b double").coalesce(1).write.parquet(str(tmp_path / "p" / "x"))
    spark.createDataFrame([("s",)], "c string").coalesce(1).write.parquet(str(tmp_path / "p" / "y"))
    rows = files.read_many(spark, str(tmp_path / "p" / "*" / "*.parquet"), "parquet", keys={"kind": r"/p/([xy])/"}).collect()
    assert {r["kind"]: (r["a"], r["c"]) for r in rows} == {"x": (1, None), "y": (None, "s")}


def test_batch_scorers_load_once_and_fit_the_registry(spark):
    rows = spark.createDataFrame([("q", "abcd", "abcd"), ("q", "abc", "xyz"), (None, None, "x"), ("q", "", "")], "question string, answer string, context string")
    score = S.scorer("trigram")(F.col("question"), F.col("answer"), F.col("context"))
    assert [round(r[0], 12) for r in rows.select(score.alias("s")).collect()] == [1.0, 0.0, 0.0, 0.0]
    provided, method = S.provided_or("trigram", F.when(F.col("answer") == "abc", 0.5), F.col("question"), F.col("answer"), F.col("context"))
    got = rows.select(provided.alias("s"), method.alias("m")).collect()
    assert (got[1]["s"], got[1]["m"], got[0]["m"]) == (0.5, "provided_column", "trigram")

    def counting():
        calls = []

        def score(q, a, c):
            calls.append(len(q))
            return [float(len(calls))] * len(q)

        return score

    batch.register_batch("counting", counting)
    many = spark.range(500).repartition(1).select(F.lit("a").alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        seen = {r["s"] for r in many.select(S.scorer("counting")(F.col("t"), F.col("t"), F.col("t")).alias("s")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen == {1.0, 2.0, 3.0, 4.0, 5.0}  # one maker for all batches of a task


def test_ngram_cosine_counts_runs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "d", "ee_1"], k=rng.randrange(0, 30))) for _ in range(40)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts[:20], texts[20:], strict=True))] + [(99, None, "aa")], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in rows.select("i", S.ngram_cosine(F.lit(""), F.col("a"), F.col("b")).alias("s")).collect()}

    def grams(t):
        w = [x for x in (t or "").split() if len(x) > 1]
        return Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)])

    for r in rows.collect():
        a, b = grams(r["a"]), grams(r["b"])
        norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        assert math.isclose(got[r["i"]], min(1.0, sum(v * b[k] for k, v in a.items()) / norm) if norm else 0.0, abs_tol=1e-12)


def test_ascii_ngrams_counts_a_context_once(spark):
    texts = ["aa bb aa", "Aa_1 bb-cc é dd", "", "x y", "aa bb cc " * 40]
    plain = [re.sub("[^A-Za-z0-9_]", " ", t) for t in texts]
    rows = spark.createDataFrame([(i, j, texts[i], texts[j], plain[i], plain[j]) for i in range(5) for j in range(5)], "i int, j int, a string, b string, pa string, pb string")
    got = rows.select(S.scorer("ascii_ngrams")(F.lit(""), F.col("a"), F.col("b")).alias("s"), S.ngram_cosine(F.lit(""), F.col("pa"), F.col("pb")).alias("t")).collect()
    assert [r["s"] for r in got] == [r["t"] for r in got] and sum(r["s"] > 0 for r in got) >= 9
    for most in (1, 500_000):  # contexts that are dropped on the way are counted again
        assert batch.ascii_ngrams(most)([""] * 4, ["aa bb", "cc", "aa bb", "cc"], ["aa bb", "cc dd", "aa bb", "cc dd"]) == pytest.approx([1, 3**-0.5, 1, 3**-0.5])
    began = time.time()  # a long context for many answers
    assert len(batch.ascii_ngrams()([""] * 2000, ["aa bb"] * 2000, ["aa bb cc dd " * 5000] * 2000)) == 2000
    assert time.time() - began < 10


def test_overlap_of_sets_refuses_many(spark):
    rows = spark.range(70).select(F.col("id").alias("k"), F.col("id").cast("string").alias("name"))
    with pytest.raises(ValueError, match="64"):
        M.set_overlap(rows, "k", "name")


def test_pairs_of_both_kinds(spark):
    got = D.paired(spark.range(10).withColumnRenamed("id", "k"), "k").collect()
    assert sorted((r["k"], r["other"]) for r in got if r["matched"]) == [(i, i) for i in range(10)]
    assert sorted((r["k"], r["other"]) for r in got if not r["matched"]) == [(i, (i + 3) % 10) for i in range(10)]


def test_small_branches(spark):
    from claimloom.sources import io

    rows = spark.createDataFrame([(3, "f", None, "a;B", "b; a"), (1, "f", "x", "", ""), (2, "g", " ", "a", "c")], "id int, file string, text string, p string, g string")
    assert [(r["id"], r["n"]) for r in io.head(rows.withColumn("n", F.when(F.col("id") > 1, F.col("id"))), 2, "id").collect()] == [(1, 0), (2, 2)]
    assert {r["file"]: (r["n_missing"], r["first_missing"]) for r in D.first_missing(rows, "file", "id", ["text"]).collect()} == {"f": (1, 3), "g": (1, 2)}
    (r,) = M.field_agreement(rows, {"k": ("p", "g")}).collect()
    assert (r["n"], round(r["exact"], 9), round(r["jaccard"], 9)) == (3, round(2 / 3, 9), round(2 / 3, 9))
    text = F.col("text")
    score, _ = S.provided_or("lexical", F.when(F.col("id") == 1, 0.5), text, text, text, strict=True)
    assert rows.filter("id = 1").select(score).first()[0] == 0.5
    with pytest.raises(Exception, match="no provided score"):
        rows.select(score.alias("s")).collect()
    assert D.stratified(rows, "file", "id", 1, 2).count() == 2


def test_blank_text_settings_and_documents(spark, tmp_path, monkeypatch):
    import json
    import os

    from claimloom.sources import io

    (tmp_path / "c.csv").write_text("id,text\n1,\n2,x\n")
    kept = io.read_csv(spark, str(tmp_path / "c.csv"), "id string, text string", keep_blank=True, source_column="file")
    assert {r["id"]: r["text"] for r in kept.collect()} == {"1": "", "2": "x"} and kept.first()["file"].endswith("c.csv")
    assert io.read_csv(spark, str(tmp_path / "c.csv"), "id string, text string").filter("text IS NULL").count() == 1
    (tmp_path / "env").write_text("# no=1\nNEW_SETTING = 'a b'\nOLD_SETTING=new\nno line\n")
    monkeypatch.setenv("OLD_SETTING", "old")
    monkeypatch.delenv("NEW_SETTING", raising=False)
    io.load_env(str(tmp_path / "env"))
    assert os.environ["NEW_SETTING"] == "a b" and os.environ["OLD_SETTING"] == "old"
    monkeypatch.delenv("NEW_SETTING")
    io.write_document(spark.createDataFrame([(1, ["a"])], "n int, tags array<string>"), str(tmp_path / "doc"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "doc")).collect()] == [{"n": 1, "tags": ["a"]}]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "y.yaml").write_text(yaml.safe_dump({"a": [1]}))
    assert io.read_yaml(str(tmp_path / "y.yaml")) == {"a": [1]}
