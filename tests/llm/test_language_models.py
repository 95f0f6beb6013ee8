"""Kneser-Ney models against a plain computation, and the operators on them: language, quality rules."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import charlm, language, quality

DOCS = "doc_id long, text string, lang string, source string, grp string, size int"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en", "s", "x", i) for i, t in enumerate(texts)], DOCS)


def plain_model(units, order, alphabet):
    """p(context, character), by the definitions."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for u in units:
        t = f" {u} "
        for i in range(1, len(t)):
            counts[min(order, i + 1)][t[max(0, i - order + 1) : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    cuts = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        if min(n):
            y = n[0] / (n[0] + 2 * n[1])
            due = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            cuts[k] = [min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(due, 1)]
        else:
            cuts[k] = [0.5, 0.75, 1.0]

    def p(h, c):
        k, lower = len(h) + 1, p(h[1:], c) if h else 1 / alphabet
        seen = {g: v for g, v in counts[k].items() if g[:-1] == h}
        if not seen:
            return lower
        total, d = sum(seen.values()), cuts[k]
        a = counts[k].get(h + c, 0)
        return (a - d[min(a, 3) - 1] if a else 0) / total + sum(d[min(v, 3) - 1] for v in seen.values()) / total * lower

    return p


def test_models_follow_the_definition(spark, monkeypatch):
    rng = random.Random(1)
    docs = [("g", rng.choice(["ab c", "abca b", "cab", "b a", "", "aab bb c"]) + " " + "".join(rng.choice("abc d") for _ in range(rng.randrange(30)))) for _ in range(25)]
    docs = [(g, " ".join(t.split())) for g, t in docs] + [("h", "xy z")] * 3
    order = 3
    df = spark.createDataFrame(docs, "grp string, text string")
    fitted, each = (charlm.fit(df, quality.joined, order, own=own) for own in (False, True))
    alphabet = round(math.exp(-fitted.floor))
    plain = {g: plain_model([t for x, t in docs if x == g], order, alphabet) for g in "gh"}

    def total(g, u):
        t = f" {u} "
        return sum(math.log(plain[g](t[max(0, i - order + 1) : i], t[i])) for i in range(1, len(t)))

    asked = ["ab c", "zz", "abcabc ab", "x", "xy a", "", "cab" * 9]
    for window in (1 << 20, 7):  # long units are read in stretches
        monkeypatch.setattr(charlm, "WINDOW", window)
        for g in "gh":
            got, n = each.model.under(asked, [g] * len(asked))
            assert np.allclose(got, [total(g, u) for u in asked], atol=1e-4) and n.tolist() == [len(u) + 1 for u in asked]
        assert np.allclose(fitted.model.every(asked)[0], [[total(g, u) for g in fitted.groups] for u in asked], atol=1e-4)
    known = sorted({c for _, t in docs for c in f"{t} "})
    assert len(known) + 1 == alphabet
    for h in ("", " ", "a", "ab", "zz"):  # known characters have all of the mass but that of the one unknown
        mass = sum(plain["g"](h[-2:], c) for c in known)
        assert 0.8 < mass < 1


def test_counts_of_many_small_pieces_are_those_of_one(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh ") for _ in range(80)).split()) for _ in range(300)]
    df = spark.createDataFrame([("g", t) for t in texts], "grp string, text string").repartition(7)
    want = Counter()
    for t in texts:
        u = f" {t} "
        for i in range(1, len(u)):
            want[u[max(0, i - 3) : i + 1]] += 1
    monkeypatch.setattr(charlm, "HELD", 50)
    assert {r["gram"]: r["n"] for r in charlm.count(df, quality.joined, 4).collect()} == want


# 4


def language_docs(spark):
    rng = random.Random(6)
    parts = {"xx": ["ba", "ke", "lo", "mun"], "yy": ["tri", "ska", "vo", "zet"], "zz": ["ñu", "él", "qua", "ó"]}
    rows = []
    for i in range(240):
        lang = ("xx", "yy", "zz")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40)).capitalize() + ".", lang))
    rows += [(240, None, "xx"), (241, "", None), (242, "123 ... ½", None), (243, rows[0][1], None), (244, "w" * 3000, "yy"), (None, "bake", None), (245, rows[0][1] + " lo" * 100_000, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("grp", F.lit(1))


def test_language(spark):
    import zlib

    rows, docs = language_docs(spark)
    judge = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, judge).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    assert [got[i]["lang_pred"] for i in (240, 241, 242)] == ["und"] * 3 and got[243]["lang_pred"] == got[245]["lang_pred"] == rows[0][2]
    assert got[240]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values()) and judge.bound < 10
    assert language.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), judge).count() == 0


def test_language_with_a_model_too_large_to_broadcast(spark):
    rows, docs = language_docs(spark)
    docs = docs.unionAll(docs.limit(3))
    one, other = language.train(docs), language.train(docs, max_rows=0, chunk_chars=20_000)
    assert other.fitted.model is None and (one.temperature, one.bound) == pytest.approx((other.temperature, other.bound))
    a, b = (sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in language.identify(docs, j, 20_000).collect()) for j in (one, other))
    assert a == b and len(a) == len(rows) + 3


# 7


def quality_texts():
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice(["ka", "lo", "mi", "te"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)) for _ in range(120)]
    texts += [None, "", "#$ a\n\nb\nb\n b\n|<>", "x y z v w " * 30, "é ü " * 12, "qzxj wvbk " + " ".join(f"{a}{b}xqzj" for a in "qwxzj" for b in "bdfgh") * 2, texts[0]]
    texts += [" ".join(t.upper().split()) for t in texts[3:6]] + ["one two three four five six seven eight nine ten eleven one two three four five", "w " * 70_000 + "end\n" * 3, "a\x0bb\x0cc\rd\te f g h i j k"]
    return texts


def test_quality(spark):
    texts = quality_texts()
    langs = ["en"] * 100 + [None] * (len(texts) - 100)
    docs = docs_of(spark, texts, langs)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[ \t\n\v\f\r]+", t or "") if x]
        win = defaultdict(list)
        for j in range(len(w) - 4):
            win[tuple(w[j : j + 5])].append(j)
        rep = {j + k for js in win.values() if len(js) > 1 for j in js for k in range(5)}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^ \t\n\v\f\r]", line):
                dup += line in lines
                lines.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(rep))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, (t or "")[:80])
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    assert sum(got[i]["kept"] for i in range(120)) >= 116 and not got[125]["kept"] and not any(got[i]["kept"] for i in range(127, 130))
    assert quality.judge(docs.limit(0)).count() == 0 and quality.judge(docs_of(spark, [None, "", "  "])).count() == 3


def test_quality_rejects_shuffled_words_and_too_plain_texts(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    follow = {w: rng.sample(vocab, 3) for w in vocab}

    def text(n):
        out = [rng.choice(vocab)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    plain = [text(150) for _ in range(300)]
    mixed = [rng.sample(t, len(t)) for t in plain[:10]]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, [" ".join(t) for t in plain + mixed])).collect()}
    fine = [got[i] for i in range(300) if not got[i]["base_failed"]]
    assert len(fine) > 200 and sum(r["kept"] for r in fine) >= 0.97 * len(fine)
    assert not any(got[300 + i]["kept"] or got[300 + i]["logppl"] <= got[300 + i]["high"] for i in range(10))


def test_quality_rejects_too_plain_texts(spark):
    rng = random.Random(13)
    parts = [a + b for a in "bdfgklmnprstvz" for b in "aei"]

    def text(kinds):
        return " ".join("".join(rng.choices(kinds, [1 / (i + 1) for i in range(len(kinds))], k=rng.randrange(1, 6))) for _ in range(120))

    texts = [text(parts) for _ in range(300)] + [text(parts[:2]) for _ in range(4)]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts)).collect()}
    assert sum(got[i]["kept"] for i in range(300)) >= 291 and not any(r["base_failed"] for r in got.values())
    assert all(not got[300 + i]["kept"] and got[300 + i]["logppl"] < got[300 + i]["low"] for i in range(4))


def test_quality_with_a_model_too_large_to_broadcast(spark):
    docs = docs_of(spark, quality_texts())
    a, b = ({r["doc_id"]: r.asDict() for r in quality.judge(docs, max_rows=m, chunk_chars=5_000).collect()} for m in (10**6, 0))
    for i, r in a.items():
        assert b[i].pop("logppl") == pytest.approx(r.pop("logppl"), abs=1e-9) and b[i].pop("low") == (pytest.approx(r["low"]) if r["low"] is not None else None)
        assert {k: v for k, v in r.items() if k in ("n_words", "n_repeat_words", "kept", "base_failed")} == {k: v for k, v in b[i].items() if k in ("n_words", "n_repeat_words", "kept", "base_failed")}


def test_least_hashed_rows_are_those_of_a_full_sort(spark):
    from claimloom.llm.common import least_hashed

    rows = spark.range(50_000).select("id", (F.col("id") % 7).alias("row_hash"))
    want = [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    got = least_hashed(rows, 300, "id")
    assert got.columns == rows.columns and sorted(r["id"] for r in got.collect()) == sorted(want)
    assert least_hashed(rows.limit(20), 300, "id").count() == 20 and least_hashed(rows.limit(0), 300, "id").count() == 0
