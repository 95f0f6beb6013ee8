"""Plain-Python twins of what neither SQL nor the other tests work out anew: the URL filter's probability, the quality
bands, the toxicity score and the calibration of the language models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import language, quality, toxicity, urls


def murmur3(data: bytes, seed: int = 42) -> int:
    """MurmurHash3, 32 bits, as a signed number."""
    m = 0xFFFFFFFF
    h = seed
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little")
        h = (rotl(h ^ (rotl(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m), 13) * 5 + 0xE6546B64) & m
    if data[whole:]:
        h ^= rotl(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_url_probability(spark):
    model, bits = urls.fit(spark), 14
    pages = ["http://WWW.Shop.example.com/en/a?q#f", "https://x.net/de/1", "no scheme", None, "ftp://a/", "http://é.org/ü/ß", "://host", "http://a.b.c/" + "p" * 3000]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    coef, bias = model.coefficients.toArray(), model.intercept
    for r in urls.judge_urls(rows, model).collect():
        seen = set()
        for tag, part in (("h:", r["host"]), ("p:", r["path"])):
            s = f"^{part}$"
            seen |= {murmur3((tag + s[i : i + 2]).encode()) % (1 << bits) for i in range(len(s) - 1)}
        z = bias + sum(coef[k] for k in seen)
        assert r["p_block"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert r["verdict"] == ({"com/": "allow"}.get(r["rule"]) or ("block" if r["p_block"] >= 0.5 else "allow")) or r["rule"] not in (None, "com/")


def test_url_model_is_at_the_optimum(spark):
    """The gradient of the penalised loss on standardised features is nothing."""
    labelled = [(u, y) for u, y in urls.LABELLED if not urls.held_out(u)]
    model = urls.fit(spark, iterations=500)
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "page_id long, url string")
    p = np.array([r["p_block"] for r in urls.judge_urls(rows, model).orderBy("page_id").collect()])
    y = np.array([float(y) for _, y in labelled])
    assert abs((p - y).mean()) < 1e-3  # the intercept is not penalised
    assert ((p >= 0.5) == (y > 0)).mean() > 0.95


def plain_bands(rows, lean=20.0, step=0.002):
    """rows: (grp, n_points, logppl) of documents that pass the base rules."""

    def quartiles(values):
        return np.quantile(values, [0.25, 0.5, 0.75])

    binned = {}
    for g, n, x in rows:
        binned.setdefault(g, []).append((int(math.floor(math.log2(max(1, n)))), math.floor(x / step + 0.5) * step))
    out = {}
    for g, found in binned.items():
        middle = quartiles([x for _, x in found])[1]
        q = quartiles([(x - middle) * math.sqrt(2.0 ** (size + 0.5)) for size, x in found])
        per_root = (q[2] - q[0]) / 1.349
        for size in {s for s, _ in found}:
            own = [x for s, x in found if s == size]
            q, n = quartiles(own), len(own)
            scale = (q[2] - q[0]) / 1.349
            drawn = per_root**2 / 2.0 ** (size + 0.5)
            out[g, size] = ((n * q[1] + lean * middle) / (n + lean), max(math.sqrt((n * scale**2 + lean * drawn) / (n + lean)), 2 * step))
    return out


def test_quality_bands(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(1, 3000), rng.gauss(1.7 if g == "en" else 2.1, 0.2)) for g in ("en", "de", "und") for _ in range({"en": 400, "de": 60, "und": 3}[g])]
    measured = spark.createDataFrame([(g, n, x, False) for g, n, x in rows] + [("en", 50, 9.0, True), ("xx", 50, 1.0, True)], "grp string, n_points long, logppl double, base_failed boolean")
    got = {(r["grp"], r["size"]): (r["middle"], r["scale"]) for r in quality.bands(measured).collect()}
    want = plain_bands(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def plain_marginals(field, words):
    """Log-odds by the forward-backward recursion in logs, one token after the other."""
    e, t = [field.emission(w) for w in words], field.transitions
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    n = len(words)
    fwd, bwd = [(0.0, e[0])] if n else [], [(0.0, 0.0)] * n
    for i in range(1, n):
        a, b = fwd[-1]
        fwd.append((add(a + t[0][0], b + t[1][0]), e[i] + add(a + t[0][1], b + t[1][1])))
    for i in range(n - 2, -1, -1):
        a, b = bwd[i + 1]
        bwd[i] = (add(t[0][0] + a, t[0][1] + e[i + 1] + b), add(t[1][0] + a, t[1][1] + e[i + 1] + b))
    return [f[1] + b[1] - f[0] - b[0] for f, b in zip(fwd, bwd, strict=True)]


def test_toxicity_score(spark):
    rng = random.Random(5)
    field = toxicity.Field({"w:vile": 4.0, "3:vil": 1.5, "w:kind": -2.0}, -2.5, np.array([[0.4, -0.7], [-0.2, 0.9]]), np.array([-1.0, 0.8, 1.1]))
    texts = [" ".join(rng.choices(["vile", "kind", "other", "villain", "x"], k=n)) for n in (0, 1, 2, 5, 70, 200)] + [None, "...", "vile " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(rows, field).collect():
        words = toxicity.TOKEN.findall(texts[r["doc_id"]] or "")
        z = plain_marginals(field, words)
        p = [1 / (1 + math.exp(-max(-30, min(30, v)))) for v in z]
        x = (1.0, max(-10.0, min(10.0, max(z))), math.log1p(sum(v for v in p if v > 0.05))) if z else (1.0, -10.0, 0.0)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, field.score, strict=True)))), abs=1e-6)
        assert len(r["spans"]) == sum(v >= 0 for v in z)


def test_toxicity_logistic_is_at_the_optimum():
    rng = np.random.default_rng(6)
    x = np.column_stack([np.ones(400), rng.standard_normal((400, 2))])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ np.array([-1.0, 2.0, 0.5]))))).astype(float)
    w = toxicity.logistic(x, y, l2=0.05)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(x.T @ (y - p) - 0.05 * w).max() < 1e-8


def test_marginals_of_a_long_text_take_bounded_memory():
    import tracemalloc

    field = toxicity.Field({"w:vile": 4.0}, -2.5, np.array([[0.4, -0.7], [-0.2, 0.9]]), np.array([-1.0, 0.8, 1.1]))
    words = ["vile", "kind", "other", "word"] * 250_000
    tracemalloc.start()
    (z,) = field.marginals([words])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(z) == 1_000_000 and peak < 120e6  # a few arrays of a million numbers
    few = plain_marginals(field, words[:300])
    assert field.marginals([words[:300]])[0] == pytest.approx(few, abs=1e-6)


def test_language_calibration():
    rng = np.random.default_rng(7)
    total, n = rng.normal(-300, 20, (200, 3)), rng.integers(50, 200, 200)
    own = np.where(rng.random(200) < 0.9, total.argmax(axis=1), 0)
    temperature, bound = language.calibrated(total, n, own)

    def loss(t):
        out = 0.0
        for row, k in zip(total, own, strict=True):
            z = [v * t for v in row]
            out -= max(math.log(1e-12), z[k] - max(z) - math.log(sum(math.exp(v - max(z)) for v in z)))
        return out / len(own)

    assert temperature == min(language.TEMPERATURES, key=loss)
    assert bound == pytest.approx(float(np.quantile([-row[k] / m for row, k, m in zip(total, own, n, strict=True)], 0.999)) + 0.1)


def test_bands_decide_what_is_kept(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(["ka", "lo", "mi", "te", "su", "ra"], k=80)), "en") for i in range(60)], "doc_id long, text string, lang string")
    for r in quality.judge(docs).collect():
        assert r["kept"] == (not r["base_failed"] and r["low"] <= r["logppl"] <= r["high"])
    assert docs.select(F.count("*")).first()[0] == 60
