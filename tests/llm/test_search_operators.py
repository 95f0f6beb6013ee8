"""Collocations, collision search and treap search against brute force on small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import collisions, collocations, treaps
from claimloom.llm.common import numbered, pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, f string, word string")


def brute_collocations(rows, least, top, keep_below=50):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            if any(100 * b >= keep_below * a for h, b in found.items() if len(h) > len(g) and g in {h[:2], h[1:]}):
                continue
            score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def some_texts(rng, n, vocab=40):
    words = [f"w{i}" for i in range(vocab)] + ["New", "YORK", "city", "é", "ß!", "x\x85y"]
    out = []
    for i in range(n):
        w = [words[int(x)] for x in rng.zipf(1.3, rng.integers(0, 60)) if x < len(words)]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = ["new", "york", "city"]
        seps = rng.choice([" ", "  ", "\t", ", ", ".\n", " "], len(w))
        out.append("".join(a + b for a, b in zip(w, seps, strict=True)))
    return out


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("head", "bucket", "block"), [(10**6, 10**6, 10**6), (5, 20, 50), (0, 7, 8)])
def test_collocations(spark, monkeypatch, head, bucket, block):
    rng = np.random.default_rng(3)
    texts = some_texts(rng, 240) + [None, "", "  ", "...", "the " * 3000, "a b " * 700, "x" * 100 + " y " + ("x" * 100 + " y ") * 20, "one two one two " * 30]
    langs = [["en", "de", None, "und"][i % 4] for i in range(len(texts))]
    rows = list(zip(texts, langs, strict=True)) + [(texts[0], "en")] * 3
    fragments = collocations._rewrite

    def small_blocks(*args):
        run = fragments(*args)

        def wrapped(batches):
            collocations.BLOCK = block
            yield from run(batches)

        return wrapped

    monkeypatch.setattr(collocations, "_rewrite", small_blocks)
    docs = docs_of(spark, [(i, t, lang, "f", "word") for i, (t, lang) in enumerate(rows)])
    got = collocations.collocations(docs, least=5, top=60, head=head, bucket=bucket)
    want = brute_collocations(rows, 5, 60)
    assert len(want) > 60 and collected(got) == want


@pytest.mark.parametrize("bits", [60, 6])
def test_collocations_of_words_beyond_the_lexicon(spark, monkeypatch, bits):
    """No text goes through a join, and words whose hashes clash are told apart."""
    rows = [(t, ["en", "de", None][i % 3]) for i, t in enumerate(some_texts(np.random.default_rng(4), 240, vocab=150))]
    docs = docs_of(spark, [(i, t, lang, "f", "word") for i, (t, lang) in enumerate(rows)])
    join = type(docs).join

    def checked(self, *args, **named):
        assert "text" not in self.columns
        return join(self, *args, **named)

    monkeypatch.setattr(type(docs), "join", checked)
    got = collocations.collocations(docs, least=4, top=60, head=4, bits=bits)
    assert collected(got) == brute_collocations(rows, 4, 60)


def test_collocations_with_wide_numbers_and_without_rows(spark, monkeypatch):
    assert collocations.collocations(docs_of(spark, [])).collect() == []
    assert collocations.collocations(docs_of(spark, [(1, None, None, "", "")])).collect() == []
    rows = spark.createDataFrame([(0, 1, -1, 9 * 10**12), (0, 2, -1, 3 * 10**12)], "a long, b long, c long, f long")
    words = spark.createDataFrame([("en", i, w, 10**13) for i, w in enumerate("xyz")], "lang string, id long, word string, f long")
    got = {r["phrase"]: r["score"] for r in collocations.scored(rows, words).collect()}
    assert got == {"x y": 10**6 * 81 // 100, "x z": 10**6 * 9 // 100}


def test_grams_of_many_kinds_of_words(monkeypatch):
    rng = np.random.default_rng(5)
    ids = rng.integers(-1, 50, 3000)
    cols = collocations.fragments(np.concatenate([[-1, -1], ids, [-1, -1]]))
    there = np.stack(cols, axis=1) >= 0
    sides = (there[:, :2].sum(axis=1) * 3 + there[:, 3:].sum(axis=1)).astype(np.uint8)
    words, ones = np.stack(cols, axis=1)[there], np.ones(len(sides), np.int64)
    grams, counts = collocations.grams_of(sides, words, ones)
    want = Counter()
    for k in (2, 3):
        for i in range(len(ids) - k + 1):
            if (ids[i : i + k] >= 0).all():
                want[(*ids[i : i + k].tolist(), *[-1] * (3 - k))] += 1
    assert dict(zip(map(tuple, grams.tolist()), counts.tolist(), strict=True)) == dict(want)
    monkeypatch.setattr(collocations, "NARROW", 0)
    again = collocations.grams_of(sides, words, ones)
    assert dict(zip(map(tuple, again[0].tolist()), again[1].tolist(), strict=True)) == dict(want)


def test_numbers_do_not_hang_on_how_ranges_are_drawn(spark):
    rows = spark.range(50_000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("row_at"))
    got = numbered(rows, "number", F.desc("row_at"), "v").orderBy("number").collect()
    want = sorted(((r, v) for v in range(50_000) for r in [v % 7]), key=lambda x: (-x[0], x[1]))
    assert [(r["number"], r["row_at"], r["v"]) for r in got] == [(i, *x) for i, x in enumerate(want)]


def test_pieces_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * n for n in (1, 5, 20, 1, 1, 9, 30, 30, 0)])], names=["a", "text"])
    got = [b.column(0).to_pylist() for b in pieces(batch, 3, 10)]
    assert sum(got, []) == list(range(9)) and got == [[0, 1], [2], [3, 4], [5], [6], [7], [8]]


# collision search


def exact(q, x):
    s = 0.0
    for a, b in zip(q, x, strict=True):
        s += a * b
    return s


def brute_nearest(vectors, asked, k):
    out = []
    for i in asked:
        found = sorted((-exact(vectors[i], x), j) for j, x in vectors.items() if j != i and len(x) == len(vectors[i]))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return out


def test_collision_search(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.2, 3, (1500, 1))
    x[700:720] = x[0] + rng.standard_normal((20, 24)) * 0.01
    x[800:830] = x[1]
    rows = [(i, [float(np.float32(v)) for v in x[i]], 0) for i in range(1500)]
    nan, inf = float("nan"), float("inf")
    none = [(2000, None, 0), (2001, [], 0), (2020, [0.0] * 24, 0), (2040, [nan] + [1.0] * 23, 0), (2060, [inf] + [1.0] * 23, 0), (2080, [None] + [1.0] * 23, 0), (None, [9.0] * 24, 0)]
    odd = [(3000, [1.0, 2.0], 0), (3001, [5.0, 1.0], 0), rows[5], rows[20], (20, [9.0] * 24, 0)]
    table = spark.createDataFrame(rows + none + odd, "vec_id long, embedding array<double>, score int").repartition(5)
    got = [tuple(r) for r in collisions.nearest(table, F.pmod("vec_id", F.lit(20)) == 0, k=10, block=300).orderBy("query_id", "rank").collect()]
    vectors = {i: v for i, v, _ in rows + odd[:2]}
    vectors[20] = min(vectors[20], [9.0] * 24)
    want = brute_nearest(vectors, [i for i in vectors if i % 20 == 0], 10)
    found, true = {(q, j) for q, _, j, _ in got}, {(q, j) for q, _, j, _ in want}
    assert len(found & true) >= 0.97 * len(true) and len(got) == len(want)
    assert all(s == exact(vectors[q], vectors[j]) for q, _, j, s in got)
    by = defaultdict(list)
    for q, r, j, s in got:
        by[q].append((r, -s, j))
    assert all([r for r, _, _ in v] == list(range(1, len(v) + 1)) and v == sorted(v, key=lambda t: t[1:]) for v in by.values())
    assert [g for g in got if g[0] == 3000] == [(3000, 1, 3001, 7.0)]


def test_collision_search_with_few_rows(spark, monkeypatch):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in collisions.nearest(table, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 2, -1.0)]
    assert collisions.nearest(table.limit(0), F.col("vec_id") == 0).collect() == []
    assert collisions.nearest(table, F.col("vec_id") == 9).collect() == []
    monkeypatch.setattr(collisions, "SHIPPED", 2)  # several blocks of queries
    assert sorted(tuple(r) for r in collisions.nearest(table, F.lit(True), k=1).collect()) == [(0, 1, 1, 0.0), (1, 1, 0, 0.0), (2, 1, 1, 0.0)]


# treap search


def brute_ranks(docs, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    terms = lambda t: term.findall((t or "").translate(LOWER))
    tfs = [(d, Counter(terms(t))) for d, t in docs]
    tfs = [(d, c, sum(c.values())) for d, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(n for _, _, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    asked = defaultdict(Counter)
    for i, t in dict.fromkeys(items):
        asked[i].update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, c, n in tfs:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("postings", "block", "most"), [(10**6, 10**6, 10**6), (40, 30, 10**6), (200, 5, 0)])
def test_treap_search(spark, monkeypatch, postings, block, most):
    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in range(60)] + ["Éa", "ß", "zwei"]
    texts = [" ".join(words[int(x)] for x in rng.zipf(1.2, rng.integers(0, 40)) if x < len(words)) for _ in range(150)]
    docs = [(int(d), t) for d, t in zip(rng.permutation(1000)[:150], texts, strict=True)]
    docs += [(5000 + i, "same t1 t2; words-here") for i in range(30)] + [(None, "same t1 alone"), (None, None), (7, ""), (8, "!?"), docs[0], docs[0]]
    docs += [(6000, "t1 " * 400_000 + "t2")]
    items = [(1, "T1 t2 t2 same"), (2, "t5, t5; t7 zwei"), (3, None), (4, "nothing known"), (5, " ".join(words)), (None, "same"), (1, "T1 t2 t2 same"), (6, "words"), (6, "here alone")]
    monkeypatch.setattr(treaps, "MOST_TERMS", most)
    monkeypatch.setattr(treaps, "AT_ONCE", 4)
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    asked = treaps.item_terms(spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"))
    got = treaps.search(treaps.build(frame, asked.select("term").distinct(), postings), asked, 12, block)
    got = sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute_ranks(docs, items, 12)


def test_treap_search_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        asked = treaps.item_terms(i)
        assert treaps.search(treaps.build(d, asked.select("term").distinct()), asked).collect() == []


def test_treaps_prune():
    """Of many documents few are scored, and equal ones do not make a chain."""
    rng = np.random.default_rng(1)
    n = 20_000
    impacts = np.concatenate([rng.integers(1, 1000, n // 2), np.full(n // 2, 500)])
    keys = (np.searchsorted(treaps.STEPS, impacts) << 40) | treaps._chance(np.arange(n))
    root, left, right = treaps.treap(keys.tolist())
    depth, todo = 0, [(root, 1)]
    while todo:
        node, d = todo.pop()
        depth = max(depth, d)
        todo += [(c, d + 1) for c in (left[node], right[node]) if c >= 0]
    assert depth < 200
    packed = {c: np.array(v, "<i4").tobytes() for c, v in (("docs", range(n)), ("impacts", impacts), ("lefts", left), ("rights", right), ("roots", [root]))}
    shard = treaps.Shard({"doc_ids": list(range(n)), "terms": ["t"], "counts": [n], **packed})
    top = treaps.Top(20)
    scored = shard.search(np.array([0]), np.array([3]), top)
    order = np.lexsort((np.arange(n), -impacts))[:20]
    assert top.ids.tolist() == order.tolist() and top.scores.tolist() == (3 * impacts[order]).tolist()
    assert scored < n // 5
