"""Toxic spans by a linear-chain conditional random field; its marginals give document scores.

Labels are of documents, so token labels are induced: within toxic training documents, a word is toxic if the
word or one of its beginnings is many times as frequent in toxic documents as in clean ones. A field with two
states is trained on windows around such words and on windows of clean documents; its features are the word,
its beginnings and its end. Forward-backward marginals of every token are those of the whole text as one chain:
stretches of CHAIN tokens are passed through at once, and what enters each comes from the products of the steps of
those before or behind it. The largest marginal log-odds and the expected number of toxic tokens go into
a logistic score, fitted on the same documents. Tokens at one half or more give the offending offsets.

Training takes at most `max_docs` documents of each label, the least by hash of doc_id among those of up to
`max_chars` characters, one text for each doc_id, and of each at most `toxic_windows` or `clean_windows` windows, drawn at
random: documented bounds on labelled rows, so the model's size is bounded. Scoring covers every whole text.

Defined cases: null or empty text has no tokens and gets the score of that; labels that are null are ignored,
of several for a document the largest counts; without labels of both kinds every score is the share of toxic
labels; repeated rows are scored each on its own; extra columns are ignored by score and kept by reject.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, least_hashed, pieces, row_key, table, texts

TOKEN = re.compile(r"[^\W\d_]+")
CHAIN, PAD = 64, -30.0
#: toxic documents that a telling feature must be in
LEAST = 3


def features(word: str) -> list[str]:
    w = word.lower()
    return ["w:" + w, *(f"{k}:{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k), *([f"e:{w[-3:]}"] if len(w) > 3 else [])]


def odds(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1 against 0; e: chains x tokens of exp(emission), t: 2 x 2 of exp(transition)."""
    f, b = np.empty_like(e), np.empty_like(e)
    f[:, 0], b[:, -1] = e[:, 0], 1
    for i in range(1, e.shape[1]):
        f[:, i] = e[:, i] * (t[0, 1] + f[:, i - 1] * t[1, 1]) / (t[0, 0] + f[:, i - 1] * t[1, 0])
    for i in range(e.shape[1] - 2, -1, -1):
        x = b[:, i + 1] * e[:, i + 1]
        b[:, i] = (t[1, 0] + x * t[1, 1]) / (t[0, 0] + x * t[0, 1])
    return f, b


def _through(steps: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """Odds that enter each stretch, given the steps within stretches as maps of odds, (a x + b) / (c x + d), and the
    place of each stretch in its text; 1 enters the first."""
    a, b, c, d = (x.copy() for x in steps[0])
    for a2, b2, c2, d2 in steps[1:]:
        a, b, c, d = a2 * a + b2 * c, a2 * b + b2 * d, c2 * a + d2 * c, c2 * b + d2 * d
        most = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / most, b / most, c / most, d / most
    into = np.ones(len(place))
    order = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place))
    for k in range(1, len(ends)):
        here = order[ends[k - 1] : ends[k]]
        x = into[here - 1]
        into[here] = (a[here - 1] * x + b[here - 1]) / (c[here - 1] * x + d[here - 1])
    return into


def whole_odds(e: np.ndarray, t: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """odds() of whole texts that lie in stretches, one row each, of `size` tokens: the place-th of their text, in order."""
    n, width = e.shape
    first, full = place == 0, size[:, None] > np.arange(width)
    none, one = np.zeros(n), np.ones(n)
    f, b = np.empty_like(e), np.empty_like(e)
    forward = [(np.where(first & (i == 0), 0, e[:, i] * t[1, 1]), np.where(first & (i == 0), e[:, i], e[:, i] * t[0, 1]), np.where(first & (i == 0), 0, t[1, 0]), np.where(first & (i == 0), 1, t[0, 0])) for i in range(width)]
    x = _through(forward, place)
    for i, (p, q, r, s) in enumerate(forward):
        x = f[:, i] = (p * x + q) / (r * x + s)
    # b of a token from b of the next: 1 at a text's end; steps from the last stretch to the first, from its last token on
    last = np.append(first[1:], True)
    ahead = [np.where(last, none, e[np.minimum(np.arange(n) + 1, n - 1), 0])] + [e[:, i + 1] for i in range(width - 2, -1, -1)]
    end = [last] + [~full[:, i + 1] & last for i in range(width - 2, -1, -1)]
    backward = [(np.where(z, none, y * t[1, 1]), np.where(z, one, t[1, 0]), np.where(z, none, y * t[0, 1]), np.where(z, one, t[0, 0])) for y, z in zip(ahead, end, strict=True)]
    count = np.bincount(np.cumsum(first) - 1)
    behind = np.repeat(count, count) - 1 - place
    x = _through([tuple(m[::-1] for m in step) for step in backward], behind[::-1])[::-1]
    for i, (p, q, r, s) in zip(range(width - 1, -1, -1), backward, strict=True):
        x = b[:, i] = (p * x + q) / (r * x + s)
    return f, b


class Field:
    """Weights of features, transitions (logs), and the logistic score over them."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray, score: np.ndarray, base: float = 0.0):
        self.weights, self.bias, self.transitions, self.score, self.base = weights, bias, transitions, score, base
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def emission(self, word: str) -> float:
        e = self.cache.get(word)
        if e is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            get = self.weights.get
            e = self.cache[word] = max(PAD, min(-PAD, self.bias + sum(get(x, 0.0) for x in features(word))))
        return e

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Log-odds that each token is toxic."""
        rows = np.array([-(-len(d) // CHAIN) for d in docs], np.int64)
        e = np.full((rows.sum(), CHAIN), PAD)
        flat, at = e.reshape(-1), 0
        emission = self.emission
        for d, n in zip(docs, rows.tolist(), strict=True):
            flat[at : at + len(d)] = np.fromiter(map(emission, d), float, len(d))
            at += n * CHAIN
        if not len(e):
            return [np.zeros(0) for _ in docs]
        place = np.arange(len(e)) - np.repeat(np.cumsum(rows) - rows, rows)
        size = np.minimum(np.repeat(np.array(list(map(len, docs))), rows) - place * CHAIN, CHAIN)
        f, b = whole_odds(np.exp(e), np.exp(self.transitions), size, place)
        z = np.log(np.maximum(f * b, 1e-30)).reshape(-1)
        out, at = [], 0
        for d, n in zip(docs, rows.tolist(), strict=True):
            out.append(z[at : at + len(d)])
            at += n * CHAIN
        return out

    @staticmethod
    def summary(z: np.ndarray) -> tuple[float, float, float]:
        if not len(z):
            return 1.0, -10.0, 0.0
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return 1.0, float(np.clip(z.max(), -10, 10)), float(np.log1p(p[p > 0.05].sum()))

    def scores(self, zs: list[np.ndarray]) -> np.ndarray:
        if self.score is None:
            return np.full(len(zs), self.base)
        x = np.array([self.summary(z) for z in zs]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.score, -30, 30)))


def induce(docs: list[tuple[str, int]], ratio: float = 20.0) -> set[str]:
    """Features (words and beginnings) that are so many times as frequent in toxic documents. Documents that share
    their least words by hash count once, lest copies make their words look telling. Of clean documents only what
    enough toxic ones have is counted."""
    df, n = {}, [0, 0]
    for y in (1, 0):
        seen, count = set(), Counter()
        for text, label in docs:
            if label != y:
                continue
            kinds = {w.lower() for w in TOKEN.findall(text)}
            mark = tuple(sorted(map(hash_word, kinds))[:3])
            if mark in seen:
                continue
            seen.add(mark)
            n[y] += 1
            count.update({f for w in kinds for f in features(w) if f[0] != "e" and (y or f in df[1])})
        df[y] = {f: k for f, k in count.items() if k >= LEAST or not y}
    return {f for f, k in df[1].items() if k / max(1, n[1]) >= ratio * (df[0].get(f, 0) + 0.5) / max(1, n[0])}


def hash_word(w: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(w)


def fit(docs: list[tuple[str, int]], window: int = 16, toxic_windows: int = 6, clean_windows: int = 2, steps: int = 60, l2: float = 1e-4, seed: int = 7) -> Field:
    """docs: (text, 0 or 1)."""
    n1 = sum(y for _, y in docs)
    if not n1 or n1 == len(docs):
        return Field({}, PAD, np.zeros((2, 2)), None, n1 / len(docs) if docs else 0.0)
    telling = induce(docs)
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    row, col, tags = array("q"), array("q"), []

    def add(words: list[str], tag: list[int]) -> None:
        for i, w in enumerate(words, len(tags) * window):
            for f in features(w):
                row.append(i)
                col.append(index.setdefault(f, len(index)))
        tags.append(tag)

    for text, y in docs:  # words are split anew where they are needed: those of all documents take many times the texts' memory
        words = TOKEN.findall(text)
        if not words:
            continue
        if y:
            bad = {w for w in set(words) if not telling.isdisjoint(features(w))}
            tag = [int(w in bad) for w in words]
            for i in rng.permutation(np.flatnonzero(tag))[:toxic_windows].tolist():
                a = max(0, i - int(rng.integers(window)))
                add(words[a : a + window], tag[a : a + window])
        else:
            for a in rng.integers(0, max(1, len(words) - window), clean_windows):
                add(words[a : a + window], [0] * len(words[a : a + window]))
    if not tags:
        return Field({}, PAD, np.zeros((2, 2)), None, n1 / len(docs))
    y = np.zeros((len(tags), window))
    mask = np.zeros((len(tags), window), bool)
    for r, tag in enumerate(tags):
        mask[r, : len(tag)], y[r, : len(tag)] = True, tag
    row, col = np.frombuffer(row, np.int64), np.frombuffer(col, np.int64)
    w, bias, t = np.zeros(len(index)), -3.0, np.zeros((2, 2))
    gold = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & mask[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])
    hw, hb, ht = np.full(len(w), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    n = mask.sum()
    for _ in range(steps):
        e = np.where(mask, np.bincount(row, w[col], y.size).reshape(y.shape) + bias, PAD)
        e = np.clip(e, PAD, -PAD)
        ex, tx = np.exp(e), np.exp(t)
        f, b = odds(ex, tx)
        p = f * b / (1 + f * b)
        gap = np.where(mask, y - p, 0)
        pair = np.stack([np.ones_like(f[:, :-1]) * tx[0, 0], tx[0, 1] * ex[:, 1:] * b[:, 1:], f[:, :-1] * tx[1, 0], f[:, :-1] * tx[1, 1] * ex[:, 1:] * b[:, 1:]])
        pair = (pair / pair.sum(axis=0) * mask[:, 1:]).sum(axis=(1, 2)).reshape(2, 2)
        gw = np.bincount(col, gap.reshape(-1)[row], len(w)) / n - l2 * w
        gb, gt = gap.sum() / n, (gold - pair) / n - l2 * t
        hw, hb, ht = hw + gw * gw * 1e4, hb + gb * gb * 1e4, ht + gt * gt * 1e4
        w, bias, t = w + 50 * gw / np.sqrt(hw), bias + 50 * gb / np.sqrt(hb), t + 10 * gt / np.sqrt(ht)
    names = list(index)
    field = Field({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(bias), t, np.zeros(3))
    x = np.array([field.summary(z) for i in range(0, len(docs), 100) for z in field.marginals([TOKEN.findall(t) for t, _ in docs[i : i + 100]])])
    field.score = logistic(x, np.array([y for _, y in docs], float))
    field.cache.clear()
    return field


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_chars: int = 20_000) -> Field:
    """Fitted on at most max_docs labelled documents of each kind, none of them held out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).filter(~held_out())
    rows = []
    for y in (1, 0):
        ids = least_hashed(known.filter(F.col("_toxic") == y), max_docs, "doc_id")
        found = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")  # at most max_docs ids
        found = found.filter((F.length("text") > 0) & (F.length("text") <= max_chars)).groupBy("doc_id").agg(F.min("text").alias("text"))
        rows += [(r["text"], y, r["doc_id"]) for r in found.collect()]  # at most max_docs
    rows.sort(key=lambda r: (r[2], r[0]))
    return fit([(t, y) for t, y, _ in rows])


def _score(model):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            for b in pieces(batch, 500):
                said = [t or "" for t in texts(b)]
                zs = field.marginals([TOKEN.findall(t) for t in said])
                spans = []
                for t, z in zip(said, zs, strict=True):
                    bad = np.flatnonzero(z >= 0)
                    if len(bad):
                        at = [m.span() for m in TOKEN.finditer(t)]
                        spans.append([{"start": at[i][0], "end": at[i][1]} for i in bad.tolist()])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(field.scores(zs), pa.float64()), pa.array(spans, span)], names=["doc_id", "key", "score", "spans"])

    return run


def score(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, key, score, spans (code points of offending tokens) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), f"doc_id long, key {KEY}, score double, spans array<struct<start:int,end:int>>")


def reject(docs: DataFrame, model: Field, threshold: float = 0.5) -> DataFrame:
    """docs without those that score at or over the threshold; columns as they are."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for b in pieces(batch, 500):
                zs = field.marginals([TOKEN.findall(t or "") for t in texts(b)])
                yield b.filter(pa.array(field.scores(zs) < threshold))

    return docs.select(*names).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), spans.alias("spans"))
