"""Language identification: one Kneser-Ney character model for each language (see charlm), lowest cross-entropy
per character, with calibrated rejection.

Models are counted over all training documents but a tenth of them, by hash, which are for calibration. Temperature
and rejection bound are calibrated on at most `calibration_docs` of that tenth, none over `calibration_chars`
characters: documented bounds on labelled rows. The temperature is the one under which scores, the softmax of the
total log-probabilities, fit best; the bound is a high quantile of the entropy that a document has under its own language.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the first language by
name; without training rows all is `und`; without calibration rows the temperature is the last of the list and
nothing is rejected; repeated rows are judged each on its own; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charlm
from .common import least_hashed, pieces, table

_LETTERS = re.compile(r"[^\W\d_]+")
TEMPERATURES = tuple(2.0**-k for k in range(14))


def words_of(column: pa.Array) -> list[list[str]]:
    """Lower-cased runs of letters; runs of numerals that are no letters are left out by known()."""
    return [_LETTERS.findall((t or "").lower()) for t in column.to_pylist()]


def known(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def totals(model: charlm.Model, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log-probabilities by language, and of predicted characters, for each document: unique words are scored once."""
    number: dict[str, int] = {}
    add = number.setdefault
    ids = np.fromiter((add(w, len(number)) for d in docs for w in d), np.int64)
    lp, n = model.every(list(number))
    doc = np.repeat(np.arange(len(docs)), list(map(len, docs))).astype(np.int64)
    out = np.stack([np.bincount(doc, lp[ids, j], len(docs)) for j in range(lp.shape[1])], axis=1) if lp.shape[1] else np.zeros((len(docs), 0))
    return out, np.bincount(doc, n[ids], len(docs))


def probabilities(total: np.ndarray, temperature: float) -> np.ndarray:
    z = (total - total.max(axis=1, keepdims=True)) * temperature
    z = np.exp(z)
    return z / z.sum(axis=1, keepdims=True)


class Judge:
    """Model, temperature and rejection bound."""

    def __init__(self, fitted: charlm.Fitted, temperature: float = TEMPERATURES[-1], bound: float = float("inf")):
        self.fitted, self.temperature, self.bound = fitted, temperature, bound


def calibrated(total: np.ndarray, n: np.ndarray, own: np.ndarray, quantile: float = 0.999) -> tuple[float, float]:
    """Temperature and bound from documents' totals and the places of their own languages."""
    at = np.arange(len(own))
    bound = float(np.quantile(-total[at, own] / np.maximum(n, 1), quantile)) + 0.1
    return min(TEMPERATURES, key=lambda t: -np.log(np.maximum(probabilities(total, t)[at, own], 1e-12)).mean()), bound


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _totals(model: charlm.Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, 500):
            total, n = totals(model, words_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["grp", "total", "n"])


def train(docs: DataFrame, order: int = 4, calibration_docs: int = 2000, calibration_chars: int = 20_000, max_rows: int = 2_000_000, chunk_chars: int = 16_000_000) -> Judge | None:
    text = F.col("text").cast("string")
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("grp"), text.alias("text"))
    tenth = F.pmod(F.xxhash64("text"), F.lit(10)) == 0  # copies lie on one side
    fitted = charlm.fit(rows.filter(~tenth).select("grp", "text"), words_of, order, max_rows) or charlm.fit(rows.select("grp", "text"), words_of, order, max_rows)
    if fitted is None:
        return None
    spare = least_hashed(rows.filter(tenth & (F.length("text") <= calibration_chars)), calibration_docs, "doc_id", "text", "grp")
    got = charlm.scored(spare, fitted, words_of, _totals, "grp string, total array<double>, n long", chunk_chars).collect()  # at most calibration_docs rows
    at = {g: i for i, g in enumerate(fitted.groups)}
    got = [r for r in got if r["n"] and r["grp"] in at]
    if not got:
        return Judge(fitted)
    got.sort(key=lambda r: (r["grp"], r["n"], r["total"]))
    return Judge(fitted, *calibrated(np.array([r["total"] for r in got]), np.array([r["n"] for r in got]), np.array([at[r["grp"]] for r in got])))


def _predict(groups: list[str], temperature: float, bound: float):
    names = np.array(groups, object)

    def run(model: charlm.Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 500):
                docs = words_of(b.column(2))
                total, n = totals(model, docs)
                best = total.argmax(axis=1)
                at = np.arange(len(docs))
                low = -total[at, best] / np.maximum(n, 1)
                p = probabilities(total, temperature)[at, best]
                none = np.array([not known(d) for d in docs], bool)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(none, "und", names[best]), pa.string()), pa.array(np.where(none, 0.0, p)), pa.array(np.where(none, np.nan, low)), pa.array(none | (low > bound))], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return run


def identify(docs: DataFrame, judge: Judge | None, chunk_chars: int = 16_000_000) -> DataFrame:
    """doc_id, lang_pred, score, entropy (nats a character), rejected for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("grp"), F.col("text").cast("string").alias("text"))
    if judge is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(float("nan")).alias("entropy"), F.lit(True).alias("rejected"))
    run = _predict(judge.fitted.groups, judge.temperature, judge.bound)
    return charlm.scored(rows, judge.fitted, words_of, run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean", chunk_chars)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
