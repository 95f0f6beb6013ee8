"""Quality rules: base counts, and perplexity bands of a Kneser-Ney model (see charlm) for each language.

The model is of characters across words, so the order of words counts: a unit is a whole document, its words
between single spaces. It learns from the documents' text without the symbols of the base counts, so a symbol is a
character that it does not know, whatever junk the corpus holds: a few in a text hardly move its perplexity, many
do. Documents are in two folds by the hash of their text, copies in one; each is scored under
the model of its language's other fold, which holds none of its own counts.

Bands: each language has a middle and a scale of log-perplexity a character for every doubling of length, from
the median and the quartiles of all its documents that pass the base rules. A length of few documents leans on
the language's median and on a scale that falls with the root of the length, as if `lean` documents more had shown
them. Documents more than `width` scales from the middle, on either side, are rejected.

Repeated words: a hash of every word, of every window of five, equal windows within a text, and the words that
any of them covers. Hashes have 64 bits, so two different windows of one text being taken as equal is out of reach.

Defined cases: a null text has no words and fails the base rules; a null language is a group of its own; a
language without a document in the other fold has the score of unknown characters throughout; a single document of
a language is in its band; repeated rows are judged each on its own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charlm
from .common import pieces, saved, table

SYMBOLS = "#*$%&|<>"
_U = np.uint64
_R = 0x9E3779B97F4A7C15


def joined(column: pa.Array) -> list[str]:
    """The words of each text between single spaces."""
    return [str(b" ".join((t or b"").split()), "utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


_NO_SYMBOL = str.maketrans("", "", SYMBOLS)


def plain(column: pa.Array) -> list[str]:
    """joined() without symbols: what a model learns from."""
    return [" ".join(t.translate(_NO_SYMBOL).split(" ")) if t else t for t in joined(column)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out


class _Words:
    """Hashes of words by sums over their characters; powers are kept from text to text."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def hashes(self, points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(points) > len(self.up):
            n = 1 << len(points).bit_length()
            self.up, self.down = _powers(_R, n), _powers(pow(_R, -1, 1 << 64), n)
        x = (points.astype(_U) + _U(1)) * _U(0xBF58476D1CE4E5B9)
        sums = np.zeros(len(points) + 1, _U)
        np.cumsum((x ^ (x >> _U(31))) * self.up[: len(points)], out=sums[1:])
        h = (sums[end] - sums[first]) * self.down[first]
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32))


def repeated_words(ids: np.ndarray, size: int = 5) -> int:
    """Words in windows of `size` words that are found twice or more in the text; ids: hashes of its words."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    h = np.zeros(n, _U)
    for j in range(size):
        h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB) + ids[j : j + n]
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    at = np.flatnonzero(twice[at] == h)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


_OUT = [("doc_id", pa.int64()), ("grp", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_points", pa.int64()), ("logppl", pa.float64())]
_SCHEMA = "doc_id long, grp string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_points long, logppl double"


def _measure(model: charlm.Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, lang, grp, text)."""
    words = _Words()
    for batch in batches:
        for b in pieces(batch, 500):
            data = [t or b"" for t in b.column(3).cast(pa.binary()).to_pylist()]
            said, n_words, n_repeat = joined(b.column(3)), [], []
            for t in said:
                points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                space = np.flatnonzero(points == 32)
                first, end = np.concatenate(([0], space + 1)), np.append(space, len(points))
                n_words.append(len(first) if t else 0)
                n_repeat.append(repeated_words(words.hashes(points, first, end)) if len(first) > 5 else 0)
            if model is None:
                lp, n = np.zeros(len(said)), np.ones(len(said), np.int64)
            else:
                lp, n = model.under(said, b.column(2).to_pylist())
            cols = [
                b.column(0), b.column(1), n_words, [len(t) - max(k - 1, 0) for t, k in zip(said, n_words, strict=True)],
                [sum(map(t.count, SYMBOLS)) for t in said], list(map(dup_lines, data)), n_repeat, n, -lp / n,
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, _OUT, strict=True)], names=[n for n, _ in _OUT])


def measure(docs: DataFrame, order: int = 4, max_rows: int = 2_000_000, chunk_chars: int = 16_000_000) -> DataFrame:
    """Base counts and log-perplexity of every row of docs, under a model of the documents of its language's other fold."""
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("string")
    fold = F.pmod(F.xxhash64(text), F.lit(2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"), fold.alias("fold"))
    fitted = charlm.fit(rows.select(F.concat("lang", F.lit("/"), F.col("fold").cast("string")).alias("grp"), "text"), plain, order, max_rows, own=True)
    asked = rows.select("doc_id", "lang", F.concat("lang", F.lit("/"), (1 - F.col("fold")).cast("string")).alias("grp"), "text")
    if fitted is None:
        return asked.mapInArrow(lambda batches: _measure(None, batches), _SCHEMA)
    return charlm.scored(asked, fitted, joined, _measure, _SCHEMA, chunk_chars)


def bands(measured: DataFrame, lean: float = 20.0, step: float = 0.002) -> DataFrame:
    """grp, size (doublings of length), middle, scale: from histograms of log-perplexities, so that no group's values are gathered."""
    n, bin_ = F.greatest(F.col("n_points"), F.lit(1)), F.round(F.col("logppl") / step).cast("long")
    bins = measured.filter("NOT base_failed").groupBy("grp", F.floor(F.log2(n)).cast("int").alias("size"), bin_.alias("bin")).agg(F.count("*").alias("n"))
    bins = saved(bins.withColumn("x", F.col("bin") * step), "quality-bins")

    def quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"), F.sum("n").alias("n"))

    half = F.pow(F.lit(2.0), F.col("size") + 0.5)  # the middle of the doubling
    every = quartiles(bins, ["grp"], "x").select("grp", F.col("q")[1].alias("all"))
    stray = bins.join(every, "grp").withColumn("u", (F.col("x") - F.col("all")) * F.sqrt(half))
    every = every.join(quartiles(stray, ["grp"], "u").select("grp", ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("per_root")), "grp")
    own = quartiles(bins, ["grp", "size"], "x").join(every, "grp")
    scale = (F.col("q")[2] - F.col("q")[0]) / 1.349
    drawn = F.col("per_root") * F.col("per_root") / half
    return own.select(
        "grp", "size", ((F.col("n") * F.col("q")[1] + lean * F.col("all")) / (F.col("n") + lean)).alias("middle"),
        F.greatest(F.sqrt((F.col("n") * scale * scale + lean * drawn) / (F.col("n") + lean)), F.lit(2 * step)).alias("scale"),
    )


def judge(docs: DataFrame, order: int = 4, width: float = 3.0, lean: float = 20.0, max_rows: int = 2_000_000, chunk_chars: int = 16_000_000) -> DataFrame:
    """Base counts, base_failed, logppl, low and high, and kept, for each row of docs."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = saved(measure(docs, order, max_rows, chunk_chars).withColumn("base_failed", failed), "quality")
    found = measured.withColumn("size", F.floor(F.log2(F.greatest(F.col("n_points"), F.lit(1)))).cast("int")).join(bands(measured, lean), ["grp", "size"], "left")
    found = found.withColumns({"low": F.col("middle") - width * F.col("scale"), "high": F.col("middle") + width * F.col("scale")})
    inside = F.coalesce(F.col("logppl").between(F.col("low"), F.col("high")), F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & inside)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "logppl", "low", "high")


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the quality query that SQL can express."""
    return query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def oracle_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
r AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r"""
