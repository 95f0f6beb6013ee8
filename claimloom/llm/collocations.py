"""Phrase collocations, mined by pivot partitioning as in MG-FSM.

1. Words are counted by language. The frequent ones are numbered from the most to the least frequent, so that of two
   words the larger number is the rarer. An n-gram belongs to its pivot: the rarest of its words, the leftmost if the
   word stands in it twice.
2. Every text is rewritten to fragments, one around each word that can be a pivot: the words to the left and right, at most
   two each, up to the first that is infrequent, rarer than the pivot or beyond the piece. A fragment holds exactly the
   n-grams that its pivot owns at this place, so every occurrence of an n-gram lies in one fragment. Equal
   fragments of a task are one with a weight. Fragments are routed by their pivot to buckets.
3. A bucket is mined on its own: it counts the n-grams of its pivots and emits no others. A pivot with more occurrences
   than a bucket is to hold is spread over several, whose counts are added up.
4. Phrases are scored, filtered and ranked by joins and windows; products are decimals of 38 digits.

The lexicon that a task needs to number words is broadcast up to a bound (`head` words of at most LONG bytes). Any other
word has a number of its own from a hash, above all of the lexicon's, whether it is frequent or not: n-grams of infrequent
words are mined like others and do not reach the least count. So texts are read as they are and joined to nothing. Words
whose hashes clash are known from the counts: the frequent ones are broadcast too, the others end a fragment.

Defined cases: a null text is empty; a null lang is `und`; repeated rows count each; ties go by phrase; an empty table
gives no rows; extra columns are ignored. A piece without white space is one word, however long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, pieces, raw, saved, ship, shipped, table

#: longest word, in bytes, that a broadcast lexicon holds
LONG = 64
#: tokens that are turned into fragments at once
BLOCK = 1_000_000
#: bits of the hash that numbers words beyond the broadcast ones, and how many of those a worker remembers
BITS, REMEMBERED = 60, 100_000
#: kinds of words in a bucket up to which a trigram's local numbers fit one 64-bit key
NARROW = 2**21 - 1

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, ends of pieces to \n, tab to space
_NORMAL = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def segments(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text, with \\n at ends of pieces and empty ones between spaces, in lists of bounded length."""
    data, at = text.translate(_NORMAL).replace(b"\n", b" \n "), 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split(b" ")
        at = end


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n for words of this task so far; a null word has the number of all words."""
    seen: dict[str, Counter] = {}
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            for none in (b"", b"\n"):
                counts.pop(none, None)
            words = pa.array([None, *counts], pa.binary()).cast(pa.string())
            n = pa.array([sum(counts.values()), *counts.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, n], names=["lang", "word", "n"])
        seen.clear()

    for batch in batches:
        for b in pieces(batch, 1000):
            for lang, text in zip(b.column(0).to_pylist(), raw(b), strict=True):
                counts = seen.setdefault(lang, Counter())
                size += len(text)
                for words in segments(text):
                    counts.update(words)
                if size > 64 << 20 or sum(map(len, seen.values())) > 300_000:
                    yield from emit()
                    size = 0
    yield from emit()


def word_key(lang: bytes, word: bytes, bits: int) -> int:
    """The leading bits (60 at most) of the MD5 of language and word; key_of() is the same as a Column."""
    return int(hashlib.md5(lang + b" " + word).hexdigest()[:15], 16) >> (60 - bits)


def key_of(bits: int) -> Column:
    data = F.concat(F.col("lang").cast("binary"), F.lit(" ").cast("binary"), F.col("word").cast("binary"))
    return F.shiftright(F.conv(F.substring(F.md5(data), 1, 15), 16, 10).cast("long"), 60 - bits)


def word_counts(docs: DataFrame, least: int, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n): all words of each language; (lang, word, f, key, id): its frequent ones, id 0 for the most frequent of all;
    (key): those that words share, which are few."""
    rows = docs.mapInArrow(_word_counts, "lang string, word string, n long")
    counted = rows.groupBy("lang", "word").agg(F.sum("n").alias("f")).withColumn("key", key_of(bits))
    known = F.when(F.col("f") >= least, F.col("word"))  # of the others only their keys are kept
    counted = saved(counted.select("lang", known.alias("word"), "f", "key"), "word-counts")
    totals = counted.filter("key IS NULL").select("lang", F.col("f").alias("n"))
    clashes = counted.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return totals, numbered(counted.filter("word IS NOT NULL"), "id", F.desc("f"), "lang", "word"), clashes


class _Ids(dict):
    """Numbers of a language's words; -1 for ends of pieces, -2 for what is no word. Words that are not known have -1, or with
    `beyond` a number above it from their key, but for keys that clash."""

    def __init__(self, lang: str, known: dict, beyond: int = -1, bits: int = BITS, clashes: frozenset = frozenset()):
        super().__init__(known)
        self.lang, self.beyond, self.bits, self.clashes = lang.encode(), beyond, bits, clashes
        self[b""], self[b"\n"] = -2, -1
        self.most = len(self) + REMEMBERED

    def __missing__(self, word: bytes) -> int:
        if self.beyond < 0:
            return -1
        key = word_key(self.lang, word, self.bits)
        found = -1 if key in self.clashes else self.beyond + key
        if len(self) < self.most and len(word) <= LONG:
            self[word] = found
        return found


class Lexicon:
    """The broadcast words by language; what is built from them is kept by a worker."""

    def __init__(self, data: Broadcast, beyond: int, bits: int, clashes: frozenset):
        self.name, self.data, self.beyond, self.bits, self.clashes = uuid.uuid4().hex, data, beyond, bits, clashes

    def ids(self) -> dict[str, _Ids]:
        if self.name not in _BUILT:
            _BUILT.clear()
            rows = shipped(self.data)
            langs, words, ids = (rows.column(c).combine_chunks() for c in ("lang", "word", "id"))
            by_lang: dict[str, dict] = {}
            for lang, word, i in zip(langs.to_pylist(), words.cast(pa.binary()).to_pylist(), ids.to_pylist(), strict=True):
                by_lang.setdefault(lang, {})[word] = i
            _BUILT[self.name] = {lang: self.of(lang, known) for lang, known in by_lang.items()}
        return _BUILT[self.name]

    def of(self, lang: str, known: dict) -> _Ids:
        return _Ids(lang, known, self.beyond, self.bits, self.clashes)


_BUILT: dict[str, dict[str, _Ids]] = {}


def stirred(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + c.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fragments(ids: np.ndarray) -> list[np.ndarray]:
    """Five columns, the pivot in the middle and -1 where there is no word, for each word of ids but the first and last
    two that owns an n-gram. Words to the left are more frequent than the pivot, those to the right are not rarer."""
    l2, l1, pivot, r1, r2 = (ids[i : len(ids) - 4 + i] for i in range(5))
    left = (l1 >= 0) & (l1 < pivot)
    far_left = left & (l2 >= 0) & (l2 < pivot)
    right = (r1 >= 0) & (r1 <= pivot)
    far_right = right & (r2 >= 0) & (r2 <= pivot)
    some = np.flatnonzero(left | right)
    parts = ((l2, far_left), (l1, left), (pivot, None), (r1, right), (r2, far_right))
    return [c[some] if there is None else np.where(there[some], c[some], -1) for c, there in parts]


def _routed(columns: list[np.ndarray], salts: np.ndarray, buckets: int, dtype: str) -> pa.RecordBatch:
    """Equal fragments as one with a weight, those of a bucket as one row."""
    names = ["bucket", "sides", "words", "weights"]
    h, pivot = stirred(columns), columns[2]
    if not len(h):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), *(pa.array([], pa.binary()) for _ in names[1:])], names=names)
    salt = np.zeros(len(h), np.uint64)
    if len(salts):
        hot = pivot < len(salts)
        salt[hot] = h[hot] % salts[pivot[hot]]
    bucket = stirred([pivot, salt]) % np.uint64(buckets)
    order = np.argsort((bucket << np.uint64(40)) | (h >> np.uint64(24)))
    rows = np.stack([c[order] for c in columns], axis=1)
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    rows, bucket, weight = rows[new], bucket[order][new], np.diff(np.append(new, len(order)))
    there = rows >= 0
    sides = (there[:, :2].sum(axis=1) * 3 + there[:, 3:].sum(axis=1)).astype(np.uint8)
    ends = np.cumsum(there.sum(axis=1))
    words = rows[there].astype(dtype)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    out = [[], [], [], []]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        first = int(ends[a - 1]) if a else 0
        out[0].append(int(bucket[a]))
        out[1].append(sides[a:b].tobytes())
        out[2].append(words[first : int(ends[b - 1])].tobytes())
        out[3].append(weight[a:b].astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=names)


def _rewrite(lexicon: Lexicon, salts: np.ndarray, buckets: int, dtype: str):
    """Texts to fragments. All texts of a task are one stream with -1 between them, cut into blocks of bounded size;
    a block keeps its last four places, two as context, for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = lexicon.ids(), [np.full(2, -1)], 2

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size
            ids = np.concatenate([*held, np.full(2, -1)] if last else held)
            held, size = [ids[-4:]], 4
            return _routed(fragments(ids), salts, buckets, dtype)

        for batch in batches:
            for b in pieces(batch, 1000):
                for lang, text in zip(b.column(0).to_pylist(), raw(b), strict=True):
                    known = words.get(lang) or lexicon.of(lang, {})
                    for part in segments(text):
                        at = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
                        at = at[at != -2]
                        held.append(at)
                        size += len(at)
                        if size > BLOCK:
                            yield flush(False)
                    held.append(np.full(2, -1))
                    size += 2
        if size > 2:
            yield flush(True)

    return run


def grams_of(sides: np.ndarray, words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of three words, -1 behind bigrams; counts) of the n-grams that the fragments' pivots own."""
    left, right = sides.astype(np.int64) // 3, sides.astype(np.int64) % 3
    width = left + 1 + right
    pivot = np.cumsum(width) - width + left
    kinds, local = np.unique(words, return_inverse=True)
    windows = [(left >= 1, (-1, 0)), (right >= 1, (0, 1)), (left >= 2, (-2, -1, 0)), ((left >= 1) & (right >= 1), (-1, 0, 1)), (right >= 2, (0, 1, 2))]
    columns, counts = [[], [], []], []
    for there, places in windows:
        at = pivot[there]
        for k in range(3):
            columns[k].append(local[at + places[k]] if k < len(places) else np.full(len(at), -1))
        counts.append(weights[there])
    a, b, c = (np.concatenate(x) for x in columns)
    counts = np.concatenate(counts)
    if not len(a):
        return np.empty((0, 3), np.int64), counts
    if len(kinds) < NARROW:
        key = (a << 42) | (b << 21) | (c + 1)
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    else:
        order = np.lexsort((c, b, a))
        rows = np.stack([a[order], b[order], c[order]], axis=1)
        new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    total, first = np.add.reduceat(counts[order], new), order[new]
    kinds = np.append(kinds.astype(np.int64), -1)  # for -1
    return np.stack([kinds[a[first]], kinds[b[first]], kinds[c[first]]], axis=1), total


def _mine(least: int, n_hot: int, dtype: str):
    def run(rows: pa.Table) -> pa.Table:
        sides, words, weights = (b"".join(rows.column(c).to_pylist()) for c in ("sides", "words", "weights"))
        grams, f = grams_of(np.frombuffer(sides, np.uint8), np.frombuffer(words, dtype), np.frombuffer(weights, "<u4").astype(np.int64))
        keep = (f >= least) | (grams.max(axis=1, initial=-1) < n_hot)  # of spread pivots other buckets may hold more
        return pa.table([*(pa.array(grams[keep, k]) for k in range(3)), pa.array(f[keep])], names=["a", "b", "c", "f"])

    return run


def phrases(docs: DataFrame, words: DataFrame, totals: DataFrame, clashes: DataFrame, least: int, head: int, bucket: int, bits: int = BITS) -> DataFrame:
    """a, b, c (numbers of words, c is -1 for two) and f of every phrase of two or three words that occurs `least` times."""
    spark = docs.sparkSession
    n_ids, n_words = words.count(), totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket = max(bucket, n_words // 1_000_000)  # so at most a million pivots are spread
    whole = not words.filter((F.col("id") >= head) | (F.octet_length("word") > LONG)).limit(1).count()
    shared = [] if whole else [r[0] for r in clashes.collect()]  # of 60 bits hardly any
    kept = words if whole else words.filter(known(head, bucket, shared))
    found = kept.select("lang", "word", "id").toArrow()  # at most `head` words of at most LONG bytes, those that are spread, and clashes
    lexicon = Lexicon(ship(spark, found), -1 if whole else n_ids, bits, frozenset(shared))
    hot = words.filter(F.col("f") > bucket).select("id", "f").toArrow()
    order = np.argsort(hot.column("id").to_numpy())
    salts = (-(-hot.column("f").to_numpy()[order] // bucket)).astype(np.uint64)
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * n_words // bucket))
    dtype = "<i4" if whole and n_ids < 2**31 else "<i8"
    routed = docs.mapInArrow(_rewrite(lexicon, salts, buckets, dtype), "bucket long, sides binary, words binary, weights binary")
    mined = routed.groupBy("bucket").applyInArrow(_mine(least, len(salts), dtype), "a long, b long, c long, f long")
    found = mined.groupBy("a", "b", "c").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    if whole:
        return found
    other = words.filter(~known(head, bucket, shared)).select((F.col("key") + n_ids).alias("hashed"), "id")
    for c in ("a", "b", "c"):  # back to the words' own numbers; without a match it is one already
        found = found.join(other, F.col(c) == F.col("hashed"), "left").withColumn(c, F.coalesce("id", c)).drop("hashed", "id")
    return found


def known(head: int, bucket: int, shared: list[int]) -> Column:
    """Whether a frequent word is broadcast."""
    return ((F.col("id") < head) & (F.octet_length("word") <= LONG)) | (F.col("f") > bucket) | F.col("key").isin(shared)


def scored(found: DataFrame, words: DataFrame, keep_below: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that no longer one stands for: of a phrase none that holds it occurs
    keep_below percent as often."""
    word = words.select("lang", "id", "word", "f")
    pairs, triples = found.filter("c < 0").select("a", "b", "f"), found.filter("c >= 0")
    longer = triples.select(F.col("a"), F.col("b"), "f").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f"))
    longer = longer.groupBy("a", "b").agg(F.max("f").alias("longer"))
    two = pairs.join(longer, ["a", "b"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {keep_below} * f"))
    three = triples.join(pairs.select("a", "b", F.col("f").alias("f_ab")), ["a", "b"])
    three = three.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc")), ["b", "c"])

    def named(rows: DataFrame, c: str) -> DataFrame:
        mine = word.select(F.col("id").alias(c), F.col("word").alias(f"w_{c}"), F.col("f").alias(f"f_{c}"), *(["lang"] if c == "a" else []))
        return rows.join(mine, c)

    two = named(named(two, "a"), "b").select("lang", F.concat_ws(" ", "w_a", "w_b").alias("phrase"), "f", F.array(F.struct(F.col("f_a").alias("l"), F.col("f_b").alias("r"))).alias("cuts"))
    cuts = F.array(F.struct(F.col("f_a").alias("l"), F.col("f_bc").alias("r")), F.struct(F.col("f_ab").alias("l"), F.col("f_c").alias("r")))
    three = named(named(named(three, "a"), "b"), "c").select("lang", F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), "f", cuts.alias("cuts"))
    wide = "CAST({} AS DECIMAL(19, 0))".format
    square = f"(1000000 * ({wide('f')} * {wide('f')}))"
    cut = f"transform(cuts, (c, k) -> named_struct('score', {square} div ({wide('c.l')} * {wide('c.r')}), 'k', k, 'l', c.l, 'r', c.r))"
    best = two.unionByName(three).withColumn("cut", F.expr(f"array_min({cut})"))
    return best.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def best_of(rows: DataFrame, top: int, spread: int = 32) -> DataFrame:
    """rank and the `top` rows of each language. First the best of each of `spread` shares of a language are picked, so that
    one task gets top * spread rows of a language, however many it has."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(spread))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top).drop("rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 10, keep_below: int = 50, top: int = 2000, head: int = 1_000_000, bucket: int = 500_000, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases.

    a phrase's a is its count; of its cuts the one that scores lowest counts, with l and r the counts of its parts and n that of
    all words; score is floor(1000000 * a * a / (l * r)). bucket: occurrences that one mining task is to hold. head: words of
    the broadcast lexicon. bits: of the hash that numbers the others."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    totals, words, clashes = word_counts(docs, least, bits)
    found = saved(phrases(docs, words, totals, clashes, least, head, bucket, bits), "phrases")
    best = best_of(scored(found, words, keep_below), top)
    long = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *long)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    return r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)) GROUP BY lang, k, p),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, p, f, string_split(p, ' ') AS x FROM g WHERE k > 1 AND f >= 10),
parts AS (SELECT lang, p, f, j, array_to_string(x[1:j], ' ') AS head, array_to_string(x[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT parts.lang, parts.p, parts.f AS a, j, y.f AS l, z.f AS r, (1000000 * CAST(parts.f AS HUGEINT) * parts.f) // (CAST(y.f AS HUGEINT) * z.f) AS score
  FROM parts JOIN g AS y ON y.lang = parts.lang AND y.p = head JOIN g AS z ON z.lang = parts.lang AND z.p = tail),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
longer AS (SELECT lang, y, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS y FROM c WHERE k = 3) GROUP BY lang, y),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON low.lang = longer.lang AND low.p = longer.y WHERE longer.f IS NULL OR 100 * longer.f < 50 * low.a),
r AS (SELECT lang, p AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM kept)
SELECT r.lang, row_number() OVER (PARTITION BY r.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r.r AS r, CAST(n AS BIGINT) AS n, score
FROM r JOIN n USING (lang) QUALIFY rank <= 2000"""
