"""Ranked lexical search over inverted treaps.

Index: documents are dealt into shards as they are read, each of a bounded number of postings. In a shard the documents are
ordered by doc_id, and every term has a treap over its postings: search order by document, heap order by impact. The
impact of a posting is (1000000000 * tf) div (1000 * tf + 12 * m); a term's weight is only known to a query and multiplies
all of its impacts alike. Heaps compare impacts by steps of an eighth of an octave, and within a step by hash, so
equal impacts (copies) do not make a treap a chain; a node's bound is the top of its step.

Search: all terms of a query go down their treaps together. A state is a range of documents and, for each term, the
topmost node inside it, so the sum of weighted bounds is a maximum for the range. Ranges whose maximum cannot enter the
top k are pruned; the others, greatest maxima first, are split at the document of their heaviest node, which is scored
exactly. A task carries the k-th best score from shard to shard.

Queries are a stated set, broadcast in blocks of bounded size, each searched in all shards; the best of each task are
merged at the end. All arithmetic is in 64-bit integers.

Defined cases: null and empty texts have no terms and are no documents; repeated rows are documents each on their own; a
null doc_id comes after all others; of items with the same id, distinct texts are one text; ties go by doc_id; an
empty corpus or item gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, raw, saved, ship, shipped, table

#: A-Z to a-z, and what is in no term to a space
_NORMAL = bytes(b if chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(128)) + bytes(range(128, 256))
#: tops of the steps by which heaps compare impacts
STEPS = np.unique(np.floor(2 ** (np.arange(8 * 20 + 8) / 8)).astype(np.int64))
#: ranges that are split at once
AT_ONCE = 256
#: terms, and their bytes, up to which an index is made of the asked terms only
MOST_TERMS, MOST_BYTES = 1_000_000, 64 << 20


def terms_of(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a text in lists of bounded length."""
    data, at = text.translate(_NORMAL), 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Own(dict):
    """Numbers of terms in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Asked(dict):
    def __missing__(self, term: bytes) -> int:
        return -1


_SHARD = "n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms array<string>, counts array<int>, docs binary, tfs binary"


def _shards(asked: Broadcast | None, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Own() if asked is None else _Asked((t, i) for i, t in enumerate(shipped(asked).column("term").cast(pa.binary()).to_pylist()))
        ids: list[int | None] = []
        lengths: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = n_docs = n_terms = 0

        def emit() -> pa.RecordBatch:
            nonlocal ids, lengths, found, held, n_docs, n_terms
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            doc = np.repeat(np.arange(len(order)), np.array([len(found[i][0]) for i in order], np.int64))
            term, tf = (np.concatenate([found[i][k] for i in order]) if order else np.empty(0, np.int64) for k in (0, 1))
            by_term = np.argsort(term, kind="stable")
            kinds, counts = np.unique(term, return_counts=True)
            names = list(known)
            row = (
                n_docs, n_terms, [ids[i] for i in order], np.array([lengths[i] for i in order], np.int64).tobytes(), [names[k] for k in kinds.tolist()],
                counts.astype(np.int32), doc[by_term].astype("<i4").tobytes(), tf[by_term].astype("<i4").tobytes(),
            )
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            columns = [pa.array([v], t) for v, t in zip(row, types, strict=True)]
            columns[4] = columns[4].cast(pa.list_(pa.string()))
            ids, lengths, found, held, n_docs, n_terms = [], [], [], 0, 0, 0
            if asked is None:
                known.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SHARD.split(", ")])

        for batch in batches:
            for b in pieces(batch, 1000):
                for doc_id, text in zip(b.column(0).to_pylist(), raw(b), strict=True):
                    n, parts = 0, []
                    for words in terms_of(text):
                        n += len(words)
                        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                        parts.append(np.unique(at[at >= 0], return_counts=True))
                    if not n:
                        continue
                    n_docs, n_terms = n_docs + 1, n_terms + n
                    term, tf = parts[0] if len(parts) == 1 else _united(parts)
                    if len(term):
                        ids.append(doc_id)
                        lengths.append(n)
                        found.append((term, tf))
                        held += len(term)
                    if held > postings:
                        yield emit()
        if n_docs:
            yield emit()

    return run


def _united(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    term, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return term, np.bincount(at, np.concatenate([p[1] for p in parts]), len(term)).astype(np.int64)


def treap(keys: list[int]) -> tuple[int, list[int], list[int]]:
    """Root, left and right children (-1 for none) of the heap-ordered tree over keys in their order."""
    left, right, spine = [-1] * len(keys), [-1] * len(keys), []
    for i, key in enumerate(keys):
        below = -1
        while spine and keys[spine[-1]] < key:
            below = spine.pop()
        left[i] = below
        if spine:
            right[spine[-1]] = i
        spine.append(i)
    return spine[0], left, right


_TREAPS = "doc_ids array<long>, terms array<string>, counts array<int>, roots binary, docs binary, impacts binary, lefts binary, rights binary"


def _treaps(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                m = np.array([75 + 25 * n * n_docs // n_terms for n in np.frombuffer(row["lengths"], np.int64).tolist()], np.int64)
                docs, tf = np.frombuffer(row["docs"], "<i4").astype(np.int64), np.frombuffer(row["tfs"], "<i4").astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[docs])
                keys = (np.searchsorted(STEPS, impact) << 40) | _chance(docs)
                roots, lefts, rights, at = [], [], [], 0
                for n in row["counts"]:
                    root, left, right = treap(keys[at : at + n].tolist())
                    roots.append(at + root)
                    lefts += [x + at if x >= 0 else -1 for x in left]
                    rights += [x + at if x >= 0 else -1 for x in right]
                    at += n
                packed = (np.array(x, "<i4").tobytes() for x in (roots, docs, impact, lefts, rights))
                out = (row["doc_ids"], row["terms"], row["counts"], *packed)
                types = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types, strict=True)], names=[c.split()[0] for c in _TREAPS.split(", ")])

    return run


def _chance(docs: np.ndarray) -> np.ndarray:
    """40 bits of a hash of the document's number."""
    h = (docs.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(24)).astype(np.int64)


class Index:
    """treaps: a row for each shard; df: documents by term; n_docs and n_terms of the corpus. Kept in the shared folder."""

    def __init__(self, treaps: DataFrame, df: DataFrame, n_docs: int, n_terms: int):
        self.treaps, self.df, self.n_docs, self.n_terms = treaps, df, n_docs, n_terms


def build(docs: DataFrame, asked: DataFrame | None = None, postings: int = 500_000) -> Index:
    """The index of docs(doc_id, text), read once. asked (term): only these terms are indexed if they are few enough to be
    broadcast, which changes no score; otherwise all are."""
    spark = docs.sparkSession
    few = None
    if asked is not None:
        n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        few = ship(spark, asked.select("term").toArrow()) if n <= MOST_TERMS and size <= MOST_BYTES else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = saved(rows.mapInArrow(_shards(few, postings), _SHARD), "shards", per_file=8)
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counted = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term"))
    df = saved(counted.agg(F.sum("x.counts").alias("df")), "document-counts")
    treaps = saved(shards.filter(F.size("doc_ids") > 0).drop("n_docs", "n_terms").mapInArrow(_treaps(n_docs, max(1, n_terms)), _TREAPS), "treaps", per_file=8)
    return Index(treaps, df, n_docs, n_terms)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, 1000):
            known, at, found, n = _Own(), [], [], []
            for i, text in enumerate(raw(b)):
                parts = [np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), return_counts=True) for words in terms_of(text)]
                term, tf = _united(parts) if parts else (np.empty(0, np.int64),) * 2
                at += [i] * len(term)
                found += term.tolist()
                n += tf.tolist()
            names = list(known)
            terms = pa.array([names[k] for k in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), terms, pa.array(n, pa.int64())], names=["item_id", "term", "n"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, n of items(item_id, text), written once."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    kind = rows.schema["item_id"].dataType.simpleString()
    return saved(rows.mapInArrow(_count_terms, f"item_id {kind}, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n")), "item-terms")


class Top:
    """The k best documents of an item so far: score, then doc_id, then nulls."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.none = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def full(self) -> bool:
        return len(self.scores) == self.k

    def take(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        scores, ids, none = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.none, none])
        order = np.lexsort((ids, none, -scores))[: self.k]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]


class Shard:
    """The treaps of a shard, end to end; the last node stands for none."""

    def __init__(self, row: dict):
        self.none = np.array([x is None for x in row["doc_ids"]], bool)
        self.ids = np.array([x or 0 for x in row["doc_ids"]], np.int64)
        self.n = len(self.ids)
        self.at = {t: i for i, t in enumerate(row["terms"])}
        docs, impacts, lefts, rights, self.roots = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("docs", "impacts", "lefts", "rights", "roots"))
        self.nowhere = len(docs)
        term = np.repeat(np.arange(len(row["counts"])), row["counts"])
        self.keys = term * self.n + docs  # ascending: postings of a term lie by document
        self.docs, self.impacts = np.append(docs, -1), np.append(impacts, 0)
        self.bounds = np.append(STEPS[np.searchsorted(STEPS, impacts)], 0)
        self.left, self.right = (np.append(np.where(x < 0, self.nowhere, x), self.nowhere) for x in (lefts, rights))

    def inside(self, node: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each node's subtree the topmost node whose document lies in its range."""
        while True:
            where, some = self.docs[node], node != self.nowhere
            high, low = some & (where >= end), some & (where < first)
            if not (high.any() or low.any()):
                return node
            node = np.where(high, self.left[node], np.where(low, self.right[node], node))

    def scores(self, terms: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        keys = terms * self.n + docs[:, None]
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, self.nowhere - 1)] == keys
        return (np.where(known, self.impacts[np.minimum(at, self.nowhere)], 0) * weights).sum(axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: Top) -> int:
        """Adds the shard's documents to the top of a query; how many were scored."""
        node, first, end = self.roots[terms][None, :], np.zeros((1, 1), np.int64), np.full((1, 1), self.n)
        scored = 0
        while len(node):
            most = (self.bounds[node] * weights).sum(axis=1)
            good = most > 0
            if top.full():
                worst = top.scores[-1]
                # an equal score only enters before the last of the best
                before = self.n if top.none[-1] else np.searchsorted(self.ids[~self.none], top.ids[-1])
                good = (most > worst) | ((most == worst) & (first[:, 0] < before))
            state = [node[good], first[good], end[good]]
            later = [x[:0] for x in state]
            if len(state[0]) > AT_ONCE:
                order = np.argpartition(-most[good], AT_ONCE)
                later, state = ([x[part] for x in state] for part in (order[AT_ONCE:], order[:AT_ONCE]))
            node, first, end = state
            if not len(node):
                break
            heaviest = np.argmax(self.bounds[node] * weights, axis=1)
            split = self.docs[node[np.arange(len(node)), heaviest]]
            score = self.scores(terms, weights, split)
            scored += len(split)
            split_well = split[score > 0]
            top.take(score[score > 0], self.ids[split_well], self.none[split_well])
            split = split[:, None]
            low, high = self.inside(node, first, split), self.inside(node, split + 1, end)
            new = ([later[0], low, high], [later[1], first, split + 1], [later[2], split, end])
            node, first, end = map(np.concatenate, new)
        return scored


def _search(asked: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shipped(asked).combine_chunks()
        numbers, weights = rows.column("item").to_numpy(), rows.column("weight").to_numpy()
        terms = rows.column("term").to_pylist()
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        own = np.array([vocabulary[t] for t in terms], np.int64)
        edge = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1], [True]))) if len(numbers) else np.zeros(1, np.int64)
        tops = [Top(k) for _ in edge[1:]]
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                shard = Shard(row)
                here = np.array([shard.at.get(t, -1) for t in vocabulary], np.int64)[own]
                for top, a, b in zip(tops, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    found = here[a:b] >= 0
                    if found.any():
                        shard.search(here[a:b][found], weights[a:b][found], top)
        n = [len(t.scores) for t in tops]
        if sum(n):
            items = rows.column("item_id").take(pa.array(np.repeat(edge[:-1], n)))
            items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
            ids = pa.array(np.concatenate([t.ids for t in tops]), mask=np.concatenate([t.none for t in tops]))
            yield pa.RecordBatch.from_arrays([items, ids, pa.array(np.concatenate([t.scores for t in tops]))], names=["item_id", "doc_id", "score"])

    return run


def search(index: Index, asked: DataFrame, k: int = 20, block: int = 500_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item of item_terms(). block: terms of the items of one broadcast."""
    spark = asked.sparkSession
    weight = F.floor(F.lit(1000) * F.log((F.lit(2) * F.lit(index.n_docs) + 2) / (F.lit(2) * F.col("df") + 1))).cast("long")
    known = asked.join(index.df, "term").withColumn("weight", F.col("n") * weight).filter("weight > 0").select("item_id", "term", "weight")
    known = saved(known, "weighted-terms")
    blocks = max(1, -(-known.count() // block))
    kind = asked.schema["item_id"].dataType.simpleString()
    found = None
    for part in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == part).toArrow()  # some `block` rows, whole items
        rows = rows.sort_by([("item_id", "ascending"), ("weight", "descending"), ("term", "ascending")])
        ids = rows.column("item_id").combine_chunks().dictionary_encode().indices if rows.num_rows else pa.array([], pa.int32())
        rows = rows.append_column("item", ids.fill_null(-1).cast(pa.int64()))
        here = index.treaps.mapInArrow(_search(ship(spark, rows), k), f"item_id {kind}, doc_id long, score long")
        found = here if found is None else found.unionAll(here)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = item_terms(table(spark, sf_dir, "benchmark"))
    return search(build(table(spark, sf_dir, "documents"), asked.select("term").distinct()), asked)


def oracle_sql() -> str:
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {terms} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({terms}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
u AS (SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * nd) // nt)) AS u FROM tf JOIN d USING (rid), s),
r AS (SELECT item_id, rid, doc_id, CAST(sum(q * w * u) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN u USING (term) GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20"""
