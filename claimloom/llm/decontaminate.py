"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Each task streams the words of whole documents through the automaton and tracks the longest match that ends
at each word. A word is hit if it lies in an occurrence of a window: `min_words` consecutive words of an
item, or a whole shorter item. Words that no item has, and word pairs that no item has, end every match, so
only stretches that are long enough between those are walked; this changes no result.

Test items are taken in blocks of about `block_chars` characters, one automaton a block, so that what the driver
and a task hold is bounded however large the benchmark is (by default some 500,000 states). An automaton is built once,
broadcast as arrays and kept by each worker. With more than one block the documents are first sifted by hashes of all
windows, many blocks at a time, and an automaton reads only the documents that hold a window of its block.

Defined cases: null or empty text has no words; repeated rows are judged each on its own; items with equal
texts all count; a null item_id counts as the empty string; extra columns are kept by remove_spans and
ignored by find_hits; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, between, free, pieces, raw, row_key, saved, table

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A-Z to a-z, and what is in no word to a space
_NORMAL = bytes(b if chr(b).isdigit() or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Of all items together, over word numbers; built online, one item after another."""

    def __init__(self, items: list[tuple[str, list[bytes]]], min_words: int):
        self.min_words, self.vocab = min_words, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        items = [(i, w) for i, w in items if w]
        self.shortest = min([min_words, *(len(w) for _, w in items)])
        numbered = [(i, [self.vocab.setdefault(x, len(self.vocab)) for x in w]) for i, w in items]
        for _, w in numbered:
            last = 0
            for c in w:
                last = self._extend(last, c)
        self.wide = len(self.vocab) or 1
        self.step = {v * self.wide + c: to for v, t in enumerate(self.next) for c, to in t.items()}
        self._mark(numbered)
        pairs = {a * len(self.vocab) + b for _, w in numbered for a, b in zip(w, w[1:], strict=False)}
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)

    def packed(self) -> dict:
        """What a scan needs; transitions as sorted keys and targets."""
        n = len(self.vocab) or 1
        keys = np.array([v * n + c for v, t in enumerate(self.next) for c in sorted(t)], np.int64)
        to = np.array([t[c] for t in self.next for c in sorted(t)], np.int32)
        arrays = {"length": np.array(self.length, np.int32), "link": np.array(self.link, np.int32), "window": np.array(self.window, np.int32), "pairs": self.pairs, "keys": keys, "to": to}
        rest = {k: getattr(self, k) for k in ("min_words", "shortest", "vocab", "owners", "shorts")}
        return arrays | rest

    @classmethod
    def unpacked(cls, held: dict) -> SuffixAutomaton:
        self = cls.__new__(cls)
        for k in ("min_words", "shortest", "vocab", "owners", "shorts", "pairs"):
            setattr(self, k, held[k])
        self.length, self.link, self.window = (held[k].tolist() for k in ("length", "link", "window"))
        self.step, self.wide = dict(zip(held["keys"].tolist(), held["to"].tolist(), strict=True)), len(self.vocab) or 1
        return self

    def _extend(self, last: int, c: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        q = nxt[last].get(c)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._split(last, c, q)
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        nxt.append(dict(nxt[q]))
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _mark(self, numbered) -> None:
        """owners: items of the window that a state holds as its suffix; shorts: whole shorter items that end there."""
        n = len(self.length)
        self.window, self.owners = [-1] * n, {}
        own: dict[int, set] = {}
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.window[v] = self.window[up] if self.window[up] != -1 else v if self.length[v] >= self.min_words else -1
        for item, w in numbered:
            for v, length in self.walk(w):
                if length >= self.min_words:
                    self.owners.setdefault(self.window[v], set()).add(item)
            if len(w) < self.min_words:
                own.setdefault(v, set()).add((len(w), item))
        self.shorts: dict[int, tuple] = {}
        if own:
            for v in sorted(range(1, n), key=self.length.__getitem__):
                if found := (*self.shorts.get(self.link[v], ()), *own.get(v, ())):
                    self.shorts[v] = found

    def walk(self, w) -> Iterator[tuple[int, int]]:
        """The state and the length of the longest match that ends at each word."""
        v, size, link, step, wide, length = 0, 0, self.link, self.step, self.wide, self.length
        for c in w:
            while v and v * wide + c not in step:
                v = link[v]
                size = length[v]
            to = step.get(v * wide + c)
            if to is not None:
                v = to
                size += 1
            yield v, size

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Parts of at least the shortest window in which all words, and all pairs of neighbours, are items' own."""
        least = self.shortest
        if len(ids) < least:
            return []
        if least == 1:
            good = ids >= 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        good = (ids[:-1] >= 0) & (ids[1:] >= 0)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        long = edge[1::2] - edge[::2] >= least - 1
        out = []
        for a, b in zip(edge[::2][long].tolist(), edge[1::2][long].tolist(), strict=True):
            key = ids[a:b] * len(self.vocab) + ids[a + 1 : b + 1]
            at = np.searchsorted(self.pairs, key)
            known = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key
            e = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
            out += [(a + x, a + y + 1) for x, y in zip(e[::2].tolist(), e[1::2].tolist(), strict=True) if y - x >= least - 1]
        return out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs of hit words, and the items with an occurring window."""
        get, spans, items = self.vocab.get, [], set()
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for a, b in self.stretches(ids):
            for i, (v, size) in enumerate(self.walk(ids[a:b].tolist()), a + 1):
                reach = 0
                if size >= self.min_words:
                    reach = self.min_words
                    items |= self.owners[self.window[v]]
                for k, item in self.shorts.get(v, ()):
                    if k <= size:
                        reach = max(reach, k)
                        items.add(item)
                if reach:
                    start = i - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, items


_HITS = f"doc_id long, key {KEY}, n_words long, hits array<struct<start:int,end:int,lo:int,hi:int>>, items array<string>"


_AUTOMATA: dict[str, SuffixAutomaton] = {}


def automaton(name: str, data: Broadcast) -> SuffixAutomaton:
    """The broadcast automaton; made once in a worker."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = SuffixAutomaton.unpacked(data.value)
    return _AUTOMATA[name]


def _scan(name: str, data: Broadcast):
    """Rows (doc_id, key, text, further columns) to doc_id, key, n_words, hits, items and the further columns."""
    hit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sa = automaton(name, data)
        for batch in batches:
            for b in pieces(batch, 1000):
                n, found, owned = [], [], []
                for text in raw(b):
                    words = words_of(text)
                    spans, own = sa.hits(words)
                    at = []
                    if spans:  # bytes of the words, wanted only where something was hit
                        place = [m.span() for m in _WORD.finditer(text)]
                        at = [{"start": x, "end": y, "lo": place[x][0], "hi": place[y - 1][1]} for x, y in spans]
                    n.append(len(words))
                    found.append(at)
                    owned.append(sorted(own))
                columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(hit)), pa.array(owned, pa.list_(pa.string()))]
                names = ["doc_id", "key", "n_words", "hits", "items", *b.schema.names[3:]]
                yield pa.RecordBatch.from_arrays([*columns, *b.columns[3:]], names=names)

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return benchmark.select(item, F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")


def item_block(items: DataFrame, k: int, n: int) -> list[tuple[str, list[bytes]]]:
    """The k-th of n blocks of items, some block_chars characters."""
    part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return [(r["item"], words_of(r["text"].encode())) for r in part.collect()]


def _scanned(rows: DataFrame, items: list[tuple[str, list[bytes]]], min_words: int, more: str = "") -> DataFrame:
    data = rows.sparkSession.sparkContext.broadcast(SuffixAutomaton(items, min_words).packed())
    return rows.mapInArrow(_scan(uuid.uuid4().hex, data), _HITS + more)


def window_hashes(words: list[bytes], sizes: Iterable[int]) -> Iterator[np.ndarray]:
    """Hashes of all runs of so many words, for each of the sizes."""
    from xxhash import xxh64_intdigest

    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    for size in sizes:
        h = np.full(max(0, len(w) - size + 1), size, np.uint64)
        for j in range(size if len(h) else 0):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + w[j : j + len(h)]
        yield (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _sift(hashes: Broadcast):
    """row, n_words and the blocks of which the text holds a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, sizes = hashes.value
        for batch in batches:
            for b in pieces(batch, 1000):
                n, found = [], []
                for text in raw(b):
                    words = words_of(text)
                    n.append(len(words))
                    mine: set[int] = set()
                    for h in window_hashes(words, sizes):
                        # a window that several blocks hold stands there several times
                        starts, ends = (np.searchsorted(known, h, side=side) for side in ("left", "right"))
                        some = starts < ends
                        for x, y in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                            mine.update(block[x:y].tolist())
                    found.append(sorted(mine))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["row", "n_words", "blocks"])

    return run


def _sifted(rows: DataFrame, items: DataFrame, n: int, min_words: int, at_once: int) -> DataFrame:
    """row, n_words, blocks of rows(row, text), which are read once for each `at_once` blocks."""
    found = None
    for first in range(0, n, at_once):
        hashes, blocks, sizes = [], [], set()
        for k in range(first, min(n, first + at_once)):
            for _, words in item_block(items, k, n):
                if words:
                    size = min(min_words, len(words))
                    sizes.add(size)
                    hashes += window_hashes(words, (size,))
                    blocks.append(np.full(len(hashes[-1]), k, np.int32))
        known, block = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((hashes, np.uint64), (blocks, np.int32)))
        order = np.lexsort((block, known))
        data = rows.sparkSession.sparkContext.broadcast((known[order], block[order], sorted(sizes)))
        part = rows.select("row", "text").mapInArrow(_sift(data), "row long, n_words long, blocks array<int>")
        found = part if found is None else found.unionAll(part)
    return found


def find_hits(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, block_chars: int = 1_500_000, at_once: int = 32) -> DataFrame:
    """doc_id, key, n_words, hits (runs of hit words with their bytes in the text) and items for each row of docs.
    at_once: blocks whose windows are sifted in one pass over the documents, some 2 MB of hashes each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_chars))
    if n == 1:
        return _scanned(rows, item_block(items, 0, 1), min_words)
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    sifted = saved(_sifted(rows, items, n, min_words, at_once), "sifted")
    asked = saved(sifted.select("row", F.explode("blocks").alias("block")), "asked-blocks")
    found = None
    for k in range(n):  # written one by one, so that the driver holds one block
        few = rows.join(asked.filter(F.col("block") == k).select("row"), "row", "left_semi").select("doc_id", "key", "text", "row")
        part = saved(_scanned(few, item_block(items, k, n), min_words, ", row long"), "block-hits").filter(F.size("hits") > 0)
        found = part if found is None else found.unionAll(part)
    united = found.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = united.mapInArrow(_united, "row long, hits array<struct<start:int,end:int,lo:int,hi:int>>, items array<string>")
    sizes = sifted.groupBy("row").agg(F.max("n_words").alias("n_words"))
    whole = rows.select("row", "doc_id", "key").join(sizes, "row").join(united, "row", "left")
    none = {c: F.array().cast(whole.schema[c].dataType) for c in ("hits", "items")}
    return whole.select("doc_id", "key", "n_words", *(F.coalesce(c, none[c]).alias(c) for c in none))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching runs of different blocks as one."""
    for b in batches:
        out = []
        for hits in b.column(1).to_pylist():
            runs: list[dict] = []
            for h in sorted(hits, key=lambda h: (h["start"], h["end"])):
                if runs and runs[-1]["end"] >= h["start"]:
                    runs[-1] |= {"end": max(runs[-1]["end"], h["end"]), "hi": max(runs[-1]["hi"], h["hi"])}
                else:
                    runs.append(dict(h))
            out.append(runs)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.schema.field(1).type), b.column(2)], names=b.schema.names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without their hit spans; rows of which more than max_coverage of the words are hit are dropped.
    Columns stay as they are, n_chars (if any) is set anew where text was cut."""
    key, at, drop, left = free(docs.columns, "row_key", "row_cut", "row_drop", "row_text")
    found = find_hits(docs, benchmark, min_words).filter(F.size("hits") > 0)
    hit = F.aggregate("hits", F.lit(0), lambda a, h: a + h["end"] - h["start"])
    found = found.select(F.col("key").alias(key), F.transform("hits", lambda h: F.struct(h["lo"].alias("lo"), h["hi"].alias("hi"))).alias(at), (hit / F.col("n_words") > max_coverage).alias(drop)).dropDuplicates([key])
    rows = docs.withColumn(key, row_key("doc_id", "text")).join(found, key, "left").filter(~F.coalesce(drop, F.lit(False)))
    cut = F.when(F.col(at).isNull(), F.col("text")).otherwise(between(F.col("text").cast("binary"), F.col(at), ""))
    out = rows.withColumn(left, cut)
    new = {"text": F.col(left)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length(left).cast("long"))
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0), lambda a, h: a + h["end"] - h["start"]).cast("long")
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def oracle_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, win FROM (
  SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
