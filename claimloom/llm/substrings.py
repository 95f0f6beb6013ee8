"""Suffix-array dedup by bucket-pointer refinement, over sampled suffixes.

Removes each byte that a string of `length` bytes covers which starts anywhere else too.

1. Sampling: only a sample of suffixes is shuffled. Suffixes get the identifier (a 64-bit hash) of their first length / 2
   bytes; every start of a string of `length` bytes is assigned the suffix of least identifier among those that
   begin in its first half, the first among equals. That depends on the string alone, so equal strings are assigned
   suffixes at the same place in one sample bucket. Sample buckets of one suffix are done.
2. Refinement of what a sample bucket's suffixes stand for: every start gets the bucket of its first q-gram (25 bytes for
   a length of 400). A bucket is refined by sorting its starts on the bucket identifiers of the starts q bytes later, which
   gives the buckets of 2q bytes; those identifiers are reused in the next round, and so on up to `length` bytes.
   A start that is alone in its bucket keeps its identifier and is sorted no more. Starts that are together in the
   end are found elsewhere too, and their bytes are marked.
3. Marks are united for each text, and the bytes that are left are kept.

Equal texts are one text, of which one row is refined; if they have `length` bytes or more they go whole. A sample
bucket of more than `hot` suffixes, beyond what a task should hold, is refined in rows of single strings, whose
identifiers are hashes of the pair of identifiers of half as many bytes, from the q-gram up; Spark pre-aggregates
and deals them by identifier. No task holds an unbounded bucket.

Defined cases: a null text is empty; repeated rows are equal texts; texts of fewer than `length` bytes stay;
matches never cross documents; rows with a null doc_id count like any other; extra columns are ignored.
Identifiers have 64 bits; two different strings in a bucket being taken as equal is out of reach. Texts are known by a hash of
64 bits; where two texts share one, which a second hash tells, that second one is theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, raw, saved, table

_U = np.uint64
_R = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
#: crowded buckets whose identifiers are broadcast; if there are more, they are joined like the others
MOST_CROWDS = 1_000_000
_HIGH, _LOW = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out


_UP, _DOWN = _powers(_R, 1 << 16), _powers(pow(_R, -1, 1 << 64), 1 << 16)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def buckets(text: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifier of every start of q bytes."""
    n = len(text)
    if n < q:
        return np.zeros(0, _U)
    up, down = (_UP, _DOWN) if n < 1 << 16 else (_powers(_R, n), _powers(pow(_R, -1, 1 << 64), n))
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[text] * up[:n], out=sums[1:])
    return _stir((sums[q:] - sums[:-q]) * down[: n - q + 1])


def assigned(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that are the least of `width` neighbours, and the first and last start that each is assigned to."""
    n = len(x) - width + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    v = (x & _HIGH) | np.arange(len(x), dtype=_U)  # earlier is less among equals
    pad = np.full(-len(v) % width, np.iinfo(np.uint64).max, _U)
    block = np.concatenate([v, pad]).reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).reshape(-1)
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], first, np.append(first[1:], n) - 1


def rounds(length: int, least: int = 25) -> list[int]:
    """Lengths of the rounds of refinement: the q-gram, then up to twice as many bytes each time."""
    out = [length]
    while out[-1] > least:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def strings(text: np.ndarray, length: int) -> np.ndarray:
    """Identifier of every string of `length` bytes: a hash of those of its two halves, which overlap if it is odd."""
    sizes = rounds(length)
    x = buckets(text, sizes[0])
    for q, size in zip(sizes, sizes[1:], strict=False):
        n = max(0, len(text) - size + 1)
        x = _stir(x[:n] * _U(3) + _stir(x[size - q : size - q + n]))
    return x


def together(text: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Starts of strings of `length` bytes that come twice, ascending; room: the bytes from each start to its row's end.

    A bucket's identifier is the start of one of its members, so identifiers stay below the text's length whatever is
    split off, and a pair of them and a place fit one number for a text of up to two million bytes."""
    sizes, width = rounds(length), max(1, len(text).bit_length())
    alive = np.flatnonzero(room >= sizes[0])
    if not len(alive):
        return alive
    ids, more = np.zeros(len(text), np.int64), np.zeros(len(text), bool)

    def regroup(order: np.ndarray, new: np.ndarray) -> None:
        """New identifiers for the starts alive, in this order with these first ones; those in company stay alive."""
        nonlocal alive
        place = alive[order]
        ids[place] = place[new][np.cumsum(new) - 1]
        company = ~(new & np.append(new[1:], True))
        more[:] = False
        more[place[company]] = True
        alive = np.flatnonzero(more)

    h = buckets(text, sizes[0])[alive]
    order, new = _ordered_hashes(h, width)
    regroup(order, new)
    for q, size in zip(sizes, sizes[1:], strict=False):
        alive = alive[room[alive] >= size]
        if not len(alive):
            break
        pair = (ids[alive] << width) | ids[alive + (size - q)]
        if 3 * width <= 63:
            packed = np.sort((pair << width) | np.arange(len(pair)))
            order, pair = packed & ((1 << width) - 1), packed >> width
        else:
            order = np.argsort(pair)
            pair = pair[order]
        regroup(order, np.concatenate(([True], pair[1:] != pair[:-1])))
    return alive


def _ordered_hashes(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and which of them is the first of its kind."""
    if 3 * width <= 63:
        packed = np.sort((h & ~_U((1 << width) - 1)) | np.arange(len(h), dtype=_U))
        order = (packed & _U((1 << width) - 1)).astype(np.int64)
        kind, high = h[order], packed >> _U(width)
        new, apart = kind[1:] != kind[:-1], high[1:] != high[:-1]
        if (new == apart).all():  # no two kinds share their high bits
            return order, np.concatenate(([True], new))
    order = np.argsort(h)
    return order, np.concatenate(([True], h[order][1:] != h[order][:-1]))


def _sample(length: int):
    q = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 500):
                cols: list[list] = [[], [], [], []]
                for key, text in zip(b.column(0).to_pylist(), raw(b), strict=True):
                    if len(text) < length:
                        continue
                    x = buckets(np.frombuffer(text, np.uint8), q)
                    place, first, last = assigned(x, length - q + 1)
                    for c, v in zip(cols, (x[place].view(np.int64), np.full(len(place), key), first, last), strict=True):
                        c.append(v)
                if cols[0]:
                    kinds = (np.int64, np.int64, np.int32, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "key", "first", "last"])

    return run


def _around(length: int):
    """The bytes of all strings assigned to each suffix."""
    kind = [("bucket", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("hot", pa.bool_()), ("bytes", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 50):
                cols = [[] for _ in kind]
                for key, text, found in zip(b.column(0).to_pylist(), raw(b), b.column(2).to_pylist(), strict=True):
                    for s in found:
                        for c, v in zip(cols, (s["bucket"], key, s["first"], s["hot"], text[s["first"] : s["last"] + length]), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kind, strict=True)], names=[n for n, _ in kind])

    return run


def _identify(around: list[bytes], length: int, rows: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of all strings of all rows, end to end, and how many each row has. Rows are laid end to end and
    looked up at a stroke, so many at a time, as no identifier depends on what is before or behind its bytes."""
    own = np.fromiter(map(len, around), np.int64, len(around)) - length + 1
    out = []
    for i in range(0, len(around), rows):
        n = own[i : i + rows]
        ends = np.cumsum(n + length - 1)
        ids = strings(np.frombuffer(b"".join(around[i : i + rows]), np.uint8), length)
        out.append(ids[np.repeat(ends - n - length + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    return np.concatenate(out) if out else np.zeros(0, _U), own


def _refine(length: int):
    """Rows come sorted by sample bucket; whole buckets are compared at once, many in one go, as equal strings share one."""

    def compare(bucket: list[int], key: list[int], first: list[int], around: list[bytes]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, around), np.int64, len(around))
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(around), np.uint8)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(text))
        hit = together(text, ends[row] - place, length)
        new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0))) if len(hit) else np.zeros(0, bool)
        a = hit[new]
        z = np.append(hit[np.flatnonzero(new)[1:] - 1], hit[-1:]) if len(hit) else hit
        start = np.array(first, np.int64)[row[a]] - (ends - sizes)[row[a]]
        columns = [np.array(key, np.int64)[row[a]], (start + a).astype(np.int32), (start + z + length).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for b in pieces(batch, 1000, 1 << 20):
                for h, c in zip(held, (b.column(i).to_pylist() for i in range(4)), strict=True):
                    h += c
                last = held[0][-1]
                cut = held[0].index(last) if held[0][0] != last else 0
                if cut:
                    yield compare(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if held[0]:
            yield compare(*held)

    return run


def _single(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 500):
                ids, own = _identify(b.column(3).to_pylist(), length)
                row = np.repeat(np.arange(len(own)), own)
                at = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
                key, first, bucket = (b.column(i).to_numpy()[row] for i in (1, 2, 0))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids.view(np.int64)), pa.array(key), pa.array((first + at).astype(np.int32))], names=["bucket", "id", "key", "start"])

    return run


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _second(text: Column) -> Column:
    return F.xxhash64(F.lit("second"), text)


def _texts(rows: DataFrame, length: int) -> DataFrame:
    """key, id, n, and the least and greatest second hash of the texts with `length` bytes or more."""
    long = rows.filter(F.octet_length("text") >= length).withColumn("second", _second(F.col("text")))
    return saved(long.groupBy("key", "id").agg(F.count("*").alias("n"), F.min("second").alias("low"), F.max("second").alias("high")), "texts")


def repeated(docs: DataFrame, length: int = 400, hot: int = 8192) -> DataFrame:
    """doc_id, text, whole (all of it goes), marks (byte runs to remove, in no order, may overlap): one row for each row of docs."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(doc_id, F.lit(-(2**63))).alias("id"), doc_id.alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", text_key(F.col("text")))
    own = _texts(rows, length)
    clash = saved(own.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("key"), "clashes")
    if not clash.isEmpty():  # different texts of one key go by their second hash
        rows = rows.join(clash.withColumn("clash", F.lit(True)), "key", "left")
        rows = rows.withColumn("key", F.when(F.col("clash"), _second(F.col("text"))).otherwise(F.col("key"))).drop("clash")
        own = _texts(rows, length)
    copies = own.groupBy("key").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    sample = saved(rows.select("key", "text").mapInArrow(_sample(length), "bucket long, key long, first int, last int").distinct(), "suffixes")
    shared = saved(sample.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    crowded = shared.filter(F.col("n") > hot).select("bucket")
    rest, crowds = sample, None
    if 0 < crowded.limit(MOST_CROWDS + 1).count() <= MOST_CROWDS:  # their suffixes need not meet in the task of their bucket
        crowds = sample.join(F.broadcast(crowded), "bucket").withColumn("hot", F.lit(True))
        rest = sample.join(F.broadcast(crowded), "bucket", "left_anti")
    marked = rest.join(shared, "bucket").withColumn("hot", F.col("n") > hot).drop("n")
    marked = (marked if crowds is None else marked.unionByName(crowds)).groupBy("key").agg(F.collect_list(F.struct("bucket", "first", "last", "hot")).alias("found"))
    one = marked.join(copies.select("key", "id"), "key")
    around = rows.join(one.hint("shuffle_hash"), ["key", "id"]).select("key", "text", "found").mapInArrow(_around(length), "bucket long, key long, first int, hot boolean, bytes binary")
    around = saved(around, "around")
    cold = around.filter("NOT hot").drop("hot").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine(length), "key long, start int, end int")
    single = around.filter("hot").drop("hot").mapInArrow(_single(length), "bucket long, id long, key long, start int")
    twice = single.groupBy("bucket", "id").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    crowd = single.join(twice, ["bucket", "id"]).select("key", "start", (F.col("start") + length).alias("end"))
    spans = cold.unionByName(crowd).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    alone = copies.filter("n = 1").join(spans, "key").select("key", "id", "marks", F.lit(False).alias("whole"))
    twins = own.join(copies.filter("n > 1").select("key"), "key").select("key", "id", F.lit(None).cast("array<struct<start:int,end:int>>").alias("marks"), F.lit(True).alias("whole"))
    found = alone.unionByName(twins)
    return rows.join(found.hint("shuffle_hash"), ["key", "id"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "marks")


def kept_bytes(text: bytes, whole: bool, marks) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal runs that were removed."""
    if whole:
        return b"", int(bool(text))
    if not marks:
        return text, 0
    out, at, runs = [], 0, 0
    end = -1
    for a, z in sorted((m["start"], m["end"]) for m in marks):
        if a > end:
            runs += 1
            out.append(text[max(at, 0) : a])
        end = at = max(end, z)
    out.append(text[at:])
    return b"".join(out), runs


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, kept (the bytes that are left; a cut may fall within a character), n_bytes, n_removed, n_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 500):
                data = raw(b)
                left = [kept_bytes(t, w, m) for t, w, m in zip(data, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                n = [len(t) for t in data]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in left], pa.binary()), pa.array(n, pa.int64()), pa.array([a - len(k) for a, (k, _) in zip(n, left, strict=True)], pa.int64()), pa.array([r for _, r in left], pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return repeated(docs, length).mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql(length: int = 400) -> str:
    """For small tables: every string of so many bytes is hashed where it starts."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * length})) AS h FROM (SELECT doc_id, x, unnest(range(0, n - {length - 1})) AS i FROM n WHERE n >= {length})),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN t USING (h)),
r AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS z FROM (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s) GROUP BY doc_id, k),
g AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM r),
k AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS runs, string_agg(substr(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS kept, max(z) AS last FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN runs IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)"""
