"""SimHash near-duplicates, with candidates by the pigeonring principle.

A 64-bit fingerprint is seen as a ring of four segments of 16 bits. If two differ in at most 3 bits, then
from some segment on each chain of l consecutive segments differs in at most l * 3/4 bits: 0, 1, 2 and 3. The
first two segments of such a chain are a join key of 32 bits: one side looks it up as it is and with each
zero bit of the second segment set, so every pair within the budget meets. The chain of three is checked next
and prunes candidates before the full count of differing bits.

Documents with equal fingerprints are one node. A key that many nodes share is split by one of the other two
segments, of which one differs in at most a bit, so that 48 bits are known. If many nodes share those too, both
sides, those that are looked up and those that look, are dealt into blocks, and each pair of blocks, bounded in size,
returns a spanning forest of its links: no group emits all its pairs, and no task holds an unbounded group.
Links go to components().

The pipeline's stage (cluster_words, keep_one) takes such pairs, and bands of least shingle hashes, as candidates only: each
link is verified by the exact Jaccard similarity of the texts' five-word shingles before it goes to components(). First
every node of a band is held against the band's first node, so that rows grow with the nodes; what that links is
contracted. Only bands whose nodes are still in several components are compared as a whole, in blocks of bounded size,
and there only nodes of different components.

Rows are known by two hashes of doc_id and text, texts by a hash of 128 bits of their words.

Defined cases: a null text has no words; without words the fingerprint is zero, linked like any other; a
null doc_id stands in its group but is no component's name unless nothing else is there; repeated rows are
rows of one group; extra columns are ignored by cluster and kept by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, free, pieces, raw, row_key, saved, table
from .components import components

BITS, SEGMENTS, WIDTH = 64, 4, 16
#: near copies share this part, 4 of 5, of their shingles of so many words
LEAST, SHINGLE = (4, 5), 5
#: least hashes of the shingles under BANDS * ROWS orders; a pair that shares 0.8 misses all bands once in 300,000
BANDS, ROWS = 32, 5


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z alone are lowered, white space is ASCII's
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1000):
                fp = np.array([fingerprint(t, shingle, seed) for t in raw(b)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "key", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, key (of doc_id and text), fp for each row of docs."""
    return _keyed(docs).mapInArrow(_fingerprints(shingle, seed), f"doc_id long, key {KEY}, fp long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))


def word_fingerprints(text: bytes, count: int, seed: int = 42) -> list[int]:
    """`count` fingerprints of the text's distinct words, whose hashes are stirred anew for each."""
    from xxhash import xxh64_intdigest

    kinds = set(text.lower().split())
    if not kinds:
        return [0] * count
    h = np.fromiter(map(xxh64_intdigest, kinds, repeat(seed)), np.uint64, len(kinds))
    out = []
    for i in range(count):
        g = h
        if i:
            g = h * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1))
            g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            g ^= g >> np.uint64(29)
        ones = np.zeros(BITS, np.int64)
        for j in range(0, len(g), 4096):
            ones += np.unpackbits(g[j : j + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(g), bitorder="little").view("<u8")[0]))
    return out


def shingle_hashes(text: bytes, size: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct runs of `size` words; of fewer words one, of all; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + w[j : j + len(h)]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def band_keys(grams: np.ndarray, seed: int = 42) -> np.ndarray:
    """For each band a hash of the least hashes of its orders; none of an empty set."""
    if not len(grams):
        return np.empty(0, np.uint64)
    draw = np.random.default_rng(seed)
    stir = draw.integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(grams), 1024):
        np.minimum(least, ((grams[i : i + 1024] ^ stir[0]) * stir[1]).min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for one in least.reshape(BANDS, ROWS).T:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + (one >> np.uint64(32))
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fp: Column, i: int, second: Column) -> Column:
    return F.lit(i << 2 * WIDTH) + F.shiftleft(_segment(fp, i), WIDTH) + second


def _flipped(fp: Column, i: int) -> Column:
    """Keys with one zero bit of the second segment set: of two that differ there, one has the zero."""
    second = _segment(fp, i + 1)
    zeros = F.filter(F.array(*(F.lit(1 << b).cast("long") for b in range(WIDTH))), lambda m: second.bitwiseAND(m) == 0)
    return F.transform(zeros, lambda m: F.struct(F.lit(i).alias("i"), _keys(fp, i, second + m).alias("key")))


def links(nodes: DataFrame, distance: int = 3, direct: int = 48, block: int = 2048) -> DataFrame:
    """Pairs (u, v) of nodes(fp) that differ in at most `distance` bits; within a key of more than `direct` nodes
    a spanning forest of such pairs. With a column `tag` (a small number), pairs are of equal tag, which is returned."""
    if distance >= SEGMENTS:
        raise ValueError("the budgets are for distances below the number of segments")
    tagged = "tag" in nodes.columns
    nodes = nodes if tagged else nodes.withColumn("tag", F.lit(0))
    tag = F.shiftleft(F.col("tag").cast("long"), 2 * WIDTH + 2)

    def keyed(keys: Column) -> DataFrame:
        return nodes.select("fp", "tag", F.explode(keys).alias("k")).select("fp", "tag", "k.i", (F.col("k.key") + tag).alias("key"))

    index = keyed(F.array(*(F.struct(F.lit(i).alias("i"), _keys(F.col("fp"), i, _segment(F.col("fp"), i + 1)).alias("key")) for i in range(SEGMENTS))))
    probes = keyed(F.flatten(F.array(*(_flipped(F.col("fp"), i) for i in range(SEGMENTS)))))
    # a probe meets index rows, index rows meet each other; each row that asks meets at most `direct`
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    hot = saved(sizes.filter(F.col("n") > direct).select("key"), "hot-keys")
    some_hot = not hot.isEmpty()

    def near(rows: DataFrame) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        three = sum((F.when(F.col("i") == i, _apart(_segment(a, i), _segment(b, i)) + _apart(_segment(a, i + 1), _segment(b, i + 1)) + _apart(_segment(a, i + 2), _segment(b, i + 2))).otherwise(0) for i in range(SEGMENTS)), F.lit(0))
        return rows.filter(three <= distance * 3 // SEGMENTS).filter(_apart(a, b) <= distance).select("tag", a.alias("u"), b.alias("v"))

    def cold(rows: DataFrame) -> DataFrame:
        return rows.join(hot, "key", "left_anti") if some_hot else rows

    held = cold(index).select("key", "tag", "i", F.col("fp").alias("b"))
    asked = cold(index.withColumn("own", F.lit(True)).unionByName(probes.withColumn("own", F.lit(False)))).select("key", "own", F.col("fp").alias("a"))
    out = near(held.join(asked, "key").filter(~F.col("own") | (F.col("a") < F.col("b"))))
    if some_hot:
        held, asked = _split_hot(index, probes, hot)
        small = held.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") <= direct).select("key")
        out = out.unionByName(near(held.withColumnRenamed("fp", "b").join(small, "key").join(asked.select("key", F.col("fp").alias("a")), "key").filter("a <> b")))
        out = out.unionByName(_block_links(hot_blocks(held, asked, direct, block), distance))
    out = out.distinct()
    return out if tagged else out.select("u", "v")


def _split_hot(index: DataFrame, probes: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys, those that are looked up and those that look, under keys of 48 bits: hashes of the key and
    the value of one of the last two segments of the ring, as it is and, for those that look, with any bit turned."""

    def parts(rows: DataFrame, turned: bool) -> DataFrame:
        keys = []
        for j in (2, 3):
            value = F.expr(f"shiftrightunsigned(fp, {WIDTH} * ((i + {j}) % {SEGMENTS})) & {(1 << WIDTH) - 1}")
            values = F.array(value, *(value.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(WIDTH))) if turned else F.array(value)
            keys.append(F.transform(values, partial(_named, j)))
        return rows.join(hot, "key").select("tag", "i", "fp", F.explode(F.concat(*keys)).alias("key"))

    held = saved(parts(index, False), "hot-held")
    asked = parts(index.unionByName(probes), True).join(held.select("key").distinct(), "key", "left_semi").distinct()
    return held, saved(asked, "hot-asked")


def _named(j: int, value: Column) -> Column:
    return F.xxhash64(F.col("key"), F.lit(j), value)


def hot_blocks(held: DataFrame, asked: DataFrame, direct: int, block: int) -> DataFrame:
    """key, tag, x, y, held, fp: the nodes of each key that more than `direct` held rows have, in pairs (x, y) of blocks of
    about `block` rows that are held and as many that ask."""
    some = held.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > direct)
    some = some.join(asked.groupBy("key").agg(F.count("*").alias("m")), "key")
    some = saved(some.select("key", F.ceil(F.col("n") / block).cast("int").alias("xs"), F.ceil(F.col("m") / block).cast("int").alias("ys")), "hot-blocks")

    def dealt(rows: DataFrame, own: str, other: str, names: tuple[str, str], flag: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("fp"), F.col(own).cast("long")).cast("int")
        return rows.join(some, "key").select("key", "tag", F.lit(flag).alias("held"), "fp", mine.alias(names[0]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]))

    return dealt(held, "xs", "ys", ("x", "y"), True).unionByName(dealt(asked, "ys", "xs", ("y", "x"), False))


def _block_links(rows: DataFrame, distance: int) -> DataFrame:
    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["held"].to_numpy()
        out = spanning(np.unique(pdf["fp"].to_numpy()[held]), np.unique(pdf["fp"].to_numpy()[~held]), distance)
        return pd.DataFrame({"tag": [int(pdf["tag"].iloc[0])] * len(out), "u": [p[0] for p in out], "v": [p[1] for p in out]}, dtype="int64")

    return rows.groupBy("key", "x", "y").applyInPandas(forest, "tag int, u long, v long")


def spanning(held: np.ndarray, asked: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a held and an asking fingerprint within the distance: rows that are one tree
    already are not compared."""
    names, place = np.unique(np.concatenate([held, asked]), return_inverse=True)
    f, root, right = names.view(np.uint64), np.arange(len(names)), np.unique(place[len(held) :])
    out = []
    for i in np.unique(place[: len(held)]).tolist():
        rest = right[root[right] != root[i]]
        if not len(rest):
            continue
        near = rest[np.bitwise_count(f[rest] ^ f[i]) <= distance]
        if len(near):
            roots, first = np.unique(root[near], return_index=True)
            out += [(int(names[i]), int(names[near[k]])) for k in first]
            root[np.isin(root, roots)] = root[i]
    return out


def cluster(docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """doc_id, key, fp, component_id (smallest doc_id reachable) for each row of docs."""
    rows = saved(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), distance))
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.select("fp", "component").join(names, "component").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", "key", "fp", "component_id")


def _word_prints(count: int, seed: int):
    from xxhash import xxh3_128_intdigest

    lists = pa.list_(pa.int64())

    def halves(numbers: list[int]) -> pa.StructArray:
        both = [np.array([(n >> at) & (2**64 - 1) for n in numbers], np.uint64).view(np.int64) for at in (64, 0)]
        return pa.StructArray.from_arrays([pa.array(h) for h in both], names=["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1000):
                words = [b" ".join(t.lower().split()) for t in raw(b)]
                same = halves([xxh3_128_intdigest(w, seed) for w in words])
                fps = np.array([word_fingerprints(w, count, seed) for w in words], np.uint64).view(np.int64)
                grams = [shingle_hashes(w, SHINGLE, seed) for w in words]
                bands = [band_keys(g, seed).view(np.int64).tolist() for g in grams]
                columns = [b.column(0), b.column(1), same, pa.array(list(map(len, grams)), pa.int64()), pa.array(fps.tolist(), lists), pa.array(bands, lists)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "same", "n_grams", "fps", "bands"])

    return run


def _grams(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1000):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t, SHINGLE, seed).tobytes() for t in raw(b)], pa.binary())], names=["node", "grams"])

    return run


def similar(sets: list[np.ndarray], known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is LEAST or more, all of them compared exactly but
    those that are one tree already; sets with equal known numbers are from the start. None of the sets is empty."""
    size = np.array(list(map(len, sets)))
    kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    root, mine, out = np.arange(len(sets)), np.zeros(len(kinds), bool), []
    if known is not None:
        first: dict[int, int] = {}
        root = np.array([first.setdefault(k, i) for i, k in enumerate(known)])
    for i in range(len(sets)):
        if (root == root[i]).all():
            break
        own = ids[starts[i] : starts[i] + size[i]]
        mine[own] = True
        both = np.add.reduceat(mine[ids], starts, dtype=np.int64)
        mine[own] = False
        near = np.flatnonzero((LEAST[1] * both >= LEAST[0] * (size + size[i] - both)) & (root != root[i]))
        if len(near):
            roots, first_of = np.unique(root[near], return_index=True)
            out += [(i, int(near[k])) for k in first_of]
            root[np.isin(root, roots)] = root[i]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, x, y, node, component, grams) lie sorted by the first three; the links of each such group."""
    now, held, out = None, {}, []

    def done() -> None:
        if len(held) > 1:
            names = list(held)
            found = similar([np.frombuffer(g, np.uint64) for _, g in held.values()], [c for c, _ in held.values()])
            out.extend((names[i], names[j]) for i, j in found)

    def emit() -> pa.RecordBatch:
        found = _links_of(out)
        out.clear()
        return found

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if row[:3] != now:
                done()
                now, held = row[:3], {}
            held[row[3]] = row[4:]
        if len(out) > 10_000:
            yield emit()
    done()
    yield emit()


def _links_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])


def shingle_sets(docs: DataFrame, nodes: DataFrame, seed: int = 42) -> DataFrame:
    """node, grams: the hashes of the shingles of each of nodes(node, key), from docs(key, text)."""
    found = docs.join(nodes, "key").dropDuplicates(["node"]).select("node", "text")
    return saved(found.mapInArrow(_grams(seed), "node long, grams binary"), "grams")


def within_groups(grams: DataFrame, members: DataFrame, block: int = 1024, most_grams: int = 2_000_000) -> DataFrame:
    """Links (u, v) within the groups of members(group, node, n_grams, component): of each group what joins its components to a
    spanning forest. Groups are compared in blocks of bounded rows and shingles. members is read twice."""
    members = members.filter("n_grams > 0")
    who = F.bit_xor(F.xxhash64("node"))
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("n_grams").alias("all_grams"), who.alias("who")).filter("n > 1")
    sizes = sizes.groupBy("n", "all_grams", "who").agg(F.min("group").alias("group"))  # groups of the same nodes are compared once
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("all_grams") / most_grams)).cast("int")
    sizes = saved(sizes.select("group", blocks.alias("blocks")), "sizes")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    rows = members.join(sizes, "group").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node", "component").join(grams, "node")
    keys = ["group", "x", "y"]
    rows = rows.select(*keys, "node", "component", "grams").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_verified, "u long, v long")


def verified(docs: DataFrame, nodes: DataFrame, members: DataFrame, seed: int = 42, block: int = 1024, words: int = 2_000_000) -> DataFrame:
    """within_groups() of members(group, node, n_words) that have no components yet. docs: key, text; nodes: node, key."""
    members = members.select("group", "node", F.col("n_words").alias("n_grams"), F.col("node").alias("component"))
    asked = nodes.select("node", "key").join(members.select("node").distinct(), "node", "left_semi")
    return within_groups(shingle_sets(docs, asked, seed), members, block, words)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (u, v, grams of u, grams of v) of pairs that are similar."""
    for batch in batches:
        out = []
        for u, v, *sets in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            a, b = (np.frombuffer(x, np.uint64) for x in sets)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both):
                out.append((u, v))
        yield _links_of(out)


def alike(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose exact Jaccard similarity is LEAST or more."""
    rows = pairs.join(grams.select(F.col("node").alias("u"), F.col("grams").alias("a")), "u")
    rows = rows.join(grams.select(F.col("node").alias("v"), F.col("grams").alias("b")), "v")
    return rows.select("u", "v", "a", "b").mapInArrow(_alike, "u long, v long")


def _may_fit(a: str, b: str) -> Column:
    """Sets of such sizes can share enough."""
    return (F.least(a, b) > 0) & (LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b))


def _near_prints(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (u, v) of nodes(node, fps), the first ones of fingerprints within the distance; none is verified."""
    here = nodes.select("node", F.posexplode("fps").alias("tag", "fp"))
    first = saved(here.groupBy("tag", "fp").agg(F.min("node").alias("first")), "firsts")
    near = links(first.select("tag", "fp"), distance)
    near = near.join(first.select("tag", F.col("fp").alias("u"), F.col("first").alias("a")), ["tag", "u"])
    near = near.join(first.select("tag", F.col("fp").alias("v"), F.col("first").alias("b")), ["tag", "v"]).filter("a <> b")
    return near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def cluster_words(docs: DataFrame, count: int = 1, seed: int = 42, distance: int = 3) -> DataFrame:
    """doc_id, key, component_id for each row of docs. Texts that are equal but for case and white space are one node;
    nodes of which one of `count` fingerprints of distinct words is within the distance, or a band of least shingle
    hashes is equal, are candidates, and link if the exact Jaccard similarity of their five-word shingles is LEAST or
    more. The bands find what fingerprints do not: cut or lengthened copies at 0.8 differ in 6 to 10 bits of 64."""
    taken = _keyed(docs)
    prints = f"doc_id long, key {KEY}, same {KEY}, n_grams long, fps array<long>, bands array<long>"
    rows = saved(taken.mapInArrow(_word_prints(count, seed), prints), "word-prints")
    least = [F.min(c).alias(c) for c in ("key", "n_grams", "fps", "bands")]
    nodes = rows.groupBy("same").agg(F.min("doc_id").alias("least"), *least)
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # groups of two and more: equal bands, equal fingerprints
    prints = F.transform("fps", lambda fp, tag: F.xxhash64(F.lit("print"), tag, fp))
    members = nodes.select("node", "n_grams", F.explode(F.concat("bands", prints)).alias("group"))
    centres = members.groupBy("group").agg(F.min(F.struct("node", "n_grams")).alias("centre"), F.count("*").alias("n")).filter("n > 1")
    shared = saved(members.join(centres, "group").select("group", "node", "n_grams", F.col("centre.node").alias("centre"), F.col("centre.n_grams").alias("n_centre")), "shared")
    near = saved(_near_prints(nodes, distance), "near-prints")
    ends = shared.select("node").unionAll(near.select("u")).unionAll(near.select("v")).distinct()
    grams = shingle_sets(taken.select("key", "text"), nodes.select("node", "key").join(ends, "node", "left_semi"), seed)

    # each node against the first of its groups
    star = shared.filter("node <> centre").filter(_may_fit("n_grams", "n_centre")).select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    edges = saved(alike(star, grams), "star-links")
    known = saved(components(edges), "star-components")

    # what is left: groups that hold several components, and fingerprints that are near
    own = saved(nodes.join(known, "node", "left").select("node", "n_grams", F.coalesce("component", "node").alias("component")), "contracted")
    placed = shared.join(own.select("node", "component"), "node")
    mixed = placed.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("group")
    mixed = saved(placed.join(mixed, "group", "left_semi").select("group", "node", "n_grams", "component"), "mixed-groups")
    for end in ("u", "v"):
        near = near.join(own.select(F.col("node").alias(end), F.col("n_grams").alias(f"n_{end}"), F.col("component").alias(f"c_{end}")), end)
    apart = near.filter("c_u <> c_v").filter(_may_fit("n_u", "n_v")).select("u", "v")
    edges = edges.unionByName(within_groups(grams, mixed)).unionByName(alike(apart, grams))

    joined = nodes.select("node", "same", "least").join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(names, "component").select("same", "component_id")
    return rows.select("doc_id", "key", "same").join(known, "same").select("doc_id", "key", "component_id")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The row of docs with the smallest doc_id (then key) of each component, with all columns. found: of cluster or
    cluster_words, by default the latter."""
    found = saved((cluster_words(docs) if found is None else found).select("doc_id", "key", "component_id"), "clusters")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    (name,) = free(docs.columns, "row_key")
    keys = saved(best.select(F.col("best.key").alias(name)).distinct(), "kept")
    rows = docs.withColumn(name, row_key("doc_id", "text")).join(keys, name, "left_semi")
    twice = saved(found.groupBy("key").count().filter("count > 1").select(F.col("key").alias(name)), "repeated")
    if not twice.isEmpty():  # rows that are there more than once
        rows = rows.join(twice, name, "left_anti").unionByName(rows.join(twice, name, "left_semi").dropDuplicates([name]))
    return rows.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
