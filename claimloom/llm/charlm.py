"""Interpolated modified Kneser-Ney models over characters, one for each group of documents.

A unit (a document's words between single spaces, or one word) is read between one space in front and one
behind; no n-gram leaves its unit. The order is the same at every size of the corpus.

Counting: each task counts n-grams of the order by group and emits one row for each it has seen; Spark adds them
up over all documents. N-grams that start at the front space and are shorter than the order are counted as they
are, all other lower orders by distinct continuations. Discounts, back-off weights and interpolated
probabilities of every order are then made by joins and aggregates (model_rows), nothing of which is gathered.

Scoring: a Model holds rows in arrays sorted by 64-bit hash, one for each order, so that a look-up is a binary
search. A model of at most `max_rows` rows is broadcast. A larger one stays in Spark: documents are dealt into
chunks of bounded text, the rows whose n-grams a chunk holds are joined to it, and each chunk is scored under a
Model of those rows (`scored`). Both ways give the same scores.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, saved

_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(29)
#: rows of counts that a task holds before it emits them, and points that are looked up at a time
HELD, WINDOW = 1 << 20, 1 << 20


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h + c.astype(np.uint64) + np.uint64(1)) * _M
    return h ^ (h >> _S)


def hashes_of(grams: list[str], k: int) -> np.ndarray:
    """Of strings of k code points each, read from the last point to the first."""
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), k)
    h = np.zeros(len(points), np.uint64)
    for j in range(k - 1, -1, -1):
        h = _mix(h, points[:, j])
    return h


def _name(group: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(group or "")


def joint(keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of a group."""
    h = (keys ^ names) * _M
    return h ^ (h >> np.uint64(32))


def laid_out(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the units, each between spaces of its own, and how many points of its unit precede each."""
    size = np.fromiter(map(len, units), np.int64, len(units)) + 2
    points = np.frombuffer((" " + "  ".join(units) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if units else np.zeros(0, np.uint32)
    return points, np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)


def rolled(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For each k up to the order the hash of the k points that end at each place; where fewer precede it has no meaning."""
    out = [np.zeros(len(points), np.uint64)]
    for k in range(1, order + 1):
        h = out[-1].copy()
        if len(points) >= k:
            h[k - 1 :] = _mix(h[k - 1 :], points[: len(points) - k + 1])
        out.append(h)
    return out


def windows(points: np.ndarray, depth: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Points and depths in stretches of bounded length; of each, the first place that is new and its place in the whole."""
    for a in range(0, len(points), WINDOW):
        b = max(0, a - order)
        yield points[b : a + WINDOW], depth[b : a + WINDOW], a - b, a


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in an order in which equal ones lie together, and where each such run starts. Sorted by the
    high bits of the key with the place in the low ones; of two keys with equal high bits the runs may come in parts."""
    n = len(keys)
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    at = (np.sort((keys & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    full = keys[at]
    return at, np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), full[1:] != full[:-1])))


class Counts:
    """N-grams of one length: keys, points and counts, merged now and then."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, keys: np.ndarray, points: np.ndarray, ends: np.ndarray, weight: np.ndarray | None) -> None:
        """Of n-grams that end at these places of the points."""
        at, start = grouped(keys)
        n = np.diff(np.append(start, len(at))) if weight is None else np.add.reduceat(weight[at], start)
        first = at[start]
        self.parts.append((keys[first], points[ends[first][:, None] + np.arange(1 - self.k, 1)], n))
        self.held += len(first)
        if len(self.parts) > 1 and self.held > 2 * len(self.parts[0][0]) + 200_000:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, points, n = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
            keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
            self.parts = [(keys, points[first], np.bincount(back, n, len(keys)).astype(np.int64))]
            self.held = len(keys)

    def rows(self) -> tuple[list[str], np.ndarray]:
        """Of a key whose runs came in parts there may be several rows where nothing was merged; Spark adds them up."""
        self.merge()
        if not self.parts:
            return [], np.zeros(0, np.int64)
        _, points, n = self.parts[0]
        text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [text[i : i + self.k] for i in range(0, len(text), self.k)], n


def count_grams(units: list[str], order: int, weights: list[int] | None = None, into: dict[int, Counts] | None = None) -> dict[int, Counts]:
    """Counts of n-grams of the order, and of shorter ones where a unit begins."""
    into = {} if into is None else into
    points, depth = laid_out(units)
    weight = None if weights is None else np.repeat(np.array(weights, np.int64), np.fromiter(map(len, units), np.int64, len(units)) + 2)
    for part, deep, new, at in windows(points, depth, order):
        h = rolled(part, order)
        for k in range(2, order + 1):
            here = np.flatnonzero(deep[new:] >= order - 1 if k == order else deep[new:] == k - 1) + new
            if len(here):
                into.setdefault(k, Counts(k)).add(h[k][here], part, here, None if weight is None else weight[here - new + at])
    return into


def _counting(units_of: Callable, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, Counts]] = defaultdict(dict)

        def emit() -> Iterator[pa.RecordBatch]:
            for g, by in held.items():
                for c in by.values():
                    grams, n = c.rows()
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n)], names=["grp", "gram", "n"])
            held.clear()

        for batch in batches:
            for b in pieces(batch, 500):
                own: dict[str, list] = defaultdict(list)
                for g, u in zip(b.column(0).to_pylist(), units_of(b.column(1)), strict=True):
                    own[g].append(u)
                for g, docs in own.items():
                    if isinstance(docs[0], str):
                        count_grams(docs, order, None, held[g])
                    else:  # words: each kind once, with its count
                        kinds: dict[str, int] = {}
                        for d in docs:
                            for w in d:
                                kinds[w] = kinds.get(w, 0) + 1
                        count_grams(list(kinds), order, list(kinds.values()), held[g])
                if sum(c.held for by in held.values() for c in by.values()) > HELD:
                    for by in held.values():
                        for c in by.values():
                            c.merge()
                    if sum(c.held for by in held.values() for c in by.values()) > HELD:
                        yield from emit()
        yield from emit()

    return run


def count(rows: DataFrame, units_of: Callable, order: int) -> DataFrame:
    """grp, gram, n over all rows(grp, text). units_of gives, of an Arrow column of texts, a string for each (one
    unit) or a list of words (a unit each)."""
    found = rows.select("grp", "text").mapInArrow(_counting(units_of, order), "grp string, gram string, n long")
    return found.groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def model_rows(counts: DataFrame, order: int) -> tuple[DataFrame, float]:
    """len, grp, gram, logp (null for what is a context only), backoff (null for what is none): one row for each
    n-gram of counts(grp, gram, n) and of its lower orders, and for each empty context; and the floor, the log-probability of
    a character without any evidence."""
    own = saved(counts, "gram-counts")
    levels = {order: own.filter(F.length("gram") == order).withColumnRenamed("n", "a")}
    for k in range(order - 1, 0, -1):
        below = levels[k + 1].groupBy("grp", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("a"))
        front = own.filter(F.length("gram") == k).withColumnRenamed("n", "a")
        levels[k] = saved(below.unionByName(front).groupBy("grp", "gram").agg(F.sum("a").alias("a")), "grams")
    floor = -float(np.log(1 + levels[1].select("gram").distinct().count()))
    out, lower = None, None
    for k in range(1, order + 1):
        # D1, D2, D3+ of a group's adjusted counts; where a count of counts is empty, half of what is due
        n = [F.sum(F.when(F.col("a") == i, 1).otherwise(0)).cast("double") for i in range(1, 5)]
        cuts = levels[k].groupBy("grp").agg(*(x.alias(f"n{i}") for i, x in enumerate(n, 1)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        due = (1 - 2 * y * F.col("n2") / F.col("n1"), 2 - 3 * y * F.col("n3") / F.col("n2"), 3 - 4 * y * F.col("n4") / F.col("n3"))
        some = F.least("n1", "n2", "n3", "n4") > 0
        cuts = cuts.select("grp", *(F.when(some, F.least(F.greatest(d, F.lit(0.05 * i)), F.lit(0.95 * i))).otherwise(F.lit(0.25 + 0.25 * i)).alias(f"d{i}") for i, d in enumerate(due, 1)))
        rows = levels[k].join(cuts, "grp").withColumn("h", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        rows = rows.withColumn("d", F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = rows.groupBy("grp", "h").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("gamma"))
        mine = (F.col("a") - F.col("d")) / F.col("total")
        joined = rows.select("grp", "gram", "h", "a", "d").join(contexts, ["grp", "h"])
        if k == 1:
            made = joined.select("grp", "gram", (mine + F.col("gamma") * float(np.exp(floor))).alias("p"))
        else:
            joined = joined.withColumn("rest", F.substring("gram", 2, k - 1))
            made = joined.join(lower.select("grp", F.col("gram").alias("rest"), F.col("p").alias("below")), ["grp", "rest"]).select("grp", "gram", (mine + F.col("gamma") * F.col("below")).alias("p"))
        lower = saved(made, "gram-logp")
        kinds = lower.select(F.lit(k).alias("len"), "grp", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff"))
        weights = contexts.select(F.lit(k - 1).alias("len"), "grp", F.col("h").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("backoff"))
        out = kinds.unionByName(weights) if out is None else out.unionByName(kinds).unionByName(weights)
    return out.groupBy("len", "grp", "gram").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff")), floor


def _hashed(rows: DataFrame, groups: list[str], own: bool) -> DataFrame:
    """len, key, g, logp, backoff of rows whose n-grams are strings; key is the hash of the n-gram, with its group's if own."""
    at, names = {g: i for i, g in enumerate(groups)}, np.array([_name(g) for g in groups], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, grams = b.column(0).to_numpy(), b.column(2).to_pylist()
            g = np.fromiter((at[x] for x in b.column(1).to_pylist()), np.int32, len(size))
            key = np.zeros(len(size), np.uint64)
            for k in np.unique(size).tolist():
                here = np.flatnonzero(size == k)
                if k:
                    key[here] = hashes_of([grams[i] for i in here.tolist()], k)
            if own:
                key = joint(key, names[g])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key.view(np.int64)), pa.array(g), *(b.column(i).cast(pa.float32()) for i in (3, 4))], names=["len", "key", "g", "logp", "backoff"])

    return rows.select("len", "grp", "gram", "logp", "backoff").mapInArrow(run, "len int, key long, g int, logp float, backoff float")


class Model:
    """For each length the sorted hashes of the n-grams with logp and backoff, of which what is missing is NaN. If own, the
    group is in the hash; else each hash has an entry for each group that has it."""

    def __init__(self, rows: pa.Table, groups: list[str], order: int, floor: float, own: bool):
        self.order, self.floor, self.groups, self.own = order, floor, groups, own
        size, key, g, logp, backoff = (rows.column(c).to_numpy() for c in ("len", "key", "g", "logp", "backoff"))
        key = key.view(np.uint64)
        self.tables = []
        for k in range(order + 1):
            here = np.flatnonzero(size == k)
            here = here[np.argsort(key[here])] if own else here[np.lexsort((g[here], key[here]))]
            keys, first = (key[here], None) if own else np.unique(key[here], return_index=True)
            self.tables.append((keys, None if own else np.append(first, len(here)), None if own else g[here], logp[here], backoff[here]))

    @staticmethod
    def _find(table, keys: np.ndarray) -> np.ndarray:
        """Places of keys in a table, -1 where they are not."""
        if not len(table) or not len(keys):
            return np.full(len(keys), -1)
        order, start = grouped(keys)
        kinds = keys[order[start]]
        at = np.minimum(np.searchsorted(table, kinds), len(table) - 1)
        out = np.empty(len(keys), np.int64)
        out[order] = np.repeat(np.where(table[at] == kinds, at, -1), np.diff(np.append(start, len(keys))))
        return out

    def _entries(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the key, entry) for all entries of the keys."""
        table, first = self.tables[k][:2]
        at = self._find(table, keys)
        hit = np.flatnonzero(at >= 0)
        n = first[at[hit] + 1] - first[at[hit]]
        return np.repeat(hit, n), np.repeat(first[at[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def every(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each unit under each group, and its number of predicted characters."""
        out = np.zeros((len(units), len(self.groups)))
        size = np.fromiter(map(len, units), np.int64, len(units)) + 1
        if not units or not self.groups:
            return out, size
        points, depth = laid_out(units)
        for part, deep, new, at in windows(points, depth, self.order):
            h = rolled(part, self.order)
            place = np.flatnonzero(deep[new:] > 0) + new
            lp, todo = np.zeros((len(place), len(self.groups))), np.ones((len(place), len(self.groups)), bool)
            for k in range(self.order, 0, -1):
                fit = np.flatnonzero((deep[place] >= k - 1) & todo.any(axis=1))
                if not len(fit):
                    continue
                who, e = self._entries(k, h[k][place[fit]])
                row, g, value = fit[who], self.tables[k][2][e], self.tables[k][3][e]
                good = todo[row, g] & ~np.isnan(value)
                lp[row[good], g[good]] += value[good]
                todo[row[good], g[good]] = False
                fit = fit[todo[fit].any(axis=1)]
                who, e = self._entries(k - 1, h[k - 1][place[fit] - 1] if k > 1 else np.zeros(len(fit), np.uint64))
                row, g, value = fit[who], self.tables[k - 1][2][e], self.tables[k - 1][4][e]
                good = todo[row, g] & ~np.isnan(value)
                lp[row[good], g[good]] += value[good]
            lp += todo * self.floor
            unit = np.repeat(np.arange(len(units)), size + 1)[place - new + at]
            for j in range(len(self.groups)):
                out[:, j] += np.bincount(unit, lp[:, j], len(units))
        return out, size

    def under(self, units: list[str], groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each unit under its own group, and its number of predicted characters."""
        out = np.zeros(len(units))
        size = np.fromiter(map(len, units), np.int64, len(units)) + 1
        if not units:
            return out, size
        points, depth = laid_out(units)
        name = {g: _name(g) for g in set(groups)}
        names = np.fromiter((name[g] for g in groups), np.uint64, len(groups))
        for part, deep, new, at in windows(points, depth, self.order):
            h = rolled(part, self.order)
            todo = np.flatnonzero(deep[new:] > 0) + new
            unit = np.repeat(np.arange(len(units)), size + 1)[at - new : at - new + len(part)] if len(units) > 1 else np.zeros(len(part), np.int64)
            who, lp = names[unit], np.zeros(len(part))
            for k in range(self.order, 0, -1):
                fit = deep[todo] >= k - 1
                mine = todo[fit]
                keys, _, _, logp, _ = self.tables[k]
                found = self._find(keys, joint(h[k][mine], who[mine]))
                value = np.where(found >= 0, logp[found], np.nan) if len(logp) else np.full(len(mine), np.nan)
                hit = ~np.isnan(value)
                lp[mine[hit]] += value[hit]
                mine = mine[~hit]
                keys, _, _, _, backoff = self.tables[k - 1]
                found = self._find(keys, joint(h[k - 1][mine - 1] if k > 1 else np.zeros(len(mine), np.uint64), who[mine]))
                value = np.where(found >= 0, backoff[found], np.nan) if len(backoff) else np.full(len(mine), np.nan)
                lp[mine] += np.nan_to_num(value)
                todo = np.concatenate([todo[~fit], mine])
                if not len(todo):
                    break
            lp[todo] += self.floor
            out += np.bincount(unit[new:], lp[new:], len(units))
        return out, size


#: characters of all languages together up to which their rows are broadcast to a model that is itself too large
MOST_CHARACTERS = 1_000_000


class Fitted:
    """What fit() gives: the rows of the model in Spark, and the model itself where it is small enough."""

    def __init__(self, rows: DataFrame, groups: list[str], order: int, floor: float, own: bool, max_rows: int):
        self.rows, self.groups, self.order, self.floor, self.own = rows, groups, order, floor, own
        self.model = self.of(rows.toArrow()) if rows.count() <= max_rows else None

    def of(self, rows: pa.Table) -> Model:
        return Model(rows, self.groups, self.order, self.floor, self.own)


def fit(rows: DataFrame, units_of: Callable, order: int = 4, max_rows: int = 2_000_000, own: bool = False) -> Fitted | None:
    """The model of rows(grp, text), all of which are counted; None if they hold no characters. max_rows bounds what is
    gathered and broadcast (20 bytes a row), not the model. own: units will be scored under one group each."""
    counts = saved(count(rows, units_of, order), "gram-totals")
    groups = sorted(r["grp"] for r in counts.select("grp").distinct().collect())  # a row for each language
    if not groups:
        return None
    made, floor = model_rows(counts, order)
    return Fitted(saved(_hashed(made, groups, own), "gram-rows"), groups, order, floor, own, max_rows)


def scored(docs: DataFrame, fitted: Fitted, units_of: Callable, score: Callable, schema: str, chunk_chars: int = 16_000_000) -> DataFrame:
    """score(model, batches) over docs, whose last two columns are grp and text; schema: of what it gives. With a model
    too large to broadcast, documents are dealt into chunks of about chunk_chars characters."""
    if fitted.model is not None:
        shared = docs.sparkSession.sparkContext.broadcast(fitted.model)  # at most max_rows rows
        return docs.mapInArrow(lambda batches: score(shared.value, batches), schema)
    order, floor, groups, own, names = fitted.order, fitted.floor, fitted.groups, fitted.own, docs.columns
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = max(1, -(-total // chunk_chars))
    rows = docs.withColumn("chunk", F.pmod(F.xxhash64(*names), F.lit(chunks)))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 500):
                by = defaultdict(list)
                for c, g, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), units_of(b.column(2)), strict=True):
                    by[c, g if own else None] += [u] if isinstance(u, str) else list(set(u))
                for (c, g), units in by.items():
                    points, depth = laid_out(units)
                    for part, deep, new, _ in windows(points, depth, order):
                        h, a = rolled(part, order), max(0, new - 1)
                        for k in range(order + 1):
                            key = np.unique(h[k][a:][deep[a:] >= k - 1])
                            key = joint(key, np.full(len(key), _name(g), np.uint64)) if own else key
                            if len(key):
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int64)), pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64))], names=["chunk", "len", "key"])

    need = saved(rows.select("chunk", "grp", "text").mapInArrow(needed, "chunk long, len int, key long").distinct(), "needed-grams")
    # every chunk asks for the empty n-gram and for most characters: those do not meet in the task of their key
    short, long = "len <= 1", "len > 1"
    few = fitted.rows.filter(short)
    few = F.broadcast(few) if few.limit(MOST_CHARACTERS + 1).count() <= MOST_CHARACTERS else few
    found = need.filter(long).join(fitted.rows.filter(long), ["len", "key"]).unionByName(need.filter(short).join(few, ["len", "key"]))
    shipped = found.select("chunk", F.struct("len", "key", "g", "logp", "backoff").alias("row"))
    both = rows.select("chunk", F.lit(1).alias("kind"), F.lit(None).cast(shipped.schema["row"].dataType).alias("row"), F.struct(*names).alias("doc"))
    both = both.unionByName(shipped.select("chunk", F.lit(0).alias("kind"), "row", F.lit(None).cast(both.schema["doc"].dataType).alias("doc")))
    both = both.repartition(int(min(chunks, 20_000)), "chunk").sortWithinPartitions("chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, model = None, [], None
        empty = pa.schema([("len", pa.int32()), ("key", pa.int64()), ("g", pa.int32()), ("logp", pa.float32()), ("backoff", pa.float32())]).empty_table()
        for batch in batches:
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.diff(chunk) | np.diff(kind)) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(chunk)], strict=True):
                if chunk[i] != now:
                    now, entries, model = chunk[i], [], None
                if kind[i] == 0:
                    entries.append(pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column(2).slice(i, j - i))]).cast(empty.schema))
                    continue
                if model is None:
                    model = Model(pa.concat_tables([empty, *entries]), groups, order, floor, own)
                yield from score(model, iter([pa.RecordBatch.from_struct_array(batch.column(3).slice(i, j - i))]))

    return both.mapInArrow(run, schema)
