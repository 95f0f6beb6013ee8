"""Nearest neighbours by inner product, found by collision counting.

Index: vectors are dealt into blocks by hash. In a block every vector gets one more component, sqrt(M^2 - |x|^2) with M
the block's greatest norm, so that the vector of largest inner product with a query is the nearest one to the query
scaled to norm M. The block is projected onto `projections` random lines, and each projection is kept as a sorted array.

Search: in each array a window is centred at the query's own projection. It covers SPAN * R to both sides; a vector
collides as often as it lies in the windows of the arrays. Virtual rehashing widens the radius R, and only what the
windows gain is counted. A vector with enough collisions for a distance of R is verified by its true inner product. The search in
a block ends once R reaches the distance of the k-th best so far, over this and the blocks before it, or once every
vector of the block lies in reach. Windows and candidates have no cap.

Of two normal projections of vectors R apart the difference is normal with deviation R, so the number of collisions is
binomial; the threshold lies SURE deviations below its mean. A vector at the final radius is missed by chance
with about 2 %, nearer ones less often.

Queries are a stated set: they are broadcast in blocks of bounded size, each searched against all index blocks.
The best of each task are merged at the end. Scores are sums in the order of the components, in double precision, so
equal vectors have equal scores; ties go to the smaller vec_id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no
part. Of rows with the same id the one with the least vector counts. Only vectors of as many components are compared.
With fewer than k candidates all are returned. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, ship, shipped, table

#: half a window, in radii
SPAN = 1.0
#: deviations between the expected number of collisions at the radius and the threshold
SURE = 2.0
#: by how much virtual rehashing widens the radius
WIDER = 1.15
#: queries that are searched together in a block, and components of the queries of one broadcast
TOGETHER, SHIPPED = 128, 4_000_000


def threshold(projections: int, span: float = SPAN, sure: float = SURE) -> int:
    p = math.erf(span / math.sqrt(2))
    return max(1, math.floor(projections * p - sure * math.sqrt(projections * p * (1 - p))))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id long, vector array<double>: the rows that take part, one for each id."""
    vector = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite).filter(F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def lines(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((projections, dim + 1))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_INDEX = "dim int, n int, most double, ids binary, vectors binary, arrays binary, places binary"


def _build(projections: int, seed: int):
    def run(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("vector"), dim)
        norms = np.sqrt((x * x).sum(axis=1))
        most, a = float(norms.max()), lines(dim, projections, seed)
        along = a[:, :dim] @ x.T + a[:, dim:] * np.sqrt(np.maximum(most**2 - norms**2, 0))
        order = np.argsort(along, axis=1)
        out = (dim, len(ids), most, ids.tobytes(), x.tobytes(), np.take_along_axis(along, order, 1).tobytes(), order.astype("<i4").tobytes())
        types = (pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4)
        return pa.table([pa.array([v], t) for v, t in zip(out, types, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])

    return run


def build(vectors: DataFrame, projections: int = 64, block: int = 8192, seed: int = 7) -> DataFrame:
    """The index of usable(vectors): a row for each block of about `block` vectors, written to the shared folder."""
    n = vectors.count()
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, round(n / block))))
    rows = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), dealt.alias("block"))
    return saved(rows.groupBy("dim", "block").applyInArrow(_build(projections, seed), _INDEX), "collision-index", per_file=8)


class Best:
    """The k best (score, id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0), np.empty(0, np.int64)

    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -math.inf

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Block:
    """A block of the index and the search in it."""

    def __init__(self, row: dict, projections: int, seed: int):
        self.dim, self.n, self.most = row["dim"], row["n"], row["most"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["vectors"]).reshape(self.n, self.dim)
        self.arrays = np.frombuffer(row["arrays"]).reshape(-1, self.n)
        self.places = np.frombuffer(row["places"], "<i4").reshape(-1, self.n).astype(np.intp)
        self.lines, self.least = lines(self.dim, projections, seed), threshold(projections)

    def verify(self, at: np.ndarray, q: np.ndarray, own: int, best: Best) -> None:
        """Those of the vectors `at` that are among the best. A first product, whose last bits depend on how it is summed,
        only sets aside what is clearly worse."""
        rough = self.x[at] @ q
        slack = 1e-12 * self.dim * self.most * math.sqrt(float(q @ q))
        at = at[(rough >= best.floor() - slack) & (self.ids[at] != own)]
        if len(at):
            best.take(np.add.accumulate(self.x[at] * q, axis=1)[:, -1], self.ids[at])

    def search(self, ids: np.ndarray, q: np.ndarray, best: list[Best]) -> None:
        """Adds what this block has to the best of the queries."""
        norms = np.sqrt((q * q).sum(axis=1))
        wanted = [i for i, b in enumerate(best) if b.floor() <= self.most * norms[i]]
        if not wanted:
            return
        ids, q, norms, best = ids[wanted], q[wanted], norms[wanted], [best[i] for i in wanted]
        along = (q * (self.most / norms)[:, None]) @ self.lines[:, : self.dim].T

        def reach(i: int) -> float:
            """Distance of the k-th best so far to the query, as the block scales them."""
            floor = best[i].floor()
            return math.inf if floor == -math.inf else math.sqrt(max(0.0, 2 * self.most * (self.most - floor / norms[i])))

        active = np.arange(len(ids))
        farthest = 2 * self.most  # no two vectors are farther apart
        radius = np.array([min(0.8 * reach(i), 0.3 * farthest) for i in active])
        radius = np.maximum(radius, 0.02 * farthest)
        low = np.stack([np.searchsorted(a, along[:, j]) for j, a in enumerate(self.arrays)], axis=1)
        high = low.copy()
        counts, seen = np.zeros((len(ids), self.n), np.int16), np.zeros((len(ids), self.n), bool)
        while len(active):
            wide = SPAN * radius[active]
            new_low, new_high = np.empty((2, len(active), len(self.arrays)), np.int64)
            for j, a in enumerate(self.arrays):
                new_low[:, j] = np.searchsorted(a, along[active, j] - wide, side="left")
                new_high[:, j] = np.searchsorted(a, along[active, j] + wide, side="right")
            going = []
            for k, i in enumerate(active.tolist()):
                gained = []
                for places, a, b, c, d in zip(self.places, new_low[k].tolist(), low[i].tolist(), high[i].tolist(), new_high[k].tolist(), strict=True):
                    gained += [places[a:b], places[c:d]]
                low[i], high[i] = np.minimum(new_low[k], low[i]), np.maximum(new_high[k], high[i])
                counts[i] += np.bincount(np.concatenate(gained), minlength=self.n).astype(np.int16)
                all_in_reach = radius[i] >= farthest
                at = np.flatnonzero(~seen[i] if all_in_reach else (counts[i] >= self.least) & ~seen[i])
                seen[i, at] = True
                if len(at):
                    self.verify(at, q[i], int(ids[i]), best[i])
                end = reach(i)
                if radius[i] < min(end, farthest):
                    radius[i] = min(radius[i] * WIDER, end, farthest)
                    going.append(i)
            active = np.array(going, np.intp)


def _search(asked, k: int, projections: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shipped(asked)
        ids, sizes = queries.column("vec_id").to_numpy(), queries.column("dim").to_numpy()
        best = [Best(k) for _ in ids]
        flat = queries.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        by_dim = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
        points = {d: flat[(ends[at] - d)[:, None] + np.arange(d)] for d, at in by_dim.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                block = Block(row, projections, seed)
                at = by_dim.get(block.dim, ())
                for j in range(0, len(at), TOGETHER):
                    part = at[j : j + TOGETHER]
                    block.search(ids[part], points[block.dim][j : j + TOGETHER], [best[p] for p in part.tolist()])
        n = [len(b.ids) for b in best]
        if sum(n):
            out = [np.repeat(ids, n), np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, projections: int = 64, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each of usable(queries). projections and seed are those of the index."""
    spark = index.sparkSession
    kept = saved(queries.select("vec_id", "vector", F.size("vector").alias("dim")), "queries")
    total = kept.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // SHIPPED))
    found = None
    for part in range(blocks):
        rows = kept.filter(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == part).toArrow()  # about SHIPPED numbers
        here = index.mapInArrow(_search(ship(spark, rows), k, projections, seed), "query_id long, vec_id long, score double")
        found = here if found is None else found.unionAll(here)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 64, block: int = 8192, seed: int = 7) -> DataFrame:
    """The k nearest of each row for which `asked` (of vec_id) is true, among all rows."""
    rows = saved(usable(vectors, id_col, vector_col), "vectors")
    return search(build(rows, projections, block, seed), rows.filter(asked), k, projections, seed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)
