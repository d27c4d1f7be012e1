"""Exact and routed nearest-neighbour search over points(id, vector, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.functions import fuzzy
from lumenspar.functions.distance import EXACT, METRICS, wasserstein
from lumenspar.functions.vectors import mean_vector, vec

#: Queries that travel to the points at most; queries, and points, of a block at most, about.
FEW, QUERY_BLOCK, POINT_BLOCK = 4096, 32_768, 65_536
#: Queries and points of a tile, whose distances are in memory at once; pairs measured exactly at once.
TILE_QUERIES, TILE_POINTS, PAIRS = 256, 4096, 16_384


def search(points: DataFrame, query: Sequence[float], k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k nearest points with distance; ties by id. A filter is applied before any distance."""
    rows = points if where is None else points.where(where)
    return rows.withColumn("distance", METRICS[metric](F.col("vector"), vec(query))).orderBy("distance", "id").limit(k)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length, but for those that are unit within 1e-9 or all but zero."""
    n2 = (v * v).sum(1, keepdims=True)
    return np.where((abs(n2 - 1) <= 1e-9) | (n2 <= 1e-18), v, v / np.sqrt(np.maximum(n2, 1e-300)))


def distances(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of all queries (rows) to all points (columns) of a batch."""

    def l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :], 0)

    def poincare(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        den = np.maximum((1 - (q * q).sum(1))[:, None] * (1 - (x * x).sum(1))[None, :], 1e-9)
        return np.arccosh(1 + 2 * l2(q, x) / den)

    def lorentz(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        flipped = x.copy()
        flipped[:, 0] *= -1
        return np.arccosh(np.maximum(-(q @ flipped.T), 1 + 1e-12))

    def hybrid(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return lorentz(q[:, :33], x[:, :33]) + l2(q[:, 33:], x[:, 33:])

    return {"l2": l2, "euclidean": l2, "cosine": lambda q, x: l2(unit(q), unit(x)), "poincare": poincare, "lorentz": lorentz, "hybrid": hybrid}[metric]


def pair_distances(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of row after row of two matrices, summed coordinate by coordinate; unit vectors for the cosine."""

    def l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        d = q - x
        return np.einsum("ij,ij->i", d, d)

    def poincare(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        free = lambda v: 1 - np.einsum("ij,ij->i", v, v)
        return np.arccosh(1 + 2 * l2(q, x) / np.maximum(free(q) * free(x), 1e-9))

    def lorentz(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.arccosh(np.maximum(q[:, 0] * x[:, 0] - np.einsum("ij,ij->i", q[:, 1:], x[:, 1:]), 1 + 1e-12))

    def hybrid(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return lorentz(q[:, :33], x[:, :33]) + l2(q[:, 33:], x[:, 33:])

    return {"l2": l2, "euclidean": l2, "cosine": l2, "poincare": poincare, "lorentz": lorentz, "hybrid": hybrid}[metric]


def first_of_rows(row: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first k entries of each row lie, by distance to 9 digits and id, and their places from nought."""
    order = np.lexsort((ids, np.round(np.where(np.isnan(d), np.inf, d), 9), row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[place < k], place[place < k]


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each row, with their ids; distances equal to 9 digits go by id."""
    n, width = d.shape
    at, _ = first_of_rows(np.repeat(np.arange(n), width), d.ravel(), ids.ravel(), k)
    return d.ravel()[at].reshape(n, -1), ids.ravel()[at].reshape(n, -1)


def without_repeats(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the points without those of which k others of smaller id have the very same vector.

    None of these is ever among the k nearest, and a vector that many points have costs no more than k.
    """
    mix = np.random.default_rng(5).integers(1, 2**63, vectors.shape[1], np.uint64) | np.uint64(1)
    hashes = np.zeros(len(ids), np.uint64)
    for column, odd in zip(np.ascontiguousarray(vectors).view(np.uint64).T, mix, strict=True):
        hashes = (hashes ^ column) * odd
        hashes ^= hashes >> np.uint64(29)
    order = np.lexsort((ids, hashes))
    new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
    if new.all():
        return np.arange(len(ids))
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    beyond = np.flatnonzero(np.arange(len(order)) - start >= k)
    # hashes may clash: only what equals the first of its hash, as do the k before it, goes
    equal = np.zeros(len(order), bool)
    for at in range(0, len(order), PAIRS):
        part = slice(at, at + PAIRS)
        equal[part] = (vectors[order[part]].view(np.uint64) == vectors[order[start[part]]].view(np.uint64)).all(1)
    ahead = np.r_[0, np.cumsum(equal)]
    gone = beyond[equal[beyond] & (ahead[beyond] - ahead[start[beyond]] >= k)]
    return np.sort(np.delete(order, gone))


class _Sieve:
    """Scores of queries and points that fall as the distance grows, as matrix products in single precision.

    ``left`` and ``right`` hold what is multiplied; ``level`` is the least score that a point has
    whose distance is no more than some bars. The rounding of single precision is bounded by the
    lengths of both, so a point is only left out if it is too far for certain.
    """

    def __init__(self, metric: str, queries: np.ndarray):
        self.metric, self.n2 = metric, np.einsum("ij,ij->i", queries, queries)
        one = np.ones((len(queries), 1))
        if metric in ("l2", "euclidean", "cosine"):
            left = np.hstack((queries, one))
        elif metric == "lorentz":
            left = queries * np.r_[-1.0, np.ones(queries.shape[1] - 1)]
        elif metric == "poincare":
            left = np.hstack((queries, one, self.n2[:, None]))
        else:
            left = None
        with np.errstate(over="ignore"):
            self.left = None if left is None else left.astype(np.float32)
        self.length = None if left is None else np.sqrt(np.einsum("ij,ij->i", left, left))

    def right(self, points: np.ndarray) -> tuple[np.ndarray, float, float]:
        """The points' side, its greatest length, and the least of one minus the points' squared lengths."""
        n2 = np.einsum("ij,ij->i", points, points)
        free = float((1 - n2).min())
        right = points
        if self.metric in ("l2", "euclidean", "cosine"):
            right = np.hstack((points, -n2[:, None] / 2))
        elif self.metric == "poincare":
            w = (1 / np.where(n2 < 1, 1 - n2, np.nan))[:, None]
            right = np.hstack((points * w, -n2[:, None] * w / 2, -w / 2))
        with np.errstate(over="ignore"):
            return right.astype(np.float32).T, float(np.sqrt(np.einsum("ij,ij->i", right, right).max())), free

    def fits(self, part: np.ndarray, length: float, free: float) -> bool:
        """Whether single precision can hold the scores, and they order as the distances do."""
        if self.left is None or not self.length[part].max() * max(length, 1.0) < 1e30:
            return False
        least = float((1 - self.n2[part]).min())
        return self.metric != "poincare" or (least > 0 and free > 0 and least * free >= 1e-9)

    def slack(self, part: np.ndarray, length: float) -> np.ndarray:
        return 1.2 * (self.left.shape[1] + 8) * 2.0**-24 * self.length[part] * length + 1e-9

    def level(self, part: np.ndarray, bars: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            if self.metric == "lorentz":
                return -np.maximum(np.cosh(bars + 1e-9), 1 + 1e-12)
            if self.metric == "poincare":
                return -(np.cosh(bars + 1e-9) - 1) * (1 - self.n2[part]) / 4
        return (self.n2[part] - bars - 1e-9) / 2


class _Top:
    """The best k points of some queries so far; with ``earlier``, of points with a smaller first coordinate.

    Points come by tiles. A tile's scores show which few points may be nearer than the k
    that a query has; only these are measured exactly.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, earlier: bool = False):
        if earlier:
            order = np.argsort(vectors[:, 0], kind="stable")
            ids, vectors = ids[order], vectors[order]
        self.ids, self.k, self.metric, self.earlier = ids, k, metric, earlier
        self.measure, self.exact = distances(metric), pair_distances(metric)
        self.vectors = unit(vectors) if metric == "cosine" else vectors
        self.sieve = _Sieve(metric, self.vectors)
        self.first = np.nan_to_num(vectors[:, 0], nan=np.inf, posinf=np.inf, neginf=-np.inf) if earlier else None
        self.d, self.i = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
        self.n = np.zeros(len(ids), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Takes points in, for all queries or those of some places in ascending order."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        kept = without_repeats(ids, vectors, self.k)
        kept = kept[np.argsort(vectors[kept, 0], kind="stable")] if self.earlier else kept
        for at in range(0, len(kept), TILE_POINTS):
            some = kept[at : at + TILE_POINTS]
            x = unit(vectors[some]) if self.metric == "cosine" else vectors[some]
            first = np.nan_to_num(x[:, 0], nan=np.inf, posinf=np.inf, neginf=-np.inf) if self.earlier else None
            right = self.sieve.right(x) if self.sieve.left is not None else (None, 0.0, 0.0)
            step = max(TILE_QUERIES, TILE_QUERIES * TILE_POINTS // len(some))
            for q in range(0, len(rows), step):
                part = rows[q : q + step]
                allowed = None
                if self.earlier and not first.max() < self.first[part].min():
                    if not first.min() < self.first[part].max():
                        continue
                    allowed = first[None, :] < self.first[part, None]
                self._tile(part, ids[some], x, right, allowed)

    def _tile(self, part: np.ndarray, ids: np.ndarray, x: np.ndarray, right: tuple[np.ndarray, float, float], allowed: np.ndarray | None) -> None:
        k, q, n = self.k, self.vectors[part], self.n[part]
        bars = np.where(n == k, np.round(np.where(np.isnan(self.d[part, k - 1]), np.inf, self.d[part, k - 1]), 9), np.inf)
        if self.sieve.fits(part, *right[1:]):
            scores, slack = self.sieve.left[part] @ right[0], self.sieve.slack(part, right[1])
            least = self.sieve.level(part, bars) - slack
        else:
            scores = -self.measure(q, x)
            size = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
            slack = 1e-8 * (1 + size(q) * size(x).max())
            least = -bars - slack
        if allowed is not None:
            scores[~allowed] = -np.inf
        if k < len(ids) and (n < k).any():  # the k best scores of the tile are a bar as well
            at = np.flatnonzero(n < k)
            least[at] = np.fmax(least[at], np.partition(scores[at], len(ids) - k, axis=1)[:, len(ids) - k] - 2 * slack[at])
        least = np.nextafter(least.astype(scores.dtype), scores.dtype.type(-np.inf))
        near = ~(scores < least[:, None])  # what is no number stays
        if allowed is not None:
            near &= allowed
        near = near.ravel()
        if len(near) % 8 == 0:  # few are near: look at eight at once
            eight = np.flatnonzero(near.view(np.uint64))
            found = (eight[:, None] * 8 + np.arange(8)).ravel()
            found = found[near[found]]
        else:
            found = np.flatnonzero(near)
        if not len(found):
            return
        row, col = np.divmod(found, len(ids))
        d = np.concatenate([self.exact(q[row[at : at + PAIRS]], x[col[at : at + PAIRS]]) for at in range(0, len(row), PAIRS)])
        close = ~(np.round(d, 9) > bars[row])
        row, d, i = row[close], d[close], ids[col[close]]
        touched = np.unique(row)
        old, place = np.nonzero(np.arange(k) < n[touched, None])
        old = touched[old]
        row = np.concatenate((old, row))
        d, i = np.concatenate((self.d[part[old], place], d)), np.concatenate((self.i[part[old], place], i))
        at, place = first_of_rows(row, d, i, k)
        self.d[part[row[at]], place], self.i[part[row[at]], place] = d[at], i[at]
        self.n[part[touched]] = np.bincount(row[at], minlength=len(n))[touched]

    def columns(self) -> list[pa.Array]:
        row, place = np.nonzero(np.arange(self.k) < self.n[:, None])
        return [pa.array(self.ids[row]), pa.array(self.i[row, place]), pa.array(self.d[row, place])]


FOUND, FOUND_NAMES = "query_id long, id long, distance double", ["query_id", "id", "distance"]


def rows_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, as one matrix, of a batch that is not empty."""
    vectors = batch.column("vector")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float)
    return batch.column("id").to_numpy().astype(np.int64), flat.reshape(batch.num_rows, -1)


def _scan(ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, earlier: bool = False) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(ids, vectors, k, metric, earlier)
        for batch in batches:
            if batch.num_rows:
                top.add(*rows_of(batch))
        yield pa.RecordBatch.from_arrays(top.columns(), names=FOUND_NAMES)

    return run


def meet(k: int, metric: str, earlier: bool = False) -> Callable:
    """The k nearest points of a block for the queries of a block."""

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        if not queries.num_rows or not points.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=FOUND_NAMES)
        top = _Top(*rows_of(queries), k, metric, earlier)
        top.add(*rows_of(points))
        return pa.table(top.columns(), names=FOUND_NAMES)

    return run


def block_counts(queries: int, points: int, cores: int) -> tuple[int, int]:
    """Into how many blocks queries and points are dealt: pairs of blocks for all cores, if blocks do not get tiny."""
    over, down = max(1, -(-queries // QUERY_BLOCK)), max(1, -(-points // POINT_BLOCK))
    while over * down < 4 * cores and max(queries / over, points / down) > 2048:
        over, down = (over * 2, down) if queries / over >= points / down else (over, down * 2)
    return over, down


def batch_search(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, earlier: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of each query's k nearest points.

    Up to ``FEW`` queries travel to the points, which are scanned where they lie.
    More queries, and the points, are dealt into blocks by hash, and each pair of blocks
    meets in one task; the driver sees none of them. Either way a task keeps k candidates a
    query by matrix products over tiles, and one window merges those, so no pair is ever a
    row. ``earlier``: only points whose first coordinate is smaller than the query's.
    """
    some = k + 1 if exclude_self else k
    narrow = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    points, queries = narrow(points), narrow(queries)
    n = queries.count()
    if n <= min(FEW, QUERY_BLOCK):
        rows = queries.collect()
        ids, vectors = np.array([r.id for r in rows], np.int64), np.array([r.vector for r in rows], float)
        found = points.mapInArrow(_scan(ids, vectors, some, metric, earlier), FOUND) if rows else points.sparkSession.createDataFrame([], FOUND)
    else:
        over, down = block_counts(n, points.count(), points.sparkSession.sparkContext.defaultParallelism)
        each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        q = queries.select("*", F.pmod(F.xxhash64("id"), F.lit(over)).cast("int").alias("i"), each(down).alias("j"))
        p = points.select("*", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(down)).cast("int").alias("j"), each(over).alias("i"))
        found = q.groupBy("i", "j").cogroup(p.groupBy("i", "j")).applyInArrow(meet(some, metric, earlier), FOUND)
    if exclude_self:
        found = found.where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search_collections(collections: dict[str, DataFrame], query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """The k nearest points of each collection."""
    parts = [search(df, query, k, metric).select(F.lit(name).alias("collection"), "id", "distance") for name, df in collections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rerank(points: DataFrame, query: Sequence[float], k: int, cheap: Column, exact: Column, oversample: int = 4) -> DataFrame:
    """Two stages: k times oversample points by a cheap score, then the k best by the exact one."""
    few = points.withColumn("coarse", cheap).orderBy("coarse", "id").limit(k * oversample)
    return few.withColumn("distance", exact).orderBy("distance", "id").limit(k)


def truncated_search(points: DataFrame, query: Sequence[float], k: int, dim: int, metric: str = "l2", oversample: int = 4) -> DataFrame:
    """First stage on the first ``dim`` coordinates, second on all."""
    v = F.col("vector")
    return rerank(points, query, k, METRICS[metric](F.slice(v, 1, dim), vec(query[:dim])), METRICS[metric](v, vec(query)), oversample)


def exact_rerank(points: DataFrame, query: Sequence[float], k: int, metric: str, oversample: int = 4) -> DataFrame:
    return rerank(points, query, k, METRICS[metric](F.col("vector"), vec(query)), EXACT[metric](F.col("vector"), vec(query)), oversample)


def wasserstein_rerank(points: DataFrame, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """The same k points, ordered by Wasserstein distance."""
    few = search(points, query, k, metric)
    return few.withColumn("distance", wasserstein(F.col("vector"), vec(query))).orderBy("distance", "id")


def attach_payload(found: DataFrame, payloads: DataFrame) -> DataFrame:
    """Payloads of the k rows found; the join comes after the limit."""
    return found.join(payloads.select("id", "payload"), "id", "left")


def merge_tiers(tiers: Sequence[DataFrame], k: int) -> DataFrame:
    """Hits of several tiers: the best distance of an id stands, then the k best."""
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    return out.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(k)


def centroids(points: DataFrame, by: str, dim: int) -> DataFrame:
    """(chunk, centroid, n); vectors of another length are left out."""
    fit = points.where(F.size("vector") == dim)
    return fit.groupBy(F.col(by).alias("chunk")).agg(mean_vector(F.col("vector"), dim).alias("centroid"), F.count(F.lit(1)).alias("n"))


def route(centroid: DataFrame, query: Sequence[float], probe_k: int = 3) -> DataFrame:
    """The probe_k chunks nearest to the query; 0 or more than there are means all."""
    ranked = centroid.withColumn("distance", METRICS["l2"](F.col("centroid"), vec(query))).orderBy("distance", "chunk")
    return ranked if probe_k <= 0 else ranked.limit(probe_k)


def routed_search(points: DataFrame, by: str, centroid: DataFrame, query: Sequence[float], k: int, probe_k: int = 3, metric: str = "l2") -> DataFrame:
    """Search of the nearest chunks only; their names become a partition filter."""
    chunks = [r.chunk for r in route(centroid, query, probe_k).select("chunk").collect()]
    return search(points, query, k, metric, F.col(by).isin(chunks))


def fuzzy_search(points: DataFrame, tree: fuzzy.Node, k: int, metric: str = "cosine") -> DataFrame:
    """(id, score) by a fuzzy tree over exp(-distance) to its leaves."""
    values = [F.exp(-METRICS[metric](F.col("vector"), vec(leaf.vector))) for leaf in fuzzy.leaves(tree)]
    return points.select("id", fuzzy.membership(tree, values).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def maximal_marginal(candidates: DataFrame, query: Sequence[float], k: int, balance: float = 0.5) -> list[int]:
    """Ids of k of a few candidates, likeness to the query weighed against likeness to those taken."""
    rows = candidates.select("id", "vector").collect()
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    vectors = [unit(np.array(r.vector, float)) for r in rows]
    q = unit(np.array(query, float))
    taken: list[int] = []
    while len(taken) < min(k, len(rows)):
        rest = [i for i in range(len(rows)) if i not in taken]
        gain = lambda i: balance * vectors[i] @ q - (1 - balance) * max((vectors[i] @ vectors[j] for j in taken), default=0.0)
        taken.append(max(rest, key=lambda i: (gain(i), -rows[i].id)))
    return [rows[i].id for i in taken]
