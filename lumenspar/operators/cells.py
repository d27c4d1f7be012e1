"""Approximate search: points in cells around centroids, of which a query probes the nearest.

The centroids are fitted on a bounded sample; every point is put into the cell of its
nearest centroid, and the table is written in order of cells, so that a filter on cells
reaches the files. How many cells a query probes is measured on the sample: as few as find
the wanted share of exact neighbours there. On vectors without any structure that is most
of them, on clustered ones few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.operators import search as S
from lumenspar.work import materialize

#: Points to fit and measure on, about; cells at most; queries of the measurement.
SAMPLE, MAX_CELLS, MEASURED = 20_000, 4096, 256
_NARROW = "id long, vector array<double>"


@dataclass(frozen=True)
class CellIndex:
    """points(id, vector, cell) with the centroids, the points of each cell, and the cells to probe."""

    points: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]
    metric: str
    probes: int


def _space(v: np.ndarray, metric: str) -> np.ndarray:
    """Where cells are cut: unit vectors for the cosine, coordinates as they are for the rest."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if metric == "cosine" else v


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def fit_centroids(v: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Means of ``cells`` groups of nearest points."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        at = _far(v, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, v)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def probes_needed(v: np.ndarray, centroids: np.ndarray, metric: str, k: int, recall: float) -> int:
    """The fewest cells that give ``recall`` of the k nearest others, over some of the sample as queries."""
    at = np.linspace(0, len(v) - 1, min(MEASURED, len(v))).astype(int)
    space = _space(v, metric)
    cell = _far(space, centroids).argmin(1)
    order = np.argsort(_far(space[at], centroids), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    d = S.distances(metric)(v[at], v)
    d[np.arange(len(at)), at] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(v) - 1)]
    found = np.sort(np.take_along_axis(rank, cell[near], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1 if len(found) else 1


#: Cells that queries of a tile probe, all together, about; scores of a tile.
PROBES, SCORES = 131_072, 1 << 20


def _nearest(centroids: np.ndarray, metric: str) -> Callable:
    """Each point with the cell of its nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // len(centroids))
        for batch in batches:
            if batch.num_rows:
                _, v = S.rows_of(batch)
                cell = np.concatenate([_far(_space(v[at : at + step], metric), centroids).argmin(1) for at in range(0, len(v), step)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell.astype(np.int32))], names=["id", "vector", "cell"])

    return run


def _probes(centroids: np.ndarray, metric: str, n: int, block: np.ndarray) -> Callable:
    """Each query once for a block of cells of which it probes some, with these; ``block`` has the block of each cell, -1 for empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(PROBES // n, SCORES // len(centroids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                _, v = S.rows_of(some)
                cells = np.argsort(_far(_space(v, metric), centroids), axis=1, kind="stable")[:, :n]
                row, cell = np.repeat(np.arange(len(v)), cells.shape[1]), cells.ravel()
                row, cell = row[block[cell] >= 0], cell[block[cell] >= 0]
                order = np.lexsort((cell, block[cell], row))
                row, cell = row[order], cell[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[cell[1:]] != block[cell[:-1]])][: len(row)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(cell.astype(np.int32)))
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([some.column("id").take(take), some.column("vector").take(take), pa.array(block[cell[first]].astype(np.int32)), lists], names=["id", "vector", "block", "cells"])

    return run


def _meet(k: int, metric: str) -> Callable:
    """The k nearest points for the queries of a block, of the points in the cells that each probes."""

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        if not queries.num_rows or not points.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=S.FOUND_NAMES)
        top = S._Top(*S.rows_of(queries), k, metric)
        lists = queries.column("cells").combine_chunks()
        wanted, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        order = np.lexsort((row, wanted))
        wanted, row = wanted[order], row[order]
        ids, vectors = S.rows_of(points)
        cell = points.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        for c in np.unique(cell):
            asked = row[np.searchsorted(wanted, c) : np.searchsorted(wanted, c, "right")]
            if len(asked):
                here = order[np.searchsorted(cell, c, sorter=order) : np.searchsorted(cell, c, "right", sorter=order)]
                top.add(ids[here], vectors[here], asked)
        return pa.table(top.columns(), names=S.FOUND_NAMES)

    return run


def build(points: DataFrame, metric: str = "l2", cells: int | None = None, sample: int = SAMPLE, k: int = 10, recall: float = 0.96) -> CellIndex:
    """Fits on about ``sample`` points chosen by hash of the id and indexes all points."""
    narrow = points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    n = narrow.count()
    share = int(min(1.0, sample / max(n, 1)) * 2**30)
    rows = narrow.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < share).orderBy("id").collect()
    if not rows:
        return CellIndex(narrow.withColumn("cell", F.lit(0)), np.zeros((1, 0)), {}, metric, 1)
    v = np.array([r.vector for r in rows], float)
    centroids = fit_centroids(_space(v, metric), cells or max(1, min(MAX_CELLS, int(n**0.5))))
    put = narrow.mapInArrow(_nearest(centroids, metric), f"{_NARROW}, cell int")
    stored = materialize(put.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "cells")
    sizes = {r.cell: r.n for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    return CellIndex(stored, centroids, sizes, metric, probes_needed(v, centroids, metric, k, recall))


def cell_search(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of each query's k nearest points in the cells it probes.

    Cells that follow each other make a block of bounded size. A query goes once to a block
    of which it probes cells, and is not repeated for each of them. Blocks of points and of
    queries that are too large are split by hash, so neither a crowded cell nor one that all
    queries want is one task.
    """
    some = k + 1 if exclude_self else k
    spark = index.points.sparkSession
    n = min(probes or index.probes, len(index.centroids))
    narrow = queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    if not index.sizes:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    sizes = np.array([index.sizes.get(c, 0) for c in range(len(index.centroids))])
    room = max(1, min(S.POINT_BLOCK, max(2048, -(-int(sizes.sum()) // (4 * spark.sparkContext.defaultParallelism)))))
    block = np.where(sizes > 0, (np.cumsum(sizes) - sizes) // room, -1)
    within = np.bincount(block[block >= 0], sizes[block >= 0])
    probing = materialize(narrow.mapInArrow(_probes(index.centroids, index.metric, n, block), f"{_NARROW}, block int, cells array<int>"), "probes")
    asked = {r.block: r.n for r in probing.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a block
    blocks = [(b, -(-int(within[b]) // S.POINT_BLOCK), -(-m // S.QUERY_BLOCK)) for b, m in asked.items()]
    # as many rows as blocks and cells
    split = F.broadcast(spark.createDataFrame(blocks, "block int, over int, down int"))
    there = [(c, int(block[c])) for c in index.sizes if int(block[c]) in asked]
    of = F.broadcast(spark.createDataFrame(there, "cell int, block int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = probing.join(split, "block").select("id", "vector", "cells", "block", F.pmod(F.xxhash64("id"), F.col("down")).cast("int").alias("j"), each("over").alias("i"))
    wanted = index.points.where(F.col("cell").isin([c for c, _ in there])).join(of, "cell").join(split, "block")
    p = wanted.select("id", "vector", "cell", "block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("over")).cast("int").alias("i"), each("down").alias("j"))
    found = q.groupBy("block", "i", "j").cogroup(p.groupBy("block", "i", "j")).applyInArrow(_meet(some, index.metric), S.FOUND)
    if exclude_self:
        found = found.where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
