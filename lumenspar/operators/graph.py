"""Proximity graphs as edge tables: building, pruning, traversal, clusters, diffusion, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspar.components import connected_components
from lumenspar.functions.distance import METRICS
from lumenspar.functions.vectors import norm_sq
from lumenspar.operators.search import batch_search, pair_distances, unit
from lumenspar.work import materialize

EDGE_TYPE = {"lorentz": "HIERARCHY", "l2": "SIMILARITY", "euclidean": "SIMILARITY", "cosine": "SIMILARITY"}


def knn_graph(points: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """edges(src, dst, distance, rank): the exact k nearest others of every point."""
    found = batch_search(points, points, k, metric, exclude_self=True)
    return found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance", "rank")


def level(id_col: Column, top: int = 15) -> Column:
    """A point's layer: trailing zeros of its hash, so each layer holds half of the one below."""
    h = F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("long")
    low = h.bitwiseAND(-h)
    return F.least(F.when(h == 0, F.lit(top)).otherwise(F.bit_count(low - 1)).cast("int"), F.lit(top))


def layered_graph(points: DataFrame, m: int = 16, metric: str = "l2", layers: int = 3) -> DataFrame:
    """edges(layer, src, dst, distance, rank): 2m neighbours at the bottom, m above."""
    out = None
    for n in range(layers):
        here = points if n == 0 else points.where(level(F.col("id")) >= n)
        edges = knn_graph(here, 2 * m if n == 0 else m, metric).select(F.lit(n).alias("layer"), "*")
        out = edges if out is None else out.unionByName(edges)
    return out


def _greedy(d: np.ndarray, vectors: np.ndarray, most: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], alpha: float) -> list[int]:
    """Places of a source's edges, in order of distance, that no kept one leads to; at most ``most`` of them are measured against the rest."""
    kept: list[int] = []
    free, at = np.ones(len(d), bool), 0
    while len(kept) < most and at < len(d):
        at += int(free[at:].argmax())
        if not free[at]:
            break
        kept.append(at)
        at += 1
        rest = vectors[at:]
        free[at:] &= alpha * measure(np.broadcast_to(vectors[at - 1], rest.shape), rest) >= d[at:]
    return kept


def _diverse(m: int, metric: str, alpha: float, density: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows in order of source and distance, with all of a source's in one partition."""
    measure = pair_distances(metric)

    def pruned(src: np.ndarray, dst: np.ndarray, d: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        shown = unit(vectors) if metric == "cosine" else vectors
        starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        out, rank = [], []
        for a, z in zip(starts, np.r_[starts[1:], len(src)], strict=True):
            # a sparse neighbourhood keeps half as many edges
            most = m // 2 if density and d[a:z][:m].mean() > 1.2 else m
            kept = _greedy(d[a:z], shown[a:z], most, measure, alpha)
            out += [a + i for i in kept]
            rank += range(1, len(kept) + 1)
        at = np.array(out, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(src[at]), pa.array(dst[at]), pa.array(d[at]), pa.array(rank, pa.int64())], names=["src", "dst", "distance", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the last source, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rows = (*(batch.column(c).to_numpy() for c in ("src", "dst", "distance")), vectors)
            end = int(np.searchsorted(rows[0], rows[0][-1]))  # sources rise
            if end or (held and held[-1][0][-1] != rows[0][0]):
                done = [*held, tuple(c[:end] for c in rows)]
                yield pruned(*(np.concatenate(c) for c in zip(*done, strict=True)))
                held = []
            held.append(tuple(c[end:] for c in rows))
        if held:
            yield pruned(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def prune(edges: DataFrame, points: DataFrame, m: int, metric: str = "l2", alpha: float = 1.0, density: bool = False) -> DataFrame:
    """Edges that lead where kept, nearer ones do not (alpha > 1 keeps longer ones too).

    A task goes through its sources one after another; of a source that many points lead to,
    edges are measured against the m kept ones only.
    """
    rows = edges.join(points.select(F.col("id").alias("dst"), "vector"), "dst")
    rows = rows.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("distance").cast("double").alias("distance"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.repartition("src").sortWithinPartitions("src", "distance", "dst").mapInArrow(_diverse(m, metric, alpha, density), "src long, dst long, distance double, rank long")


def build(points: DataFrame, m: int = 16, ef: int = 64, metric: str = "l2", alpha: float = 1.0) -> DataFrame:
    """Candidates, diversity, links both ways, and pruning of what became too many."""
    one_way = materialize(prune(knn_graph(points, ef, metric), points, m, metric, alpha), "links")
    both = one_way.select("src", "dst", "distance").unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()
    return prune(materialize(both, "links"), points, 2 * m, metric, alpha)


def node(edges: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    """(id, neighbours, edge_type) of every point."""
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("x"))
    kind = EDGE_TYPE.get(metric, "UNKNOWN")
    return points.select("id").join(lists, "id", "left").select("id", F.coalesce("x.dst", F.expr("cast(array() as array<bigint>)")).alias("neighbours"), F.lit(kind).alias("edge_type"))


def neighbors(edges: DataFrame, of: int, limit: int = 64, offset: int = 0) -> DataFrame:
    return edges.where(F.col("src") == of).orderBy("rank").offset(offset).limit(limit).select("dst", "distance", "rank")


def concept_parents(layered: DataFrame, of: int, layer: int = 0, limit: int = 32) -> DataFrame:
    """Neighbours one layer up, or on the same layer where there are none."""
    up = layered.where((F.col("layer") == layer + 1) & (F.col("src") == of))
    found = layered.where((F.col("layer") == layer) & (F.col("src") == of)) if up.isEmpty() else up
    return found.orderBy("rank").limit(limit).select("layer", "dst", "distance")


def all_concept_parents(layered: DataFrame, layer: int = 0, limit: int = 32) -> DataFrame:
    """(src, layer, dst, distance) of all points of a layer: neighbours one layer up, or on the same one."""
    up = layered.where(F.col("layer") == layer + 1)
    own = layered.where(F.col("layer") == layer).join(up.select("src").distinct(), "src", "left_anti")
    return up.unionByName(own).where(F.col("rank") <= limit).select("src", "layer", "dst", "distance")


def traverse(edges: DataFrame, start: int, max_depth: int = 2, max_nodes: int = 256, breadth: int | None = None, dead: DataFrame | None = None) -> DataFrame:
    """(id, depth) breadth-first from a point; ``dead(id)`` rows are not entered.

    A step joins the frontier to the edges; what is kept is bounded by ``max_nodes``.
    """
    spark = edges.sparkSession
    live = edges if breadth is None else edges.where(F.col("rank") <= breadth)
    live = live if dead is None else live.join(dead.select(F.col("id").alias("dst")), "dst", "left_anti")
    seen = spark.createDataFrame([(start, 0)], "id long, depth int")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = live.join(F.broadcast(frontier.select(F.col("id").alias("src"))), "src").select(F.col("dst").alias("id")).distinct()
        left = max_nodes - seen.count()
        if left <= 0:
            break
        frontier = materialize(step.join(seen, "id", "left_anti").orderBy("id").limit(left).withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def clusters(edges: DataFrame, min_size: int = 3, max_clusters: int = 32, max_nodes: int = 10_000) -> DataFrame:
    """(cluster, id) of the largest undirected components; ``max_nodes`` is a cap a cluster reports."""
    labels = materialize(connected_components(edges.select("src", "dst")), "clusters")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).orderBy(F.desc("n"), "label").limit(max_clusters)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("node"))
    return labels.join(F.broadcast(sizes), "label").withColumn("r", rank).where(F.col("r") <= max_nodes).select(F.col("label").alias("cluster"), F.col("node").alias("id"))


def light_cone_tree(points: DataFrame, max_children: int | None = None) -> DataFrame:
    """(id, parent, distance): the nearest point nearer to the origin (Lorentz coordinates).

    Blocks of points meet as in the batch search, so a pair of points is never a row.
    """
    there = points.where(F.col("vector").isNotNull())
    found = batch_search(there, there, 1, "lorentz", earlier=True)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("parent"), "distance")


def hops_to(edges: DataFrame, a: int, targets: Sequence[int], max_depth: int = 6) -> dict[int, int | None]:
    """Steps of the shortest undirected paths from a point to others, None beyond ``max_depth``; one search for all."""
    found: dict[int, int | None] = dict.fromkeys(targets) | ({a: 0} if a in targets else {})
    if all(n is not None for n in found.values()):
        return found
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    seen = edges.sparkSession.createDataFrame([(a,)], "id long")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = both.join(frontier.toDF("src"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = materialize(step, "hops")
        left = [b for b, n in found.items() if n is None]
        found |= {r.id: depth for r in frontier.where(F.col("id").isin(left)).collect()}
        if all(n is not None for n in found.values()) or frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return found


def hops(edges: DataFrame, a: int, b: int, max_depth: int = 6) -> int | None:
    """Steps of the shortest undirected path, or None beyond ``max_depth``."""
    return hops_to(edges, a, [b], max_depth)[b]


def evaluate_claims(edges: DataFrame, a: int, targets: Sequence[int], max_depth: int = 6) -> dict[int, float]:
    """exp(-0.4 hops) for each target; 1 for the same point, 0 where one is out of reach."""
    return {b: 0.0 if n is None else float(np.exp(-0.4 * n)) for b, n in hops_to(edges, a, targets, max_depth).items()}


def evaluate_claim(edges: DataFrame, a: int, b: int, max_depth: int = 6) -> float:
    return evaluate_claims(edges, a, [b], max_depth)[b]


def trust_scores(steps: DataFrame, metric: str = "l2") -> DataFrame:
    """(trajectory, score) of steps(trajectory, seq, vector): 1 / (1 + exp(mean growth of the distance to the last))."""
    w = Window.partitionBy("trajectory")
    last = F.max_by("vector", "seq").over(w)
    measured = steps.withColumn("d", METRICS[metric](F.col("vector"), last)).withColumn("n", F.count(F.lit(1)).over(w))
    change = measured.withColumn("delta", F.col("d") - F.lag("d").over(w.orderBy("seq"))).where("n >= 3")
    return change.groupBy("trajectory").agg(F.avg("delta").alias("change")).select("trajectory", (1 / (1 + F.exp(F.greatest("change", F.lit(0.0))))).alias("score"))


def wave_search(
    seeds: DataFrame, edges: DataFrame, k: int, steps: int = 3, sigma: float = 0.5, damping: float = 0.9, mass_sq: float = 0.05,
    potential: float = 0.3, restart: float = 0.15, beam: int = 256, neighbours: int = 16,
) -> DataFrame:
    """(id, energy): diffusion from seeds(id, distance) along edges, with restarts, top k.

    A step is one join and one sum; the state is never more than ``beam`` rows, so it is
    broadcast to the edges.
    """
    kernel = edges.where(F.col("rank") <= neighbours).select("src", "dst", (F.exp(-F.col("distance") ** 2 / sigma**2) * damping).alias("w"))
    start = materialize(seeds.select("id", (1 / (1 + F.col("distance"))).alias("v")), "seeds")
    state = start.select("id", F.col("v").alias("e"))
    for step in range(steps):
        moved = kernel.join(F.broadcast(state), kernel.src == state.id).select(F.col("dst").alias("id"), (F.col("e") * F.col("w")).alias("e"))
        stay = state.select("id", (F.col("e") * (1 - mass_sq)).alias("e"))
        total = moved.unionByName(stay).groupBy("id").agg(F.sum("e").alias("e"))
        factor = restart * (1 - step / steps * 0.3)
        both = total.join(F.broadcast(start), "id", "full")
        v, e = F.coalesce("v", F.lit(0.0)), F.coalesce("e", F.lit(0.0))
        new = both.select("id", (e * (1 + potential * v) * (1 - factor) + factor * v * v).alias("e"))
        top = new.orderBy(F.desc("e"), "id").limit(beam)
        scale = F.max("e").over(Window.partitionBy())
        state = materialize(top.select("id", F.when(scale > 1e-12, F.col("e") / scale).otherwise(F.col("e")).alias("e")), "wave")
    return state.orderBy(F.desc(F.round("e", 12)), "id").limit(k).select("id", F.col("e").alias("energy"))


def wave_from(points: DataFrame, edges: DataFrame, query: Sequence[float], k: int, metric: str = "l2", **params: float) -> DataFrame:
    from lumenspar.operators.search import search

    n = max(5 * k, int(params.get("beam", 256)) // 4, 20)
    return wave_search(search(points, query, n, metric).select("id", "distance"), edges, k, **params)


def consensus_wave(points: DataFrame, edges: DataFrame, query: Sequence[float], k: int, metric: str = "l2", seeds: int = 5) -> DataFrame:
    """(id, score, distance): diffusive traverses from the nearest points, ranks weighed by the seeds.

    A traverse gives 3k points; a point's score is the sum over the seeds that reach it of
    the seed's weight over one plus the rank there, from nought.
    """
    from lumenspar.operators.search import search

    near = search(points, query, seeds, metric).select("id", "distance").collect()
    total = None
    for seed in near:
        start = points.sparkSession.createDataFrame([(seed.id, 0.0)], "id long, distance double")
        reached = wave_search(start, edges, 3 * k)
        rank = F.row_number().over(Window.orderBy(F.desc(F.round("energy", 12)), "id"))  # 3k rows
        scored = reached.select("id", (F.lit(1 / (1 + seed.distance)) / rank).alias("s"))
        total = scored if total is None else total.unionByName(scored)
    out = total.groupBy("id").agg(F.sum("s").alias("score")).select("id", "score", (1 / F.col("score") - 1).alias("distance"))
    return out.orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def _fnv(ids: pd.Series, vectors: pd.Series) -> pd.Series:
    """FNV-1a over the id's low 32 bits and the vector's bytes; all rows of one length at a time."""
    out = np.zeros(len(ids), np.int64)
    sizes = vectors.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        low = (ids.to_numpy()[at].astype(np.int64) & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(len(at), 4)
        rest = np.array([np.asarray(v, "<f8") for v in vectors.iloc[at]], "<f8").reshape(len(at), size).view(np.uint8).reshape(len(at), 8 * size)
        h = np.full(len(at), 14695981039346656037, np.uint64)
        for column in np.concatenate((low, rest), axis=1).T.astype(np.uint64):
            h = (h ^ column) * np.uint64(1099511628211)
        out[at] = h.view(np.int64)
    return pd.Series(out)


point_hash = F.pandas_udf(_fnv, T.LongType())


def digest(points: DataFrame, buckets: int = 256) -> DataFrame:
    """(bucket, hash, n): XOR of the point hashes of each id bucket."""
    return points.groupBy(F.pmod("id", F.lit(buckets)).alias("bucket")).agg(
        F.expr("bit_xor(h)").alias("hash"), F.count(F.lit(1)).alias("n")
    ) if "h" in points.columns else digest(points.withColumn("h", point_hash("id", "vector")), buckets)


def root(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.expr("bit_xor(hash)").alias("root"))


def handshake(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Buckets whose digests differ."""
    a, b = mine.select("bucket", F.col("hash").alias("a")), theirs.select("bucket", F.col("hash").alias("b"))
    return a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def sync_pull(points: DataFrame, wanted: Sequence[int], buckets: int = 256) -> DataFrame:
    return points.where(F.pmod("id", F.lit(buckets)).isin(list(wanted)))


def sync_push(points: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, report of accepted and duplicate rows)."""
    new = incoming.join(points.select("id"), "id", "left_anti")
    known = incoming.join(points.select("id"), "id", "left_semi")
    report = new.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("what"), "n").unionByName(
        known.agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate").alias("what"), "n")
    )
    return new, report


def _pair(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()


def merkle_levels(leaves: DataFrame) -> tuple[list[int], list[list[bytes]]]:
    """Ids and levels, from the leaves to the root, of a SHA-256 tree over leaves(id, h); for result sets, which are short.

    A node without a partner is paired with itself.
    """
    rows = leaves.orderBy("id").select("id", "h").collect()
    levels = [[bytes.fromhex(r.h) for r in rows]]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_pair(last[i], last[min(i + 1, len(last) - 1)]) for i in range(0, len(last), 2)])
    return [r.id for r in rows], levels


def merkle_root(leaves: DataFrame) -> str:
    _, levels = merkle_levels(leaves)
    return levels[-1][0].hex() if levels[-1] else hashlib.sha256(b"").hexdigest()


def inclusion_proofs(leaves: DataFrame) -> dict[int, list[tuple[str, bool]]]:
    """For each id, the partners from its leaf to the root, and whether the partner is on the left."""
    ids, levels = merkle_levels(leaves)
    out = {}
    for at, i in enumerate(ids):
        proof = []
        for level_ in levels[:-1]:
            partner = at ^ 1
            proof.append((level_[partner if partner < len(level_) else at].hex(), at % 2 == 1))
            at //= 2
        out[i] = proof
    return out


def proven(leaf: str, proof: Sequence[tuple[str, bool]], root_: str) -> bool:
    """Whether a leaf with its proof leads to the root."""
    h = bytes.fromhex(leaf)
    for partner, left in proof:
        h = _pair(bytes.fromhex(partner), h) if left else _pair(h, bytes.fromhex(partner))
    return h.hex() == root_


def hyperbolicity(points: DataFrame, samples: int = 1000, seed: int = 7) -> tuple[float, str]:
    """Gromov delta over hashed quadruples of points, and the metric it suggests.

    The sample is the rows of smallest hash; delta and quadruples are over that sample.
    """
    rows = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(500).select("vector").collect()
    v = np.array([r.vector for r in rows], float)
    if len(v) < 4:
        return 0.0, "euclidean"
    rng = np.random.default_rng(seed)
    quads = np.array([rng.choice(len(v), 4, replace=False) for _ in range(samples)])
    d = lambda a, b: np.linalg.norm(v[quads[:, a]] - v[quads[:, b]], axis=1)
    sums = np.sort(np.stack((d(0, 1) + d(2, 3), d(0, 2) + d(1, 3), d(0, 3) + d(1, 2))), axis=0)
    delta = float(((sums[2] - sums[1]) / 2).max())
    unit = bool((abs(np.linalg.norm(v[:20], axis=1) - 1) <= 1e-2).all())
    return delta, "lorentz" if delta < 0.15 else "poincare" if delta < 0.30 else "cosine" if unit else "l2"


def frechet_means(points: DataFrame, by: str, c: float = 1.0, max_iter: int = 32, tol: float = 1e-6) -> DataFrame:
    """(group, mean) in the ball: a step of every group's mean is one join and one average."""
    from lumenspar.functions import geometry as G
    from lumenspar.functions.vectors import mean_vector, norm

    dim = len(points.select("vector").first().vector)
    state = points.groupBy(F.col(by).alias("group")).agg(F.min_by("vector", "id").alias("mean")).select("group", G.project_to_ball(F.col("mean"), c).alias("mean"))
    state = materialize(state.withColumn("moved", F.lit(1.0)), "means")
    rows = points.select(F.col(by).alias("group"), "vector")
    for _ in range(max(1, max_iter)):
        grads = rows.join(state.where(F.col("moved") > tol), "group").select("group", "mean", G.log_map(F.col("mean"), F.col("vector"), c).alias("g"))
        step = grads.groupBy("group").agg(mean_vector(F.col("g"), dim).alias("g"))
        both = state.join(step, "group", "left")
        size = norm(F.coalesce("g", F.transform("mean", lambda _: F.lit(0.0))))
        new = F.when(size > max(tol, 1e-15), G.project_to_ball(G.exp_map(F.col("mean"), F.col("g"), c), c)).otherwise(F.col("mean"))
        state = materialize(both.select("group", new.alias("mean"), size.alias("moved")), "means")
        if state.where(F.col("moved") > max(tol, 1e-15)).isEmpty():
            break
    return state.select("group", "mean")


def lyapunov(steps: DataFrame, c: float = 1.0) -> DataFrame:
    """(trajectory, trend) of steps(trajectory, seq, vector): mean change of the distance to the Frechet mean."""
    from lumenspar.functions.geometry import log_map
    from lumenspar.functions.vectors import norm

    means = frechet_means(steps.withColumn("id", F.col("seq")), "trajectory", c).withColumnsRenamed({"group": "trajectory"})
    w = Window.partitionBy("trajectory").orderBy("seq")
    e = norm(log_map(F.col("mean"), F.col("vector"), c))
    rows = steps.join(means, "trajectory").withColumn("e", e).withColumn("d", F.col("e") - F.lag("e").over(w))
    return rows.groupBy("trajectory").agg(F.avg("d").alias("trend"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


def radius(points: DataFrame) -> DataFrame:
    return points.select("id", F.sqrt(norm_sq(F.col("vector"))).alias("radius"))
