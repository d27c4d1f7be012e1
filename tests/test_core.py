"""The engine's own operators: fixtures with known answers, laws, plans, and all SQL twins."""

import importlib.util
import math
import os
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import lumenspar.operators.graph as G
from lumenspar import filters as P
from lumenspar.components import connected_components
from lumenspar.functions import distance as D
from lumenspar.functions import fuzzy, geometry
from lumenspar.functions import quantize as Q
from lumenspar.functions.vectors import vec
from lumenspar.operators import cells
from lumenspar.operators import lexical as L
from lumenspar.operators import search as S
from lumenspar.operators.lexical import _porter, stopwords
from lumenspar.operators.stems import german, spanish
from lumenspar.plans import ORACLE, QUERIES
from lumenspar.plans import fixtures as X
from lumenspar.sources import collections as C
from lumenspar.sources import wal
from lumenspar.spec import CollectionSpec, Component
from lumenspar.work import shared_dir, work_path
from tests.conftest import SF


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, same, name):
    same(QUERIES[name](spark, SF), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"m07_frechet_mean", "m13_lyapunov"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_known_distances(spark):
    near = lambda c, x: value(spark, c) == pytest.approx(x, abs=1e-6)
    assert near(D.l2(vec([1, 2, 3]), vec([4, 5, 6])), 27)
    assert near(D.cosine(vec([1, 0]), vec([0, 1])), 2) and near(D.cosine(vec([1, 0]), vec([-1, 0])), 4)
    assert near(D.poincare(vec([0, 0]), vec([0.5, 0])), math.acosh(1 + 0.5 / 0.75))
    r = 1.5
    assert near(D.lorentz(vec([1, 0, 0]), vec([math.cosh(r), math.sinh(r), 0])), r)
    assert near(D.l2_sqrt(vec([0, 0]), vec([3, 4])), 5)
    assert near(D.wasserstein(vec([1, 0, 0]), vec([0, 0, 1])), 2)
    coded = value(spark, Q.lorentz_scalar(vec([math.cosh(1), math.sinh(1), 0])))
    assert list(coded.codes) == [127, 97, 0]


def test_validity(spark):
    ok = lambda v, m: value(spark, D.valid(vec(v), m))
    assert ok([0.1, 0.2], "poincare") and not ok([1, 0], "poincare") and not ok([0.8, 0.8], "poincare")
    assert ok([1, 0, 0], "lorentz") and not ok([-1, 0, 0], "lorentz")
    assert not ok([float("nan")], "l2") and not ok([float("inf")], "cosine")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-0.5, 0.5), min_size=3, max_size=3), st.lists(st.floats(-0.5, 0.5), min_size=3, max_size=3))
def test_exp_and_log_maps_undo_each_other(x, y):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    back = value(spark, geometry.exp_map(vec(x), geometry.log_map(vec(x), vec(y))))
    assert back == pytest.approx(y, abs=1e-6)


@settings(max_examples=6, deadline=None)
@given(st.floats(0, 1), st.floats(0, 1))
def test_fuzzy_duals(a, b):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for t, s in fuzzy.DUAL.items():
        left = value(spark, 1 - fuzzy.TNORMS[t](F.lit(a), F.lit(b)))
        assert left == pytest.approx(value(spark, fuzzy.TCONORMS[s](F.lit(1 - a), F.lit(1 - b))), abs=1e-9)


def test_filters(spark):
    rows = spark.createDataFrame(
        [(1, {"price": "100", "cat": "book"}), (2, {"price": "200", "cat": "tech"}), (3, {"price": "50", "cat": "book"}), (4, {"price": "x"})], "id long, metadata map<string,string>"
    ).withColumn("vector", vec([0.1] * 8))
    ids = lambda f: {r.id for r in rows.where(P.compile_filter(f)).collect()}
    assert ids(P.Range("price", 80)) == {1, 2} and ids(P.Range("price", None, 150)) == {1, 3} and ids(P.Range("price", 80, 150)) == {1}
    assert ids(P.And((P.Range("price", 80), P.Match("cat", "tech")))) == {2}
    assert ids(P.Not(P.Match("cat", "book"))) == {2, 4} and ids(P.And(())) == {1, 2, 3, 4} and ids(P.Or(())) == set()
    for bad in ({}, {"match": {}}, {"nope": 1}, {"and": 3}, []):
        with pytest.raises(ValueError):
            P.from_dict(bad)


def test_plans(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    fields = P.Fields(metadata=None, columns={"brand": "p_brand", "type": "p_type"})
    plan = part.where(P.compile_filter(P.Prefix("type", "S"), fields)).select("p_partkey")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan
    points = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    assert "TakeOrderedAndProject" in S.search(points, [0.0] * 64, 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in S.batch_search(points, points.limit(3), 5)._jdf.queryExecution().toString()


def test_collections(spark):
    catalog = C.Catalog(spark, work_path(spark, "catalog"))
    made = catalog.create(CollectionSpec("a_x", (Component("h", "lorentz", 3), Component("t", "l2", 2))))
    assert made.spec.metric == "hybrid" and catalog.list("a") == ["a_x"] and catalog.list("b") == []
    with pytest.raises(ValueError):
        catalog.create(made.spec)
    assert catalog.get("a_x").spec == made.spec
    flat = catalog.create(CollectionSpec("flat", (Component("v", "l2", 2),)))
    rows = spark.createDataFrame([(1, [1.0, 2.0, 9.0], {"a": "1"}), (2, [3.0, 4.0], None)], "id long, vector array<double>, metadata map<string,string>")
    flat.insert(rows)
    flat.insert(rows.where("id = 2").withColumn("metadata", F.create_map(F.lit("b"), F.lit("2"))))
    flat.delete(rows.where("id = 1"))
    live = flat.live().collect()
    assert [(r.id, r.vector, r.metadata) for r in live] == [(2, [3.0, 4.0], {"b": "2"})]
    with pytest.raises(Exception, match="invalid vector"):
        flat.insert(rows.withColumn("vector", F.array(F.lit(1.0))))
    with pytest.raises(Exception, match="no such id"):
        flat.update_payload(spark.createDataFrame([(7, {"c": "3"})], "id long, metadata map<string,string>"))
    catalog.delete("flat")
    assert not catalog.exists("flat")


def test_wal_replay_and_source(spark, tmp_path):
    entries = [wal.Entry(i, "insert" if i % 3 else "delete", i * 7, (0.5, float(i)), {"k": "é" * i}) for i in range(20)]
    data = [wal.encode(e) for e in entries]
    assert list(wal.replay(b"".join(data))) == entries
    assert list(wal.replay(b"".join(data)[:-3])) == entries[:-1]
    torn = bytearray(b"".join(data))
    torn[len(b"".join(data[:5])) + 12] ^= 1
    assert list(wal.replay(bytes(torn))) == entries[:5]
    for i in range(2):
        (tmp_path / f"{i}.wal").write_bytes(b"".join(data[i * 10 : i * 10 + 10]))
    spark.dataSource.register(wal.WalSource)
    read = spark.read.format("lumenspar_wal").option("paths", ",".join(f"file://{tmp_path}/{i}.wal" for i in range(2))).load()
    assert sorted((r.clock, r.op, r.id, tuple(r.vector), r.metadata["k"]) for r in read.collect()) == sorted((e.clock, e.op, e.id, e.vector, e.metadata["k"]) for e in entries)


def test_working_tables_can_be_removed(spark, monkeypatch):
    from lumenspar import work

    own = shared_dir(spark) + "/other"
    monkeypatch.setattr(work, "shared_dir", lambda _: own)
    made = work.materialize(spark.range(10), "ten")
    folder = made.inputFiles()[0].rsplit("/", 2)[0]
    assert own in folder and spark.sparkContext.applicationId in folder
    work.clean_up(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder + "/*")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7), (None, 3)], "src long, dst long")
    labels = {r.node: r.label for r in connected_components(edges).collect()}
    assert labels == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_frechet_mean_of_symmetric_points(spark):
    points = spark.createDataFrame([(1, "g", [0.3, 0.1]), (2, "g", [-0.3, -0.1]), (3, "h", [0.2, 0.4])], "id long, grp string, vector array<double>")
    means = {r.group: r.mean for r in G.frechet_means(points, "grp").collect()}
    assert means["g"] == pytest.approx([0, 0], abs=1e-5) and means["h"] == pytest.approx([0.2, 0.4], abs=1e-5)


def test_line_tree_is_hyperbolic(spark):
    points = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate((0, 1, -1, 2, -2))], "id long, vector array<double>")
    delta, metric = G.hyperbolicity(points)
    assert delta < 0.2 and metric == "lorentz"


def test_stems_and_stopwords():
    assert [_porter(w) for w in ("caresses", "ponies", "hopping", "relational", "rate", "adjustment", "controlling")] == ["caress", "poni", "hop", "relat", "rate", "adjust", "control"]
    known = {"aufeinander": "aufeinand", "kategorischen": "kategor", "häuser": "haus", "freundlichkeit": "freundlich", "straße": "strass", "ergebnisse": "ergebnis"}
    assert {w: german(w) for w in known} == known
    known = {"cheques": "chequ", "chequeo": "cheque", "chicana": "chican", "torreón": "torreon", "toreándolo": "tor", "torcer": "torc", "rápidamente": "rapid", "naciones": "nacion"}
    assert {w: spanish(w) for w in known} == known
    assert "the" in stopwords("EN") and "und" in stopwords("german") and stopwords("xx") == []


def test_queries_load_without_a_session_from_the_archive_of_pyspark():
    lib = next(Path(importlib.util.find_spec("pyspark").origin).parent.glob("python/lib"))
    path = os.pathsep.join([str(Path(__file__).parent.parent), *map(str, sorted(lib.glob("*.zip")))])
    code = "import pyspark, __spark_entry__ as e; assert '.zip' in pyspark.__file__; print(len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "SPARK_HOME"} | {"PYTHONPATH": path}
    assert int(subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout) > 100


def test_refined_codes_are_one_greedy_pass():
    rng = np.random.default_rng(1)
    for n in (1, 3, 64, 128):
        v = rng.normal(size=n)
        v /= max(1.0, np.abs(v).max())
        codes = [int(math.copysign(math.floor(abs(x * 127) + 0.5), x)) for x in v]

        def loss(c):
            e = np.array(c) / 127 - v
            along = (e @ v) ** 2 / (v @ v)
            return along + 10 * (e @ e - along)

        for i in range(n):
            options = [codes[:i] + [codes[i] + s] + codes[i + 1 :] for s in (0, -1, 1) if abs(codes[i] + s) <= 127]
            codes = min(options, key=lambda c: round(loss(c), 13))
        assert Q.refine(v).tolist() == codes
    long = rng.uniform(-1, 1, 129)
    assert Q.refine(long).tolist() == [int(math.copysign(math.floor(abs(x * 127) + 0.5), x)) for x in long]


def test_smallest_breaks_ties_by_id():
    d = np.array([[3.0, 1.0, 1.0, 2.0, 1.0], [np.nan, 5.0, 5.0, 5.0, 0.0]])
    ids = np.array([[1, 9, 4, 2, 7], [1, 3, 2, 8, 5]])
    assert S.smallest(d, ids, 2)[1].tolist() == [[4, 7], [5, 2]]
    assert S.smallest(d, ids, 9)[1].shape == (2, 5)


def test_blocks_of_queries_and_points_meet(spark, monkeypatch):
    points = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    key = lambda df: sorted((r.query_id, r.id, r["rank"]) for r in df.collect())
    whole = key(S.batch_search(points, points, 3, "cosine", exclude_self=True))
    monkeypatch.setattr(S, "QUERY_BLOCK", 40)
    monkeypatch.setattr(S, "POINT_BLOCK", 30)
    assert key(S.batch_search(points, points, 3, "cosine", exclude_self=True)) == whole
    assert key(S.batch_search(points.limit(0), points, 3)) == [] == key(S.batch_search(points, points.limit(0), 3))


def test_a_rewrite_leaves_one_log_whenever_it_stops(spark):
    flat = C.Catalog(spark, work_path(spark, "catalog")).create(CollectionSpec("flat", (Component("v", "l2", 1),)))
    rows = spark.createDataFrame([(1, [1.0], {"a": "x"}), (2, [2.0], {"a": "y"}), (1, [3.0], {"a": "z"})], "id long, vector array<double>, metadata map<string,string>")
    flat.insert(rows.coalesce(1))
    live = lambda: sorted((r.id, r.vector[0], r.metadata["a"]) for r in flat.live().collect())
    assert live() == [(1, 3.0, "z"), (2, 2.0, "y")]
    # a rewrite that did not come to its end counts for nothing
    rows.limit(0).write.parquet(f"{flat.path}/log-1")
    from lumenspar.work import remove

    remove(spark, f"{flat.path}/log-1/_SUCCESS")
    assert live() == [(1, 3.0, "z"), (2, 2.0, "y")]
    flat.vacuum(F.col("id") == 2)
    assert live() == [(1, 3.0, "z")] and flat.log().count() == 1
    flat.insert(rows.where("id = 2"))
    assert live() == [(1, 3.0, "z"), (2, 2.0, "y")]


def test_digests_of_negative_ids(spark):
    points = spark.createDataFrame([(-1, [0.5]), (255, [0.5]), (3, [1.0, 2.0])], "id long, vector array<double>")
    found = {r.bucket: r.n for r in G.digest(points).collect()}
    assert found == {255: 2, 3: 1}
    assert {r.id for r in G.sync_pull(points, [255]).collect()} == {-1, 255}

    def fnv(i, v):
        h = 14695981039346656037
        for byte in (i & 0xFFFFFFFF).to_bytes(4, "little") + np.asarray(v, "<f8").tobytes():
            h = (h ^ byte) * 1099511628211 % 2**64
        return h - 2**64 if h >= 2**63 else h

    assert {r.id: r.h for r in points.select("id", G.point_hash("id", "vector").alias("h")).collect()} == {i: fnv(i, v) for i, v in ((-1, [0.5]), (255, [0.5]), (3, [1.0, 2.0]))}


@pytest.mark.parametrize("kind", ["l2", "cosine", "poincare", "lorentz"])
def test_cell_search_finds_most_neighbours(spark, kind):
    sf = SF.replace("0.001", "0.1")
    found = {(r.query_id, r.id) for r in QUERIES[f"s01_cell_search_{kind}"](spark, sf).collect()}
    p = X.points(spark, sf, kind)
    exact = {(r.query_id, r.id) for r in S.batch_search(p, p.where("id % 20 = 0"), 10, kind, exclude_self=True).collect()}
    assert len(found & exact) >= 0.95 * len(exact)


def test_cells_of_clusters_are_few(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 8)) * 20
    v = centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    index = cells.build(points, cells=30, sample=1000)
    assert index.probes <= 8 and sum(index.sizes.values()) == 3000
    queries = points.where("id % 20 = 0")
    exact = {(r.query_id, r.id): r["rank"] for r in S.batch_search(points, queries, 5).collect()}
    found = {(r.query_id, r.id): r["rank"] for r in cells.cell_search(index, queries, 5).collect()}
    assert len(found.keys() & exact.keys()) >= 0.95 * len(exact)
    # blocks of a few rows give what whole cells give
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    monkeypatch.setattr(S, "POINT_BLOCK", 17)
    assert {(r.query_id, r.id): r["rank"] for r in cells.cell_search(index, queries, 5).collect()} == found
    assert cells.cell_search(cells.build(points.limit(0)), queries, 5).count() == 0


@pytest.mark.parametrize(("alpha", "density"), [(1.0, False), (1.2, False), (1.2, True)])
def test_pruning_matches_brute_force(spark, alpha, density):
    points = X.points(spark, SF)
    edges = G.knn_graph(points, 24).cache()
    v = {r.id: np.array(r.vector) for r in points.collect()}
    lists = {}
    for r in edges.collect():
        lists.setdefault(r.src, []).append((r.distance, r.dst))
    want = set()
    for src, near in lists.items():
        near.sort()
        most = 4 if density and sum(d for d, _ in near[:8]) / 8 > 1.2 else 8
        kept = []
        for d, dst in near:
            if len(kept) < most and all(alpha * ((v[dst] - v[other]) ** 2).sum() >= d for other in kept):
                kept.append(dst)
        want |= {(src, dst, rank) for rank, dst in enumerate(kept, 1)}
    assert {(r.src, r.dst, r["rank"]) for r in G.prune(edges, points, 8, alpha=alpha, density=density).collect()} == want


def test_marginal_relevance_by_hand(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.6, 0.8]), (4, [0.0, 1.0])], "id long, vector array<double>")
    # gains after the first: -0.4, -0.24 and 0
    assert S.maximal_marginal(points, [1.0, 0.0], 2, 0.3) == [1, 4]
    assert S.maximal_marginal(points, [1.0, 0.0], 9, 1.0) == [1, 2, 3, 4]


def test_trend_towards_the_mean(spark):
    steps = [("in", i, [0.4 / (i + 1), 0.0]) for i in range(4)] + [("short", 0, [0.1, 0.1])]
    rows = spark.createDataFrame(steps, "trajectory string, seq long, vector array<double>")
    found = {r.trajectory: r.trend for r in G.lyapunov(rows).collect()}
    mean = G.frechet_means(rows.where("trajectory = 'in'").withColumn("id", F.col("seq")), "trajectory").first().mean
    far = [np.linalg.norm(value(spark, geometry.log_map(vec(mean), vec(x)))) for t, _, x in steps if t == "in"]
    assert set(found) == {"in"} and found["in"] == pytest.approx((far[-1] - far[0]) / 3, abs=1e-6)


def test_a_batch_that_comes_twice_merges_once(spark):
    from lumenspar import streaming as Z

    path = work_path(spark, "merged")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, clock long, x string")
    merge = Z.merge_into(path, buckets=2)
    merge(rows((1, 1, "a"), (2, 1, "b"), (3, 1, "c")), 0)
    for epoch in (1, 1, 2, 3, 3):
        merge(rows((1, epoch + 1, f"a{epoch}"), (3, 0, "late")), epoch)
    merge(rows().limit(0), 4)
    found = {(r.id, r.clock, r.x) for r in Z.merged(spark, path, "id long, clock long, x string").collect()}
    assert found == {(1, 4, "a3"), (2, 1, "b"), (3, 1, "c")}
    left = spark.read.parquet(path).groupBy("b").agg(F.countDistinct("v").alias("n")).collect()
    assert all(r.n <= 2 for r in left)


def test_the_light_cone_tree_makes_no_pair_a_row(spark, monkeypatch):
    points = X.points(spark, SF, "lorentz")
    plan = G.light_cone_tree(points)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    v = {r.id: np.array(r.vector) for r in points.collect()}
    far = lambda a, b: round(math.acosh(max(a[0] * b[0] - a[1:] @ b[1:], 1 + 1e-12)), 9)
    want = {i: min((far(a, b), j) for j, b in v.items() if b[0] < a[0])[1] for i, a in v.items() if any(b[0] < a[0] for b in v.values())}
    assert {r.id: r.parent for r in G.light_cone_tree(points).collect()} == want
    for name, rows in (("QUERY_BLOCK", 40), ("POINT_BLOCK", 30), ("TILE_POINTS", 8), ("TILE_QUERIES", 8)):
        monkeypatch.setattr(S, name, rows)
    assert {r.id: r.parent for r in G.light_cone_tree(points).collect()} == want


@pytest.mark.parametrize("metric", ["l2", "cosine", "poincare", "lorentz", "hybrid"])
def test_a_block_is_searched_by_tiles(metric):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 65))
    v *= rng.uniform(0.2, 0.9, (6000, 1)) / np.linalg.norm(v, axis=1, keepdims=True)
    if metric in ("lorentz", "hybrid"):
        v[:, 0] = np.sqrt(1 + (v[:, 1 : 65 if metric == "lorentz" else 33] ** 2).sum(1))
    v[rng.random(6000) < 0.3] = v[17]
    ids = rng.permutation(6000)
    measure, shown = S.pair_distances(metric), S.unit(v) if metric == "cosine" else v
    tracemalloc.start()
    top = S._Top(ids[:2000], v[:2000], 11, metric)
    top.add(ids, v)
    query, found, _ = (c.to_numpy() for c in top.columns())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 90e6  # all at once: 2,000 x 6,000 distances and their copies, 300 MB
    for at in range(0, 2000, 50):
        d = np.round(measure(np.broadcast_to(shown[at], shown.shape), shown), 9)
        assert found[query == ids[at]].tolist() == ids[np.lexsort((ids, d))[:11]].tolist()


def test_scores_that_single_precision_cannot_hold_are_measured():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 3)) * 10.0 ** rng.integers(-30, 40, (500, 1))
    v[:9, 1] = np.nan, np.inf, -np.inf, 1e300, 1e-300, 0, 1e20, 1e-20, 1
    with np.errstate(all="ignore"):
        top = S._Top(np.arange(500), v, 3, "l2")
        top.add(np.arange(500), v)
        query, found, _ = (c.to_numpy() for c in top.columns())
        for i in range(500):
            d = np.round(((v - v[i]) ** 2).sum(1), 9)
            d[np.isnan(d)] = np.inf
            assert found[query == i].tolist() == np.lexsort((np.arange(500), d))[:3].tolist()


def test_queries_that_probe_many_cells_are_not_repeated_for_each(spark):
    rng = np.random.default_rng(6)
    centroids, v = rng.normal(size=(400, 8)), rng.normal(size=(900, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(900)), pa.array(v.tolist())], names=["id", "vector"])
    block = np.where(np.arange(400) % 100 == 7, -1, np.arange(400) // 40)
    out = list(cells._probes(centroids, "l2", 300, block)([batch]))
    assert sum(b.num_rows for b in out) <= 900 * 10 and max(sum(map(len, b.column("cells").to_pylist())) for b in out) <= cells.PROBES
    got = {}
    for b in out:
        for i, at, some in zip(b.column("id").to_pylist(), b.column("block").to_pylist(), b.column("cells").to_pylist(), strict=True):
            assert (block[some] == at).all()
            got.setdefault(i, set()).update(some)
    far = ((v[:, None, :] - centroids) ** 2).sum(2)
    assert all(got[i] == {c for c in np.argsort(far[i])[:300] if block[c] >= 0} for i in range(900))


def test_texts_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 3} a c{i}") for i in range(60)] + [(60, None), (61, "")], "id long, text string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        read.add(1)
        return (text or "").split()

    def reads(run):
        before = read.value
        return run(), read.value - before

    scores = lambda index: {r.id: round(r.score, 9) for r in L.bm25(index, ["a", "b1", "none"]).collect()}
    some, n = reads(lambda: scores(L.build_index(docs, "id", words("text"), ["a", "b1", "none"])))
    assert n == 62 and len(some) == 60
    stored, n = reads(lambda: L.store_index(L.build_index(docs, "id", words("text")), f"file://{tmp_path}/index"))
    assert n == 124 and scores(stored) == some  # once for postings, once for lengths
    assert {r.term: r.df for r in stored.df.collect()} == {"a": 60} | {f"b{i}": 20 for i in range(3)} | {f"c{i}": 1 for i in range(60)}
    summary, n = reads(lambda: L.corpus_summary(docs, words("text")).first())
    assert n == 62 and tuple(summary) == (62, 240 / 62, 64)
    assert tuple(L.corpus_summary(docs.limit(0), words("text")).first()) == (0, 1.0, 0)
    queries = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c7"), (2, "b2"), (2, "zz"), (3, "zz")], "query_id long, term string")
    top, n = reads(lambda: L.benchmark_top(docs, "id", words("text"), queries, 4).collect())
    assert n == 62
    every = L.benchmark_scores(stored, queries).collect()
    want = {(q, i): s for q in (1, 2) for s, i in sorted(((r.score, -r.id) for r in every if r.query_id == q), key=lambda x: (-round(x[0], 6), -x[1]))[:4]}
    assert {(r.query_id, -r.id): pytest.approx(r.score, abs=1e-9) for r in top} == want and len(top) == 8


def test_benchmark_scores_by_tiles(spark, monkeypatch):
    text = L.benchmark_tokens(F.col("text"))
    docs = X.table(spark, SF, "documents")
    queries = X.table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text).alias("term"))
    whole = {(r.query_id, r.id, r["rank"]) for r in L.benchmark_top(docs, "doc_id", text, queries, 5).collect()}
    plan = L.benchmark_top(docs, "doc_id", text, queries, 5)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    monkeypatch.setattr(L, "SCORED", 40)
    assert {(r.query_id, r.id, r["rank"]) for r in L.benchmark_top(docs, "doc_id", text, queries, 5).collect()} == whole


def test_one_search_finds_all_claims_and_pruning_takes_hubs_in_pieces(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(1, 5)], "src long, dst long")
    assert G.hops_to(edges, 1, [1, 3, 7, 8, 9, 40], 4) == {1: 0, 3: 2, 7: 3, 8: 4, 9: None, 40: None}
    assert G.evaluate_claims(edges, 2, [2, 99]) == {2: 1.0, 99: 0.0}
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 4))
    v[::2] = v[0]
    src = np.sort(np.r_[np.zeros(2999, int), rng.integers(1, 40, 500), np.full(700, 41)])
    dst = rng.permutation(np.r_[np.arange(1, 3000), rng.integers(0, 3000, 1200)])
    far = S.pair_distances("l2")
    d = far(v[src], v[dst])
    order = np.lexsort((dst, d, src))
    src, dst, d = src[order], dst[order], d[order]
    want = []
    for s in np.unique(src):
        kept = []
        for j in np.flatnonzero(src == s):
            if len(kept) < 8 and all(far(v[dst[[j]]], v[dst[[i]]])[0] >= d[j] for i in kept):
                kept.append(j)
        want += [(s, dst[j], r) for r, j in enumerate(kept, 1)]
    table = pa.table({"src": src, "dst": dst, "distance": d, "vector": pa.array(v[dst].tolist())})
    for size in (7, 300, 9999):
        tracemalloc.start()
        out = list(G._diverse(8, "l2", 1.0, False)(iter(table.to_batches(size))))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [(a, b, c) for x in out for a, b, c in zip(*(x.column(n).to_pylist() for n in ("src", "dst", "rank")), strict=True)] == want
        assert most < 20e6  # all against all: 72 MB


def test_quality_by_label_makes_no_pair_a_row(spark):
    from lumenspar.operators import accounting as A

    p = X.points(spark, SF)
    q = p.where("id % 5 = 0").select(F.col("id").alias("query_id"), "label")
    ranked = S.batch_search(p, p.where("id % 5 = 0"), 10, exclude_self=True)
    pairs = q.join(p.select("id", "label"), "label").where("id <> query_id").select("query_id", "id")
    quality = A.label_quality(ranked, q, p.select("id", "label"), 10)
    assert quality.first() == A.retrieval_quality(ranked, pairs, 10).first()
    assert A.label_quality(ranked, q, p.select("id", F.col("id").alias("label")), 10).first().queries == 0
