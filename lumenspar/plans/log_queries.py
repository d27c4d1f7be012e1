"""Queries of graphs, logs, streams, tenancy and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspar import streaming as Z
from lumenspar.functions.quantize import bytes_per_vector
from lumenspar.functions.vectors import norm, norm_sq, scale
from lumenspar.operators import accounting as A
from lumenspar.operators import graph as G
from lumenspar.operators import search as S
from lumenspar.plans import fixtures as X
from lumenspar.plans import lexical_queries as LX
from lumenspar.plans.registry import query
from lumenspar.sources import collections as C
from lumenspar.sources import wal
from lumenspar.spec import CollectionSpec, Component
from lumenspar.work import work_path

# --- graph: the ten nearest neighbours of every point -----------------------------------

_EDGES = f"""{X.pts()}, dd AS (SELECT a.id AS src, b.id AS dst, {X.l2("a.v", "b.v")} AS distance FROM pts a JOIN pts b ON a.id <> b.id),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 9), dst) AS rank FROM dd) WHERE rank <= 10)"""


def _edges(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    from lumenspar.work import materialize

    return materialize(G.knn_graph(X.points(spark, d), k), "graph")


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query("g01_knn_graph", f"WITH {_EDGES} SELECT src, dst, round(distance, 6) AS distance, rank FROM e")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return _long(_edges(spark, d), "rank").select("src", "dst", F.round("distance", 6).alias("distance"), "rank")


_H = "('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT"
_LAYERED = f"""{X.pts()}, lv AS (SELECT *, CASE WHEN {_H} = 0 THEN 15 ELSE least(15, bit_count(({_H} & -{_H}) - 1)) END AS level FROM pts),
ld AS (SELECT layer, a.id AS src, b.id AS dst, {X.l2("a.v", "b.v")} AS distance FROM unnest(range(0, 3)) AS u(layer), lv a, lv b WHERE a.id <> b.id AND a.level >= layer AND b.level >= layer),
le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer, src ORDER BY round(distance, 9), dst) AS rank FROM ld) WHERE rank <= CASE WHEN layer = 0 THEN 8 ELSE 4 END)"""


def _layered(spark: SparkSession, d: str) -> DataFrame:
    from lumenspar.work import materialize

    return materialize(G.layered_graph(X.points(spark, d), 4), "layers")


@query("g01_layers", f"WITH {_LAYERED} SELECT layer, src, dst, round(distance, 6) AS distance, rank FROM le")
def g01_layers(spark: SparkSession, d: str) -> DataFrame:
    return _long(_layered(spark, d), "layer", "rank").withColumn("distance", F.round("distance", 6))


@query("g02_g03_build")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return G.build(X.points(spark, d), m=8, ef=24)


@query("g04_robust_prune")
def g04(spark: SparkSession, d: str) -> DataFrame:
    return G.prune(_edges(spark, d, 24), X.points(spark, d), 8, alpha=1.2, density=True)


@query("g05_node", f"WITH {_EDGES} SELECT src AS id, string_agg(dst, ',' ORDER BY rank) AS neighbours, 'SIMILARITY' AS edge_type FROM e GROUP BY src")
def g05(spark: SparkSession, d: str) -> DataFrame:
    return G.node(_edges(spark, d), X.points(spark, d), "l2").select("id", F.array_join("neighbours", ",").alias("neighbours"), "edge_type")


@query("g06_neighbors", f"WITH {_EDGES} SELECT dst, round(distance, 6) AS distance, rank FROM e WHERE src = 7 ORDER BY rank LIMIT 5 OFFSET 2")
def g06(spark: SparkSession, d: str) -> DataFrame:
    return _long(G.neighbors(_edges(spark, d), 7, 5, 2), "rank").withColumn("distance", F.round("distance", 6))


@query("g07_concept_parents", f"""WITH {_LAYERED}, up AS (SELECT DISTINCT src FROM le WHERE layer = 1)
SELECT src, layer, dst, round(distance, 6) AS distance FROM le WHERE rank <= 3 AND ((layer = 1) OR (layer = 0 AND src NOT IN (SELECT src FROM up)))""")
def g07(spark: SparkSession, d: str) -> DataFrame:
    """Parents of all points: one layer up, or on their own layer for those that end there."""
    return _long(G.all_concept_parents(_layered(spark, d), 0, 3), "layer").withColumn("distance", F.round("distance", 6))


query("g07_concept_parents_of", f"WITH {_LAYERED}, top_ AS (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS l FROM le WHERE layer = 1 AND src = 3) SELECT layer, dst, round(distance, 6) AS distance FROM le, top_ WHERE src = 3 AND layer = l")(
    lambda spark, d: _long(G.concept_parents(_layered(spark, d), 3), "layer").withColumn("distance", F.round("distance", 6))
)


_REACH = "WITH RECURSIVE {e}, r AS (SELECT {start}::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < {depth}) SELECT id, min(depth) AS depth FROM r GROUP BY id"


@query("g08_traverse", _REACH.format(e=_EDGES, start=5, depth=2))
def g08(spark: SparkSession, d: str) -> DataFrame:
    return G.traverse(_edges(spark, d), 5, 2, 100_000)


query("g11_subsumption_tree", _REACH.format(e=_EDGES, start=11, depth=3))(lambda spark, d: G.traverse(_edges(spark, d), 11, 3, 100_000))
query("g12_explore_graph", _REACH.format(e=_EDGES + ", b AS (SELECT * FROM e WHERE rank <= 4)", start=2, depth=2).replace("JOIN e ON", "JOIN b ON"))(
    lambda spark, d: G.traverse(_edges(spark, d), 2, 2, 100_000, breadth=4)
)


@query("g10_clusters", f"""WITH RECURSIVE {_EDGES}, near AS (SELECT src, dst FROM e WHERE rank <= 1), u AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near),
r AS (SELECT src AS a, src AS b FROM u UNION SELECT r.a, u.dst FROM r JOIN u ON r.b = u.src), c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a),
s AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster HAVING count(*) >= 3 ORDER BY n DESC, cluster LIMIT 32) SELECT cluster, id FROM c WHERE cluster IN (SELECT cluster FROM s)""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return G.clusters(_edges(spark, d, 1))


@query("g11_light_cone_tree", f"""WITH {X.pts("lorentz")}, p AS (SELECT a.id, b.id AS parent, {X.lorentz("a.v", "b.v")} AS distance FROM pts a JOIN pts b ON b.v[1] < a.v[1])
SELECT id, parent, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), parent) AS r FROM p) WHERE r = 1""")
def g11_cone(spark: SparkSession, d: str) -> DataFrame:
    return G.light_cone_tree(X.points(spark, d, "lorentz")).withColumn("distance", F.round("distance", 6))


@query("g13_evaluate_claim", f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN u ON src = id WHERE depth < 6)
SELECT b AS id, round(coalesce((SELECT exp(-0.4 * min(depth)) FROM r WHERE r.id = b), 0), 6) AS score FROM (VALUES (1::BIGINT), (40), (77)) AS t(b)""")
def g13(spark: SparkSession, d: str) -> DataFrame:
    claims = G.evaluate_claims(_edges(spark, d), 1, (1, 40, 77))
    return spark.createDataFrame([(b, round(score, 6)) for b, score in claims.items()], "id long, score double")


_TRAJ = f"{X.pts()}, tr AS (SELECT id % 40 AS trajectory, id AS seq, v FROM pts)"


@query("g14_trust_score", f"""WITH {_TRAJ}, l AS (SELECT *, last_value(v) OVER (PARTITION BY trajectory ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM tr),
m AS (SELECT trajectory, seq, {X.l2("v", "w")} AS d FROM l), c AS (SELECT trajectory, d - lag(d) OVER (PARTITION BY trajectory ORDER BY seq) AS x FROM m)
SELECT trajectory, round(1 / (1 + exp(greatest(avg(x), 0))), 6) AS score FROM c GROUP BY trajectory HAVING count(*) >= 3""")
def g14(spark: SparkSession, d: str) -> DataFrame:
    steps = X.points(spark, d).select((F.col("id") % 40).alias("trajectory"), F.col("id").alias("seq"), "vector")
    return G.trust_scores(steps).withColumn("score", F.round("score", 6))


@query("g15_digest")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return G.digest(X.points(spark, d))


@query("g16_handshake", "SELECT DISTINCT vec_id % 256 AS bucket FROM embeddings WHERE label = 4")
def g16(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    return G.handshake(G.digest(p), G.digest(p.where("label <> 4")))


@query("g17_sync", "SELECT 'accepted' AS what, count(*) FILTER (vec_id % 3 = 0) AS n FROM embeddings WHERE vec_id % 256 IN (1, 2, 3, 4) UNION ALL SELECT 'duplicate', count(*) FILTER (vec_id % 3 <> 0) FROM embeddings WHERE vec_id % 256 IN (1, 2, 3, 4)")
def g17(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    return G.sync_push(p.where("id % 3 <> 0"), G.sync_pull(p, [1, 2, 3, 4]))[1]


@query("g18_merkle_root")
def g18(spark: SparkSession, d: str) -> DataFrame:
    hits = S.search(X.points(spark, d), X.vector(spark, d), 10)
    leaves = hits.select("id", F.sha2(F.concat_ws("|", "id", F.round("distance", 6).cast("string")), 256).alias("h"))
    return spark.createDataFrame([(G.merkle_root(leaves),)], "root string")


@query("g18_inclusion_proofs", X.top("l2", 11).replace("SELECT id, round(distance, 6) AS distance FROM d", "SELECT id, true AS proven, false AS forged, 4::BIGINT AS steps FROM d"))
def g18_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Each hit's proof leads to the root; with another hit's leaf it does not."""
    hits = S.search(X.points(spark, d), X.vector(spark, d), 11)
    leaves = hits.select("id", F.sha2(F.concat_ws("|", "id", F.round("distance", 6).cast("string")), 256).alias("h"))
    root, proofs = G.merkle_root(leaves), G.inclusion_proofs(leaves)
    of = {r.id: r.h for r in leaves.collect()}
    other = dict(zip(of, [*list(of)[1:], next(iter(of))], strict=True))
    rows = [(i, G.proven(of[i], p, root), G.proven(of[other[i]], p, root), len(p)) for i, p in proofs.items()]
    return spark.createDataFrame(rows, "id long, proven boolean, forged boolean, steps long")


_WSTEP = """k{n} AS (SELECT dst AS id, sum(e * w) AS e FROM ke JOIN w{p} ON src = w{p}.id GROUP BY dst), a{n} AS (SELECT id, sum(e) AS e FROM (SELECT * FROM k{n} UNION ALL SELECT id, e * 0.95 FROM w{p}) GROUP BY id),
b{n} AS (SELECT coalesce(a{n}.id, sd.id) AS id, coalesce(e, 0) * (1 + 0.3 * coalesce(s, 0)) * (1 - {f}) + {f} * coalesce(s, 0) * coalesce(s, 0) AS e FROM a{n} FULL JOIN sd ON a{n}.id = sd.id),
t{n} AS (SELECT * FROM b{n} ORDER BY e DESC, id LIMIT 256), w{n} AS (SELECT id, e / (SELECT max(e) FROM t{n}) AS e FROM t{n})"""


@query("s17_wave_search", f"""WITH {_EDGES}, q AS (SELECT v AS q FROM pts WHERE id = 0), sd AS (SELECT id, 1 / (1 + {X.l2("v", "q")}) AS s FROM pts, q ORDER BY s DESC, id LIMIT 64),
ke AS (SELECT src, dst, exp(-distance * distance / 0.25::DOUBLE) * 0.9::DOUBLE AS w FROM e), w0 AS (SELECT id, s AS e FROM sd),
{", ".join(_WSTEP.format(n=i + 1, p=i, f=f"({0.15 * (1 - i / 3 * 0.3)!r}::DOUBLE)") for i in range(3))} SELECT id, round(e, 6) AS energy FROM w3 ORDER BY round(e, 12) DESC, id LIMIT 10""")
def s17(spark: SparkSession, d: str) -> DataFrame:
    return G.wave_from(X.points(spark, d), _edges(spark, d), X.vector(spark, d), 10).withColumn("energy", F.round("energy", 6))


query("g09_diffusive_traverse")(lambda spark, d: G.wave_from(X.points(spark, d), _edges(spark, d), X.vector(spark, d, of=9), 20))


@query("m07_frechet_mean")
def m07(spark: SparkSession, d: str) -> DataFrame:
    return G.frechet_means(X.points(spark, d, "poincare"), "label")


query("x02_consolidate")(lambda spark, d: G.frechet_means(S.search(X.points(spark, d, "poincare"), X.vector(spark, d, "poincare"), 10, "poincare").withColumn("g", F.lit(1)), "g"))


@query("m13_lyapunov")
def m13(spark: SparkSession, d: str) -> DataFrame:
    steps = X.points(spark, d, "poincare").select((F.col("id") % 40).alias("trajectory"), F.col("id").alias("seq"), "vector")
    return G.lyapunov(steps)


@query("m16_hyperbolicity")
def m16(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([G.hyperbolicity(X.points(spark, d))], "delta double, metric string")


@query("m18_s22_secure_search", X.top("l2", 10))
def s22(spark: SparkSession, d: str) -> DataFrame:
    """A keyed rotation keeps distances, so the search over rotated points finds the same ones."""
    from lumenspar.operators.secure import orthogonal, rotate

    m = orthogonal(b"key", 64)
    q = (m @ X.vector(spark, d)).tolist()
    return S.search(rotate(X.points(spark, d), m), q, 10).select("id", F.round("distance", 6).alias("distance"))


# --- the log: events, keyed by user, with errors as deletes ------------------------------

_LOG = "lg AS (SELECT event_id AS clock, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op, user_id AS id, value, ts, event_type FROM events), lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY clock DESC) AS r FROM lg) WHERE r = 1 AND op = 'insert')"


def _log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("insert")
    return X.table(spark, d, "events").select(F.col("event_id").alias("clock"), op.alias("op"), F.col("user_id").alias("id"), "value", "ts", "event_type")


def _live(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(_log(spark, d)).where("op = 'insert'")


query("io04_io06_upsert_latest", f"WITH {_LOG} SELECT id, clock, value FROM lv")(lambda spark, d: _live(spark, d).select("id", "clock", "value"))
query("io05_batch_insert", f"WITH {_LOG} SELECT count(*) AS n, count(DISTINCT id) AS ids FROM lg WHERE op = 'insert'")(
    lambda spark, d: _log(spark, d).where("op = 'insert'").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))
)
query("io08_delete", f"WITH {_LOG} SELECT DISTINCT id FROM lg WHERE id NOT IN (SELECT id FROM lv)")(
    lambda spark, d: _log(spark, d).select("id").distinct().join(_live(spark, d), "id", "left_anti")
)


def _collection(spark: SparkSession, d: str) -> C.Collection:
    catalog = C.Catalog(spark, work_path(spark, "catalog"))
    made = catalog.create(CollectionSpec("vectors", (Component("all", "l2", 64),)))
    made.insert(X.metadata_points(spark, d).select("id", "vector", "metadata"))
    return made


@query("io01_io02_collection", "SELECT count(*) AS points, count(*) + count(*) FILTER (vec_id % 7 = 0) AS log_rows, 2::BIGINT AS clock, 68 AS vector_bytes FROM embeddings WHERE true HAVING count(*) > 0".replace("count(*) AS points", "count(*) FILTER (vec_id % 7 <> 0) AS points"))
def io01(spark: SparkSession, d: str) -> DataFrame:
    made = _collection(spark, d)
    made.delete(X.points(spark, d).where("id % 7 = 0"))
    return made.stats().select("points", "log_rows", "clock", "vector_bytes")


@query("io03_freeze", "SELECT count(*) AS n FROM embeddings")
def io03(spark: SparkSession, d: str) -> DataFrame:
    made = _collection(spark, d)
    made.freeze()
    n = made.live().count()
    made.unfreeze()
    return spark.createDataFrame([(n,)], "n long")


@query("io07_fast_upsert", f"""WITH {X.pts()} SELECT a.id, {X.l2("a.v", "b.v")} > 1.0 OR a.label <> b.label AS reindex FROM pts a JOIN pts b ON b.id = a.id + 1""")
def io07(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d).select("id", "vector", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    return C.changed(p, p.withColumn("id", F.col("id") - 1), 1.0)


@query("io10_update_payload", "SELECT vec_id AS id, label::VARCHAR AS label, CASE WHEN vec_id % 2 = 0 THEN 'new' WHEN vec_id % 5 <> 0 THEN (vec_id % 4)::VARCHAR END AS bucket FROM embeddings")
def io10(spark: SparkSession, d: str) -> DataFrame:
    made = _collection(spark, d)
    made.update_payload(X.points(spark, d).where("id % 2 = 0").select("id", F.create_map(F.lit("bucket"), F.lit("new")).alias("metadata")))
    return made.live().select("id", F.element_at("metadata", "label").alias("label"), F.element_at("metadata", "bucket").alias("bucket"))


@query("io11_wal", f"WITH {X.pts()} SELECT id, id + 1 AS clock, 'insert' AS op, label::VARCHAR AS label, round({X.n2('v')}, 6) AS length_sq FROM pts")
def io11(spark: SparkSession, d: str) -> DataFrame:
    """All points written as log segments by the tasks that hold them, and replayed from there."""
    meta = F.create_map(F.lit("label"), F.col("label").cast("string"))
    rows = X.points(spark, d).select((F.col("id") + 1).alias("clock"), F.lit("insert").alias("op"), "id", "vector", meta.alias("metadata"))
    back = wal.read(spark, wal.write_segments(rows, work_path(spark, "wal")))
    return back.select("id", "clock", "op", F.element_at("metadata", "label").alias("label"), F.round(norm_sq(F.col("vector")), 6).alias("length_sq"))


query("io06_upsert_in_a_batch", "SELECT user_id AS id, max(event_id) AS last FROM events GROUP BY user_id")(lambda spark, d: _batch_upserts(spark, d))


def _batch_upserts(spark: SparkSession, d: str) -> DataFrame:
    """One insert with many rows an id, in order of events: the last row of each id stands."""
    made = C.Catalog(spark, work_path(spark, "catalog")).create(CollectionSpec("events", (Component("all", "l2", 1),)))
    rows = X.table(spark, d, "events").orderBy("event_id")
    made.insert(rows.select(F.col("user_id").alias("id"), F.array(F.lit(0.0)).alias("vector"), F.create_map(F.lit("event"), F.col("event_id").cast("string")).alias("metadata")))
    return made.live().select("id", F.element_at("metadata", "event").cast("long").alias("last"))


@query("io12_durability", """WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT s AS step, CASE s WHEN 0 THEN 0 WHEN 1 THEN n ELSE n END AS through_handle, CASE s WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE n END AS written
FROM n, unnest(range(0, 4)) AS u(s)""")
def io12(spark: SparkSession, d: str) -> DataFrame:
    """What a handle and what a fresh reader see: before, while a batch is held, after the commit, after an asynchronous write."""
    catalog = C.Catalog(spark, work_path(spark, "catalog"))
    made = catalog.create(CollectionSpec("vectors", (Component("all", "l2", 64),)))
    rows = X.metadata_points(spark, d).select("id", "vector", "metadata")
    seen = []

    def look() -> None:
        seen.append((len(seen), made.live().count(), catalog.get("vectors").live().count()))

    look()
    made.insert(rows.where("id % 2 = 0"), durability="batch")
    made.insert(rows.where("id % 2 = 1"), durability="batch")
    look()
    made.commit()
    look()
    made.insert(rows, durability="async")
    made.commit()
    look()
    return spark.createDataFrame(seen, "step long, through_handle long, written long")


@query("io16_chunk_store", f"WITH {X.pts()} SELECT count(*) AS points, 8::BIGINT AS chunks, true AS pruned FROM pts")
def io16(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written to a store of their own and read back one by one, each alone."""
    store = work_path(spark, "store")
    routes = _collection(spark, d).flush(8, store).collect()
    one = [C.read_chunks(spark, store, [r.chunk]) for r in routes]
    pruned = all("PartitionFilters: [isnotnull(chunk" in x._jdf.queryExecution().toString() for x in one)
    return spark.createDataFrame([(sum(x.count() for x in one), len(one), pruned)], "points long, chunks long, pruned boolean")


@query("io13_snapshot", "SELECT vec_id AS id FROM embeddings")
def io13(spark: SparkSession, d: str) -> DataFrame:
    made, path = _collection(spark, d), work_path(spark, "snapshot")
    made.snapshot(path)
    made.restore(path)
    return made.live().select("id")


@query("io14_flush", "SELECT count(*) AS points FROM embeddings")
def io14(spark: SparkSession, d: str) -> DataFrame:
    return _collection(spark, d).flush(8).agg(F.sum("n").alias("points"))


@query("io15_payloads", "SELECT page_id AS id, octet_length(encode(html))::BIGINT AS bytes FROM pages WHERE page_id % 3 <> 0")
def io15(spark: SparkSession, d: str) -> DataFrame:
    catalog = C.Catalog(spark, work_path(spark, "catalog"))
    made = catalog.create(CollectionSpec("pages", (Component("all", "l2", 2),)))
    pages = X.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"), F.encode("html", "utf-8").alias("payload"))
    made.insert(pages)
    made.delete(pages.where("id % 3 = 0"))
    return made.payloads().select("id", F.octet_length("payload").cast("long").alias("bytes"))


query("io17_get_points", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (1, 5, 9)")(lambda spark, d: C.get_points(X.points(spark, d), [1, 5, 9]).select("id", "label"))
query("io18_peek", "SELECT o_orderkey AS id, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 5")(
    lambda spark, d: C.peek(X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), 20, 5)
)
_ORD = "SELECT o_orderkey AS id, o_orderstatus FROM orders"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")


query("io19_scroll", f"{_ORD} WHERE o_orderstatus = 'F' ORDER BY id LIMIT 30 OFFSET 10")(lambda spark, d: C.scroll(_orders(spark, d), F.col("o_orderstatus") == "F", 30, 10))
query("io19_scroll_compat", f"SELECT * FROM ({_ORD} ORDER BY id OFFSET 10) WHERE o_orderstatus = 'F' ORDER BY id LIMIT 30")(
    lambda spark, d: C.scroll_unfiltered_offset(_orders(spark, d), F.col("o_orderstatus") == "F", 30, 10)
)
query("io20_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")(lambda spark, d: C.count(_orders(spark, d), F.col("o_orderstatus") == "O"))

# --- streams and clocks --------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events as a stream of files and as a table."""
    events = X.table(spark, d, "events")
    path = work_path(spark, "stream")
    events.repartition(4, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path), events


def _ran(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    return Z.run_available(stream, work_path(spark, "out"), work_path(spark, "progress"), mode)


@query("t01_replicate", "SELECT event_id AS clock, user_id AS id FROM events WHERE event_id > 500")
def t01(spark: SparkSession, d: str) -> DataFrame:
    stream, _ = _event_stream(spark, d)
    return _ran(spark, Z.replicate(stream.select(F.col("event_id").alias("clock"), F.col("user_id").alias("id")), 500))


@query("t02_subscribe", "SELECT event_id, event_type AS type FROM events WHERE event_type IN ('view', 'click')")
def t02(spark: SparkSession, d: str) -> DataFrame:
    stream, _ = _event_stream(spark, d)
    return _ran(spark, Z.subscribe(stream.select("event_id", F.col("event_type").alias("type"), F.lit("c").alias("collection")), ["view", "click"], "c")).drop("collection")


@query("t03_trajectory_event", f"""WITH {X.pts()}, q AS (SELECT id AS query_id, {X.times("v", "0.5")} AS q FROM pts WHERE id % 20 = 0),
r AS (SELECT query_id, id, v, row_number() OVER (PARTITION BY query_id ORDER BY round({X.l2("v", "q")}, 9), id) AS r FROM pts, q)
SELECT 'trajectory' AS type, query_id, id, round(v[1], 6) + 0.0 AS x, round(v[2], 6) + 0.0 AS y FROM r WHERE r = 1""")
def t03(spark: SparkSession, d: str) -> DataFrame:
    """A stream of searches; each emits an event with its top hit and where that lies."""
    points = X.points(spark, d)
    asked, out = work_path(spark, "asked"), work_path(spark, "events")
    points.where("id % 20 = 0").select("id", scale(F.col("vector"), 0.5).alias("vector")).repartition(3, "id").write.parquet(asked)
    stream = spark.readStream.schema("id long, vector array<double>").option("maxFilesPerTrigger", 1).parquet(asked)
    Z.run_batches(stream, Z.emit_trajectory(points, out), work_path(spark, "progress"))
    events = spark.read.parquet(f"{out}/*")
    return events.select("type", "query_id", "id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


query("t04_clock", f"WITH {_LOG} SELECT max(clock) + 1 AS clock, greatest(max(clock), 12345) + 1 AS merged FROM lg")(
    lambda spark, d: Z.tick(_log(spark, d)).select("clock", Z.merge_clocks(F.col("clock") - 1, F.lit(12345)).alias("merged"))
)
@query("t05_monitor", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last FROM events GROUP BY event_type")
def t05(spark: SparkSession, d: str) -> DataFrame:
    """Running totals by type, kept up batch by batch over a stream of files."""
    events, path = X.table(spark, d, "events"), work_path(spark, "stream")
    events.repartition(4, "event_id").write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = work_path(spark, "totals")
    Z.run_batches(Z.monitor(stream), Z.replace_at(out), work_path(spark, "progress"), "complete")
    return Z.last_version(spark, out).select("event_type", "n", F.round("total", 4).alias("total"), "last")


query("t06_expiry", "SELECT event_id FROM events WHERE ts + to_seconds(event_id % 1000 * 60) > (SELECT max(ts) FROM events)")(
    lambda spark, d: Z.alive(X.table(spark, d, "events").withColumn("ttl", (F.col("event_id") % 1000 * 60).cast("decimal(18,6)")), F.lit(X.table(spark, d, "events").agg(F.max("ts")).first()[0])).select("event_id")
)
query("t07_eviction", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate, o_orderkey LIMIT (SELECT count(*) - 1000 FROM orders)")(
    lambda spark, d: A.eviction(X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_access")), 1000)
)
query("t08_stale_peers", "SELECT user_id AS peer, max(ts) AS last_seen, (SELECT max(ts) FROM events) - max(ts) > INTERVAL 30 SECOND AS stale FROM events GROUP BY user_id")(
    lambda spark, d: A.stale_peers(X.table(spark, d, "events").select(F.col("user_id").alias("peer"), "ts"), F.lit(X.table(spark, d, "events").agg(F.max("ts")).first()[0]))
)


@query("t09_micro_batch_merge", f"WITH {_LOG}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY clock DESC) AS r FROM lg) WHERE r = 1) SELECT id, clock FROM l")
def t09(spark: SparkSession, d: str) -> DataFrame:
    path, out = work_path(spark, "stream"), work_path(spark, "merged")
    _log(spark, d).select("clock", "id").repartition(3, "clock").write.parquet(path)
    stream = spark.readStream.schema("clock long, id long").option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.writeStream.foreachBatch(Z.merge_into(out)).option("checkpointLocation", work_path(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return Z.merged(spark, out, "clock long, id long").select("id", "clock")


@query("t10_vacuum", "SELECT vec_id AS id FROM embeddings WHERE label <> 3")
def t10(spark: SparkSession, d: str) -> DataFrame:
    from lumenspar.filters import vacuum_predicate

    made = _collection(spark, d)
    made.vacuum(vacuum_predicate("label", "eq", 3))
    return made.live().select("id")


@query("t11_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t11(spark: SparkSession, d: str) -> DataFrame:
    return Z.windowed_counts(X.table(spark, d, "events")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("t11_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k""")
def t11_sessions(spark: SparkSession, d: str) -> DataFrame:
    return Z.sessions(X.table(spark, d, "events")).select("user_id", F.col("w.start").alias("start"), "n")


# --- tenancy and accounting -----------------------------------------------------------------


def _owned(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "customer").select(
        F.concat(F.lit("t"), F.col("c_nationkey")).alias("tenant"), F.col("c_mktsegment").alias("collection"), (F.col("c_custkey") % 1000).alias("bytes")
    )


query("a01_tenant_collections", "SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_nationkey = 3")(
    lambda spark, d: A.collections_of(_owned(spark, d).select(A.tenant_collection(F.col("tenant"), F.col("collection")).alias("collection")), "t3")
)
query("a02_usage_report", "SELECT 't' || c_nationkey AS tenant, count(DISTINCT c_mktsegment) AS collections, count(*) AS points, sum(c_custkey % 1000)::BIGINT AS bytes FROM customer GROUP BY 1")(
    lambda spark, d: A.usage_report(_owned(spark, d))
)
query("a03_metering", """WITH e AS (SELECT user_id AS tenant, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'storage' ELSE 'other' END AS kind, event_id * 1000 AS bytes FROM events),
s AS (SELECT tenant, sum((kind = 'insert')::INT)::BIGINT AS inserts, sum((kind = 'search')::INT)::BIGINT AS searches, sum(CASE WHEN kind = 'storage' THEN 1000000.0::DOUBLE * bytes * 3600 / (1073741824.0 * 2592000.0) ELSE 0 END) AS rent FROM e GROUP BY tenant)
SELECT tenant, inserts, searches, round(rent, 6) AS rent, round(inserts + searches * 10 + rent, 6) AS cost FROM s WHERE inserts > 0 OR searches > 0 OR rent > 0""")(
    lambda spark, d: A.metering(
        X.table(spark, d, "events").select(
            F.col("user_id").alias("tenant"), F.create_map(*[F.lit(x) for x in ("signup", "insert", "view", "search", "purchase", "storage", "click", "other", "error", "other")])[F.col("event_type")].alias("kind"),
            (F.col("event_id") * 1000).alias("bytes"), F.lit(3600).alias("seconds"),
        )
    ).withColumns({"rent": F.round("rent", 6), "cost": F.round("cost", 6)})
)
query("a04_throttle", "SELECT c_custkey AS tenant, CASE WHEN c_acctbal <= 0 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 20 + 7)::INT) END AS deadline, c_acctbal <= 0 AND TIMESTAMP '2024-01-15' > TIMESTAMP '2024-01-01' + to_days((c_custkey % 20 + 7)::INT) AS throttled FROM customer")(
    lambda spark, d: A.throttle(
        X.table(spark, d, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_acctbal").alias("balance"), (F.expr("timestamp'2024-01-01'") + F.make_dt_interval((F.col("c_custkey") % 20).cast("int"))).alias("exhausted_at")),
        F.expr("timestamp'2024-01-15'"),
    )
)
query("a05_eco", """WITH c AS (SELECT label, count(*) AS n, 64 * (1 + label % 3) AS dim FROM embeddings GROUP BY label), b AS (SELECT label, n * dim * 4 AS baseline, n * (dim + 4) AS actual FROM c), s AS (SELECT *, greatest(baseline - actual, 0) AS saved FROM b)
SELECT label, baseline::BIGINT AS baseline, actual::BIGINT AS actual, CASE WHEN saved / baseline > 0.75 THEN 'platinum' WHEN saved / baseline > 0.5 THEN 'gold' WHEN saved / baseline > 0.3 THEN 'silver' WHEN saved / baseline > 0.1 THEN 'bronze' ELSE 'none' END AS tier, round(saved / 1073741824.0 * 3 * 1e6, 4) AS wh_e6 FROM s""")(
    lambda spark, d: A.eco(
        X.table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("full_dim", (64 * (1 + F.col("label") % 3)).cast("long")), F.col("full_dim") + (bytes_per_vector("scalar", 0))
    ).select("label", "baseline", "actual", "tier", F.round(F.col("wh") * 1e6, 4).alias("wh_e6"))
)
query("a06_esg_report", "SELECT count(*) AS records, round(sum(value), 4) AS wh, round(sum(value * 0.4), 4) AS co2_kg, arg_max(event_id, ts) AS ratio FROM events WHERE epoch(ts)::BIGINT >= (SELECT max(epoch(ts)::BIGINT) FROM events) - 2592000")(
    lambda spark, d: A.esg_report(
        X.table(spark, d, "events").select(F.unix_timestamp("ts").alias("ts"), F.col("value").alias("wh"), (F.col("value") * 0.4).alias("co2_kg"), F.col("event_id").alias("ratio")),
        X.table(spark, d, "events").agg(F.unix_timestamp(F.max("ts"))).first()[0], "30d",
    ).select("records", F.round("wh", 4).alias("wh"), F.round("co2_kg", 4).alias("co2_kg"), "ratio")
)


@query("m19_retrieval_quality", f"""WITH {X.pts()}, q AS (SELECT id AS query_id, v AS q, label AS ql FROM pts WHERE id % 20 = 0), dd AS (SELECT query_id, id, ql = label AS rel, {X.l2("v", "q")} AS x FROM pts, q WHERE id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9), id) AS rank FROM dd), w AS (SELECT query_id, count(*) FILTER (rel) AS n, count(*) FILTER (rel AND rank <= 10) AS f, min(rank) FILTER (rel AND rank <= 10) AS first,
coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 10), 0) AS dcg FROM r GROUP BY query_id)
SELECT round(avg(f / n), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1)))), 6) AS ndcg, count(*) AS queries FROM w""")
def m19(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    q = p.where("id % 20 = 0")
    ranked = S.batch_search(p, q, 10, exclude_self=True)
    return A.label_quality(ranked, q.select(F.col("id").alias("query_id"), "label"), p.select("id", "label"), 10).select(*[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "queries")


@query("s21_cognitive_rerank")
def s21(spark: SparkSession, d: str) -> DataFrame:
    """Likeness weighed down by how far a hit lies from the other hits."""
    from lumenspar.functions.geometry import local_entropy
    hits = S.search(X.points(spark, d), X.vector(spark, d), 20, "cosine").select("id", "distance", scale(F.col("vector"), 0.95).alias("p"))
    others = F.collect_list("p").over(Window.partitionBy())
    score = (1 - F.col("distance") / 2) * (1 - 0.25 * local_entropy(F.col("p"), others))
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id")


@query("s18_client_wave")
def s18(spark: SparkSession, d: str) -> DataFrame:
    """Five seeds, a diffusive traverse from each, its ranks weighed by the seed and added up."""
    return G.consensus_wave(X.points(spark, d), _edges(spark, d), X.vector(spark, d), 10)


query("x00_norms", f"WITH {X.pts()} SELECT id, round(sqrt({X.n2('v')}), 6) AS length FROM pts")(lambda spark, d: X.points(spark, d).select("id", F.round(norm(F.col("vector")), 6).alias("length")))


# --- the rest of the surface -----------------------------------------------------------------


@query("io09_insert_text", "SELECT count(*) AS n FROM benchmark")
def io09(spark: SparkSession, d: str) -> DataFrame:
    """Texts embedded and inserted as points with their text as metadata."""
    from lumenspar.sources.text import hash_embedder

    made = C.Catalog(spark, work_path(spark, "catalog")).create(CollectionSpec("texts", (Component("all", "cosine", 64),)))
    texts = X.table(spark, d, "benchmark").where("text is not null")
    made.insert(texts.select(F.col("item_id").alias("id"), hash_embedder(64)(F.col("text")).alias("vector"), F.create_map(F.lit("text"), F.col("text")).alias("metadata")))
    return C.count(made.live())


@query("m18_lorentz_transform", X.top("lorentz", 10))
def m18_lorentz(spark: SparkSession, d: str) -> DataFrame:
    """A keyed rotation and boost keeps geodesic distances."""
    from lumenspar.operators.secure import lorentz_transform, rotate

    m = lorentz_transform(b"key", 65)
    q = (m @ X.vector(spark, d, "lorentz")).tolist()
    return S.search(rotate(X.points(spark, d, "lorentz"), m), q, 10, "lorentz").select("id", F.round("distance", 6).alias("distance"))


@query("s22_hidden_metadata", "SELECT vec_id AS id, sha256('k' || sha256('k' || label::VARCHAR)) AS label FROM embeddings WHERE label = 3")
def s22_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Equality search over keyed hashes of a metadata value."""
    from lumenspar.operators.secure import hide

    rows = X.points(spark, d).select("id", hide(F.col("label").cast("string"), "k").alias("label"))
    return rows.where(F.col("label") == hide(F.lit("3"), "k"))


@query("s22_sealed_payload", "SELECT page_id, md5(html) AS digest FROM pages")
def s22_sealed(spark: SparkSession, d: str) -> DataFrame:
    """Payloads encrypted and decrypted again."""
    from lumenspar.operators.secure import seal, unseal

    key = b"0123456789abcdef"
    sealed = X.table(spark, d, "pages").select("page_id", seal(F.encode("html", "utf-8"), key).alias("b"))
    return sealed.select("page_id", F.md5(unseal(F.col("b"), key)).alias("digest"))


query("x05_explore_down", _REACH.format(e=_EDGES, start=20, depth=2))(lambda spark, d: G.traverse(_edges(spark, d), 20, 2, 100_000))


@query("x07_fused_retrieval", f"""WITH {X.query_of()}, v AS (SELECT id, row_number() OVER (ORDER BY {X.l2("v", "q")}, id) AS r FROM pts, q QUALIFY r <= 20),
{LX.keyword_sql()}, t AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= 20)
SELECT coalesce(v.id, t.id) AS id, round(coalesce(1 / (0.5::DOUBLE + v.r), 0) + coalesce(1 / (0.5::DOUBLE + t.r), 0), 6) AS score FROM v FULL JOIN t ON v.id = t.id""")
def x07_fused(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks with a small constant, over the nearest points and the best documents by keyword."""
    from lumenspar.operators.lexical import rrf

    near = S.search(X.points(spark, d), X.vector(spark, d), 20).select("id", "distance")
    best = LX.keyword_hits(spark, d).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return rrf(near, best, 0.5).select("id", F.round("score", 6).alias("score"))


@query("a08_configure", "SELECT 5 AS probe_k, 8 AS oversample, 'hybrid' AS metric, 801 AS dimension, 'hybrid801' AS mode")
def a08(spark: SparkSession, d: str) -> DataFrame:
    spec = CollectionSpec("c", (Component("head", "lorentz", 33), Component("tail", "l2", 768))).configured(probe_k=5, oversample=8)
    return spark.createDataFrame([(spec.probe_k, spec.oversample, spec.metric, spec.dimension, spec.mode)], "probe_k int, oversample int, metric string, dimension int, mode string")
