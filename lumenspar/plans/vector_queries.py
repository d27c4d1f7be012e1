"""Queries of distances, geometry, quantization and search."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.functions import distance as D
from lumenspar.functions import fuzzy
from lumenspar.functions import geometry as G
from lumenspar.functions import quantize as Q
from lumenspar.functions.vectors import norm, vec
from lumenspar.operators import cells
from lumenspar.operators import search as S
from lumenspar.plans import fixtures as X
from lumenspar.plans.registry import query

def V() -> Column:
    return F.col("vector")


def _scored(name: str, kind: str, measure, sql: str) -> None:
    """Registers: the distance of every point to point 0."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        q = vec(X.vector(spark, d, kind))
        return X.points(spark, d, kind).select("id", F.round(measure(V(), q), 6).alias("distance"))

    query(name, f"WITH {X.query_of(kind)} SELECT id, round({sql}, 6) AS distance FROM pts, q")(run)


_POS = "list_transform({}, lambda x: greatest(x, 0.0))"
_scored("d01_l2", "l2", D.l2, X.l2("v", "q"))
_scored("d02_cosine", "cosine", D.cosine, X.DISTANCE["cosine"]("v", "q"))
_scored("d03_poincare", "poincare", D.poincare, X.poincare("v", "q"))
_scored("d04_lorentz", "lorentz", D.lorentz, X.lorentz("v", "q"))
_scored("d05_hybrid", "hybrid", D.hybrid, X.hybrid("v", "q"))
_scored("d06_wasserstein", "l2", D.wasserstein,
        "list_sum(list_transform(range(1, 65), lambda i: abs(list_sum(list_transform(v[1:i], lambda x: greatest(x, 0.0))) / list_sum("
        + _POS.format("v") + ") - list_sum(list_transform(q[1:i], lambda x: greatest(x, 0.0))) / list_sum(" + _POS.format("q") + "))))")
_K = lambda a: X.times(a, f"2 / (1 + {X.n2(a)})")
_scored("d07_klein_chord", "poincare", D.klein_chord, X.l2(_K("v"), _K("q")))
_scored("d08_klein_to_lorentz", "poincare", lambda a, b: D.lorentz(D.klein_to_lorentz(a), D.klein_to_lorentz(b)),
        f"acosh(greatest((1 - {X.dot('v', 'q')}) / sqrt(greatest(1 - {X.n2('v')}, 1e-12)) / sqrt(greatest(1 - {X.n2('q')}, 1e-12)), 1 + 1e-12))")
_C = "list_transform({}, lambda x: least(greatest(round(x * 127), -127), 127) / 127.0::DOUBLE)"
_scored("d09_l2_to_codes", "l2", lambda a, b: Q.l2_to_codes(Q.scalar(a), b), X.l2(_C.format("v"), "q"))
_P = _C.format("v")
_scored("d10_poincare_to_codes", "poincare", lambda a, b: Q.poincare_argument_to_codes(Q.scalar(a), b),
        f"1 + 2 * {X.l2(_P, 'q')} / greatest((1 - {X.n2(_P)}) * (1 - {X.n2('q')}), 1e-9)")
_ALPHA = "greatest(list_max(list_transform(v, lambda y: abs(y))), 1e-12)"
_LC = f"list_transform(v, lambda x: least(greatest(round(x / {_ALPHA} * 127), -127), 127) / 127.0::DOUBLE * {_ALPHA})"
_scored("d11_lorentz_to_codes", "lorentz", lambda a, b: Q.lorentz_to_codes(Q.lorentz_scalar(a), b), X.lorentz(_LC, "q"))


@query("d12_hamming", f"""WITH {X.query_of()} SELECT id, list_sum(list_transform(list_zip(v, q), lambda p: ((p[1] > 0) <> (p[2] > 0))::INT))::BIGINT AS distance FROM pts, q""")
def d12_hamming(spark: SparkSession, d: str) -> DataFrame:
    rows = X.points(spark, d)
    q = vec(X.vector(spark, d))
    return rows.select("id", Q.hamming(Q.sign_bits(V()), Q.sign_bits(q)).alias("distance"))


_scored("d13_hybrid_truncated", "hybrid", lambda a, b: D.hybrid_truncated(a, b, 8), X.hybrid("v", "q", 8))
_SIM = f"({X.dot('v', 'q')} / sqrt({X.n2('v')} * {X.n2('q')}))"
_scored("d14_exact_cosine", "cosine", D.cosine_exact, f"least(greatest(1 - {_SIM}, 0), 2)")
_scored("d14_exact_l2", "l2", D.l2_sqrt, f"sqrt({X.l2('v', 'q')})")
_scored("d15_weighted", "hybrid", lambda a, b: D.weighted(a, b, [("lorentz", 33, 0.7), ("l2", 32, 0.3)], {1: 0.5}),
        f"0.7 * {X.lorentz('v[1:33]', 'q[1:33]')} + 0.5 * sqrt({X.l2('v[34:65]', 'q[34:65]')})")
_scored("d16_cache_hybrid", "hybrid", lambda a, b: 0.6 * D.lorentz(F.slice(a, 1, 33), F.slice(b, 1, 33)) + 0.4 * D.l2(F.slice(a, 34, 32), F.slice(b, 34, 32)),
        f"0.6 * {X.lorentz('v[1:33]', 'q[1:33]')} + 0.4 * {X.l2('v[34:65]', 'q[34:65]')}")
_scored("d17_cosine_similarity", "l2", D.cosine_similarity, _SIM)


# --- geometry: x = point in the ball, y = point 0, t = a tenth of the raw vector -------


def _shape(v: Column) -> list[Column]:
    return [F.round(norm(v), 6).alias("length"), (F.round(F.element_at(v, 1), 6) + 0.0).alias("first"), (F.round(F.element_at(v, -1), 6) + 0.0).alias("last")]


_SHAPE = "round(sqrt({n}), 6) AS length, round(o[1], 6) + 0.0 AS first, round(o[-1], 6) + 0.0 AS last".format(n=X.n2("o"))


def _mob(x: str, y: str, c: float = 1.0) -> str:
    xy, x2, y2 = X.dot(x, y), X.n2(x), X.n2(y)
    return f"list_transform(list_zip({x}, {y}), lambda p: (p[1] * (1 + 2 * {c} * {xy} + {c} * {y2}) + p[2] * (1 - {c} * {x2})) / (1 + 2 * {c} * {xy} + {c * c} * {x2} * {y2}))"


def _neg(x: str) -> str:
    return f"list_transform({x}, lambda z: -z)"


class _Chain:
    """CTEs that add one bound column each."""

    def __init__(self):
        self.steps = [f"{X.pts('poincare')}, q AS (SELECT v AS y FROM pts WHERE id = 0), s0 AS (SELECT id, pts.label, v AS x, y, {X.times(X._V, '0.1')} AS t FROM pts, q JOIN embeddings ON true WHERE vec_id = id)"]

    def bind(self, name: str, expr: str) -> _Chain:
        self.steps.append(f"s{len(self.steps)} AS (SELECT *, {expr} AS {name} FROM s{len(self.steps) - 1})")
        return self

    def log(self, out: str, x: str, y: str) -> _Chain:
        self.bind(f"{out}_n", _neg(x)).bind(f"{out}_d", _mob(f"{out}_n", y)).bind(f"{out}_l", f"sqrt({X.n2(f'{out}_d')})")
        factor = f"greatest(1 - {X.n2(x)}, 1e-15) * atanh(least({out}_l, 1 - 1e-15)) / {out}_l"
        return self.bind(out, f"CASE WHEN {out}_l < 1e-15 THEN {X.times(f'{out}_d', '0')} ELSE {X.times(f'{out}_d', factor)} END")

    def exp(self, out: str, x: str, v: str) -> _Chain:
        self.bind(f"{out}_l", f"sqrt({X.n2(v)})")
        self.bind(f"{out}_s", X.times(v, f"CASE WHEN {out}_l < 1e-15 THEN 0 ELSE tanh({out}_l / greatest(1 - {X.n2(x)}, 1e-15)) / {out}_l END"))
        return self.bind(out, f"CASE WHEN {out}_l < 1e-15 THEN {x} ELSE {_mob(x, f'{out}_s')} END")

    def transport(self, out: str, x: str, y: str, v: str) -> _Chain:
        self.bind(f"{out}_a", _neg(x)).bind(f"{out}_b", _mob(y, f"{out}_a")).bind(f"{out}_c", _mob(f"{out}_a", v))
        self.bind(f"{out}_e", _mob(y, f"{out}_c")).bind(f"{out}_f", _neg(f"{out}_b")).bind(f"{out}_g", _mob(f"{out}_f", f"{out}_e"))
        return self.bind(out, X.times(f"{out}_g", f"greatest(1 - {X.n2(y)}, 1e-15) / greatest(1 - {X.n2(x)}, 1e-15)"))

    def sql(self, select: str = _SHAPE) -> str:
        return f"WITH {', '.join(self.steps)} SELECT id, {select} FROM s{len(self.steps) - 1}"


def _shaped(name: str, body, chain: _Chain) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        y = vec(X.vector(spark, d, "poincare"))
        t = F.transform("raw", lambda x: x * 0.1)
        rows = X.points(spark, d, "poincare").join(X.points(spark, d).select("id", F.col("vector").alias("raw")), "id")
        return rows.select("id", body(V(), y, t).alias("o")).select("id", *_shape(F.col("o")))

    query(name, chain.sql())(run)


_shaped("m01_project_to_ball", lambda x, y, t: G.project_to_ball(F.transform(x, lambda a: a * 2)), _Chain().bind("b", X.times("x", "2")).bind(
    "o", f"CASE WHEN sqrt({X.n2('b')}) <= 1 - 1e-9 THEN b ELSE {X.times('b', f'(1 - 1e-9) / sqrt({X.n2(chr(98))})')} END"))
_shaped("m02_mobius_add", lambda x, y, t: G.mobius_add(x, y), _Chain().bind("o", _mob("x", "y")))
_shaped("m03_exp_map", lambda x, y, t: G.exp_map(x, t), _Chain().exp("o", "x", "t"))
_shaped("m04_log_map", lambda x, y, t: G.log_map(x, y), _Chain().log("o", "x", "y"))
_shaped("m05_riemannian_gradient", lambda x, y, t: G.riemannian_gradient(x, t), _Chain().bind("o", X.times("t", f"pow(greatest(1 - {X.n2('x')}, 1e-15) / 2, 2)")))
_shaped("m06_parallel_transport", lambda x, y, t: G.parallel_transport(x, y, t), _Chain().transport("o", "x", "y", "t"))
_shaped("m06_gyro", lambda x, y, t: G.gyro(x, y, t), _Chain().bind("a", _mob("x", "y")).bind("b", _mob("y", "t")).bind("c", _mob("x", "b")).bind("d", _neg("a")).bind("o", _mob("d", "c")))
_shaped("m10_poincare_to_lorentz", lambda x, y, t: G.poincare_to_lorentz(x), _Chain().bind("o", f"list_concat([(1 + {X.n2('x')}) / (1 - {X.n2('x')})], {X.times('x', f'2 / (1 - {X.n2(chr(120))})')})"))
_shaped("m10_lorentz_to_poincare", lambda x, y, t: G.lorentz_to_poincare(D.lift(t)), _Chain().bind("o", X.times("t", f"1 / (1 + sqrt(1 + {X.n2('t')}))")))
_shaped("m11_project_to_hyperboloid", lambda x, y, t: G.project_to_hyperboloid(F.concat(F.array(F.lit(5.0)), x)), _Chain().bind("o", f"list_concat([sqrt(1 + {X.n2('x')})], x)"))
_shaped("m14_koopman_extrapolate", lambda x, y, t: G.koopman_extrapolate(x, y, 0.5),
        _Chain().log("v", "x", "y").transport("w", "x", "y", "v").bind("h", X.times("w", "0.5")).exp("o", "y", "h"))
_shaped("m15_context_resonance", lambda x, y, t: G.context_resonance(x, y, 0.25), _Chain().log("v", "x", "y").bind("h", X.times("v", "0.25")).exp("o", "x", "h"))
_shaped("m17_reconsolidate", lambda x, y, t: G.reconsolidate(x, y, 0.1), _Chain().bind("o", "list_transform(list_zip(x, y), lambda p: p[1] + 0.1 * (p[2] - p[1]))"))
_shaped("s16_momentum_poincare", lambda x, y, t: G.momentum(x, y, "poincare", 0.5), _Chain().log("v", "x", "y").bind("h", X.times("v", "0.5")).exp("o", "y", "h"))
_shaped("s16_momentum_l2", lambda x, y, t: G.momentum(x, y, "l2", 2.0), _Chain().bind("o", "list_transform(list_zip(x, y), lambda p: p[2] + 2 * (p[2] - p[1]))"))

_scored("m08_lorentz_distance", "lorentz", G.lorentz_distance, f"acosh(greatest(-{X.minner('v', 'q')}, 1.0))")
_scored("m08_lorentz_product", "lorentz", D.lorentz_inner, X.minner("v", "q"))


@query("m09_lorentz_transport", f"""WITH {X.query_of("lorentz")}, u AS (SELECT v AS u FROM pts WHERE id = 1),
o AS (SELECT id, list_transform(list_zip(u, v, q), lambda p: p[1] + {X.minner("q", "u")} / (1 - {X.minner("v", "q")}) * (p[2] + p[3])) AS o FROM pts, q, u)
SELECT id, {_SHAPE} FROM o""")
def m09_lorentz_transport(spark: SparkSession, d: str) -> DataFrame:
    q, u = vec(X.vector(spark, d, "lorentz")), vec(X.vector(spark, d, "lorentz", 1))
    return X.points(spark, d, "lorentz").select("id", G.lorentz_parallel_transport(V(), q, u).alias("o")).select("id", *_shape(F.col("o")))


@query("m12_local_entropy", _Chain().log("v", "x", "y").sql(f"round(1 - exp(-sqrt({X.n2('v')})), 6) AS entropy"))
def m12_local_entropy(spark: SparkSession, d: str) -> DataFrame:
    y = vec(X.vector(spark, d, "poincare"))
    return X.points(spark, d, "poincare").select("id", F.round(G.local_entropy(V(), F.array(y, y)), 6).alias("entropy"))


@query("x06_navigate_to_attractor", _Chain().log("v", "x", "y").bind("trust", f"exp(-0.4 * sqrt({X.n2('v')}))").sql("round(trust, 6) AS trust, round(1 - trust, 6) AS entropy, trust < 0.15 AS lost"))
def x06_navigate(spark: SparkSession, d: str) -> DataFrame:
    y = vec(X.vector(spark, d, "poincare"))
    trust = F.exp(-0.4 * norm(G.log_map(V(), y)))
    rows = X.points(spark, d, "poincare").select("id", trust.alias("t"))
    return rows.select("id", F.round("t", 6).alias("trust"), F.round(1 - F.col("t"), 6).alias("entropy"), (F.col("t") < 0.15).alias("lost"))


@query("x03_verify_claim", f"""WITH {X.query_of("hybrid")}, d AS (SELECT id, {X.lorentz("v[1:33]", "q[1:33]")} + 1 - {X.dot("v[34:65]", "q[34:65]")} / sqrt({X.n2("v[34:65]")} * {X.n2("q[34:65]")}) AS d FROM pts, q)
SELECT id, round(1 / (1 + d), 6) AS trust, round(1 / (1 + d), 6) > 0.36 AS verified FROM d""")
def x03_verify_claim(spark: SparkSession, d: str) -> DataFrame:
    q = vec(X.vector(spark, d, "hybrid"))
    both = D.lorentz(F.slice(V(), 1, 33), F.slice(q, 1, 33)) + 1 - D.cosine_similarity(F.slice(V(), 34, 32), F.slice(q, 34, 32))
    rows = X.points(spark, d, "hybrid").select("id", F.round(1 / (1 + both), 6).alias("trust"))
    return rows.withColumn("verified", F.col("trust") > 0.36)


@query("d00_validity", f"""WITH {X.pts("poincare", "p")}, {X.pts("lorentz", "l")}
SELECT p.id, {X.n2("p.v")} < 1 - 1e-9 AS poincare, l.v[1] > 0 AND abs({X.minner("l.v", "l.v")} + 1) <= 1e-6 AS lorentz FROM p JOIN l ON p.id = l.id""")
def d00_validity(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d, "poincare").select("id", D.valid(V(), "poincare").alias("poincare"))
    return p.join(X.points(spark, d, "lorentz").select("id", D.valid(V(), "lorentz").alias("lorentz")), "id")


# --- quantization ---------------------------------------------------------------------

_CODES = "list_transform(v, lambda x: least(greatest(round(x * 127), -127), 127)::BIGINT)"


@query("e01_scalar_codes", f"WITH {X.pts()} SELECT id, list_sum({_CODES})::BIGINT AS total, list_max({_CODES}) AS largest FROM pts")
def e01_scalar(spark: SparkSession, d: str) -> DataFrame:
    rows = X.points(spark, d).select("id", Q.scalar(V()).alias("c"))
    return rows.select("id", F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("c").cast("long").alias("largest"))


@query("e02_refined_codes")
def e02_refined(spark: SparkSession, d: str) -> DataFrame:
    return X.points(spark, d).select("id", Q.scalar_refined(V()).alias("codes"))


_LONG = "list_concat(list_concat(v, v), v)"


@query("e02_long_vectors", f"WITH {X.pts()} SELECT id, array_to_string(list_transform({_LONG}, lambda x: CAST(greatest(least(sign(x) * floor(abs(x * 127) + 0.5), 127), -127) AS INTEGER)), ',') AS codes FROM pts")
def e02_long(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of more than 128 coordinates get plain codes."""
    codes = Q.scalar_refined(F.concat(V(), V(), V()))
    return X.points(spark, d).select("id", F.array_join(F.transform(codes, lambda c: c.cast("int")), ",").alias("codes"))


@query("e03_lorentz_codes", f"""WITH {X.pts("lorentz")}, a AS (SELECT id, v, {_ALPHA} AS alpha FROM pts)
SELECT id, round(alpha, 6) AS alpha, list_sum(list_transform(v, lambda x: least(greatest(round(x / alpha * 127), -127), 127)::BIGINT))::BIGINT AS total FROM a""")
def e03_lorentz_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = X.points(spark, d, "lorentz").select("id", Q.lorentz_scalar(V()).alias("c"))
    return rows.select("id", F.round("c.alpha", 6).alias("alpha"), F.aggregate("c.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("e04_sign_bits", f"WITH {X.pts()} SELECT id, list_sum(list_transform(v, lambda x: (x > 0)::INT))::BIGINT AS ones FROM pts")
def e04_sign_bits(spark: SparkSession, d: str) -> DataFrame:
    zero = F.transform(V(), lambda _: F.lit(0.0))
    return X.points(spark, d).select("id", Q.hamming(Q.sign_bits(V()), Q.sign_bits(zero)).alias("ones"))


@query("e05_hybrid_codes", f"""WITH {X.pts("hybrid")} SELECT id, round(v[1]::FLOAT::DOUBLE, 4) AS head,
list_sum(list_transform(v[34:65], lambda x: trunc(least(greatest(x * 127, -127), 127))::BIGINT))::BIGINT AS total FROM pts""")
def e05_hybrid_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = X.points(spark, d, "hybrid").select("id", Q.hybrid_codes(V()).alias("c"))
    return rows.select("id", F.round(F.element_at("c.head", 1).cast("double"), 4).alias("head"), F.aggregate("c.tail", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("e06_dequantize", f"WITH {X.pts()} SELECT id, round({X.l2(_C.format('v'), 'v')}, 9) AS loss FROM pts")
def e06_dequantize(spark: SparkSession, d: str) -> DataFrame:
    return X.points(spark, d).select("id", F.round(D.l2(Q.scalar_decode(Q.scalar(V())), V()), 9).alias("loss"))


@query("e07_e08_storage", """SELECT * FROM (VALUES ('none', 801, 6416::BIGINT), ('scalar', 801, 805), ('binary', 801, 105), ('hybrid801', 801, 904), ('none', 64, 520), ('scalar', 64, 68), ('binary', 64, 12), ('hybrid801', 64, 167)) AS t(mode, dim, bytes)""")
def e08_storage(spark: SparkSession, d: str) -> DataFrame:
    rows = [(m, n, Q.bytes_per_vector(m, n)) for n in (801, 64) for m in Q.MODES]
    return spark.createDataFrame(rows, "mode string, dim int, bytes long")


# --- search ---------------------------------------------------------------------------


def _out(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("distance", 6).alias("distance"))


def _search(kind: str):
    return lambda spark, d: _out(S.search(X.points(spark, d, kind), X.vector(spark, d, kind), 10, kind))


query("s01_search", X.top("l2", 10))(_search("l2"))
for _kind in ("cosine", "poincare", "lorentz", "hybrid"):
    query(f"s01_search_{_kind}", X.top(_kind, 10))(_search(_kind))


@query("s02_filtered_search", X.top("cosine", 10, "label IN (1, 3)"))
def s02_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _out(S.search(X.points(spark, d), X.vector(spark, d), 10, "cosine", F.col("label").isin(1, 3)))


def _batch_sql(kind: str, k: int, exclude: bool = False) -> str:
    return f"""WITH {X.pts(kind)}, q AS (SELECT id AS query_id, v AS q FROM pts WHERE id % 20 = 0),
d AS (SELECT query_id, id, {X.DISTANCE[kind]("v", "q")} AS d FROM pts, q {"WHERE id <> query_id" if exclude else ""}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM d)
SELECT query_id, id, round(d, 6) AS distance, rank FROM r WHERE rank <= {k}"""


def _batch(kind: str, k: int, exclude: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = X.points(spark, d, kind)
        return S.batch_search(p, p.where("id % 20 = 0"), k, kind, exclude).select("query_id", "id", (F.round("distance", 6)).alias("distance"), F.col("rank").cast("long").alias("rank"))

    return run


for _kind in ("l2", "cosine", "poincare", "lorentz", "hybrid"):
    query(f"s03_batch_search_{_kind}", _batch_sql(_kind, 10, True))(_batch(_kind, 10, True))


def _cells(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Approximate: every id divisible by 20 against the cells it probes; tests measure the recall."""
        p = X.points(spark, d, kind)
        found = cells.cell_search(cells.build(p, kind), p.where("id % 20 = 0"), 10, exclude_self=True)
        return found.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))

    return run


for _kind in ("l2", "cosine", "poincare", "lorentz"):
    query(f"s01_cell_search_{_kind}")(_cells(_kind))


@query("s04_multi_collection", f"""WITH {X.query_of()}, d AS (SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS collection, id, {X.l2("v", "q")} AS d FROM pts, q),
r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY d, id) AS r FROM d) SELECT collection, id, round(d, 6) AS distance FROM r WHERE r <= 5""")
def s04_multi(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    found = S.search_collections({"low": p.where("label < 5"), "high": p.where("label >= 5")}, X.vector(spark, d), 5)
    return found.select("collection", "id", F.round("distance", 6).alias("distance"))


@query("s06_wasserstein_rerank", f"""WITH {X.query_of()}, d AS (SELECT id, v, q, {X.l2("v", "q")} AS d FROM pts, q ORDER BY d, id LIMIT 20)
SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: abs(list_sum(list_transform(v[1:i], lambda x: greatest(x, 0.0))) / list_sum({_POS.format("v")}) - list_sum(list_transform(q[1:i], lambda x: greatest(x, 0.0))) / list_sum({_POS.format("q")})))), 6) AS distance FROM d""")
def s06_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _out(S.wasserstein_rerank(X.points(spark, d), X.vector(spark, d), 20))


@query("s07_truncated_search", f"""WITH {X.query_of()}, c AS (SELECT id, v, q FROM pts, q ORDER BY {X.l2("v[1:16]", "q[1:16]")}, id LIMIT 40)
SELECT id, round({X.l2("v", "q")}, 6) AS distance FROM c ORDER BY {X.l2("v", "q")}, id LIMIT 10""")
def s07_truncated(spark: SparkSession, d: str) -> DataFrame:
    return _out(S.truncated_search(X.points(spark, d), X.vector(spark, d), 10, 16))


@query("s08_exact_rerank", f"""WITH {X.query_of("cosine")}, c AS (SELECT id, v, q FROM pts, q ORDER BY {X.DISTANCE["cosine"]("v", "q")}, id LIMIT 40)
SELECT id, round(least(greatest(1 - {_SIM}, 0), 2), 6) AS distance FROM c ORDER BY least(greatest(1 - {_SIM}, 0), 2), id LIMIT 10""")
def s08_exact(spark: SparkSession, d: str) -> DataFrame:
    return _out(S.exact_rerank(X.points(spark, d, "cosine"), X.vector(spark, d, "cosine"), 10, "cosine"))


@query("s09_attach_payload", f"""WITH {X.query_of()}, d AS (SELECT id, {X.l2("v", "q")} AS d FROM pts, q ORDER BY d, id LIMIT 10)
SELECT id, round(d, 6) AS distance, coalesce(page_id, -1) AS payload_page, coalesce(octet_length(encode(html)), -1)::BIGINT AS payload_bytes FROM d LEFT JOIN pages ON id = page_id""")
def s09_payload(spark: SparkSession, d: str) -> DataFrame:
    payloads = X.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.struct("page_id", F.encode("html", "utf-8").alias("b")).alias("payload"))
    found = S.attach_payload(S.search(X.points(spark, d), X.vector(spark, d), 10), payloads)
    return found.select("id", F.round("distance", 6).alias("distance"), F.coalesce("payload.page_id", F.lit(-1)).alias("payload_page"), F.coalesce(F.octet_length("payload.b"), F.lit(-1)).cast("long").alias("payload_bytes"))


@query("s10_id_lookup", "SELECT vec_id AS id, 0.0::DOUBLE AS distance FROM embeddings WHERE vec_id IN (3, 7)")
def s10_lookup(spark: SparkSession, d: str) -> DataFrame:
    return X.points(spark, d).where(F.col("id").isin(3, 7)).select("id", F.lit(0.0).alias("distance"))


@query("s11_s12_merge_tiers", f"""WITH {X.query_of()}, d AS (SELECT id, {X.l2("v", "q")} AS d FROM pts, q WHERE label < 7)
SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10""")
def s12_merge(spark: SparkSession, d: str) -> DataFrame:
    p, q = X.points(spark, d), X.vector(spark, d)
    tiers = [S.search(p.where(w), q, 10).select("id", "distance") for w in ("label < 5", "label < 7 and label > 2")]
    return _out(S.merge_tiers(tiers, 10))


_CENTROID = "cent AS (SELECT label AS chunk, i, avg(v[i]) AS x FROM pts, unnest(range(1, 65)) AS u(i) GROUP BY label, i), cv AS (SELECT chunk, list(x ORDER BY i) AS c FROM cent GROUP BY chunk)"


@query("s13_routed_search", f"""WITH {X.query_of()}, {_CENTROID}, near AS (SELECT chunk FROM cv, q ORDER BY {X.l2("c", "q")}, chunk LIMIT 3),
d AS (SELECT id, {X.l2("v", "q")} AS d FROM pts, q WHERE label IN (SELECT chunk FROM near)) SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10""")
def s13_routed(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d)
    return _out(S.routed_search(p, "label", S.centroids(p, "label", 64), X.vector(spark, d), 10))


@query("s14_centroids", f"WITH {X.query_of()}, {_CENTROID} SELECT chunk, round(sqrt({X.n2('c')}), 6) AS length, round({X.l2('c', 'q')}, 6) AS distance FROM cv, q")
def s14_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = S.centroids(X.points(spark, d), "label", 64)
    return c.select("chunk", F.round(norm(F.col("centroid")), 6).alias("length"), F.round(D.l2(F.col("centroid"), vec(X.vector(spark, d))), 6).alias("distance"))


@query("s15_scatter_gather", X.top("l2", 25))
def s15_scatter(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d).repartition(16, "id")
    return _out(S.search(p, X.vector(spark, d), 25))


@query("s16_momentum_search", f"""WITH {X.pts()}, m AS (SELECT list_transform(list_zip(a.v, b.v), lambda p: p[2] + (p[2] - p[1])) AS q FROM pts a, pts b WHERE a.id = 1 AND b.id = 2),
d AS (SELECT id, {X.l2("v", "q")} AS d FROM pts, m) SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 10""")
def s16_momentum(spark: SparkSession, d: str) -> DataFrame:
    a, b = X.vector(spark, d, of=1), X.vector(spark, d, of=2)
    return _out(S.search(X.points(spark, d), [y + (y - x) for x, y in zip(a, b, strict=True)], 10))


@query("s19_fuzzy_search", f"""WITH {X.pts()}, a AS (SELECT v AS a FROM pts WHERE id = 0), b AS (SELECT v AS b FROM pts WHERE id = 1), c AS (SELECT v AS c FROM pts WHERE id = 2),
m AS (SELECT id, exp(-{X.l2("v", "a")}) AS x, exp(-{X.l2("v", "b")}) AS y, exp(-{X.l2("v", "c")}) AS z FROM pts, a, b, c), s AS (SELECT id, greatest(least(x, 1 - z), y) AS s FROM m)
SELECT id, round(s, 6) AS score FROM s ORDER BY s DESC, id LIMIT 10""")
def s19_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    leaf = [fuzzy.Leaf(tuple(X.vector(spark, d, of=i))) for i in range(3)]
    tree = fuzzy.Or(fuzzy.And(leaf[0], fuzzy.Not(leaf[2])), leaf[1])
    return S.fuzzy_search(X.points(spark, d), tree, 10, "l2").select("id", F.round("score", 6).alias("score"))


@query("s20_fuzzy_norms", """WITH x AS (SELECT event_id, abs(value) / (1 + abs(value)) AS a, (event_id % 10) / 10.0 AS b FROM events)
SELECT event_id, round(least(a, b), 6) AS t_min, round(a * b, 6) AS t_product, round(greatest(a + b - 1, 0), 6) AS t_luk,
  round(greatest(a, b), 6) AS s_max, round(a + b - a * b, 6) AS s_prob, round(least(a + b, 1), 6) AS s_luk, round(1 - a, 6) AS neg FROM x""")
def s20_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.abs("value")
    x = X.table(spark, d, "events").select("event_id", (v / (1 + v)).alias("a"), ((F.col("event_id") % 10) / F.lit(10.0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    t, s = fuzzy.TNORMS, fuzzy.TCONORMS
    return x.select(
        "event_id", F.round(t["min"](a, b), 6).alias("t_min"), F.round(t["product"](a, b), 6).alias("t_product"), F.round(t["lukasiewicz"](a, b), 6).alias("t_luk"),
        F.round(s["max"](a, b), 6).alias("s_max"), F.round(s["probabilistic"](a, b), 6).alias("s_prob"), F.round(s["lukasiewicz"](a, b), 6).alias("s_luk"), F.round(fuzzy.negation(a), 6).alias("neg"),
    )


query("s23_ground_truth", _batch_sql("cosine", 100))(_batch("cosine", 100))


@query("x01_mmr")
def x01_mmr(spark: SparkSession, d: str) -> DataFrame:
    q = X.vector(spark, d)
    ids = S.maximal_marginal(S.search(X.points(spark, d), q, 50, "cosine"), q, 10)
    return spark.createDataFrame([(r, i) for r, i in enumerate(ids)], "rank int, id long")


