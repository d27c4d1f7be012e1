"""Collections made from the supplied tables, in Spark and as SQL of the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.functions.distance import lift
from lumenspar.functions.vectors import scale


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str, kind: str = "l2") -> DataFrame:
    """points(id, vector, label): as stored, or mapped to the ball, the hyperboloid or both."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    v = F.col("vector")
    mapped = {
        "l2": v,
        "cosine": v,
        "poincare": scale(v, 0.9 * (0.2 + 0.08 * F.col("label"))),
        "lorentz": lift(v),
        "hybrid": F.concat(lift(F.slice(v, 1, 32)), F.slice(v, 33, 32)),
    }[kind]
    return rows.withColumn("vector", mapped)


def vector(spark: SparkSession, d: str, kind: str = "l2", of: int = 0) -> list[float]:
    return list(points(spark, d, kind).where(F.col("id") == of).first().vector)


def metadata_points(spark: SparkSession, d: str) -> DataFrame:
    """points with metadata {label, bucket} as strings; every fifth has no bucket."""
    bucket = F.when(F.col("id") % 5 == 0, F.map_from_arrays(F.array(F.lit("label")), F.array(F.col("label").cast("string")))).otherwise(
        F.map_from_arrays(F.array(F.lit("label"), F.lit("bucket")), F.array(F.col("label").cast("string"), (F.col("id") % 4).cast("string")))
    )
    return points(spark, d).withColumn("metadata", bucket)


# --- SQL of the checking engine -------------------------------------------------

_V = "embedding::DOUBLE[]"


def n2(a: str) -> str:
    return f"list_inner_product({a}, {a})"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def times(a: str, s: str) -> str:
    return f"list_transform({a}, lambda el: el * ({s}))"


def unit(a: str) -> str:
    return f"CASE WHEN abs({n2(a)} - 1) <= 1e-9 OR {n2(a)} <= 1e-18 THEN {a} ELSE {times(a, f'1 / sqrt({n2(a)})')} END"


def poincare(a: str, b: str) -> str:
    return f"acosh(1 + 2 * {l2(a, b)} / greatest((1 - {n2(a)}) * (1 - {n2(b)}), 1e-9))"


def minner(a: str, b: str) -> str:
    return f"({dot(a, b)} - 2 * {a}[1] * {b}[1])"


def lorentz(a: str, b: str) -> str:
    return f"acosh(greatest(-{minner(a, b)}, 1 + 1e-12))"


def hybrid(a: str, b: str, tail: int = 32) -> str:
    return f"{lorentz(f'{a}[1:33]', f'{b}[1:33]')} + {l2(f'{a}[34:{33 + tail}]', f'{b}[34:{33 + tail}]')}"


DISTANCE = {"l2": l2, "cosine": lambda a, b: l2(unit(a), unit(b)), "poincare": poincare, "lorentz": lorentz, "hybrid": hybrid}
VECTOR = {
    "l2": _V,
    "cosine": _V,
    "poincare": f"list_transform({_V}, lambda x: x * (0.9 * (0.2 + 0.08 * label)))",
    "lorentz": f"list_concat([sqrt(1 + {n2(_V)})], {_V})",
    "hybrid": f"list_concat([sqrt(1 + {n2(f'({_V})[1:32]')})], {_V})",
}


def pts(kind: str = "l2", name: str = "pts") -> str:
    """A CTE of points(id, v, label)."""
    return f"{name} AS (SELECT vec_id AS id, {VECTOR[kind]} AS v, label FROM embeddings)"


def query_of(kind: str = "l2", of: int = 0) -> str:
    """CTEs of the points and of one of them as q."""
    return f"{pts(kind)}, q AS (SELECT v AS q FROM pts WHERE id = {of})"


def top(kind: str, k: int, where: str = "true", of: int = 0) -> str:
    return f"""WITH {query_of(kind, of)}, d AS (SELECT id, {DISTANCE[kind]("v", "q")} AS distance FROM pts, q WHERE {where})
SELECT id, round(distance, 6) AS distance FROM d ORDER BY d.distance, id LIMIT {k}"""
