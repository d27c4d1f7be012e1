"""Quantized vectors: codes as array<tinyint> or bits, distances on codes, storage sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspar.functions.vectors import let, norm_sq

MODES = ("none", "scalar", "binary", "hybrid801")


def mode_of(requested: str, metric: str, dimension: int) -> str:
    """Storage mode from a request: none, extreme (bits), anything else scalar."""
    if requested == "none":
        return "none"
    if requested in ("extreme", "binary"):
        return "binary"
    return "hybrid801" if metric == "hybrid" and dimension == 801 else "scalar"


def bytes_per_vector(mode: str, dim: int, f32: bool = False) -> int:
    return {
        "binary": (dim + 7) // 8 + 4,
        "scalar": dim + 4,
        "hybrid801": 33 * 4 + dim - 33 + 4 if dim > 33 else dim * 4 + 4,
        "none": dim * 4 + 4 if f32 else dim * 8 + 8,
    }[mode]


def _code(x: Column) -> Column:
    return F.least(F.greatest(F.round(x), F.lit(-127.0)), F.lit(127.0)).cast("tinyint")


def scalar(v: Column) -> Column:
    """Codes round(127 x), clamped."""
    return F.transform(v, lambda x: _code(x * 127))


def scalar_decode(codes: Column) -> Column:
    return F.transform(codes, lambda c: c / F.lit(127.0))


def lorentz_scalar(v: Column) -> Column:
    """struct(codes, alpha) with the largest coordinate as the scale."""
    alpha = F.greatest(F.array_max(F.transform(v, F.abs)), F.lit(1e-12))
    return let(lambda x, a: F.struct(F.transform(x, lambda c: _code(c / a * 127)).alias("codes"), a.alias("alpha")), v, alpha)


def lorentz_scalar_decode(coded: Column) -> Column:
    return let(lambda s: F.transform(s["codes"], lambda c: c / F.lit(127.0) * s["alpha"]), coded)


def hybrid_codes(v: Column, head: int = 33) -> Column:
    """struct(head as float, tail as truncated codes)."""
    tail = F.transform(F.slice(v, head + 1, F.size(v)), lambda x: F.least(F.greatest(x * 127, F.lit(-127.0)), F.lit(127.0)).cast("tinyint"))
    return F.struct(F.slice(v, 1, head).cast("array<float>").alias("head"), tail.alias("tail"))


def l2_to_codes(codes: Column, q: Column) -> Column:
    """Squared distance of a full query to scalar codes."""
    return F.aggregate(F.zip_with(codes, q, lambda c, x: (c / F.lit(127.0) - x) * (c / F.lit(127.0) - x)), F.lit(0.0), lambda s, x: s + x)


def poincare_argument_to_codes(codes: Column, q: Column) -> Column:
    """1 + 2 delta of a query to scalar codes; orders as the distance does."""
    return let(
        lambda a, b: 1 + 2 * F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        / F.greatest((1 - norm_sq(a)) * (1 - norm_sq(b)), F.lit(1e-9)),
        scalar_decode(codes), q,
    )


def lorentz_to_codes(coded: Column, q: Column) -> Column:
    from lumenspar.functions.distance import lorentz

    return lorentz(lorentz_scalar_decode(coded), q)


@F.pandas_udf(T.BinaryType())
def sign_bits(vectors: pd.Series) -> pd.Series:
    """One bit a coordinate, set where it is positive, lowest bit first."""
    return vectors.map(lambda v: np.packbits(np.asarray(v) > 0, bitorder="little").tobytes(), na_action="ignore")


@F.pandas_udf(T.LongType())
def hamming(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()) for x, y in zip(a, b, strict=True)], dtype="int64")


#: Longer vectors are not refined.
MAX_REFINED = 128


def refine(v: np.ndarray, passes: int = 1, eta: float = 10.0) -> np.ndarray:
    """Anisotropic codes: one step up or down a coordinate where that lowers the loss.

    The loss weighs the error across the vector ``eta`` times the error along it. Vectors
    of more than ``MAX_REFINED`` coordinates, and those of no length, keep plain codes.
    """
    codes = np.clip(np.trunc(v * 127 + np.copysign(0.5, v)), -127, 127)
    n2 = float(v @ v)
    if n2 <= 1e-18 or len(v) > MAX_REFINED:
        return codes.astype(np.int8)

    error = codes / 127 - v
    along, total = float(error @ v), float(error @ error)
    for _ in range(passes):
        moved = False
        for i in range(len(v)):
            best, choice = along * along / n2 + eta * (total - along * along / n2), 0
            for step in (-1, 1):
                if abs(codes[i] + step) > 127:
                    continue
                d = step / 127
                new_along, new_total = along + d * v[i], total + 2 * d * error[i] + d * d
                loss = new_along**2 / n2 + eta * (new_total - new_along**2 / n2)
                if loss < best - 1e-15:
                    best, choice = loss, step
            if choice:
                d = choice / 127
                along, total = along + d * v[i], total + 2 * d * error[i] + d * d
                error[i] += d
                codes[i] += choice
                moved = True
        if not moved:
            break
    return codes.astype(np.int8)


@F.pandas_udf(T.ArrayType(T.ByteType()))
def scalar_refined(vectors: pd.Series) -> pd.Series:
    """Scalar codes refined coordinate by coordinate."""
    return vectors.map(lambda v: refine(np.asarray(v, float)).tolist(), na_action="ignore")
