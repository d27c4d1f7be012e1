"""Distances between array<double> columns, and the registry of metrics by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspar.functions.vectors import dot, let, norm_sq, normalize, scale

HEAD = 33  # coordinates of the Lorentz head of a mixed vector


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_sqrt(a: Column, b: Column) -> Column:
    return F.sqrt(l2(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of the unit vectors: 2 (1 - cos)."""
    return l2(normalize(a), normalize(b))


def cosine_similarity(a: Column, b: Column) -> Column:
    den = F.sqrt(norm_sq(a) * norm_sq(b))
    return F.when(den > 1e-12, dot(a, b) / den).otherwise(0.0)


def cosine_exact(a: Column, b: Column) -> Column:
    """1 - cos, clamped to [0, 2], as the exact re-ranking scores it."""
    return F.least(F.greatest(1 - cosine_similarity(a, b), F.lit(0.0)), F.lit(2.0))


def poincare_argument(a: Column, b: Column) -> Column:
    """What the Poincare distance takes the inverse hyperbolic cosine of; orders alike."""
    den = F.greatest((1 - norm_sq(a)) * (1 - norm_sq(b)), F.lit(1e-9))
    return 1 + 2 * l2(a, b) / den


def poincare(a: Column, b: Column) -> Column:
    return F.acosh(poincare_argument(a, b))


def lorentz_inner(a: Column, b: Column) -> Column:
    return dot(a, b) - 2 * F.element_at(a, 1) * F.element_at(b, 1)


def lorentz(a: Column, b: Column) -> Column:
    return F.acosh(F.greatest(-lorentz_inner(a, b), F.lit(1 + 1e-12)))


def hybrid(a: Column, b: Column, head: int = HEAD) -> Column:
    """Lorentz over the head plus squared Euclidean over the rest; 0 for shorter vectors."""
    both = lorentz(F.slice(a, 1, head), F.slice(b, 1, head)) + l2(F.slice(a, head + 1, F.size(a)), F.slice(b, head + 1, F.size(b)))
    return F.when(F.size(a) >= head, both).otherwise(0.0)


def hybrid_truncated(a: Column, b: Column, tail: int, head: int = HEAD) -> Column:
    """Hybrid distance over the first ``tail`` Euclidean coordinates only."""
    return lorentz(F.slice(a, 1, head), F.slice(b, 1, head)) + l2(F.slice(a, head + 1, tail), F.slice(b, head + 1, tail))


def wasserstein(a: Column, b: Column) -> Column:
    """Wasserstein-1 of two histograms: negatives are nought, both sums one."""
    mass = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))

    def moved(x: Column, y: Column, mx: Column, my: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
        step = lambda s, p: let(
            lambda c, d: F.struct(c.alias("c"), (d + F.abs(c)).alias("d")), s["c"] + p, s["d"]
        )
        parts = F.zip_with(x, y, lambda u, v: F.greatest(u, F.lit(0.0)) / mx - F.greatest(v, F.lit(0.0)) / my)
        return F.aggregate(parts, start, step, lambda s: s["d"])

    return let(
        lambda x, y, mx, my: F.when((mx <= 1e-9) | (my <= 1e-9), F.lit(1.7976931348623157e308)).otherwise(moved(x, y, mx, my)),
        a, b, mass(a), mass(b),
    )


def to_klein(p: Column) -> Column:
    """Poincare to Klein coordinates."""
    return scale(p, 2 / (1 + norm_sq(p)))


def klein_chord(a: Column, b: Column) -> Column:
    """Squared chord between Klein points given in Poincare coordinates; cheap routing."""
    return l2(to_klein(a), to_klein(b))


def klein_to_lorentz(k: Column) -> Column:
    gamma = 1 / F.sqrt(F.greatest(1 - norm_sq(k), F.lit(1e-12)))
    return let(lambda v, g: F.concat(F.array(g), scale(v, g)), k, gamma)


def lift(x: Column) -> Column:
    """Onto the hyperboloid: sqrt(1 + |x|^2) before x."""
    return F.concat(F.array(F.sqrt(1 + norm_sq(x))), x)


def weighted(a: Column, b: Column, components: Sequence[tuple[str, int, float]], weights: dict[int, float] | None = None) -> Column:
    """Sum of weighted distances over consecutive slices (metric, length, weight)."""
    out, at = F.lit(0.0), 1
    for i, (metric, length, weight) in enumerate(components):
        w = (weights or {}).get(i, weight)
        out = out + F.lit(float(w)) * EXACT[metric](F.slice(a, at, length), F.slice(b, at, length))
        at += length
    return out


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "l2": l2, "euclidean": l2, "cosine": cosine, "poincare": poincare, "lorentz": lorentz, "hybrid": hybrid,
}
#: The scale of exact re-ranking differs from that of the search for l2 and cosine.
EXACT = METRICS | {"l2": l2_sqrt, "euclidean": l2_sqrt, "cosine": cosine_exact}


def valid(vector: Column, metric: str) -> Column:
    """Whether a vector may be stored under the metric."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if metric == "poincare":
        return finite & (norm_sq(vector) < 1 - 1e-9)
    if metric == "lorentz":
        first = F.element_at(vector, 1)
        return finite & (first > 0) & (F.abs(lorentz_inner(vector, vector) + 1) <= 1e-6)
    return finite
