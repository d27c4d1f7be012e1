"""Hyperbolic geometry on array<double> columns (ball of curvature c, and hyperboloid)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspar.functions.distance import lorentz_inner
from lumenspar.functions.vectors import combine, dot, let, norm, norm_sq, scale

TINY = 1e-15


def project_to_ball(x: Column, c: float = 1.0) -> Column:
    most = 1 / math.sqrt(c) - 1e-9
    return let(lambda v, n: F.when((n <= most) | (n <= TINY), v).otherwise(scale(v, most / n)), x, norm(x))


def mobius_add(x: Column, y: Column, c: float = 1.0) -> Column:
    """Null where the denominator vanishes."""

    def body(u: Column, v: Column, uv: Column, u2: Column, v2: Column) -> Column:
        den = 1 + 2 * c * uv + c * c * u2 * v2
        return F.when(F.abs(den) >= TINY, combine(u, (1 + 2 * c * uv + c * v2) / den, v, (1 - c * u2) / den))

    return let(lambda u, v: let(body, u, v, dot(u, v), norm_sq(u), norm_sq(v)), x, y)


def _lambda(x: Column, c: float) -> Column:
    return 2 / F.greatest(1 - c * norm_sq(x), F.lit(TINY))


def exp_map(x: Column, v: Column, c: float = 1.0) -> Column:
    root = math.sqrt(c)

    def body(p: Column, t: Column, n: Column, lam: Column) -> Column:
        step = scale(t, F.tanh(root * lam * n / 2) / (root * n))
        return F.when(n < TINY, p).otherwise(mobius_add(p, step, c))

    return let(lambda p, t: let(body, p, t, norm(t), _lambda(p, c)), x, v)


def log_map(x: Column, y: Column, c: float = 1.0) -> Column:
    root = math.sqrt(c)

    def body(d: Column, n: Column, lam: Column) -> Column:
        factor = 2 / (lam * root) * F.atanh(F.least(root * n, F.lit(1 - TINY)))
        return F.when(n < TINY, F.transform(d, lambda _: F.lit(0.0))).otherwise(scale(d, factor / n))

    return let(
        lambda p, q: let(lambda d, lam: let(body, d, norm(d), lam), mobius_add(scale(p, -1.0), q, c), _lambda(p, c)), x, y
    )


def riemannian_gradient(x: Column, gradient: Column, c: float = 1.0) -> Column:
    return let(lambda g, lam: scale(g, 1 / (lam * lam)), gradient, _lambda(x, c))


def gyro(u: Column, v: Column, w: Column, c: float = 1.0) -> Column:
    def body(a: Column, b: Column, d: Column) -> Column:
        return let(lambda ab, left: mobius_add(scale(ab, -1.0), left, c), mobius_add(a, b, c), mobius_add(a, mobius_add(b, d, c), c))

    return let(body, u, v, w)


def parallel_transport(x: Column, y: Column, v: Column, c: float = 1.0) -> Column:
    return let(
        lambda p, q, t: let(lambda g, s: scale(g, s), gyro(q, scale(p, -1.0), t, c), _lambda(p, c) / _lambda(q, c)), x, y, v
    )


def koopman_extrapolate(past: Column, current: Column, steps: float, c: float = 1.0) -> Column:
    """The next point: velocity at the past, carried to the present, followed on."""
    return let(lambda p, q: exp_map(q, scale(parallel_transport(p, q, log_map(p, q, c), c), steps), c), past, current)


def context_resonance(thought: Column, context: Column, factor: float, c: float = 1.0) -> Column:
    """The thought pulled along the geodesic to the context by a factor of 0 to 1."""
    return let(lambda t, g: exp_map(t, scale(log_map(t, g, c), min(max(factor, 0.0), 1.0)), c), thought, context)


def local_entropy(candidate: Column, neighbours: Column, c: float = 1.0) -> Column:
    """1 - exp(-mean length of the log maps); 1 without neighbours."""

    def body(p: Column, others: Column) -> Column:
        total = F.aggregate(others, F.lit(0.0), lambda s, q: s + norm(log_map(p, q, c)))
        return F.when(F.size(others) == 0, F.lit(1.0)).otherwise(1 - F.exp(-total / F.size(others)))

    return let(body, candidate, neighbours)


def lorentz_distance(u: Column, v: Column) -> Column:
    """Geodesic distance with the argument clamped to 1."""
    return F.acosh(F.greatest(-lorentz_inner(u, v), F.lit(1.0)))


def lorentz_parallel_transport(x: Column, y: Column, v: Column) -> Column:
    def body(p: Column, q: Column, t: Column, den: Column, inner: Column) -> Column:
        factor = F.when(F.abs(den) < 1e-7, F.lit(0.0)).otherwise(inner / den)
        return F.zip_with(t, F.zip_with(p, q, lambda a, b: a + b), lambda a, b: a + factor * b)

    return let(lambda p, q, t: let(body, p, q, t, 1 - lorentz_inner(p, q), lorentz_inner(q, t)), x, y, v)


def lorentz_to_poincare(x: Column) -> Column:
    den = 1 + F.element_at(x, 1)
    rest = F.slice(x, 2, F.size(x))
    return F.when(F.abs(den) < 1e-7, F.transform(rest, lambda _: F.lit(0.0))).otherwise(scale(rest, 1 / den))


def poincare_to_lorentz(p: Column) -> Column:
    def body(v: Column, n2: Column) -> Column:
        den = F.when(F.abs(1 - n2) < 1e-7, F.lit(1e-7)).otherwise(1 - n2)
        return F.concat(F.array((1 + n2) / den), scale(v, 2 / den))

    return let(body, p, norm_sq(p))


def project_to_hyperboloid(x: Column) -> Column:
    """The point with the same spatial part that lies on the hyperboloid."""
    rest = F.slice(x, 2, F.size(x))
    return F.concat(F.array(F.sqrt(1 + norm_sq(rest))), rest)


def momentum(past: Column, current: Column, metric: str, steps: float = 1.0) -> Column:
    """One step on from two points, without transport of the velocity."""
    if metric == "poincare":
        return let(lambda p, q: exp_map(q, scale(log_map(p, q), steps)), past, current)
    if metric == "lorentz":
        return poincare_to_lorentz(momentum(lorentz_to_poincare(past), lorentz_to_poincare(current), "poincare", steps))
    if metric == "hybrid":
        head, tail = (lambda v: F.slice(v, 1, 33)), (lambda v: F.slice(v, 34, F.size(v)))
        return F.concat(momentum(head(past), head(current), "lorentz", steps), momentum(tail(past), tail(current), "l2", steps))
    return F.zip_with(past, current, lambda a, b: b + steps * (b - a))


def reconsolidate(x: Column, target: Column, rate: float, metric: str = "poincare") -> Column:
    """A step towards the target, kept inside the ball."""
    moved = F.zip_with(x, target, lambda a, b: a + rate * (b - a))
    if metric != "poincare":
        return moved
    return let(lambda v, n: F.when(n >= 1, scale(v, 0.999999 / n)).otherwise(v), moved, norm(moved))
