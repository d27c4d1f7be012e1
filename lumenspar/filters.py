"""The filter language: an expression tree compiled to one boolean Column.

A missing key makes a predicate false, never null, so negation is two-valued. Keys that
were promoted to columns are read from those, where Parquet statistics can prune.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspar.functions.distance import lorentz_inner
from lumenspar.functions.vectors import norm, sub, vec


@dataclass(frozen=True)
class Match:
    key: str
    value: str


@dataclass(frozen=True)
class Prefix:
    key: str
    prefix: str


@dataclass(frozen=True)
class Range:
    """Inclusive bounds on a value that reads as a number."""

    key: str
    gte: float | None = None
    lte: float | None = None


@dataclass(frozen=True)
class InBox:
    low: tuple[float, ...]
    high: tuple[float, ...]


@dataclass(frozen=True)
class InCone:
    axes: tuple[float, ...]
    apertures: tuple[float, ...]
    cen: float = 0.0


@dataclass(frozen=True)
class InBall:
    """A geodesic ball on the hyperboloid where the centre has 33 coordinates, else Euclidean."""

    center: tuple[float, ...]
    radius: float


@dataclass(frozen=True)
class Term:
    """A word of the row's tokens."""

    token: str


@dataclass(frozen=True)
class And:
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Or:
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Not:
    part: Filter


Filter = Match | Prefix | Range | InBox | InCone | InBall | Term | And | Or | Not


@dataclass(frozen=True)
class Fields:
    """Where a filter finds its data: a metadata map, promoted columns, vector and tokens."""

    metadata: str | None = "metadata"
    columns: Mapping[str, str] = field(default_factory=dict)
    vector: str = "vector"
    tokens: str = "tokens"

    def get(self, key: str) -> Column:
        if key in self.columns:
            return F.col(self.columns[key])
        if self.metadata is None:
            raise KeyError(key)
        return F.element_at(F.col(self.metadata), F.lit(key))


def _number(value: Column) -> Column:
    return value.try_cast("double")


def _geometric(expr: Filter) -> bool:
    return isinstance(expr, InBox | InCone | InBall)


def compile_filter(expr: Filter, fields: Fields = Fields(), geometry: str = "check") -> Column:  # noqa: B008
    """The filter as a Column; with geometry="pass" regions count as true.

    Cheap predicates of a conjunction come before geometric ones, as AND stops early.
    """
    rest = functools.partial(compile_filter, fields=fields, geometry=geometry)
    v = F.col(fields.vector)
    if _geometric(expr) and geometry == "pass":
        return F.lit(True)
    match expr:
        case Match(key, value):
            out = fields.get(key).cast("string") == value
        case Prefix(key, prefix):
            out = fields.get(key).cast("string").startswith(prefix)
        case Range(key, gte, lte):
            x = _number(fields.get(key))
            out = x.isNotNull() & ~F.isnan(x)
            out = out & (x >= float(gte)) if gte is not None else out
            out = out & (x <= float(lte)) if lte is not None else out
        case Term(token):
            out = F.array_contains(F.col(fields.tokens), token)
        case InBox(low, high):
            parts = [(F.element_at(v, i + 1) >= a) & (F.element_at(v, i + 1) <= b) for i, (a, b) in enumerate(zip(low, high, strict=True))]
            out = (F.size(v) >= len(low)) & functools.reduce(operator.and_, parts, F.lit(True))
        case InCone(axes, apertures, cen):
            half = lambda x: F.abs(F.sin(x / 2))
            parts = [half(F.element_at(v, i + 1) - a) <= half(F.lit(float(w))) + cen for i, (a, w) in enumerate(zip(axes, apertures, strict=True))]
            out = (F.size(v) >= len(axes)) & functools.reduce(operator.and_, parts, F.lit(True))
        case InBall(center, radius):
            c = vec(center)
            if len(center) == 33:
                out = F.acosh(F.greatest(-lorentz_inner(v, c), F.lit(1 + 1e-12))) <= radius
            else:
                out = norm(sub(F.slice(v, 1, len(center)), c)) <= radius
        case And(parts):
            ordered = sorted(parts, key=_geometric)
            return functools.reduce(operator.and_, map(rest, ordered), F.lit(True))
        case Or(parts):
            return functools.reduce(operator.or_, map(rest, parts), F.lit(False))
        case Not(part):
            if geometry == "pass" and _geometric(part):
                return F.lit(True)
            return ~rest(part)
    return F.coalesce(out, F.lit(False))


def exact(pairs: Mapping[str, str]) -> And:
    """All entries of a key-to-value map match."""
    return And(tuple(Match(k, v) for k, v in pairs.items()))


def from_dict(data: Any) -> Filter:
    """A filter from its JSON form; malformed input is an error, not a filter that is true."""
    if not isinstance(data, dict) or len(data) != 1:
        raise ValueError(f"a filter is an object with one key, not {data!r}")
    ((kind, x),) = data.items()
    try:
        match kind:
            case "match":
                return Match(str(x["key"]), str(x["value"]))
            case "prefix":
                return Prefix(str(x["key"]), str(x["prefix"]))
            case "range":
                return Range(str(x["key"]), x.get("gte"), x.get("lte"))
            case "in_box":
                return InBox(tuple(map(float, x["min"])), tuple(map(float, x["max"])))
            case "in_cone":
                return InCone(tuple(map(float, x["axes"])), tuple(map(float, x["apertures"])), float(x.get("cen", 0)))
            case "in_ball":
                return InBall(tuple(map(float, x["center"])), float(x["radius"]))
            case "term":
                return Term(str(x["token"]))
            case "and":
                return And(tuple(map(from_dict, x)))
            case "or":
                return Or(tuple(map(from_dict, x)))
            case "not":
                return Not(from_dict(x))
    except (KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"malformed {kind} filter: {x!r}") from e
    raise ValueError(f"unknown filter {kind!r}")


def vacuum_predicate(key: str, op: str, value: float, fields: Fields = Fields()) -> Column:  # noqa: B008
    """lt, lte, gt, gte, eq or ne on a numeric key; a missing or non-numeric value matches none."""
    x = _number(fields.get(key))
    near = F.abs(x - value) <= 1e-12
    out = {"lt": x < value, "lte": x <= value, "gt": x > value, "gte": x >= value, "eq": near, "ne": ~near}[op]
    return F.coalesce(out, F.lit(False))
