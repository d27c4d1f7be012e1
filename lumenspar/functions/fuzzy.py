"""Fuzzy logic: t-norms, t-conorms and query trees compiled to a Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TNORMS = {
    "min": lambda a, b: F.least(a, b),
    "product": lambda a, b: a * b,
    "lukasiewicz": lambda a, b: F.greatest(a + b - 1, F.lit(0.0)),
}
TCONORMS = {
    "max": lambda a, b: F.greatest(a, b),
    "probabilistic": lambda a, b: a + b - a * b,
    "lukasiewicz": lambda a, b: F.least(a + b, F.lit(1.0)),
}
DUAL = {"min": "max", "product": "probabilistic", "lukasiewicz": "lukasiewicz"}


def negation(a: Column) -> Column:
    return 1 - a


@dataclass(frozen=True)
class Leaf:
    """Likeness to a vector: exp(-distance)."""

    vector: tuple[float, ...]


@dataclass(frozen=True)
class And:
    left: Node
    right: Node
    norm: str = "min"


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node
    norm: str = "max"


@dataclass(frozen=True)
class Not:
    of: Node


Node = Leaf | And | Or | Not


def leaves(node: Node) -> list[Leaf]:
    if isinstance(node, Leaf):
        return [node]
    return leaves(node.of) if isinstance(node, Not) else leaves(node.left) + leaves(node.right)


def membership(node: Node, values: list[Column]) -> Column:
    """The tree's value, given its leaves' memberships from left to right."""
    rest = iter(values)

    def value(n: Node) -> Column:
        if isinstance(n, Leaf):
            return next(rest)
        if isinstance(n, Not):
            return negation(value(n.of))
        left = value(n.left)
        return (TNORMS if isinstance(n, And) else TCONORMS)[n.norm](left, value(n.right))

    return value(node)
