"""Looking through syntax trees."""

from __future__ import annotations

from collections.abc import Iterator

from ..functions.expr import AGGREGATES
from . import ast as A


def walk(node) -> Iterator[object]:
    """All tree nodes under and including ``node``."""
    if isinstance(node, (tuple, list)):
        for x in node:
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        for name in node.__dataclass_fields__:
            yield from walk(getattr(node, name))


def conjuncts(where) -> list:
    """The parts of a condition that must all hold."""
    if where is None:
        return []
    if isinstance(where, A.Binary) and where.op == "and":
        return conjuncts(where.left) + conjuncts(where.right)
    return [where]


def names_in(node) -> set[str]:
    out = {x.name for x in walk(node) if isinstance(x, A.Variable)}
    for x in walk(node):
        if isinstance(x, (A.NodePattern, A.EdgePattern, A.Pattern)) and x.name:
            out.add(x.name)
    return out


def has_aggregate(node) -> bool:
    return any(isinstance(x, A.Call) and x.name in AGGREGATES for x in walk(node))
