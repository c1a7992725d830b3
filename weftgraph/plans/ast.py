"""Syntax tree of the pattern language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class ListLiteral:
    items: tuple


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Property:
    owner: object
    name: str


@dataclass(frozen=True)
class HasKinds:
    owner: Variable
    kinds: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    value: object
    negated: bool


@dataclass(frozen=True)
class Case:
    subject: object
    whens: tuple
    default: object


@dataclass(frozen=True)
class NodePattern:
    name: str | None
    kinds: tuple[str, ...]
    props: tuple = ()


@dataclass(frozen=True)
class EdgePattern:
    name: str | None
    kinds: tuple[str, ...]
    direction: str  # 'out', 'in' or 'both'
    props: tuple = ()
    hops: tuple[int, int] | None = None


@dataclass(frozen=True)
class Pattern:
    """Nodes and edges by turns; ``search`` is '', 'one' or 'all' (shortest paths)."""

    name: str | None
    parts: tuple
    search: str = ""


@dataclass(frozen=True)
class Exists:
    pattern: Pattern


@dataclass(frozen=True)
class Item:
    value: object
    alias: str | None


@dataclass(frozen=True)
class Match:
    patterns: tuple[Pattern, ...]
    where: object | None
    optional: bool = False


@dataclass(frozen=True)
class Unwind:
    value: object
    alias: str


@dataclass(frozen=True)
class Project:
    """WITH or RETURN."""

    items: tuple[Item, ...]
    star: bool = False
    distinct: bool = False
    order: tuple = ()  # (expression, ascending)
    skip: object | None = None
    limit: object | None = None
    where: object | None = None
    final: bool = False


@dataclass
class Query:
    clauses: list = field(default_factory=list)
    union: tuple | None = None  # (query, keep duplicates)
