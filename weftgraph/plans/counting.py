"""Counts of matches without the matches: names are summed out one by one.

A query that only counts the matches of a pattern of single edges, in groups
of some names' values, needs no row for each match.  Node and edge tables are
factors with a column for each name and a weight; a name is summed out by
joining the factors that hold it and grouping by the columns left, weights
multiplied and added.  Joins of large groups with each other (all customers of
a nation with all its suppliers) so become joins of their counts.

Edges of a pattern must differ: matches in which two are the same are counted
likewise, with one name for both, and taken off (inclusion and exclusion).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expressions
from . import ast as A
from .symbols import Frame, Symbol
from .tree import conjuncts, has_aggregate, names_in, walk

#: Pairs of edges that must differ, at most: each doubles the number of counts.
MOST_PAIRS = 3


@dataclass
class Factor:
    """``held``: names that are columns; ``groups``: columns of the result; rows and distinct values are estimates."""

    df: DataFrame
    held: frozenset[str]
    groups: tuple[str, ...]
    weight: str | None
    rows: float
    distinct: dict[str, float]


class Counting:
    """The matches of a query's MATCH clauses, counted."""

    def __init__(self, compiler, matches: list[A.Match], items: list[A.Item]) -> None:
        self.compiler, self.graph, self.items = compiler, compiler.graph, items
        self.patterns = [p for m in matches for p in m.patterns]
        self.parts = [c for m in matches for c in conjuncts(m.where)]
        self.nodes: dict[str, A.NodePattern] = {}
        self.edges: dict[str, tuple[A.EdgePattern, str, str]] = {}
        self.written: list[list[str]] = []
        self.fits = all(not p.search and not p.name for p in self.patterns) and self._named() and self._plain()

    def _named(self) -> bool:
        """Every node and edge under one name; False where the shape is another."""
        for pattern in self.patterns:
            names = [n.name or self.compiler.fresh("_n") for n in pattern.parts[::2]]
            for name, node in zip(names, pattern.parts[::2], strict=True):
                known = self.nodes.get(name)
                self.nodes[name] = A.NodePattern(node.name, tuple(dict.fromkeys((known.kinds if known else ()) + node.kinds)), (known.props if known else ()) + node.props)
            own = []
            for edge, a, b in zip(pattern.parts[1::2], names[:-1], names[1:], strict=True):
                name = edge.name or self.compiler.fresh("_e")
                if edge.hops is not None or edge.direction == "both" or name in self.edges:
                    return False
                self.edges[name] = (edge, a, b) if edge.direction == "out" else (edge, b, a)
                own.append(name)
            self.written.append(own)
        return len(self.edges) > 1 and not set(self.nodes) & set(self.edges)

    def _plain(self) -> bool:
        """Conditions on one name each, and items that are counts or belong to one name each."""
        known = set(self.nodes) | set(self.edges)
        for part in self.parts:
            if len(names_in(part)) != 1 or not names_in(part) <= known or any(isinstance(x, A.Exists) for x in walk(part)):
                return False
        counts = 0
        for item in self.items:
            value = item.value
            if isinstance(value, A.Call) and value.name == "count":
                if value.distinct or not (value.star or len(value.args) == 1 and isinstance(value.args[0], A.Variable) and value.args[0].name in known):
                    return False
                counts += 1
            elif len(names_in(value)) != 1 or not names_in(value) <= known or has_aggregate(value) or any(isinstance(x, A.Exists) for x in walk(value)):
                return False
        return counts > 0 and len(self.unlike()) <= MOST_PAIRS

    def unlike(self) -> list[tuple[str, str]]:
        """Pairs of edges of a pattern that could be one and must not."""
        out = []
        for own in self.written:
            for one, other in combinations(own, 2):
                (e, *ends), (f, *others) = self.edges[one], self.edges[other]
                if e.kinds and f.kinds and not set(e.kinds) & set(f.kinds):
                    continue
                # One edge has one start and one end, each of the kinds of both names.
                kinds = [set(self.nodes[a].kinds) | set(self.nodes[b].kinds) for a, b in zip(ends, others, strict=True)]
                if all(any(k <= t.always | t.maybe for t in self.graph.node_tables) for k in kinds):
                    out.append((one, other))
        return out

    def frame(self) -> Frame:
        """A row for each group with its counts, under the names of the items."""
        self.symbols: dict[str, Symbol] = {}
        self.values: dict[str, list[tuple[str, A.Item]]] = {}
        self.column = {n: self.compiler.fresh("_v") for n in (*self.nodes, *self.edges)}
        for item in self.items:
            if not isinstance(item.value, A.Call) or item.value.name != "count":
                self.values.setdefault(next(iter(names_in(item.value))), []).append((item.alias, item))
        pairs, used = self.unlike(), set()
        factors = [*self.node_factors(used), *self.edge_factors({x for p in pairs for x in p})]
        total, out, n = self.compiler.fresh("g"), None, 0
        for size in range(len(pairs) + 1):
            for same in combinations(pairs, size):
                groups, df = self.summed(self.merged(factors, same))
                df = df.select(*groups, (F.col("_w") * (-1) ** size).alias("_w"))
                out, n = df if out is None else out.unionByName(df), n + 1
        if n > 1:
            out = out.groupBy(*groups).agg(F.sum("_w").alias("_w"))
        out = out.where("_w > 0") if groups else out.select(F.coalesce("_w", F.lit(0)).alias("_w"))
        out = out.withColumn(total, F.col("_w").cast("bigint"))
        counts = {i.alias: Symbol("scalar", {"value": total}, type="int8") for i in self.items if isinstance(i.value, A.Call) and i.value.name == "count"}
        return Frame(out.drop("_w"), self.symbols | counts)

    def valued(self, name: str, df: DataFrame, symbol: Symbol) -> tuple[DataFrame, list[str]]:
        """The columns of the items that belong to ``name``."""
        columns: list[str] = []
        for alias, item in self.values.get(name, ()):
            if isinstance(item.value, A.Variable):
                self.symbols[alias] = symbol
                columns += symbol.all_columns()
                continue
            value = Expressions(self.graph, Frame(df, {name: symbol}), self.compiler.parameters).value(item.value)
            stem = self.compiler.fresh("w")
            df = df.withColumn(stem, value.col)
            self.symbols[alias] = Symbol("scalar", {"value": stem}, type=self.compiler.scalar_type(value))
            columns.append(stem)
        return df, list(dict.fromkeys(columns))

    def node_factors(self, used: set[int]) -> Iterator[Factor]:
        touched = {x for _, a, b in self.edges.values() for x in (a, b)}
        for name, node in self.nodes.items():
            # Edges end at existing nodes: a table that adds nothing but its id is not read.
            if name in touched and name not in self.values and not self.compiler.far_matters(node, self.parts, used):
                continue
            df, symbol = self.compiler.scan(node, name, self.parts, used)
            df, columns = self.valued(name, df, symbol)
            rows = self.graph.rows_of_nodes(node.kinds)
            yield Factor(df.select(symbol.col("id").alias(self.column[name]), *columns), frozenset([name]), tuple(columns), None, rows, {name: rows})

    def edge_factors(self, compared: set[str]) -> Iterator[Factor]:
        for name, (edge, a, b) in self.edges.items():
            df, symbol = self.compiler.edge_rows(edge, name)
            own = Frame(df, {name: symbol})
            for part in self.parts:
                if names_in(part) == {name}:
                    own = self.compiler.filtered(own, part)
            df, columns = self.valued(name, own.df, symbol)
            rows = self.graph.rows_of_edges(edge.kinds)
            held = {a: min(rows, self.graph.rows_of_nodes(self.nodes[a].kinds)), b: min(rows, self.graph.rows_of_nodes(self.nodes[b].kinds))}
            if a == b:
                df = df.where(symbol.col("src") == symbol.col("dst"))
            ends = {a: symbol.col("src"), b: symbol.col("dst")} | ({name: symbol.col("id")} if name in compared else {})
            yield Factor(df.select(*(c.alias(self.column[n]) for n, c in ends.items()), *columns), frozenset(ends), tuple(columns), None, rows, held | ({name: rows} if name in compared else {}))

    def merged(self, factors: list[Factor], same: tuple[tuple[str, str], ...]) -> list[Factor]:
        """The factors with one name for edges that are the same."""
        names: dict[str, str] = {}
        for one, other in same:
            a, b = names.get(one, one), names.get(other, other)
            names = {k: a if v == b else v for k, v in names.items()} | {one: a, other: a}
        out = []
        for f in factors:
            turned = {n: m for n, m in names.items() if n in f.held and n != m}
            df = reduce(lambda d, nm: d.withColumnRenamed(self.column[nm[0]], self.column[nm[1]]), turned.items(), f.df)
            out.append(Factor(df, frozenset(turned.get(n, n) for n in f.held), f.groups, f.weight, f.rows, {turned.get(n, n): d for n, d in f.distinct.items()}))
        # An edge's name is a column only where it is compared.
        alone = {n for n in self.edges if sum(n in f.held for f in out) == 1}
        return [Factor(f.df.drop(*(self.column[n] for n in f.held & alone)), f.held - alone, f.groups, f.weight, f.rows, f.distinct) for f in out]

    def summed(self, factors: list[Factor]) -> tuple[tuple[str, ...], DataFrame]:
        """All names summed out, the one that makes the smallest join next."""
        factors = list(factors)
        while names := sorted({n for f in factors for n in f.held}):
            _, name = min((joined_rows([f for f in factors if n in f.held]), n) for n in names)
            with_it = [f for f in factors if name in f.held]
            factors = [f for f in factors if name not in f.held] + [self.without(with_it, name)]
        factors = [f if f.weight else Factor(f.df.withColumn("_one", F.lit(1)), f.held, f.groups, "_one", f.rows, {}) for f in factors]
        df = reduce(lambda d, f: d.crossJoin(f.df), factors[1:], factors[0].df)
        groups = tuple(g for f in factors for g in f.groups)
        return groups, df.select(*groups, reduce(lambda a, b: a * b, (F.col(f.weight) for f in factors)).alias("_w"))

    def without(self, factors: list[Factor], name: str) -> Factor:
        factors = sorted(factors, key=lambda f: f.rows)
        df, held = factors[0].df, factors[0].held
        for f in factors[1:]:
            df, held = df.join(f.df, sorted(self.column[n] for n in held & f.held)), held | f.held
        rows, held = joined_rows(factors), held - {name}
        weights = [F.col(f.weight) for f in factors if f.weight]
        weight, groups = self.compiler.fresh("_w"), tuple(g for f in factors for g in f.groups)
        product = reduce(lambda a, b: a * b, weights) if weights else None
        df = df.groupBy(*sorted(self.column[n] for n in held), *groups).agg((F.count(F.lit(1)) if product is None else F.sum(product)).alias(weight))
        distinct = {n: min(f.distinct[n] for f in factors if n in f.held) for n in held}
        # Values in groups are not estimated.
        most = reduce(lambda a, b: a * b, distinct.values(), 1.0) if not groups else rows
        return Factor(df, frozenset(held), groups, weight, max(1.0, min(rows, most)), distinct)


def joined_rows(factors: list[Factor]) -> float:
    """Rows of the join of ``factors`` on all names that they share, if values are spread evenly."""
    out = reduce(lambda a, b: a * b, (max(1.0, f.rows) for f in factors))
    for name in {n for f in factors for n in f.held}:
        counts = sorted(max(1.0, f.distinct[name]) for f in factors if name in f.held)
        out /= reduce(lambda a, b: a * b, counts[1:], 1.0)
    return out
