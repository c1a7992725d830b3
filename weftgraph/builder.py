"""A fluent interface over nodes and relationships; each terminal is one DataFrame.

Criteria are small values combined by ``all_of``; every kind criterion counts
on its own (``kind_in('A') and kind_in('B')`` needs one of each).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .errors import refuse
from .operators.shortest import shortest_paths


@dataclass(frozen=True)
class Criterion:
    """target: node, rel, start or end; what: kinds, ids or prop."""

    target: str
    what: str
    values: tuple
    op: str = "in"


def node_kinds(*kinds: str) -> Criterion:
    return Criterion("node", "kinds", kinds)


def node_ids(*ids: int) -> Criterion:
    return Criterion("node", "ids", ids)


def node_property(name: str, op: str, value: object) -> Criterion:
    return Criterion("node", "prop", (name, value), op)


def rel_kinds(*kinds: str) -> Criterion:
    return Criterion("rel", "kinds", kinds)


def rel_property(name: str, op: str, value: object) -> Criterion:
    return Criterion("rel", "prop", (name, value), op)


def start_kinds(*kinds: str) -> Criterion:
    return Criterion("start", "kinds", kinds)


def end_kinds(*kinds: str) -> Criterion:
    return Criterion("end", "kinds", kinds)


def start_ids(*ids: int) -> Criterion:
    return Criterion("start", "ids", ids)


def end_ids(*ids: int) -> Criterion:
    return Criterion("end", "ids", ids)


def _any_kind(column: Column, kinds: tuple[str, ...]) -> Column:
    if not kinds:
        raise refuse("a kind criterion without kinds", "no_kind_constraint")
    return F.arrays_overlap(column, F.array(*map(F.lit, kinds)))


class Builder:
    def __init__(self, graph) -> None:
        self.graph = graph

    def nodes(self) -> Nodes:
        return Nodes(self.graph)

    def relationships(self) -> Relationships:
        return Relationships(self.graph)


@dataclass(frozen=True)
class _Selection:
    """Criteria, order and slice; every method gives a new selection."""

    graph: object
    criteria: tuple[Criterion, ...] = ()
    #: (name, ascending); "id" is the id, any other name a property.
    order: tuple[tuple[str, bool], ...] = ()
    start: int = 0
    most: int | None = None

    def filter(self, *criteria: Criterion):
        return replace(self, criteria=self.criteria + criteria)

    def order_by(self, name: str, ascending: bool = True):
        """By id or a property, absent values last; later keys break ties of earlier ones."""
        return replace(self, order=(*self.order, (name, ascending)))

    def offset(self, rows: int):
        return replace(self, start=rows)

    def limit(self, rows: int):
        return replace(self, most=rows)

    def _names(self) -> tuple[str, ...]:
        """Properties that criteria and order look at."""
        return tuple(dict.fromkeys([*(c.values[0] for c in self.criteria if c.what == "prop"), *(n for n, _ in self.order if n != "id")]))

    def _value(self, name: str, edge: bool):
        from .functions.props import Prop

        return Prop(F.col(f"p_{self._names().index(name)}"), None if self.graph.json else self.graph.prop_type(name, edge))

    def _property(self, c: Criterion, edge: bool = False) -> Column:
        prop, value = self._value(c.values[0], edge), c.values[1]
        if c.op == "=":
            return prop.equals(value)
        number = prop.cast_to("double" if isinstance(value, float) else "bigint") if isinstance(value, (int, float)) else prop.own_text()
        return {"<": number < value, "<=": number <= value, ">": number > value, ">=": number >= value}[c.op]

    def _page(self, df: DataFrame, edge: bool) -> DataFrame:
        if self.order:
            keys = [F.col("id") if n == "id" else self._value(n, edge).output() for n, _ in self.order]
            df = df.orderBy(*(k.asc_nulls_last() if up else k.desc_nulls_last() for k, (_, up) in zip(keys, self.order, strict=True)))
        df = df.offset(self.start) if self.start else df
        return df if self.most is None else df.limit(self.most)

    def count(self) -> int:
        return self.frame().count()

    def first(self) -> Row | None:
        """The first whole node or relationship in order (of ids, if none is given)."""
        chosen = self if self.order else self.order_by("id")
        return next(iter(chosen.limit(1 if self.most is None else min(1, self.most)).fetch().collect()), None)

    def fetch(self) -> DataFrame:
        """Whole nodes or relationships as one column ``entity``, in order."""
        from .operators.hydrate import entities

        rows = self.frame().withColumn("_row", F.monotonically_increasing_id()).select(F.col("id").alias("_id"), "_row")
        known = entities(self.graph, isinstance(self, Relationships))
        out = rows.join(known, F.col("_id") == F.col("id"))
        return (out.orderBy("_row") if self.order else out).select("entity")


@dataclass(frozen=True)
class Nodes(_Selection):
    def frame(self) -> DataFrame:
        names = self._names()
        single = tuple(c.values[0] for c in self.criteria if c.what == "kinds" and len(c.values) == 1)
        ids = next((list(c.values) for c in self.criteria if c.what == "ids"), None)
        df = self.graph.nodes(single, names, ids)
        for c in self.criteria:
            if c.target != "node":
                raise refuse(f"a {c.target} criterion on nodes")
            if c.what == "ids":
                df = df.where(F.col("id").isin(list(c.values)))
            elif c.what == "kinds":
                df = df.where(_any_kind(F.col("kinds"), c.values))
            else:
                df = df.where(self._property(c))
        return self._page(df, False).select("id", "kinds")

    def fetch_ids(self) -> DataFrame:
        """Ids in the order asked for, else ascending."""
        return (self if self.order else self.order_by("id")).frame().select("id")

    def fetch_kinds(self) -> DataFrame:
        return self.frame()


@dataclass(frozen=True)
class Relationships(_Selection):
    def _of(self, target: str, what: str) -> list[Criterion]:
        return [c for c in self.criteria if c.target == target and c.what == what]

    def frame(self) -> DataFrame:
        kinds: set[str] | None = None
        for c in self._of("rel", "kinds"):
            if not c.values:
                raise refuse("a kind criterion without kinds", "no_kind_constraint")
            kinds = set(c.values) if kinds is None else kinds & set(c.values)
        df = self.graph.edges(tuple(sorted(kinds)) if kinds else (), self._names())
        if kinds is not None and not kinds:
            df = df.where(F.lit(False))
        for target, column in (("start", "src"), ("end", "dst")):
            for c in self._of(target, "ids"):
                df = df.where(F.col(column).isin(list(c.values)))
            for c in self._of(target, "kinds"):
                single = c.values if len(c.values) == 1 else ()
                ends = self.graph.nodes(single).where(_any_kind(F.col("kinds"), c.values)).select(F.col("id").alias("_end"))
                df = df.join(ends, F.col(column) == F.col("_end"), "left_semi")
        for c in self._of("rel", "prop"):
            df = df.where(self._property(c, True))
        return self._page(df, True).select("id", "src", "dst", "kind")

    def fetch_ids(self) -> DataFrame:
        return self.frame().select("id")

    def fetch_triples(self) -> DataFrame:
        return self.frame().select("id", "src", "dst")

    def fetch_kinds(self) -> DataFrame:
        return self.frame().select("id", "src", "dst", "kind")

    def fetch_ends(self) -> DataFrame:
        """(start id, end id) of each edge."""
        return self.frame().select("src", "dst")

    def fetch_step(self, outbound: bool = True) -> DataFrame:
        """The far node's id and kinds with the edge's id and kind, by edge id."""
        far = "dst" if outbound else "src"
        edges = self.frame().select(F.col("id").alias("rel_id"), F.col("kind").alias("rel_kind"), F.col(far).alias("_far"))
        nodes = self.graph.nodes().select(F.col("id").alias("node_id"), F.col("kinds").alias("node_kinds"))
        return edges.join(nodes, F.col("_far") == F.col("node_id")).select("node_id", "node_kinds", "rel_id", "rel_kind").orderBy("rel_id")

    def fetch_directed_graph(self) -> DataFrame:
        """Distinct adjacency pairs."""
        return self.fetch_ends().distinct()

    def fetch_all_shortest_paths(self, high: int = 15) -> DataFrame:
        """All shortest paths from the one start id to the one end id: ``nodes``, ``edges``."""
        starts, ends = (sorted({v for c in self._of(t, "ids") for v in c.values}) for t in ("start", "end"))
        if len(starts) != 1 or len(ends) != 1:
            raise refuse("shortest paths need one start id and one end id")
        kinds = Relationships(self.graph, tuple(self._of("rel", "kinds"))).frame()
        one = lambda x: self.graph.spark.range(x, x + 1)
        found = shortest_paths(kinds, one(starts[0]), one(ends[0]), "out", high, "pair")
        return found.select(F.col("t_nodes").alias("nodes"), F.col("t_edges").alias("edges"))
