"""A property graph as DataFrames: node tables by kind, edge tables by kind.

Typed tables keep properties as plain columns, so filters and column pruning
reach the Parquet scan.  Graphs of free-form documents keep one map column
``props`` from name to ``struct<t, txt, num, bool, arr, raw>`` (absent: no such
key; JSON null: t = 'null').  Queries see both through ``functions.props``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from .errors import refuse
from .sources.json_props import property_values

#: Spark type of one property value of a free-form graph.
JSON_VALUE = "struct<t:string,txt:string,num:double,bool:boolean,arr:array<string>,raw:string>"


@dataclass(frozen=True)
class NodeTable:
    """Rows ``id``, ``kinds`` and properties; every row has ``always``, some have ``maybe``.

    With ``base`` and ``key`` the table's ids are ``base`` plus its column
    ``key`` (no property), so wanted ids become a filter of a stored column.
    """

    df: DataFrame
    always: frozenset[str]
    maybe: frozenset[str] = frozenset()
    base: int | None = None
    key: str | None = None
    #: The rows of a free-form table before any property is read: ``id``, ``kinds``, ``properties`` as JSON text.
    raw: DataFrame | None = None

    def of_ids(self, ids: list[int]) -> DataFrame:
        """The rows of these ids, and perhaps others."""
        if self.key is None:
            return self.rows.where(F.col("id").isin(ids))
        return self.df.where(F.col(self.key).isin([i - self.base for i in ids]))

    @property
    def rows(self) -> DataFrame:
        return self.df if self.raw is None else self.raw

    @property
    def props(self) -> dict[str, DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in ("id", "kinds", self.key)}


@dataclass
class Graph:
    """Node tables, and edge tables (``id, src, dst`` and properties) by kind.

    Edges are unique by (src, dst, kind) and end at existing nodes.
    """

    spark: SparkSession
    node_tables: list[NodeTable]
    edge_tables: Mapping[str, DataFrame]
    json: bool = False
    #: Epoch seconds that datetime() reads; the session's clock if not given.
    now: int | None = None
    #: Rows at most of a search level or of a product of unconnected patterns; None: no bound.
    budget: int | None = None
    #: What is done with an edge table (kind, table) when a query reads it, such as saving a derived one.
    keep: Callable[[str, DataFrame], DataFrame] | None = None
    _types: dict[str, DataType] = field(default_factory=dict)
    _rows: dict[int | str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for table in self.node_tables:
            for name, kind in table.props.items():
                # Tables that disagree on a type are read as text.
                self._types[name] = kind if self._types.get(name, kind) == kind else StringType()
        self._edge_types: dict[str, DataType] = {}
        # Free-form tables have one map each, and may not be made yet.
        for df in () if self.json else self.edge_tables.values():
            for f in df.schema.fields:
                if f.name not in ("id", "src", "dst", "kind"):
                    self._edge_types[f.name] = f.dataType if self._edge_types.get(f.name, f.dataType) == f.dataType else StringType()

    @property
    def kinds(self) -> set[str]:
        return {k for t in self.node_tables for k in t.always | t.maybe}

    def prop_type(self, name: str, edge: bool = False) -> DataType:
        return (self._edge_types if edge else self._types).get(name, StringType())

    def prop_names(self, edge: bool = False) -> list[str]:
        return list(self._edge_types if edge else self._types)

    def _value(self, df: DataFrame, name: str, edge: bool):
        if self.json:
            return F.col("props")[name] if "props" in df.columns else F.lit(None).cast(JSON_VALUE)
        wanted = self.prop_type(name, edge)
        return F.col(f"`{name}`").cast(wanted) if name in df.columns else F.lit(None).cast(wanted)

    def nodes(self, kinds: tuple[str, ...] = (), props: tuple[str, ...] = (), ids: list[int] | None = None) -> DataFrame:
        """``id``, ``kinds`` and the wanted properties (``p_0``, ``p_1``, ...) of nodes with all ``kinds``.

        With ``ids`` other nodes may be left out before they are read.
        """
        out = None
        for table in self.node_tables:
            if not set(kinds) <= table.always | table.maybe:
                continue
            df = table.rows if ids is None else table.of_ids(ids)
            for kind in sorted(set(kinds) - table.always):
                df = df.where(F.array_contains("kinds", kind))
            if table.raw is not None:
                df = df.select("id", "kinds", *([F.inline_outer(property_values(F.col("properties"), props))] if props else []))
            else:
                df = df.select("id", "kinds", *(self._value(df, p, False).alias(f"p_{i}") for i, p in enumerate(props)))
            out = df if out is None else out.unionByName(df)
        if out is None:
            template = self.node_tables[0].df
            out = template.where(F.lit(False)).select("id", "kinds", *(self._value(template, p, False).alias(f"p_{i}") for i, p in enumerate(props)))
        return out

    def edges(self, kinds: tuple[str, ...] = (), props: tuple[str, ...] = ()) -> DataFrame:
        """``id, src, dst, kind`` and the wanted properties of edges of any of ``kinds`` (all if none is given)."""
        out = None
        for kind, df in self.edge_tables.items():
            if kinds and kind not in kinds:
                continue
            df = self.keep(kind, df) if self.keep else df
            df = df.select("id", "src", "dst", F.lit(kind).alias("kind"), *(self._value(df, p, True).alias(f"p_{i}") for i, p in enumerate(props)))
            out = df if out is None else out.unionByName(df)
        if out is None:
            if not self.edge_tables:
                raise refuse("the graph has no edges", "empty_graph")
            kind, df = next(iter(self.edge_tables.items()))
            out = df.where(F.lit(False)).select("id", "src", "dst", F.lit(kind).alias("kind"), *(self._value(df, p, True).alias(f"p_{i}") for i, p in enumerate(props)))
        return out

    def rows_of_nodes(self, kinds: tuple[str, ...] = ()) -> float:
        """Rows of the tables that hold nodes with all ``kinds``; counted once."""
        return sum(self._counted(i, t.rows) for i, t in enumerate(self.node_tables) if set(kinds) <= t.always | t.maybe)

    def rows_of_edges(self, kinds: tuple[str, ...] = ()) -> float:
        return sum(self._counted(k, self.keep(k, df) if self.keep else df) for k, df in self.edge_tables.items() if not kinds or k in kinds)

    def _counted(self, key: int | str, df: DataFrame) -> int:
        if key not in self._rows:
            self._rows[key] = df.count()
        return self._rows[key]

    def query(self, text: str, parameters: dict | None = None, strict: bool = False, shortest: str | None = None) -> DataFrame:
        """Answer a query; ``shortest`` ('pair' or 'overall') settles undecided all-shortest-path modes."""
        from .plans.compiler import compile_query

        return compile_query(self, text, parameters or {}, strict, shortest)

    def builder(self):
        from .builder import Builder

        return Builder(self)
