"""What a name stands for while a query is compiled, and the rows so far."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import refuse


@dataclass
class Symbol:
    """kind: node, edge, trail, path, scalar or collected.

    ``columns`` maps id, kinds, src, dst, kind, nodes, edges or value to
    column names, ``props`` property names to column names.
    """

    kind: str
    columns: dict[str, str] = field(default_factory=dict)
    props: dict[str, str] = field(default_factory=dict)
    type: str = ""
    relation: DataFrame | None = None

    def col(self, name: str) -> Column:
        if name not in self.columns:
            raise refuse(f"{name} of a {self.kind}")
        return F.col(self.columns[name])

    def all_columns(self) -> list[str]:
        return [*self.columns.values(), *self.props.values()]


@dataclass
class Frame:
    """Rows so far (None: one empty row) and the names bound in them."""

    df: DataFrame | None = None
    symbols: dict[str, Symbol] = field(default_factory=dict)

    def bound(self, name: str | None) -> Symbol | None:
        return self.symbols.get(name) if name else None

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.symbols.values() for c in s.all_columns()))

    def trimmed(self) -> DataFrame:
        return self.df.select(*self.columns())
