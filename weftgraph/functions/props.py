"""One property value in its readings: typed, text, number, list; absent and null.

A reading is a Column.  Typed columns have their type fixed at compile time,
so comparisons stay plain predicates that reach the scan; free-form values
carry their type in the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def number_text(col: Column) -> Column:
    """Shortest decimal text of a number: whole numbers without a point."""
    whole = (F.abs(col) < 1e15) & (col == F.floor(col))
    return F.when(whole, F.floor(col).cast("bigint").cast("string")).otherwise(col.cast("string"))


@dataclass(frozen=True)
class Prop:
    """A property of a bound node or edge."""

    col: Column
    type: DataType | None  # None: a free-form value

    @property
    def json(self) -> bool:
        return self.type is None

    @property
    def tag(self) -> str:
        """Static type: 'str', 'num', 'bool', 'arr' or 'any'."""
        kinds = ((StringType, "str"), (NumericType, "num"), (BooleanType, "bool"), (ArrayType, "arr"))
        return "any" if self.json else next((t for k, t in kinds if isinstance(self.type, k)), "str")

    @property
    def fractional(self) -> bool:
        return not self.json and self.type.typeName() in ("double", "float", "decimal")

    def missing(self) -> Column:
        """Absent or null."""
        return self.col.isNull() | (self.col["t"] == "null") if self.json else self.col.isNull()

    def text(self) -> Column:
        """Text of a scalar, NULL for absent, null, lists and objects."""
        if self.json:
            return F.when(self.col["t"].isin("str", "num", "numx", "bool"), self.col["txt"])
        if self.tag == "arr":
            return null("string")
        if self.tag == "num" and self.type.typeName() in ("double", "float"):
            return number_text(self.col)
        return self.col.cast("string")

    def own_text(self) -> Column:
        """Operand of text operators: strings as they are, other scalars by their text."""
        return self.col if self.tag == "str" else self.text()

    def cast_to(self, kind: str) -> Column:
        """The text cast to int, bigint, double or boolean; a bad text aborts the query."""
        if self.tag == "num" and kind in ("int", "bigint", "double"):
            # A typed number is compared as the number it is: a fraction is never cut off.
            return self.col if kind != "double" and self.fractional else self.col.cast(kind)
        return self.text().cast(kind)

    def equals(self, value: object) -> Column:
        """Typed equality with a literal: absent is unknown, another type unequal."""
        tag = "str" if isinstance(value, str) else "bool" if isinstance(value, bool) else "num"
        if not self.json:
            if tag == self.tag:
                return self.col == F.lit(value)
            return F.when(self.col.isNotNull(), F.lit(False))
        field = {"str": "txt", "bool": "bool", "num": "num"}[tag]
        same = (self.col["t"] == tag) & (self.col[field] == F.lit(float(value) if tag == "num" else value))
        if tag == "num":
            # A number that a double would not spell the same is compared by its own text.
            exact = F.lit(repr(value)).try_cast("decimal(38,15)")
            same = same | ((self.col["t"] == "numx") & (self.col["txt"].try_cast("decimal(38,15)") == exact))
        return F.when(self.col.isNotNull(), F.coalesce(same, F.lit(False)))

    def key(self) -> Column:
        """What equality with another property and grouping compare: typed, -0 = 0, absent NULL."""
        if not self.json:
            return self.col
        c = self.col
        number = F.when(c["num"] == 0, F.lit(0.0)).otherwise(c["num"])
        return F.when(c.isNotNull(), F.struct(c["t"].alias("t"), F.when(c["t"] != "num", F.coalesce(c["raw"], c["txt"])).alias("text"), number.alias("num")))

    def elements(self) -> Column:
        """Texts of a list's elements."""
        if self.json:
            return F.when(self.col["t"] == "arr", self.col["arr"])
        return self.col.cast("array<string>") if self.tag == "arr" else null("array<string>")

    def output(self) -> Column:
        return self.text() if self.json else self.col
