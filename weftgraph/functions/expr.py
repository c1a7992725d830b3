"""Expressions to Columns, with the value semantics of the pattern language.

Every operator keeps SQL's three-valued logic.  A property is read as its
partner demands: typed against literals of one type, as text against text
operators and text lists, cast from its text against numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import refuse
from ..plans import ast as A
from .props import Prop, null

AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}


@dataclass(frozen=True)
class Value:
    """type: bool, text, int4, int8, float8, prop, list, node, edge, path, null or datetime."""

    type: str
    col: Column | None = None
    prop: Prop | None = None
    literal: object = None
    #: Literals known at compile time.
    known: bool = False
    items: tuple = ()

    @property
    def numeric(self) -> bool:
        return self.type in ("int4", "int8", "float8")

    def sql_type(self) -> str:
        return {"text": "string", "int4": "int", "int8": "bigint", "float8": "double", "bool": "boolean", "null": "string"}.get(self.type, "string")

    def text(self) -> Column:
        if self.prop:
            return self.prop.own_text()
        if self.type in ("text", "null"):
            return self.col
        return self.col.cast("string")

    def plain(self) -> Column:
        """The value as an output column."""
        return self.prop.output() if self.prop else self.col

    def key(self) -> Column:
        return self.prop.key() if self.prop else self.col


def literal(value: object) -> Value:
    if value is None:
        return Value("null", null("string"), known=True)
    if isinstance(value, bool):
        return Value("bool", F.lit(value), literal=value, known=True)
    if isinstance(value, int):
        return Value("int8", F.lit(value).cast("bigint"), literal=value, known=True)
    if isinstance(value, float):
        return Value("float8", F.lit(value), literal=value, known=True)
    if isinstance(value, (list, tuple)):
        return Value("list", F.array(*map(F.lit, value)), literal=tuple(value), known=True, items=tuple(map(literal, value)))
    return Value("text", F.lit(str(value)), literal=str(value), known=True)


def regex_pattern(pattern: str) -> str:
    """A search pattern as Java reads it: dots match line ends, a closing $ only the very end."""
    flags = "(?s)"
    if pattern.startswith("(?i)"):
        flags, pattern = "(?si)", pattern[4:]
    if pattern.endswith("$") and not re.search(r"(?<!\\)(?:\\\\)*\\\$$", pattern):
        pattern = pattern[:-1] + r"\z"
    return flags + pattern


class Expressions:
    """Compiles against a frame; ``exists`` gives the marker column of a nested pattern predicate."""

    def __init__(self, graph, frame, parameters: dict, exists=None) -> None:
        self.graph, self.frame, self.parameters, self.exists = graph, frame, parameters, exists

    def condition(self, node) -> Column:
        value = self.value(node)
        if value.type == "prop":
            return value.prop.cast_to("boolean")
        if value.type not in ("bool", "null"):
            raise refuse("a condition that is not boolean")
        return value.col.cast("boolean")

    def value(self, node, negated: bool = False) -> Value:
        return getattr(self, "_" + type(node).__name__.lower())(node, negated)

    # Leaves.
    def _literal(self, node: A.Literal, _) -> Value:
        return literal(node.value)

    def _parameter(self, node: A.Parameter, _) -> Value:
        if node.name not in self.parameters:
            raise refuse(f"no value for ${node.name}", "params")
        return literal(self.parameters[node.name])

    def _listliteral(self, node: A.ListLiteral, _) -> Value:
        items = tuple(self.value(i) for i in node.items)
        kinds = {"number" if i.numeric else i.type for i in items}
        if len(kinds) > 1 or kinds & {"null", "list", "node", "edge"}:
            raise refuse("a list of mixed, null or nested elements")
        return Value("list", F.array(*(i.plain() for i in items)), literal=tuple(i.literal for i in items), known=all(i.known for i in items), items=items)

    def _variable(self, node: A.Variable, _) -> Value:
        symbol = self.frame.bound(node.name)
        if symbol is None:
            raise refuse(f"unknown name {node.name}")
        if symbol.kind in ("node", "edge"):
            return Value(symbol.kind, symbol.col("id"))
        if symbol.kind == "scalar":
            if symbol.type == "prop":
                return Value("prop", symbol.col("value"), Prop(symbol.col("value"), None))
            return Value(symbol.type, symbol.col("value"))
        if symbol.kind == "path":
            return Value("path", F.struct(symbol.col("nodes").alias("nodes"), symbol.col("edges").alias("edges")))
        if symbol.kind == "trail":
            return Value("list", symbol.col("edges"))
        raise refuse(f"{node.name} can only be used with IN")

    def _property(self, node: A.Property, _) -> Value:
        if isinstance(node.owner, A.Call) and node.owner.name == "datetime" and not node.owner.args:
            return self._clock(node.name)
        if not isinstance(node.owner, A.Variable):
            raise refuse("a property of an expression")
        symbol = self.frame.bound(node.owner.name)
        if symbol is None or symbol.kind not in ("node", "edge"):
            raise refuse(f"a property of {node.owner.name}")
        if node.name not in symbol.props:
            raise refuse(f"property {node.name} was not carried")
        col = F.col(symbol.props[node.name])
        kind = None if self.graph.json else self.graph.prop_type(node.name, symbol.kind == "edge")
        return Value("prop", col, Prop(col, kind))

    def _clock(self, part: str) -> Value:
        now = self.graph.now
        if part == "epochseconds":
            return Value("int8", F.lit(now).cast("bigint") if now is not None else F.unix_timestamp())
        if part == "epochmillis":
            return Value("int8", F.lit(now * 1000).cast("bigint") if now is not None else F.unix_millis(F.current_timestamp()))
        raise refuse(f"datetime().{part}")

    # Boolean algebra.
    def _unary(self, node: A.Unary, negated: bool) -> Value:
        if node.op == "not":
            inner = self.value(node.value, not negated)
            return Value("bool", ~(inner.prop.cast_to("boolean") if inner.prop else inner.col.cast("boolean")))
        inner = self.value(node.value)
        if not inner.numeric:
            raise refuse("minus of a value that is not a number")
        return Value(inner.type, -inner.col)

    def _binary(self, node: A.Binary, negated: bool) -> Value:
        op = node.op
        if op in ("and", "or"):
            left, right = (self._truth(x, negated) for x in (node.left, node.right))
            return Value("bool", left & right if op == "and" else left | right)
        if op == "xor":
            return Value("bool", self._truth(node.left, False) != self._truth(node.right, False))
        if op in ("=", "<>"):
            same = self._equal(self.value(node.left), self.value(node.right))
            return Value("bool", same if op == "=" else ~same)
        if op in ("<", "<=", ">", ">="):
            return Value("bool", self._ordered(op, self.value(node.left), self.value(node.right)))
        if op == "in":
            return Value("bool", self._in(node))
        if op in ("starts", "ends", "contains"):
            return Value("bool", self._text_match(op, node, negated))
        if op == "=~":
            pattern = self.value(node.right)
            if not pattern.known or pattern.type != "text":
                raise refuse("a pattern that is not a literal")
            return Value("bool", self.value(node.left).text().rlike(regex_pattern(str(pattern.literal))))
        return self._arithmetic(op, self.value(node.left), self.value(node.right))

    def _truth(self, node, negated: bool) -> Column:
        value = self.value(node, negated)
        return value.prop.cast_to("boolean") if value.prop else value.col.cast("boolean")

    def _haskinds(self, node: A.HasKinds, _) -> Value:
        symbol = self.frame.bound(node.owner.name)
        if symbol is None or symbol.kind not in ("node", "edge"):
            raise refuse(f"kinds of {node.owner.name}")
        if symbol.kind == "edge":
            return Value("bool", F.lit(True) if len(set(node.kinds)) == 0 else F.lit(False) if len(set(node.kinds)) > 1 else symbol.col("kind") == node.kinds[0])
        out = F.lit(True)
        for kind in node.kinds:
            out = out & F.array_contains(symbol.col("kinds"), kind)
        return Value("bool", out)

    def _exists(self, node: A.Exists, _) -> Value:
        if self.exists is None:
            raise refuse("a pattern predicate here")
        return Value("bool", self.exists(node))

    def _isnull(self, node: A.IsNull, _) -> Value:
        value = self.value(node.value)
        missing = value.prop.missing() if value.prop else value.col.isNull()
        return Value("bool", ~missing if node.negated else missing)

    # Comparisons.
    def _equal(self, left: Value, right: Value) -> Column:
        if left.type == "null" or right.type == "null":
            return null("boolean")
        if left.type in ("node", "edge") or right.type in ("node", "edge"):
            if left.type != right.type:
                raise refuse("comparison of unlike entities")
            return left.col == right.col
        if right.prop and not left.prop:
            left, right = right, left
        if left.prop and right.prop:
            if left.prop.json:
                return F.when(left.col.isNotNull() & right.col.isNotNull(), left.key().eqNullSafe(right.key()))
            if left.prop.tag != right.prop.tag:
                return F.when(left.col.isNotNull() & right.col.isNotNull(), F.lit(False))
            return left.col == right.col
        if left.prop:
            if right.type == "list":
                return self._equal_list(left.prop, right)
            if right.known:
                return left.prop.equals(right.literal)
            if right.type == "text":
                return left.prop.text() == right.col
            return left.prop.cast_to(right.sql_type()) == right.col
        if left.numeric and right.numeric or left.type == right.type:
            return left.col == right.col
        raise refuse(f"comparison of {left.type} and {right.type}")

    @staticmethod
    def _equal_list(prop: Prop, right: Value) -> Column:
        number = bool(right.items) and right.items[0].numeric
        held = F.transform(prop.elements(), lambda x: x.cast("double")) if number else prop.elements()
        wanted = F.array(*(i.col.cast("double" if number else "string") for i in right.items)) if right.items else F.array().cast("array<string>")
        return F.when(prop.col.isNotNull(), F.coalesce(held == wanted, F.lit(False)))

    @staticmethod
    def _ordered(op: str, left: Value, right: Value) -> Column:
        compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
        for value in (left, right):
            if value.type in ("node", "edge", "path", "bool", "list"):
                raise refuse(f"order of {value.type}")
        if left.prop and right.prop:
            if left.prop.json or right.prop.json:
                raise refuse("order of two free-form properties", "collation")
            return compare(left.col, right.col)
        a = left.prop.cast_to(right.sql_type()) if left.prop and right.numeric else left.text() if right.type == "text" else left.plain()
        b = right.prop.cast_to(left.sql_type()) if right.prop and left.numeric else right.text() if left.type == "text" else right.plain()
        return compare(a, b)

    def _in(self, node: A.Binary) -> Column:
        if isinstance(node.right, A.Variable) and (symbol := self.frame.bound(node.right.name)) and symbol.kind == "collected":
            if "value" not in symbol.columns:
                raise refuse("membership in a collection inside OR")
            return F.array_contains(symbol.col("value"), self.value(node.left).col)
        left, right = self.value(node.left), self.value(node.right)
        if right.prop:
            # An element of a stored list, read as the literal's type.
            if left.numeric:
                return F.array_contains(F.transform(right.prop.elements(), lambda x: x.cast("double")), left.col.cast("double"))
            return F.array_contains(right.prop.elements(), left.text())
        if right.type != "list":
            raise refuse("IN without a list")
        if not right.items and right.known:
            return F.lit(False)
        if not right.items:
            return F.array_contains(right.col, left.plain())
        if left.prop:
            if right.items[0].type == "text":
                inside = left.prop.text().isin([i.literal for i in right.items]) if right.known else F.array_contains(right.col, left.prop.text())
                if left.prop.json:
                    inside = F.when(left.col["t"].isin("arr", "obj"), F.lit(False)).otherwise(inside)
                return inside
            if right.items[0].type == "bool":
                return left.prop.cast_to("boolean").isin([i.literal for i in right.items])
            kind = "double" if left.prop.fractional or any(i.type == "float8" for i in right.items) else "bigint"
            return left.prop.cast_to(kind).isin([i.literal for i in right.items])
        return left.col.isin([i.literal for i in right.items]) if right.known else F.array_contains(right.col, left.col)

    def _text_match(self, op: str, node: A.Binary, negated: bool) -> Column:
        left, right = self.value(node.left), self.value(node.right)
        if left.prop and right.known and right.type == "text":
            # A plain property: the needle is literal; under NOT an absent property is the empty text.
            text = left.prop.own_text()
            if negated:
                text = F.coalesce(text, F.lit(""))
            return {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[op](text, F.lit(right.literal))
        # Any other operand goes through LIKE with the needle as it is.
        needle = right.text()
        if right.known and isinstance(right.literal, str) and (len(right.literal) - len(right.literal.rstrip("\\"))) % 2:
            raise refuse("a needle that ends in a lone backslash")
        pattern = F.concat(F.lit("" if op == "starts" else "%"), needle, F.lit("" if op == "ends" else "%"))
        return F.like(left.text(), pattern)

    # Arithmetic.
    def _arithmetic(self, op: str, left: Value, right: Value) -> Value:
        if op == "+" and ("text" in (left.type, right.type)):
            return Value("text", F.concat(left.text(), right.text()))
        order = ("int4", "int8", "float8")
        for value in (left, right):
            if not value.numeric and not value.prop:
                raise refuse(f"arithmetic on {value.type}")
        kinds = [v.type for v in (left, right) if v.numeric]
        if not kinds:
            kinds = ["float8" if p.json or p.type.typeName() in ("double", "float") else "int8" for p in (left.prop, right.prop)]
        for value in (left, right):
            if value.prop and not value.prop.json and value.prop.tag == "num":
                kinds.append("float8" if value.prop.type.typeName() in ("double", "float", "decimal") else "int8")
        kind = max(kinds, key=order.index)
        sql = {"int4": "int", "int8": "bigint", "float8": "double"}[kind]
        a, b = ((v.prop.cast_to(sql) if v.prop else v.col.cast(sql)) for v in (left, right))
        if op == "/":
            if kind != "float8":
                raise refuse("division of whole numbers")
            return Value(kind, a / b)
        return Value(kind, {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b}[op]())

    def _case(self, node: A.Case, _) -> Value:
        out, kinds = None, []
        for test, then in node.whens:
            condition = self.condition(test) if node.subject is None else self._equal(self.value(node.subject), self.value(test))
            value = self.value(then)
            kinds.append(value)
            out = F.when(condition, value.plain()) if out is None else out.when(condition, value.plain())
        if node.default is not None:
            kinds.append(self.value(node.default))
            out = out.otherwise(kinds[-1].plain())
        kind = next((k.type for k in kinds if k.type not in ("null", "prop")), "text")
        return Value(kind, out)

    # Functions.
    def _call(self, node: A.Call, _) -> Value:
        name = node.name
        if name in AGGREGATES:
            raise refuse(f"{name} outside WITH and RETURN")
        if name == "coalesce":
            return self._coalesce([self.value(a) for a in node.args])
        one = {"id", "labels", "type", "tolower", "toupper", "size", "length", "nodes", "relationships", "trim", "abs", "tointeger", "tofloat", "tostring"}
        if name not in one | {"split", "substring", "replace"} or not node.args or name in one and len(node.args) != 1:
            raise refuse(f"function {name}")
        symbol = self.frame.bound(node.args[0].name) if isinstance(node.args[0], A.Variable) else None
        if name == "id" and symbol and symbol.kind in ("node", "edge"):
            return Value("int8", symbol.col("id").cast("bigint"))
        if name == "labels" and symbol and symbol.kind == "node":
            return Value("list", symbol.col("kinds"))
        if name == "type" and symbol and symbol.kind == "edge":
            return Value("text", symbol.col("kind"))
        if symbol and symbol.kind == "path" and name in ("length", "nodes", "relationships"):
            return Value("int8", F.size(symbol.col("edges")).cast("bigint")) if name == "length" else Value("list", symbol.col("nodes" if name == "nodes" else "edges"))
        if name in ("id", "labels", "type", "length", "nodes", "relationships"):
            raise refuse(f"{name} of this argument")
        args = [self.value(a) for a in node.args]
        first = args[0]
        if name == "size":
            if first.prop:
                return Value("int4", F.size(first.prop.elements()).cast("int"))
            return Value("int4", F.size(first.col) if first.type == "list" else F.length(first.text()))
        if name in ("tolower", "toupper", "trim"):
            return Value("text", {"tolower": F.lower, "toupper": F.upper, "trim": F.trim}[name](first.text()))
        if name == "split":
            return Value("list", self._split(first.text(), args[1]))
        if name == "substring":
            start = args[1].plain().cast("int") + 1
            return Value("text", F.substring(first.text(), start, args[2].plain().cast("int") if len(args) > 2 else F.lit((1 << 31) - 1)))
        if name == "replace":
            return Value("text", F.replace(first.text(), args[1].text(), args[2].text()))
        if name == "tostring":
            return Value("text", first.text())
        number = first.prop.cast_to("double") if first.prop else first.col.cast("double")
        if name == "tointeger":
            return Value("int8", F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
        return Value("float8", F.abs(number) if name == "abs" else number)

    def _coalesce(self, args: list[Value]) -> Value:
        """Properties are read as the type of the last argument that is not one."""
        kind = next((a for a in reversed(args) if not a.prop and a.type != "null"), None)
        if kind is None:
            return Value("text", F.coalesce(*(a.text() for a in args)))
        sql = kind.sql_type()
        parts = [a.prop.own_text() if a.prop and sql == "string" else a.prop.cast_to(sql) if a.prop else a.col.cast(sql) for a in args]
        return Value(kind.type, F.coalesce(*parts))

    @staticmethod
    def _split(text: Column, by: Value) -> Column:
        """A literal separator: '' gives no parts, an empty separator the text, a null one its characters."""
        if by.type == "null":
            return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
        if not by.known:
            raise refuse("split by a computed separator")
        whole = F.array(text) if by.literal == "" else F.split(text, re.escape(str(by.literal)))
        return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), whole)


def entity_struct(symbol, names: list[str]) -> Column:
    """A bound node or edge as one output column."""
    parts = ["id", "kinds"] if symbol.kind == "node" else ["id", "src", "dst", "kind"]
    fields = [symbol.col(p).alias(p) for p in parts if p in symbol.columns]
    props = [F.col(symbol.props[n]).alias(n) for n in names if n in symbol.props]
    return F.struct(*fields, *([F.struct(*props).alias("props")] if props else []))


__all__ = ["AGGREGATES", "Expressions", "Value", "entity_struct", "literal", "regex_pattern"]
