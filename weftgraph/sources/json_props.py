"""JSON property bags as maps of typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number that reads back the same from a double: no leading zeros, no trailing zeros after the point, no exponent.
_CANONICAL = r"^-?(0|[1-9]\d{0,14})(\.\d*[1-9])?$"


def _held(json: Column) -> Column:
    """The names, texts and shapes of a JSON object in an array of one, so that each is read once a row.

    Functions of such an array's element see values; a column used twice in an
    expression is computed twice.
    """
    # from_json keeps the spelling of numbers and the text of nested values.
    return F.array(F.struct(F.json_object_keys(json).alias("names"), F.from_json(json, "map<string,string>").alias("raws"), F.from_json(json, "map<string,variant>").alias("shapes")))


def _read(held: Column, name: Column) -> Column:
    return F.struct(held["raws"][name].alias("text"), F.schema_of_variant(held["shapes"][name]).alias("shape"))


def _typed(read: Column) -> Column:
    text, shape = read["text"], read["shape"]
    kind = (
        F.when(text.isNull(), "null")
        .when(shape == "STRING", "str")
        .when(shape == "BOOLEAN", "bool")
        .when(shape.startswith("ARRAY"), "arr")
        .when(shape.startswith("OBJECT"), "obj")
        .when(text.rlike(_CANONICAL), "num")
        .otherwise("numx")
    )
    nested = kind.isin("arr", "obj")
    return F.struct(
        kind.alias("t"),
        F.when(~nested, text).alias("txt"),
        F.when(kind.isin("num", "numx"), text.cast("double")).alias("num"),
        F.when(kind == "bool", text.cast("boolean")).alias("bool"),
        F.when(kind == "arr", F.from_json(text, "array<string>")).alias("arr"),
        F.when(nested, text).alias("raw"),
    )


def property_map(json: Column) -> Column:
    """``map<name, struct<t,txt,num,bool,arr,raw>>`` of a JSON object's text; null for none.

    t: null, bool, num, numx (a number whose spelling a double would lose),
    str, arr or obj.  The text of a number is the document's own spelling.
    """
    read = F.transform(_held(json), lambda h: F.struct(h["names"].alias("names"), F.transform(h["names"], lambda n: _read(h, n)).alias("read")))
    return F.transform(read, lambda r: F.map_from_arrays(r["names"], F.transform(r["read"], _typed)))[0]


def property_values(json: Column, names: list[str]) -> Column:
    """One row, for ``inline``, of the values ``p_0``, ``p_1``, ... that ``property_map`` has under ``names``; null for absent.

    A generator computes them once, however often a condition looks at them,
    and no other property is typed.
    """
    places = {f"p_{i}": name for i, name in enumerate(names)}
    read = F.transform(_held(json), lambda h: F.struct(*(F.when(F.array_contains(h["names"], n), _read(h, F.lit(n))).alias(p) for p, n in places.items())))
    return F.transform(read, lambda r: F.struct(*(F.when(r[p].isNotNull(), _typed(r[p])).alias(p) for p in places)))
