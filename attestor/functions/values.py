"""Presence of values, and typed reads of JSON text.

Open records keep their fields as a map from name to JSON text (``'"spin coating"'``, ``'0.84'``,
``'["a", "b"]'``), because one table holds records of any schema. "Has a value" leaves out null, the empty
string and the empty list; ``0`` and ``false`` are values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_VALUE = ("null", '""', "[]")


def is_present(value: Column, kind: str = "string") -> Column:
    """Whether a typed column has a value; ``kind`` is ``string``, ``array``, ``map`` or anything else."""
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    if kind in ("array", "map"):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def json_present(text: Column) -> Column:
    """Whether JSON text has a value."""
    return F.coalesce(~F.trim(text).isin(*NO_VALUE), F.lit(False))


def json_held(text: Column) -> Column:
    """:func:`json_present`, with the empty object as no value, too."""
    return F.coalesce(~F.trim(text).isin(*NO_VALUE, "{}"), F.lit(False))


def json_kind(text: Column) -> Column:
    """``null``, ``boolean``, ``number``, ``string``, ``array`` or ``object`` by the first character."""
    head = F.left(F.ltrim(text), F.lit(1))
    return (
        F.when(text.isNull() | (head == "n"), "null")
        .when(head == '"', "string")
        .when(head == "[", "array")
        .when(head == "{", "object")
        .when(head.isin("t", "f"), "boolean")
        .otherwise("number")
    )


def json_plain(text: Column) -> Column:
    """A JSON string without its quotes and escapes; any other JSON text as it is."""
    return F.when(F.startswith(F.ltrim(text), F.lit('"')), F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")).otherwise(text)


def json_number(text: Column) -> Column:
    """The value of a JSON number, else null."""
    return F.when(json_kind(text) == "number", text.try_cast("double"))


def json_list(text: Column) -> Column:
    """The plain items of a JSON array; a single value as a list of one, null as an empty list."""
    one = F.when(json_present(text), F.array(json_plain(text))).otherwise(F.array().cast("array<string>"))
    return F.when(json_kind(text) == "array", F.from_json(text, "array<string>")).otherwise(one)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` to four digits, 0 where ``whole`` is 0 or less."""
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def confidence(value: Column, default: float) -> Column:
    """A confidence from text or number: not a number becomes ``default``, 0 stays 0, the rest goes into 0 to 1."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(clamp(number, 0.0, 1.0))
