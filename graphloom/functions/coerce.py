"""Coercion of source columns to logical types, with the rows that do not cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.keys import as_text, strip

#: Texts that read as true, in lower case; every other text is false.
TRUE_WORDS = ("true", "1", "t", "yes")


def coerce(col: Column, kind: T.DataType, logical: str, nullable: bool = True) -> tuple[Column, Column]:
    """(value of the logical type, whether a value was there that does not cast).

    Blank text in a nullable column is NULL and no failure. Whole numbers must be written as such; arrays are read as JSON, else as {a,"b"}; objects
    that are no JSON are kept as their text.
    """
    text_in = isinstance(kind, T.StringType)
    no = F.lit(False)
    blank = strip(col) == "" if text_in else no
    value = F.when(~blank, col) if text_in and nullable else col
    there = value.isNotNull()
    if logical == "string":
        return as_text(value, kind), no
    if logical == "integer":
        if text_in:
            out = F.when(strip(value).rlike(r"^[+-]?[0-9]+$"), strip(value).try_cast("bigint"))
        elif isinstance(kind, T.BooleanType):
            out = value.cast("int").cast("bigint")
        else:
            out = value.try_cast("bigint")
        return out, there & out.isNull()
    if logical == "float":
        out = (strip(value) if text_in else value.cast("int") if isinstance(kind, T.BooleanType) else value).try_cast("double")
        return out, there & out.isNull()
    if logical == "boolean":
        if text_in:
            return F.lower(value).isin(*TRUE_WORDS), no
        out = value if isinstance(kind, T.BooleanType) else value.try_cast("double") != 0 if isinstance(kind, T.NumericType) else value.isNotNull()
        return out, no
    if logical == "array":
        if isinstance(kind, T.ArrayType):
            return value.cast("array<string>"), no
        if not text_in:
            return F.when(there, F.array(as_text(value, kind))), no
        as_json = F.from_json(value, "array<string>")
        inner = F.regexp_extract(strip(value), r"^\{(.*)\}$", 1)
        braces = F.when(
            strip(value).rlike(r"^\{.*\}$"),
            F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.btrim(F.btrim(x), F.lit('"')))),
        )
        out = F.coalesce(F.when(strip(value).startswith("["), as_json), braces)
        return out, there & out.isNull()
    if logical == "object":
        if isinstance(kind, T.VariantType):
            return value, no
        if text_in:
            return F.coalesce(F.try_parse_json(value), value.cast("variant")), no
        if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            return F.parse_json(F.to_json(value)), no
        return value.cast("variant"), no
    raise ValueError(f"unknown logical type: {logical}")
