"""Source type names, logical types and Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

LOGICAL_TYPES = ("integer", "float", "boolean", "string", "object", "array")

#: Base names of source types by logical type; any other name is a string.
SOURCE_TYPES = {
    "integer": "integer int int2 int4 int8 int16 int32 int64 int128 int256 bigint smallint tinyint mediumint serial bigserial smallserial oid year uint8 uint16 uint32 uint64 uint128 uint256",
    "float": "numeric decimal decimal32 decimal64 decimal128 decimal256 real float float4 float8 float32 float64 number fixed",
    "boolean": "boolean bool",
    "object": "json jsonb variant object map tuple geography geometry",
    "array": "array vector",
}
_LOGICAL = {name: logical for logical, names in SOURCE_TYPES.items() for word in names.split(" ") for name in (word,)} | {"double precision": "float", "double": "float"}

#: Spark type of each logical type.
SPARK_TYPES = {
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "object": T.VariantType(),
    "array": T.ArrayType(T.StringType()),
}


def clean_type(source: str) -> str:
    """A type name without the wrappers Nullable(...) and LowCardinality(...)."""
    text = source.strip()
    while m := re.fullmatch(r"(?:Nullable|LowCardinality)\((.*)\)", text, re.I | re.S):
        text = m[1].strip()
    return text


def logical_type(source: str) -> str:
    """The logical type of a source type name: case, length and precision do not matter."""
    text = source.strip().lower()
    if "[]" in text or text.startswith("array"):
        return "array"
    return _LOGICAL.get(text.split("(", 1)[0].strip(), "string")


def logical_of_spark(kind: T.DataType) -> str:
    """The logical type of a Spark type."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return "integer"
    if isinstance(kind, T.NumericType):
        return "float"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType, T.VariantType)):
        return "object"
    return "string"


#: Source type names for columns read by Spark.
SOURCE_OF_SPARK = {"integer": "bigint", "float": "double precision", "boolean": "boolean", "object": "jsonb", "array": "text[]"}


def source_type(kind: T.DataType) -> str:
    """A source type name for a Spark type."""
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return SOURCE_OF_SPARK.get(logical_of_spark(kind), "text")
