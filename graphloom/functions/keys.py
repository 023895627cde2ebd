"""Keys as pure column expressions: stable text, injective escaping, joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that a key may hold besides letters and digits.
KEY_MARKS = "_-:.@()+,=;$!*'"
#: Fixed value: what counts as white space at the ends of key text.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def as_text(col: Column, kind: T.DataType) -> Column:
    """The one text form of a value, alike on vertex and edge side.

    Timestamps have a blank between date and time and six fraction digits or none; booleans are
    true/false; floats that are whole numbers have one decimal.
    """
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        micros = F.date_format(col, "SSSSSS")
        return F.concat(F.date_format(col, "yyyy-MM-dd HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
    if isinstance(kind, T.BinaryType):
        return F.decode(col, "utf-8")
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.to_json(col)
    return col.cast("string")


def escape(text: Column) -> Column:
    """text with every character but letters, digits and KEY_MARKS percent-encoded as UTF-8.

    The escape character itself is encoded, so different texts have different keys.
    """
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for mark in ":@()+,=;$!'":
        out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return F.replace(out, F.lit("~"), F.lit("%7E"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


#: Types whose text holds only characters that a key may hold.
PLAIN_TYPES = (T.IntegralType, T.BooleanType, T.DateType)


def key_part(col: Column, kind: T.DataType, trim: bool = False) -> Column:
    """The escaped text of a value; escaping is left out where the type makes it needless."""
    text = as_text(col, kind)
    if isinstance(kind, PLAIN_TYPES):
        return text
    return escape(strip(text) if trim else text)


def key(parts: list[tuple[Column, T.DataType]], separator: str = "_", trim: bool = False) -> Column:
    """The key of its parts in order; NULL if any part is NULL."""
    texts = [key_part(c, k, trim) for c, k in parts]
    present = texts[0].isNotNull()
    for text in texts[1:]:
        present = present & text.isNotNull()
    return F.when(present, F.concat_ws(separator, *texts))


def content_key(parts: list[tuple[Column, T.DataType]]) -> Column:
    """A key made of the whole row, for rows that have none of their own: equal rows share it."""
    texts = [F.coalesce(as_text(c, k), F.lit("\x1e")) for c, k in parts]
    return F.md5(F.concat_ws("\x1f", *texts))


def present(col: Column, kind: T.DataType) -> Column:
    """Whether a value is neither NULL nor blank text."""
    if isinstance(kind, T.StringType):
        return F.coalesce(strip(col) != "", F.lit(False))
    return col.isNotNull()
