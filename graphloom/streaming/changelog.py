"""Change-log formats parsed to one event table, all by column expressions.

An event has op (INSERT, UPDATE, DELETE), schema_name, table_name, new_row and old_row (JSON text
of the columns, NULL if absent or empty), lsn (text), transaction_id and the passed-through
columns. Input that is no change is dropped: bad JSON, unknown or missing operations, no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = ("op", "schema_name", "table_name", "new_row", "old_row", "lsn", "transaction_id")


def lsn_number(lsn: Column) -> Column:
    """A log position as a number: `hi/lo` in hexadecimal, else a decimal number; NULL if neither."""
    high, low = F.split_part(lsn, F.lit("/"), F.lit(1)), F.split_part(lsn, F.lit("/"), F.lit(2))
    pair = F.conv(high, 16, 10).cast("decimal(20,0)") * 4294967296 + F.conv(low, 16, 10).cast("decimal(20,0)")
    return F.when(lsn.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), pair.try_cast("bigint")).otherwise(lsn.try_cast("bigint"))


def _text(df: DataFrame, value: str) -> Column:
    return F.decode(F.col(value), "utf-8") if dict(df.dtypes)[value] == "binary" else F.col(value)


def _row(path: str) -> Column:
    """JSON text of a row object, NULL if it is no object or an empty one."""
    return F.expr(f"CASE WHEN schema_of_variant({path}) LIKE 'OBJECT%' AND to_json({path}) <> '{{}}' THEN to_json({path}) END")


def _plain(path: str) -> Column:
    return F.expr(f"try_variant_get({path}, '$', 'string')")


def _events(parsed: DataFrame, keep: list[str]) -> DataFrame:
    return parsed.where("op is not null and coalesce(table_name, '') <> ''").select(*EVENT_COLUMNS, *keep)


def parse_debezium(df: DataFrame, value: str = "value") -> DataFrame:
    """Debezium envelopes, under `payload` or not: c and r insert, u updates, d deletes."""
    keep = [c for c in df.columns if c != value]
    doc = df.withColumn("__v", F.try_parse_json(_text(df, value))).withColumn("__p", F.expr("coalesce(try_variant_get(__v, '$.payload', 'variant'), __v)"))
    code = _plain("try_variant_get(__p, '$.op', 'variant')")
    parsed = doc.select(
        F.when(code.isin("c", "r"), "INSERT").when(code == "u", "UPDATE").when(code == "d", "DELETE").alias("op"),
        _plain("try_variant_get(__p, '$.source.schema', 'variant')").alias("schema_name"),
        _plain("try_variant_get(__p, '$.source.table', 'variant')").alias("table_name"),
        _row("try_variant_get(__p, '$.after', 'variant')").alias("new_row"),
        _row("try_variant_get(__p, '$.before', 'variant')").alias("old_row"),
        _plain("try_variant_get(__p, '$.source.lsn', 'variant')").alias("lsn"),
        F.expr("try_variant_get(__p, '$.source.txId', 'bigint')").alias("transaction_id"),
        *keep,
    )
    return _events(parsed, keep)


def parse_flat(df: DataFrame, value: str = "value") -> DataFrame:
    """Flat JSON: operation (any case), schema_name, table_name, new_row, old_row, lsn, transaction_id."""
    keep = [c for c in df.columns if c != value]
    doc = df.withColumn("__v", F.try_parse_json(_text(df, value)))
    code = F.upper(_plain("try_variant_get(__v, '$.operation', 'variant')"))
    parsed = doc.select(
        F.when(code.isin("INSERT", "UPDATE", "DELETE"), code).alias("op"),
        _plain("try_variant_get(__v, '$.schema_name', 'variant')").alias("schema_name"),
        _plain("try_variant_get(__v, '$.table_name', 'variant')").alias("table_name"),
        _row("try_variant_get(__v, '$.new_row', 'variant')").alias("new_row"),
        _row("try_variant_get(__v, '$.old_row', 'variant')").alias("old_row"),
        _plain("try_variant_get(__v, '$.lsn', 'variant')").alias("lsn"),
        F.expr("try_variant_get(__v, '$.transaction_id', 'bigint')").alias("transaction_id"),
        *keep,
    )
    return _events(parsed, keep)


#: A column of a decoded row: name, type in brackets, value that is quoted (quotes doubled) or bare.
_COLUMN = r"""("[^"]+"|[^\s\[\]]+)\[((?:[^\[\]]|\[\])*)\]:('(?:[^']|'')*'|\S+)"""


def _decoded(text: Column) -> Column:
    """JSON text of `name[type]:value ...`: null stays null; numbers and booleans stay bare."""
    part = lambda i: F.regexp_extract_all(text, F.lit(_COLUMN), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("n"), part(3).alias("v"))

    def member(x: Column) -> Column:
        name, v = F.btrim(x["n"], F.lit('"')), x["v"]
        quoted = v.startswith("'")
        inner = F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))
        escape = lambda s: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "\n", "\\\\n"), "\t", "\\\\t"), F.lit('"'))
        bare = F.when(v.isin("null", "true", "false") | v.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), v).otherwise(escape(v))
        return F.concat(escape(name), F.lit(":"), F.when(quoted, escape(inner)).otherwise(bare))

    joined = F.array_join(F.transform(zipped, member), ",")
    return F.when(F.size(zipped) > 0, F.concat(F.lit("{"), joined, F.lit("}")))


def parse_test_decoding(df: DataFrame, value: str = "value") -> DataFrame:
    """Decoded WAL text: `table s.t: OP: col[type]:value ...`, with old-key: and new-tuple: parts.

    BEGIN and COMMIT lines are no changes. lsn and transaction_id come from columns `lsn` and
    `xid` of df, if it has them."""
    keep = [c for c in df.columns if c not in (value, "lsn", "xid")]
    text = _text(df, value)
    head = r"^table ([^\s:]+): (INSERT|UPDATE|DELETE): ?(.*)$"
    name = F.regexp_extract(text, "(?s)" + head, 1)
    op, body = F.regexp_extract(text, "(?s)" + head, 2), F.regexp_extract(text, "(?s)" + head, 3)
    old = F.regexp_extract(body, r"(?s)^old-key: (.*?)(?: new-tuple: .*)?$", 1)
    new = F.when(body.contains("new-tuple: "), F.regexp_extract(body, r"(?s)new-tuple: (.*)$", 1)).otherwise(F.when(body.startswith("old-key: "), F.lit("")).otherwise(body))
    parsed = df.select(
        F.nullif(op, F.lit("")).alias("op"),
        F.when(name.contains("."), F.replace(F.split_part(name, F.lit("."), F.lit(1)), F.lit('"'))).alias("schema_name"),
        F.replace(F.split_part(name, F.lit("."), F.lit(-1)), F.lit('"')).alias("table_name"),
        F.when(op != "DELETE", _decoded(new)).alias("new_row"),
        F.when(op == "DELETE", F.coalesce(_decoded(F.when(old != "", old)), _decoded(body))).otherwise(_decoded(F.when(old != "", old))).alias("old_row"),
        (F.col("lsn").cast("string") if "lsn" in df.columns else F.lit(None).cast("string")).alias("lsn"),
        (F.col("xid").cast("bigint") if "xid" in df.columns else F.lit(None).cast("bigint")).alias("transaction_id"),
        *keep,
    )
    return _events(parsed, keep)


def parse_wal2json(df: DataFrame, value: str = "value") -> DataFrame:
    """wal2json documents, one per transaction: an event per entry of `change`, in order, with its
    place as `ordinal`."""
    keep = [c for c in df.columns if c not in (value, "lsn")]
    doc = df.withColumn("__v", F.try_parse_json(_text(df, value)))
    lsn = F.col("lsn").cast("string") if "lsn" in df.columns else _plain("try_variant_get(__v, '$.nextlsn', 'variant')")
    changes = doc.select(
        F.expr("try_variant_get(__v, '$.xid', 'bigint')").alias("transaction_id"),
        lsn.alias("lsn"),
        F.posexplode(F.expr("try_variant_get(__v, '$.change', 'array<variant>')")).alias("ordinal", "c"),
        *keep,
    )

    def zipped(names: str, values: str) -> Column:
        n, v = f"try_variant_get(c, '$.{names}', 'array<string>')", f"try_variant_get(c, '$.{values}', 'array<variant>')"
        text = f"to_json(map_from_arrays({n}, {v}), map('ignoreNullFields', 'false'))"
        return F.expr(f"CASE WHEN size({n}) > 0 AND size({n}) = size({v}) THEN {text} END")

    kind = F.upper(_plain("try_variant_get(c, '$.kind', 'variant')"))
    parsed = changes.select(
        F.when(kind.isin("INSERT", "UPDATE", "DELETE"), kind).alias("op"),
        _plain("try_variant_get(c, '$.schema', 'variant')").alias("schema_name"),
        _plain("try_variant_get(c, '$.table', 'variant')").alias("table_name"),
        F.when(kind != "DELETE", zipped("columnnames", "columnvalues")).alias("new_row"),
        zipped("oldkeys.keynames", "oldkeys.keyvalues").alias("old_row"),
        "lsn",
        "transaction_id",
        "ordinal",
        *keep,
    )
    return _events(parsed, ["ordinal", *keep])


PARSERS = {"debezium": parse_debezium, "flat": parse_flat, "test_decoding": parse_test_decoding, "wal2json": parse_wal2json}
