"""Schemas that drift between files (problem 2).

Rescue-column ingestion: each file's table objects are read into one target schema; fields that
the target does not know, or that do not cast, stay as JSON in a rescue column. Approved aliases
are promoted: their rescued values are replayed into the typed columns, from the stored column,
also when they are approved later. The ingested table keeps an inventory of the fields as received
(name, type, digest of the value), from which the list of changes is read: it compares each table
with that in the file before it of the same origin.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.scan import annotate_groups
from graphloom.plans.runtime import cut


#: The places of files are broadcast while the counted rows, at STEP_BYTES each, stay under this size.
BROADCAST_BYTES, STEP_BYTES = 16 << 20, 128


@dataclass(frozen=True)
class Target:
    """Target columns with their type (string, boolean, array<string> or json), and for each the
    aliases approved for promotion, tried in order."""

    columns: dict[str, str]
    promoted: dict[str, tuple[str, ...]] = field(default_factory=dict)


#: The table objects of the schema snapshots.
SNAPSHOT_TARGET = Target(
    columns={
        "name": "string",
        "columns": "json",
        "primary_key": "array<string>",
        "foreign_keys": "json",
        "is_partitioned": "boolean",
        "partition_of": "string",
    },
    promoted={
        "primary_key": ("primary_keys", "primaryKey", "pk_columns", "key_columns", "pk"),
        "is_partitioned": ("isPartitioned", "partitioned", "has_partitions", "is_part"),
    },
)


def explode_fields(files: DataFrame) -> DataFrame:
    """(file_id, origin, captured_at, received_at, body_digest, table_name, table_json, fields map<string,variant>) per table object.

    A body that is no JSON object with `tables`, or a NULL one, has no tables. An entry that is no
    object has a NULL map.
    """
    tables = F.expr("try_variant_get(try_parse_json(body), '$.tables', 'map<string,variant>')")
    return files.select("file_id", "origin", "captured_at", "received_at", F.md5("body").alias("body_digest"), F.explode(tables).alias("table_name", "table_json")).withColumn(
        "fields", F.expr("try_cast(table_json AS map<string,variant>)")
    )


def _kind(variant: str) -> str:
    """SQL for the plain kind of a variant: string, number, boolean, object, array, null."""
    text = f"schema_of_variant({variant})"
    return (
        f"CASE WHEN {variant} IS NULL THEN 'null' WHEN {text} LIKE 'OBJECT%' THEN 'object' WHEN {text} LIKE 'ARRAY%' THEN 'array' "
        f"WHEN {text} = 'STRING' THEN 'string' WHEN {text} = 'BOOLEAN' THEN 'boolean' WHEN {text} = 'VOID' THEN 'null' ELSE 'number' END"
    )


def _typed(variant: str, kind: str) -> Column:
    """The variant as the target type, NULL where it does not cast. A lone string is an array of
    one (comma-separated names: of each); an object with `columns` or `value` stands for that member."""
    inner = f"coalesce(try_variant_get({variant}, '$.columns', 'variant'), try_variant_get({variant}, '$.value', 'variant'), {variant})"
    if kind == "json":
        return F.expr(f"CASE WHEN is_variant_null({variant}) THEN NULL ELSE to_json({variant}) END")
    if kind == "array<string>":
        return F.expr(
            f"CASE WHEN {_kind(inner)} = 'string' THEN transform(split(try_variant_get({inner}, '$', 'string'), ','), x -> trim(x)) "
            f"WHEN {_kind(inner)} = 'array' THEN try_variant_get({inner}, '$', 'array<string>') END"
        )
    if kind == "boolean":
        return F.expr(
            f"CASE WHEN {_kind(inner)} = 'object' THEN NULL "
            f"WHEN {_kind(inner)} = 'string' THEN CASE WHEN lower(try_variant_get({inner}, '$', 'string')) IN ('true','t','yes','y','1') THEN true "
            f"WHEN lower(try_variant_get({inner}, '$', 'string')) IN ('false','f','no','n','0') THEN false END "
            f"ELSE try_variant_get({inner}, '$', 'boolean') END"
        )
    return F.expr(f"CASE WHEN {_kind(variant)} IN ('object','array') THEN NULL ELSE try_variant_get({variant}, '$', '{kind}') END")


def _inventory() -> Column:
    """The fields of a table object as received: name, kind, kind of the first element of an array
    (NULL if there is none), and a digest of the value as canonical JSON (keys in order).

    Canonical JSON has no white space, so its first characters tell the kinds."""
    kinds = {'"': "string", "{": "object", "[": "array", "t": "boolean", "f": "boolean", "n": "null"}
    kind = lambda mark: f"CASE {mark} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in kinds.items())} ELSE 'number' END"
    texts = "transform(map_entries(fields), e -> named_struct('name', e.key, 'json', to_json(e.value)))"
    element = f"CASE WHEN substr(e.json, 1, 1) = '[' AND e.json <> '[]' THEN {kind('substr(e.json, 2, 1)')} END"
    return F.expr(f"transform({texts}, e -> named_struct('name', e.name, 'kind', {kind('substr(e.json, 1, 1)')}, 'element', {element}, 'digest', md5(e.json)))")


def column_of(name: str) -> str:
    """The column of a target field; that of `columns` has a name of its own."""
    return f"tbl_{name}" if name == "columns" else name


def ingest(files: DataFrame, target: Target = SNAPSHOT_TARGET, replayed: bool = True) -> DataFrame:
    """One consistent table: a row per file and table object with the target's typed columns,
    `rescued` (JSON of unknown and uncastable fields, NULL if there are none), `promoted_from`
    (target columns that were filled from an alias, with the alias), `received` (an inventory of
    all fields of the object, NULL if it is no object) and `body_digest`.

    Every field of every file ends up in a typed column or in `rescued`. Without `replayed` the
    approved aliases stay in `rescued`. Files that come twice give rows twice (their ids differ).
    NULL and malformed bodies give no rows.
    """
    out = explode_fields(files)
    for name, kind in target.columns.items():
        out = out.withColumn(f"own_{name}", _typed(f"fields['{name}']", kind))
    tests = [f"(k = '{n}' AND (own_{n} IS NOT NULL OR is_variant_null(v)))" for n in target.columns]
    out = out.withColumn("rescue_map", F.expr(f"map_filter(fields, (k, v) -> NOT ({' OR '.join(tests)}))"))
    table = out.select(
        "file_id",
        "origin",
        "captured_at",
        "table_name",
        *[F.col(f"own_{name}").alias(column_of(name)) for name in target.columns],
        F.when(F.size("rescue_map") > 0, F.to_json("rescue_map")).when(F.col("fields").isNull(), F.to_json("table_json")).alias("rescued"),
        F.lit(None).cast("string").alias("promoted_from"),
        _inventory().alias("received"),
        "body_digest",
    )
    return replay(table, target) if replayed else table


def replay(table: DataFrame, target: Target) -> DataFrame:
    """An ingested table with the rescued values of the target's approved aliases replayed into its
    typed columns: where a column is NULL, the first alias whose rescued value casts fills it,
    leaves `rescued` and is noted in `promoted_from`. Values that do not cast stay rescued.

    Aliases that are approved after the ingestion are replayed from the stored table alone.
    """
    promoted = {name: aliases for name, aliases in target.promoted.items() if aliases}
    if not promoted:
        return table
    out = table.withColumn("rescue_map", F.expr("try_cast(try_parse_json(rescued) AS map<string,variant>)"))
    change: dict[str, Column] = {}
    for name, aliases in promoted.items():
        for alias in aliases:
            out = out.withColumn(f"alias_{name}_{alias}", _typed(f"rescue_map['{alias}']", target.columns[name]))
        free = F.col(column_of(name)).isNull()
        out = out.withColumn(f"from_{name}", F.coalesce(*[F.when(free & F.col(f"alias_{name}_{a}").isNotNull(), F.lit(a)) for a in aliases]))
        change[column_of(name)] = F.coalesce(column_of(name), *[F.when(F.col(f"from_{name}") == a, F.col(f"alias_{name}_{a}")) for a in aliases])
    moved = reduce(lambda a, b: a | b, [F.col(f"from_{n}").isNotNull() for n in promoted])
    left = F.expr(f"map_filter(rescue_map, (k, v) -> NOT ({' OR '.join(f'coalesce(k = from_{n}, false)' for n in promoted)}))")
    notes = [F.when(F.col(f"from_{n}").isNotNull(), F.concat(F.lit(f"{n}<-"), F.col(f"from_{n}"))) for n in promoted]
    change["rescued"] = F.when(~moved, F.col("rescued")).when(F.size(left) > 0, F.to_json(left))
    change["promoted_from"] = F.nullif(F.concat_ws(",", "promoted_from", *notes), F.lit(""))
    return out.select([change[c].alias(c) if c in change else F.col(c) for c in table.columns])


def typed_summary(table: DataFrame, target: Target = SNAPSHOT_TARGET) -> DataFrame:
    """An ingested table with its lists as comma-separated text, without its JSON columns, and with
    the names of the rescued and of all received fields in order."""
    cells = [F.array_join(n, ",").alias(n) if k == "array<string>" else F.col(n) for n, k in target.columns.items() if k != "json"]
    rescued = F.array_sort(F.map_keys(F.expr("try_cast(try_parse_json(rescued) AS map<string,variant>)")))
    listed = lambda names: F.coalesce(F.array_join(names, ","), F.lit(""))
    return table.select(
        "file_id", "origin", "captured_at", "table_name", *cells, listed(rescued).alias("rescued_fields"),
        listed(F.array_sort(F.expr("received.name"))).alias("received_fields"), F.coalesce("promoted_from", F.lit("")).alias("promoted_from"),
    )


def _steps(files: DataFrame) -> DataFrame:
    """(file_id, body_digest, place, next_id): the files of each origin in order.

    Of several rows with one file_id the first by captured_at, origin and digest of the body counts.
    """
    version = F.struct("captured_at", "origin", F.md5("body").alias("body_digest"))
    keys = files.groupBy("file_id").agg(F.min(version).alias("v")).select("file_id", "v.*")
    ordered = annotate_groups(keys, "origin", ["captured_at", "file_id"], number="place", lead={"file_id": "next_id"})
    return cut(ordered.select("file_id", "body_digest", "place", "next_id"))


def field_changes(files: DataFrame) -> DataFrame:
    """(file_id, table_name, old_field, new_field, change_kind) of each file against the one
    before it of its origin, by captured_at, then file_id.

    Kinds: added, removed, renamed (equal values, unique among the vanished and new fields of the
    step), retyped. The fields are those in the inventory of the ingested table; values are
    compared as canonical JSON (keys sorted), by digest. NULL origins form one series. Repeated
    rows of one file_id are one file, rows without one none. A table that appears or disappears as
    a whole is no change; an empty input gives an empty result.
    """
    files = files.where("file_id is not null")
    table = ingest(files, replayed=False).where("received is not null").select("file_id", "body_digest", "table_name", "received")
    steps = _steps(files)
    small = steps.count() * STEP_BYTES <= BROADCAST_BYTES
    placed = table.join(steps.hint("broadcast" if small else "merge"), ["file_id", "body_digest"])
    # Each body is parsed once: a table object counts for the step to its own file and for the next.
    nothing = F.lit(None).cast(table.schema["received"].dataType)
    own = F.struct(F.when(F.col("place") > 0, F.col("file_id")).alias("step"), F.col("received").alias("now"), nothing.alias("was"))
    following = F.struct(F.col("next_id").alias("step"), nothing.alias("now"), F.col("received").alias("was"))
    sides = placed.select("table_name", F.explode(F.array(own, following)).alias("s")).where("s.step is not null").select(F.col("s.step").alias("file_id"), "table_name", "s.now", "s.was")
    both = sides.groupBy("file_id", "table_name").agg(F.first("was", ignorenulls=True).alias("was"), F.first("now", ignorenulls=True).alias("now")).where("was is not null and now is not null")
    # From here on rows stay where the grouping by step and table has put them.
    none = "cast(null as struct<name:string,kind:string,element:string,digest:string>)"
    cells = (
        both.select("file_id", "table_name", F.explode(F.expr(f"concat(transform(was, x -> named_struct('o', x, 'n', {none})), transform(now, x -> named_struct('o', {none}, 'n', x)))")).alias("f"))
        .groupBy("file_id", "table_name", F.coalesce("f.o.name", "f.n.name").alias("f"))
        .agg(F.max("f.o").alias("o"), F.max("f.n").alias("n"))
    )
    elements = "(o.kind = 'array' AND coalesce(o.element <> 'null' AND n.element <> 'null' AND o.element <> n.element, false))"
    retyped = f"(o IS NOT NULL AND n IS NOT NULL AND o.kind <> 'null' AND n.kind <> 'null' AND (o.kind <> n.kind OR {elements}))"
    value = "coalesce(o, n)"
    moves = (
        cells.withColumn("retyped", F.expr(retyped))
        .where("retyped OR o IS NULL OR n IS NULL")
        .groupBy("file_id", "table_name", "retyped", F.expr(f"CASE WHEN retyped THEN f ELSE {value}.digest END").alias("what"), F.expr(f"{value}.kind = 'null'").alias("empty"))
        .agg(F.collect_list(F.expr("CASE WHEN o IS NOT NULL THEN f END")).alias("gone"), F.collect_list(F.expr("CASE WHEN n IS NOT NULL THEN f END")).alias("come"))
    )
    pair = "size(gone) = 1 AND size(come) = 1"
    return moves.select(
        "file_id",
        "table_name",
        F.explode(
            F.expr(
                f"CASE WHEN retyped THEN array(named_struct('o', gone[0], 'n', come[0], 'k', 'retyped')) "
                f"WHEN {pair} AND NOT empty THEN array(named_struct('o', gone[0], 'n', come[0], 'k', 'renamed')) "
                "ELSE concat(transform(gone, x -> named_struct('o', x, 'n', '', 'k', 'removed')), transform(come, x -> named_struct('o', '', 'n', x, 'k', 'added'))) END"
            )
        ).alias("c"),
    ).select("file_id", "table_name", F.col("c.o").alias("old_field"), F.col("c.n").alias("new_field"), F.col("c.k").alias("change_kind"))
