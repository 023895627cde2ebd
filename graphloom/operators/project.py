"""Projection of table rows to vertices and edges: one select per set, no join.

A vertex set has `_key` and the mapped properties; an edge set has exactly _key, _from, _to and
_label. Only a foreign key that does not point at its target's primary key needs a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import model
from graphloom.functions import expressions as X
from graphloom.functions import keys
from graphloom.functions.coerce import coerce
from graphloom.functions.types import logical_of_spark, logical_type, source_type

EDGE_COLUMNS = ("_key", "_from", "_to", "_label")
#: Columns that may serve as the change time of a table, in order.
SINCE_COLUMNS = ("updated_at", "modified_at", "last_modified", "created_at")


def table_of(df: DataFrame, name: str, primary_key: Iterable[str] = (), foreign_keys: Iterable[model.ForeignKey] = ()) -> model.Table:
    """A table description from a DataFrame's schema."""
    pk = list(primary_key)
    columns = [model.Column(f.name, source_type(f.dataType), f.name not in pk, f.name in pk) for f in df.schema.fields]
    return model.Table(name, columns, pk, list(foreign_keys))


def _parts(df: DataFrame, names: Iterable[str]) -> list[tuple[Column, T.DataType]]:
    return [(df[f"`{n}`"], df.schema[n].dataType) for n in names]


def _content_key(df: DataFrame, table: model.Table) -> Column:
    return keys.content_key(_parts(df, [n for n in table.names if n in df.columns]))


@dataclass
class VertexPlan:
    """The compiled projection of one collection."""

    columns: list[Column]
    failures: dict[str, Column] = field(default_factory=dict)


def _compile(df: DataFrame, table: model.Table, mapping: model.CollectionMapping, config: model.MappingConfig) -> VertexPlan:
    known = {c.name: c for c in table.columns}
    present = [n for n in df.columns if n in known]
    typed: dict[str, X.Typed] = {}
    failed: dict[str, Column] = {}
    for name in present:
        kind = df.schema[name].dataType
        logical = config.override(table.name, name) or logical_type(known[name].data_type)
        value, bad = coerce(df[f"`{name}`"], kind, logical, known[name].is_nullable)
        typed[name], failed[name] = X.Typed(value, logical), bad
    for name in df.columns:
        if name not in typed:
            typed[name] = X.Typed(df[f"`{name}`"], logical_of_spark(df.schema[name].dataType))
    kept = present if mapping.include_fields is None else [n for n in present if n in mapping.include_fields]
    kept = [n for n in kept if n not in mapping.exclude_fields]
    shadowed = {x.target for x in mapping.field_expressions}
    out: dict[str, Column] = {}
    failures: dict[str, Column] = {}
    for name in kept:
        target = mapping.field_mappings.get(name, name)
        if target not in shadowed:
            out[target] = typed[name].col
            failures[name] = failed[name]
    for x in mapping.field_expressions:
        out[x.target] = _property(x, typed)
    return VertexPlan([c.alias(n) for n, c in out.items()], failures)


def _property(x: model.FieldExpression, typed: dict[str, X.Typed]) -> Column:
    """A blank expression, and one for an engine that is not this language, passes the first
    source (else the target's own column) through."""
    if x.engine != "aql" or not x.expression.strip():
        source = x.sources[0] if x.sources else x.target
        return typed[source].col if source in typed else F.lit(None).cast("string")
    value = X.parse(x.expression).column(typed)
    return value.col.cast("string") if value.kind == "null" else value.col


def vertices(
    df: DataFrame,
    table: model.Table,
    mapping: model.CollectionMapping | None = None,
    config: model.MappingConfig | None = None,
    content_keys: bool = False,
) -> DataFrame:
    """The vertex set of a table: `_key` (if it has a primary key) and the mapped properties.

    Without a mapping the columns pass as they are. A value that does not cast to its logical type
    is NULL here and a row of `rejects`. A row whose primary key is NULL in part has no vertex (it
    is in `rejects` too). Columns that the table does not declare are left out; rows are kept as
    often as they come. With content_keys a table without a primary key gets a key from the whole
    row, which equal rows share.
    """
    config = config or model.MappingConfig()
    if mapping is None:
        columns = [df[f"`{n}`"] for n in df.columns if n not in model.RESERVED]
    else:
        columns = _compile(df, table, mapping, config).columns
    if not table.primary_key:
        return df.select(_content_key(df, table).alias("_key"), *columns) if content_keys else df.select(*columns)
    return df.select(keys.key(_parts(df, table.primary_key), config.key_separator).alias("_key"), *columns).where("_key is not null")


def rejects(df: DataFrame, table: model.Table, mapping: model.CollectionMapping, config: model.MappingConfig | None = None) -> DataFrame:
    """(source_table, collection, column_name, raw, reason, row_json): a row for each value that
    does not cast and each primary key that is NULL in part."""
    config = config or model.MappingConfig()
    plan = _compile(df, table, mapping, config)
    issues = [
        F.when(bad, F.struct(F.lit(name).alias("column_name"), keys.as_text(df[f"`{name}`"], df.schema[name].dataType).alias("raw"), F.lit("not castable").alias("reason")))
        for name, bad in plan.failures.items()
    ]
    if table.primary_key:
        missing = keys.key(_parts(df, table.primary_key), config.key_separator).isNull()
        issues.append(F.when(missing, F.struct(F.lit(",".join(table.primary_key)).alias("column_name"), F.lit(None).cast("string").alias("raw"), F.lit("null primary key").alias("reason"))))
    row = F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(
        F.lit(table.name).alias("source_table"), F.lit(mapping.target_collection).alias("collection"), F.explode(F.array_compact(F.array(*issues))).alias("i"), row.alias("row_json")
    ).select("source_table", "collection", "i.column_name", "i.raw", "i.reason", "row_json")


def edges(
    df: DataFrame,
    edge: model.EdgeDefinition,
    table: model.Table,
    config: model.MappingConfig | None = None,
    target: tuple[DataFrame, model.Table] | None = None,
    content_keys: bool = False,
) -> DataFrame:
    """The edge set of a foreign key: from each row's vertex to the one that its key names.

    A foreign key that is NULL or blank in part has no edge; its text is trimmed. The target is
    not looked up, unless the foreign key names other columns than the target's primary key: then
    `target` (rows, table) is needed, and a reference that it does not have gives no edge. With
    content_keys the rows of a table without a primary key start from the key of the whole row.
    """
    config = config or model.MappingConfig()
    if not table.primary_key and not content_keys:
        raise ValueError(f"table {table.name!r} has no primary key to build edges from")
    unknown = [c for c in edge.from_fields if c not in df.columns]
    if unknown or not edge.from_fields:
        raise ValueError(f"edge {edge.edge_collection!r}: no such columns in {table.name!r}: {unknown or 'none given'}")
    at = config.targets()
    start, end = at.get(edge.from_collection, edge.from_collection), at.get(edge.to_collection, edge.to_collection)
    refers = [keys.present(c, k) for c, k in _parts(df, edge.from_fields)]
    rows = df
    for test in refers:
        rows = rows.where(test)
    from_key = keys.key(_parts(df, table.primary_key), config.key_separator) if table.primary_key else _content_key(df, table)
    to_key = keys.key(_parts(df, edge.from_fields), config.key_separator, trim=True)
    direct = target is None or not edge.to_fields or list(edge.to_fields) == list(target[1].primary_key)
    if direct:
        out = rows.select(from_key.alias("f"), to_key.alias("t"), to_key.alias("r"))
    else:
        other, described = target
        there = other.select(
            keys.key(_parts(other, edge.to_fields), config.key_separator, trim=True).alias("r"), keys.key(_parts(other, described.primary_key), config.key_separator).alias("t")
        ).where("r is not null")
        out = rows.select(from_key.alias("f"), to_key.alias("r")).join(there, "r").select("f", "t", "r")
    return out.where("f is not null").select(
        F.concat_ws(config.key_separator, "f", "r").alias("_key"),
        F.concat(F.lit(start + "/"), "f").alias("_from"),
        F.concat(F.lit(end + "/"), "t").alias("_to"),
        F.lit(edge.edge_collection).alias("_label"),
    )


def join_table_edges(df: DataFrame, table: model.Table, mapping: model.CollectionMapping, config: model.MappingConfig | None = None) -> DataFrame:
    """The rows of a join table as edges between its two referenced tables.

    The references are ordered by (foreign table, first column); the edge key is the row's own
    primary key, or both references where it has none.
    """
    config = config or model.MappingConfig()
    if len(table.foreign_keys) != 2:
        raise ValueError(f"join table {table.name!r} must have two foreign keys, not {len(table.foreign_keys)}")
    first, second = sorted(table.foreign_keys, key=lambda fk: (fk.foreign_table, fk.columns[0] if fk.columns else ""))
    at = config.targets()
    rows = df
    for fk in (first, second):
        for c, k in _parts(df, fk.columns):
            rows = rows.where(keys.present(c, k))
    ends = [keys.key(_parts(df, fk.columns), config.key_separator, trim=True) for fk in (first, second)]
    own = keys.key(_parts(df, table.primary_key), config.key_separator) if table.primary_key else F.concat_ws(config.key_separator, *ends)
    return rows.select(
        own.alias("_key"),
        F.concat(F.lit(at.get(first.foreign_table, first.foreign_table) + "/"), ends[0]).alias("_from"),
        F.concat(F.lit(at.get(second.foreign_table, second.foreign_table) + "/"), ends[1]).alias("_to"),
        F.lit(mapping.target_collection).alias("_label"),
    ).where("_key is not null")


def since(df: DataFrame, value: object | None, column: str | None = None) -> DataFrame:
    """The rows changed at or after a value, by `column` or the first of SINCE_COLUMNS that is
    there; without such a column, or without a value, all rows."""
    found = column if column else next((c for c in SINCE_COLUMNS if c in df.columns), None)
    if value is None or found not in df.columns:
        return df
    return df.where(F.col(f"`{found}`") >= F.lit(value).cast(df.schema[found].dataType))


@dataclass
class Graph:
    """Vertex and edge sets by collection, and the named graph's definition."""

    vertices: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    definition: list[dict]

    def degrees(self, edge: str, end: str = "_to") -> DataFrame:
        """(vertex, degree) of one edge set; counts combine on the map side, so hubs are cheap."""
        return self.edges[edge].groupBy(F.col(end).alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))

    def neighbours(self, edge: str, collection: str) -> DataFrame:
        """Edges with the vertices of `collection` at their end."""
        ends = self.vertices[collection].withColumn("_to", F.concat(F.lit(collection + "/"), F.col("_key"))).drop("_key")
        return self.edges[edge].join(ends, "_to")

    def dangling(self, edge: str, collection: str, end: str = "_to") -> DataFrame:
        """Edges whose end is no vertex of `collection`."""
        there = self.vertices[collection].select(F.concat(F.lit(collection + "/"), F.col("_key")).alias(end))
        return self.edges[edge].join(there, end, "left_anti")

    def preview(self, n: int = 3) -> dict[str, DataFrame]:
        return {name: df.limit(n) for name, df in {**self.vertices, **self.edges}.items()}


def build_graph(
    schema: model.Schema,
    config: model.MappingConfig,
    read: Callable[[str], DataFrame],
    *,
    include_tables: Iterable[str] | None = None,
    exclude_tables: Iterable[str] = (),
    since_value: object | None = None,
    since_column: str | None = None,
    join_tables_as_edges: bool = False,
) -> Graph:
    """All vertex and edge sets of a mapping as lazy plans.

    Tables are chosen by include_tables and exclude_tables, edges with the table they start from.
    Join tables are vertices with two edge sets, or with join_tables_as_edges one edge set. Rows of
    a table without a primary key from which edges start have the key of the whole row.
    """
    wanted = set(config.targets()) if include_tables is None else set(include_tables)
    wanted -= set(exclude_tables)
    frames: dict[str, DataFrame] = {}

    def rows(table: str) -> DataFrame:
        if table not in frames:
            frames[table] = since(read(table), since_value, since_column)
        return frames[table]

    vertex_sets, edge_sets, joined = {}, {}, set()
    starts = {e.from_collection for e in config.edges}
    for mapping in config.collections.values():
        table = schema.tables.get(mapping.source_table)
        if table is None or table.name not in wanted:
            continue
        if join_tables_as_edges and mapping.is_join_table:
            joined.add(table.name)
            edge_sets[mapping.target_collection] = join_table_edges(rows(table.name), table, mapping, config)
        else:
            vertex_sets[mapping.target_collection] = vertices(rows(table.name), table, mapping, config, content_keys=table.name in starts)
    for edge in config.edges:
        table = schema.tables.get(edge.from_collection)
        if table is None or table.name not in wanted or table.name in joined:
            continue
        other = schema.tables.get(edge.to_collection)
        target = (read(other.name), other) if other is not None and other.primary_key and list(edge.to_fields) != list(other.primary_key) else None
        edge_sets[edge.edge_collection] = edges(rows(table.name), edge, table, config, target, content_keys=True)
    return Graph(vertex_sets, edge_sets, config.graph_definition())
