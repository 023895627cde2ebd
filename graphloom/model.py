"""Schemas and mappings: what is projected to which vertex and edge sets."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

#: Attributes of vertices and edges that no property may take.
RESERVED = ("_key", "_id", "_rev", "_from", "_to", "_label")


@dataclass
class Classification:
    """Governance signals of a column."""

    tags: list[str] = field(default_factory=list)
    tier: str | None = None
    glossary_terms: list[str] = field(default_factory=list)
    source: str | None = None

    @property
    def is_empty(self) -> bool:
        return not (self.tags or self.tier or self.glossary_terms)


@dataclass
class Column:
    name: str
    data_type: str = "text"
    is_nullable: bool = True
    is_primary_key: bool = False
    classification: Classification | None = None


@dataclass
class ForeignKey:
    columns: list[str]
    foreign_table: str
    foreign_columns: list[str]
    constraint_name: str | None = None

    @property
    def signature(self) -> tuple:
        return tuple(self.columns), self.foreign_table, tuple(self.foreign_columns)


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    is_partitioned: bool = False
    partition_of: str | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)

    def roll_up_partitions(self) -> Schema:
        """A copy in which each root of a partition tree has the foreign keys of all its
        descendants, without repeats."""
        out = copy.deepcopy(self)
        for table in out.tables.values():
            root, seen = table, {table.name}
            while root.partition_of in out.tables and root.partition_of not in seen:
                root = out.tables[root.partition_of]
                seen.add(root.name)
            if root is not table:
                known = {fk.signature for fk in root.foreign_keys}
                for fk in table.foreign_keys:
                    if fk.signature not in known:
                        known.add(fk.signature)
                        root.foreign_keys.append(copy.deepcopy(fk))
        return out


@dataclass
class FieldExpression:
    """A computed property. A blank expression passes its first source through."""

    target: str
    sources: list[str] = field(default_factory=list)
    expression: str = ""
    engine: str = "aql"
    description: str | None = None


@dataclass
class CollectionMapping:
    source_table: str
    target_collection: str
    collection_type: str = "document"
    is_join_table: bool = False
    field_mappings: dict[str, str] = field(default_factory=dict)
    exclude_fields: list[str] = field(default_factory=list)
    include_fields: list[str] | None = None
    field_expressions: list[FieldExpression] = field(default_factory=list)


def _names(value: Any) -> list[str]:
    """A list of names from a list, one name or a comma-separated text."""
    if value is None:
        return []
    if isinstance(value, str):
        return [part.strip() for part in value.split(",") if part.strip()]
    return list(value)


@dataclass
class EdgeDefinition:
    """An edge set. from_collection and to_collection name source tables."""

    edge_collection: str
    from_collection: str
    to_collection: str
    from_fields: list[str] = field(default_factory=list)
    to_fields: list[str] = field(default_factory=list)

    @property
    def signature(self) -> tuple:
        return self.from_collection, tuple(self.from_fields), self.to_collection, tuple(self.to_fields)


@dataclass
class NamingConvention:
    collections: str = "preserve"
    properties: str = "preserve"
    edges: str = "preserve"


@dataclass
class MappingConfig:
    source_schema: str = "public"
    collections: dict[str, CollectionMapping] = field(default_factory=dict)
    edges: list[EdgeDefinition] = field(default_factory=list)
    type_overrides: dict[str, str] = field(default_factory=dict)
    key_separator: str = "_"
    naming_convention: NamingConvention | None = None
    shared_keys: list[dict] = field(default_factory=list)

    def targets(self) -> dict[str, str]:
        """Source table -> target collection."""
        return {m.source_table: m.target_collection for m in self.collections.values()}

    def of_table(self, table: str) -> CollectionMapping | None:
        return next((m for m in self.collections.values() if m.source_table == table), None)

    def override(self, table: str, column: str) -> str | None:
        """The logical type that overrides a column's: `table.column` wins over the bare name."""
        return self.type_overrides.get(f"{table}.{column}", self.type_overrides.get(column))

    def graph_definition(self) -> list[dict[str, Any]]:
        """Edge definitions of the named graph, by target collections."""
        at = self.targets()
        return [
            {
                "edge_collection": e.edge_collection,
                "from_vertex_collections": [at.get(e.from_collection, e.from_collection)],
                "to_vertex_collections": [at.get(e.to_collection, e.to_collection)],
            }
            for e in self.edges
        ]


_NESTED = {
    Schema: {"tables": dict[str, Table]},
    Table: {"columns": list[Column], "foreign_keys": list[ForeignKey]},
    Column: {"classification": Classification},
    MappingConfig: {"collections": dict[str, CollectionMapping], "edges": list[EdgeDefinition], "naming_convention": NamingConvention},
    CollectionMapping: {"field_expressions": list[FieldExpression]},
}


def from_plain(kind: type, data: dict | None) -> Any:
    """An object of this module from plain JSON or YAML data; unknown fields are ignored, and
    singular or comma-joined key fields are accepted."""
    data = dict(data or {})
    if kind is EdgeDefinition:
        for plural, singular in (("from_fields", "from_field"), ("to_fields", "to_field")):
            data[plural] = _names(data.get(plural, data.get(singular)))
    if kind is ForeignKey:
        for plural, singular in (("columns", "column"), ("foreign_columns", "foreign_column")):
            data[plural] = _names(data.get(plural, data.get(singular)))
    out = {}
    for f in fields(kind):
        if f.name not in data or data[f.name] is None:
            continue
        value, nested = data[f.name], _NESTED.get(kind, {}).get(f.name)
        if nested is None:
            out[f.name] = value
        elif is_dataclass(nested):
            out[f.name] = from_plain(nested, value)
        elif nested.__origin__ is list:
            out[f.name] = [from_plain(nested.__args__[0], v) for v in value]
        else:
            inner = nested.__args__[1]
            out[f.name] = {k: from_plain(inner, {"name": k, "source_table": k, "target_collection": k} | v) for k, v in value.items()}
    return kind(**out)


def to_plain(value: Any) -> dict:
    return asdict(value)


def load(kind: type, path: str | Path) -> Any:
    """A Schema or MappingConfig from a JSON or YAML file; an empty file gives the default."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        return from_plain(kind, yaml.safe_load(text))
    return from_plain(kind, json.loads(text) if text.strip() else None)


def save(value: Any, path: str | Path) -> None:
    data = to_plain(value)
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump(data, sort_keys=False, allow_unicode=True)
    else:
        text = json.dumps(data, indent=2, ensure_ascii=False)
    Path(path).write_text(text, encoding="utf-8")
