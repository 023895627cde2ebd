"""Exports of a mapping: a conceptual and physical model document, R2RML, load scripts, a picture."""

from __future__ import annotations

import json
from urllib.parse import quote

from graphloom.functions.types import logical_type
from graphloom.model import CollectionMapping, MappingConfig, Schema, Table
from graphloom.plans.naming import convert, singularize, split_identifier

LABEL_POLICIES = ("qualify", "roles", "warn", "off")


def entity_name(name: str) -> str:
    """Singular Pascal case of a collection name."""
    words = split_identifier(name)
    return convert("_".join([*words[:-1], singularize(words[-1])]), "pascal") if words else name


def property_name(name: str) -> str:
    return convert(name, "camel")


def _properties(m: CollectionMapping, table: Table | None) -> dict[str, str | None]:
    """Property -> source column (None for computed ones)."""
    out: dict[str, str | None] = {}
    shadowed = {x.target for x in m.field_expressions}
    for c in table.names if table else m.field_mappings:
        if (m.include_fields is None or c in m.include_fields) and c not in m.exclude_fields and m.field_mappings.get(c, c) not in shadowed:
            out[m.field_mappings.get(c, c)] = c
    return out | dict.fromkeys(x.target for x in m.field_expressions)


def _role(table: Table | None, column: str | None) -> str:
    if table is None or column is None:
        return "plain"
    if column in table.primary_key:
        return "pk"
    return "fk" if any(column in fk.columns for fk in table.foreign_keys) else "plain"


def conceptual_model(config: MappingConfig, schema: Schema, *, source_kind: str = "relational", source_ref: str = "", label_policy: str = "qualify", generated_at: str | None = None) -> dict:
    """A document with entities, relationships, their physical mapping and provenance.

    Labels that several entities share are renamed to <entity><Label> (qualify), treated by the
    role of their columns (roles: identities dropped, references qualified but for the owner),
    only listed (warn), or not looked at (off).
    """
    if label_policy not in LABEL_POLICIES:
        raise ValueError(f"unknown label policy {label_policy!r}; one of {', '.join(LABEL_POLICIES)}")
    entities = []
    for m in config.collections.values():
        if m.is_join_table:
            continue
        table = schema.tables.get(m.source_table)
        props = {p: {"label": property_name(p), "column": c, "role": _role(table, c)} for p, c in _properties(m, table).items()}
        entities.append({"name": entity_name(m.target_collection), "mapping": m, "table": table, "props": props})
    by_label: dict[str, list[tuple[dict, dict]]] = {}
    for e in entities:
        for p in e["props"].values():
            by_label.setdefault(p["label"], []).append((e, p))
    collisions = []
    for label, uses in sorted(by_label.items()) if label_policy != "off" else ():
        if len({e["name"] for e, _ in uses}) < 2:
            continue
        roles = {p["role"] for _, p in uses}
        kind = "identity" if roles == {"pk"} else "reference" if "fk" in roles else "semantic"
        collisions.append({"label": label, "kind": kind, "entities": sorted(e["name"] for e, _ in uses)})
        if label_policy == "warn":
            continue
        for e, p in uses:
            if label_policy == "roles" and kind == "identity":
                p["label"] = None
            elif label_policy == "roles" and kind == "reference" and p["role"] == "pk":
                continue
            else:
                p["label"] = property_name(e["name"]) + label[:1].upper() + label[1:]
    physical, conceptual = [], []
    for e in entities:
        conceptual.append({"name": e["name"], "labels": [e["name"]], "properties": [{"name": p["label"]} for p in e["props"].values() if p["label"]]})
        physical.append(
            {
                "entity": e["name"],
                "style": "COLLECTION",
                "collection": e["mapping"].target_collection,
                "key": "_key",
                "properties": {p["label"]: name for name, p in e["props"].items() if p["label"]},
            }
        )
    named = {m.source_table: entity_name(m.target_collection) for m in config.collections.values()}
    joins = {m.source_table for m in config.collections.values() if m.is_join_table}
    relationships = [
        {
            "name": property_name(x.edge_collection),
            "from": named.get(x.from_collection, entity_name(x.from_collection)),
            "to": named.get(x.to_collection, entity_name(x.to_collection)),
            "physical": {"style": "DEDICATED_COLLECTION", "collection": x.edge_collection, "joinKeys": {"from": x.from_fields, "to": x.to_fields}},
        }
        for x in config.edges
        if x.from_collection not in joins
    ]
    for m in config.collections.values():
        table = schema.tables.get(m.source_table)
        if m.is_join_table and table is not None and len(table.foreign_keys) == 2:
            a, b = sorted(table.foreign_keys, key=lambda fk: (fk.foreign_table, fk.columns))
            physical_join = {"style": "DEDICATED_COLLECTION", "collection": m.target_collection, "joinKeys": {"from": a.columns, "to": b.columns}}
            ends = [named.get(fk.foreign_table, entity_name(fk.foreign_table)) for fk in (a, b)]
            relationships.append({"name": property_name(m.target_collection), "from": ends[0], "to": ends[1], "physical": physical_join})
    provenance = {"source": {"kind": source_kind, "ref": source_ref or config.source_schema}, "labelPolicy": label_policy, "labelCollisions": collisions}
    if generated_at:
        provenance["generatedAt"] = generated_at
    return {"version": "1", "conceptual": {"entities": conceptual, "relationships": [{k: r[k] for k in ("name", "from", "to")} for r in relationships]}, "physical": {"entities": physical, "relationships": relationships}, "provenance": provenance}


def check_model(document: dict) -> list[str]:
    """What is wrong with a model document; empty if nothing is."""
    issues = [f"missing {k}" for k in ("version", "conceptual", "physical", "provenance") if k not in document]
    if issues:
        return issues
    names = [e["name"] for e in document["conceptual"]["entities"]]
    issues += [f"entity {n} comes {names.count(n)} times" for n in sorted(set(names)) if names.count(n) > 1]
    for r in document["conceptual"]["relationships"]:
        issues += [f"relationship {r['name']}: no entity {r[end]}" for end in ("from", "to") if r[end] not in names]
    for e in document["physical"]["entities"]:
        if e["entity"] not in names:
            issues.append(f"physical mapping of unknown entity {e['entity']}")
    return issues


#: XML Schema type of each logical type and of dates.
XSD = {"integer": "xsd:integer", "float": "xsd:double", "boolean": "xsd:boolean"}


def _xsd(source: str) -> str | None:
    low = source.lower()
    if low.startswith("date") and not low.startswith("datetime"):
        return "xsd:date"
    if low.startswith(("timestamp", "datetime")):
        return "xsd:dateTime"
    return XSD.get(logical_type(source))


def r2rml(config: MappingConfig, schema: Schema, base: str = "http://example.org/") -> str:
    """The mapping as R2RML in Turtle: a triples map per collection, object properties per edge."""
    lines = ["@prefix rr: <http://www.w3.org/ns/r2rml#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", f"@prefix ex: <{base}> .", ""]
    subject = lambda t, key: base + quote(t) + "/" + config.key_separator.join("{" + k + "}" for k in key)
    for m in config.collections.values():
        table = schema.tables.get(m.source_table)
        if table is None or not table.primary_key:
            continue
        parts = [f'<#{m.source_table}> a rr:TriplesMap ;\n  rr:logicalTable [ rr:tableName "{m.source_table}" ] ;\n  rr:subjectMap [ rr:template "{subject(m.target_collection, table.primary_key)}" ; rr:class ex:{entity_name(m.target_collection)} ]']
        for p, c in _properties(m, table).items():
            if c is not None:
                kind = _xsd(table.column(c).data_type)
                parts.append(f'  rr:predicateObjectMap [ rr:predicate ex:{property_name(p)} ; rr:objectMap [ rr:column "{c}"' + (f" ; rr:datatype {kind}" if kind else "") + " ] ]")
        for e in config.edges:
            target = config.of_table(e.to_collection)
            if e.from_collection == m.source_table and target is not None:
                parts.append(f'  rr:predicateObjectMap [ rr:predicate ex:{property_name(e.edge_collection)} ; rr:objectMap [ rr:template "{subject(target.target_collection, e.from_fields)}" ; rr:termType rr:IRI ] ]')
        lines.append(" ;\n".join(parts) + " .\n")
    return "\n".join(lines)


def load_script(config: MappingConfig, folder: str, tool: str, on_duplicate: str = "replace") -> str:
    """A shell script that loads the JSON-lines folders of a written graph with a bulk tool:
    documents first, then edges."""
    lines = ["#!/usr/bin/env bash", "set -euo pipefail", f'DATA="${{DATA:-{folder}}}"', ""]
    for kind, names in (("document", [m.target_collection for m in config.collections.values()]), ("edge", [e.edge_collection for e in config.edges])):
        lines += [f'for part in "$DATA"/{n}/*.json; do\n  {tool} --file "$part" --type jsonl --collection "{n}" --create-collection true --create-collection-type {kind} --on-duplicate {on_duplicate}\ndone' for n in names]
    return "\n".join(lines) + "\n"


#: Types that the bulk tool gives to CSV columns; a blank has neither number nor truth.
CSV_TYPES = {"integer": "number", "float": "number", "boolean": "boolean"}


def csv_load_script(config: MappingConfig, schema: Schema, folder: str, tool: str, on_duplicate: str = "replace") -> str:
    """A shell script that loads dumped CSV tables directly: keys are renamed or merged from
    columns, other columns of an edge removed. References stand as they are in the dump, so keys
    that need escaping or mapped properties need load_script instead."""

    def made(attribute: str, columns: list[str]) -> list[str]:
        if len(columns) == 1:
            return [f'--translate "{columns[0]}={attribute}"']
        template = config.key_separator.join(f"[{c}]" for c in columns)
        return [f'--merge-attributes "{attribute}={template}"']

    def call(table: str, collection: str, kind: str, options: list[str]) -> str:
        shared = [f'{tool} --file "$DATA/{table}.csv"', "--type csv", f'--collection "{collection}"', "--create-collection true", f"--create-collection-type {kind}", f"--on-duplicate {on_duplicate}"]
        return " \\\n  ".join([*shared, *options])

    calls = []
    for m in config.collections.values():
        table = schema.tables.get(m.source_table)
        if table is None:
            continue
        typed = [(c.name, CSV_TYPES.get(logical_type(c.data_type))) for c in table.columns if c.name not in table.primary_key and not c.is_nullable]
        options = (made("_key", table.primary_key) if table.primary_key else []) + [f'--datatype "{c}=string"' for c in table.primary_key] + [f'--datatype "{c}={k}"' for c, k in typed if k]
        calls.append(call(table.name, m.target_collection, "document", options))
    at = config.targets()
    for e in config.edges:
        table = schema.tables.get(e.from_collection)
        if table is None or not table.primary_key:
            continue
        ends = made("_from", table.primary_key) + made("_to", e.from_fields)
        prefixes = [f'--from-collection-prefix "{at.get(e.from_collection, e.from_collection)}"', f'--to-collection-prefix "{at.get(e.to_collection, e.to_collection)}"']
        kept = {*table.primary_key, *e.from_fields}
        options = [*ends, *prefixes, *[f'--datatype "{c}=string"' for c in table.names if c in kept], *[f'--remove-attribute "{c}"' for c in table.names if c not in kept]]
        calls.append(call(table.name, e.edge_collection, "edge", options))
    return "\n".join(["#!/usr/bin/env bash", "set -euo pipefail", f'DATA="${{DATA:-{folder}}}"', "", *calls]) + "\n"


def graph_script(config: MappingConfig, name: str, module: str) -> str:
    """A script for a graph shell that creates the named graph."""
    relations = [f"graph._relation({json.dumps(d['edge_collection'])}, {json.dumps(d['from_vertex_collections'])}, {json.dumps(d['to_vertex_collections'])})" for d in config.graph_definition()]
    return f"const graph = require({json.dumps(module)});\ngraph._create({json.dumps(name)}, [\n  " + ",\n  ".join(relations) + "\n]);\n"


def picture_data(config: MappingConfig, schema: Schema) -> dict:
    """Nodes and links of the mapping for a drawing."""
    nodes = [{"id": m.target_collection, "table": m.source_table, "columns": schema.tables[m.source_table].names if m.source_table in schema.tables else [], "join": m.is_join_table} for m in config.collections.values()]
    links = [{"source": d["from_vertex_collections"][0], "target": d["to_vertex_collections"][0], "label": d["edge_collection"]} for d in config.graph_definition()]
    return {"nodes": nodes, "links": links}
