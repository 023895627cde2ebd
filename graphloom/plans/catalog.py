"""A JSON store of sources, schema snapshots, projects and load history; and mappings proposed
from outside."""

from __future__ import annotations

import copy
import json
import os
from datetime import datetime, timezone
from pathlib import Path

from graphloom import model
from graphloom.plans.mapping import auto_map, validate

KINDS = ("sources", "targets", "projects", "snapshots", "loads")


class Catalog:
    """Named records by kind in one JSON file, written whole and moved into place."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _all(self) -> dict:
        data = json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}
        return {k: data.get(k, {}) for k in KINDS}

    def _save(self, data: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        temporary = self.path.with_suffix(".new")
        temporary.write_text(json.dumps(data, indent=2), encoding="utf-8")
        os.replace(temporary, self.path)

    def put(self, kind: str, name: str, record: dict, *, replace: bool = False) -> dict:
        data = self._all()
        if name in data[kind] and not replace:
            raise KeyError(f"{kind[:-1]} {name!r} is there already")
        data[kind][name] = {**record, "name": name, "at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
        self._save(data)
        return data[kind][name]

    def get(self, kind: str, name: str) -> dict:
        return self._all()[kind][name]

    def names(self, kind: str) -> list[str]:
        return sorted(self._all()[kind])

    def remove(self, kind: str, name: str) -> None:
        data = self._all()
        del data[kind][name]
        if kind == "sources":
            data["snapshots"] = {k: v for k, v in data["snapshots"].items() if v["source"] != name}
        self._save(data)

    def snapshot(self, source: str, schema: model.Schema) -> str:
        """Keep a source's schema; returns the snapshot's name, source@number."""
        self.get("sources", source)
        name = f"{source}@{len(self.snapshots(source)) + 1}"
        self.put("snapshots", name, {"source": source, "schema": model.to_plain(schema)})
        return name

    def snapshots(self, source: str) -> list[str]:
        found = {n: v for n, v in self._all()["snapshots"].items() if v["source"] == source}
        return sorted(found, key=lambda n: int(n.rpartition("@")[2]))

    def schema(self, snapshot: str) -> model.Schema:
        return model.from_plain(model.Schema, self.get("snapshots", snapshot)["schema"])

    def record_load(self, project: str, result: dict) -> None:
        self.put("loads", f"{project}/{len(self.history(project)) + 1}", {"project": project, **result})

    def history(self, project: str) -> list[dict]:
        found = [v for v in self._all()["loads"].values() if v["project"] == project]
        return sorted(found, key=lambda v: int(v["name"].rpartition("/")[2]))


def from_proposal(schema: model.Schema, proposal: dict) -> tuple[model.MappingConfig, list[str]]:
    """(the default mapping overlaid with a proposal, what was left out of it).

    A proposal has `collections` {table: {target, rename, exclude}} and `edges` [{name, from, to,
    from_fields, to_fields}]; what names no table or column is left out, and a proposal that makes
    the mapping invalid is not used at all."""
    base = auto_map(schema)
    out, left = copy.deepcopy(base), []
    for name, wish in (proposal.get("collections") or {}).items():
        mapping, table = out.of_table(name), schema.tables.get(name)
        if mapping is None or table is None:
            left.append(f"collection {name}: no such table")
            continue
        mapping.target_collection = wish.get("target") or mapping.target_collection
        for old, new in (wish.get("rename") or {}).items():
            if old in table.names:
                mapping.field_mappings[old] = new
            else:
                left.append(f"collection {name}: no column {old}")
        for column in wish.get("exclude") or ():
            (mapping.exclude_fields.append(column) if column in table.names else left.append(f"collection {name}: no column {column}"))
    for wish in proposal.get("edges") or ():
        edge = model.from_plain(model.EdgeDefinition, {"edge_collection": wish.get("name"), "from_collection": wish.get("from"), "to_collection": wish.get("to"), "from_fields": wish.get("from_fields"), "to_fields": wish.get("to_fields")})
        known = edge.from_collection in schema.tables and edge.to_collection in schema.tables
        if not known or not set(edge.from_fields) <= set(schema.tables[edge.from_collection].names) or not set(edge.to_fields) <= set(schema.tables[edge.to_collection].names):
            left.append(f"edge {edge.edge_collection}: unknown table or column")
            continue
        same = next((e for e in out.edges if e.signature == edge.signature), None)
        if same:
            same.edge_collection = edge.edge_collection
        else:
            out.edges.append(edge)
    new_issues = set(validate(schema, out)) - set(validate(schema, base))
    return (base, [*left, *sorted(new_issues)]) if new_issues else (out, left)
