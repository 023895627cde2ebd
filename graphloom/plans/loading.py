"""Loads of whole graphs and of parts of them into a store."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import model
from graphloom.operators import project
from graphloom.plans.mapping import Action, topological_order
from graphloom.sources.store import GraphStore


@dataclass
class LoadResult:
    documents: dict[str, int] = field(default_factory=dict)
    edges: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)
    samples: dict[str, list] = field(default_factory=dict)
    cycles: list[list[str]] = field(default_factory=list)
    elapsed_seconds: float = 0.0


def load_graph(
    store: GraphStore,
    schema: model.Schema,
    config: model.MappingConfig,
    read: Callable[[str], DataFrame],
    *,
    graph_name: str | None = None,
    on_duplicate: str = "replace",
    drop_collections: bool = False,
    skip_existing: bool = False,
    dry_run: bool = False,
    include_tables: Iterable[str] | None = None,
    exclude_tables: Iterable[str] = (),
    since_value: object = None,
    since_column: str | None = None,
    join_tables_as_edges: bool = False,
    sequence: int | None = None,
    dead_letters: Callable[[DataFrame], None] | None = None,
    on_event: Callable[[str, str], None] | None = None,
) -> LoadResult:
    """Project all tables of a mapping and load them: vertices in the order of references, then
    edges. An error ends its collection only. A dry run loads nothing and keeps three rows of
    each collection. Rows without a primary key cannot be merged; their collections are written
    anew. Sequences and tombstones of earlier changes stay; `sequence` is the position of the log
    at which the tables were read, if it is known."""
    began, out = time.monotonic(), LoadResult()
    order, out.cycles = topological_order(schema)
    graph = project.build_graph(
        schema, config, read, include_tables=include_tables, exclude_tables=exclude_tables, since_value=since_value, since_column=since_column, join_tables_as_edges=join_tables_as_edges
    )
    at = {m.target_collection: m for m in config.collections.values()}
    place = {t: i for i, t in enumerate(order)}
    names = sorted(graph.vertices, key=lambda n: place.get(at[n].source_table, len(place)))

    def put(name: str, df: DataFrame, counts: dict[str, int]) -> None:
        tell = lambda what: on_event(what, name) if on_event else None
        try:
            if dry_run:
                out.samples[name], counts[name] = [r.asDict() for r in df.limit(3).collect()], df.count()
                return
            if drop_collections:
                store.drop(name)
            there = store.documents(name)
            if there is not None and skip_existing and there.head(1):
                out.skipped.append(name)
                tell("skipped")
                return
            if "_key" in df.columns:
                store.load(name, df, on_duplicate, sequence)
            else:
                store.replace(name, df.withColumn("_key", F.expr("uuid()")))
            counts[name] = store.documents(name).count()
            tell("loaded")
        except Exception as error:  # a collection that fails must not end the load
            out.errors[name] = str(error)
            tell("failed")

    for name in names:
        put(name, graph.vertices[name], out.documents)
        table = schema.tables[at[name].source_table]
        if dead_letters and not dry_run:
            dead_letters(project.rejects(project.since(read(table.name), since_value, since_column), table, at[name], config))
    for name, df in graph.edges.items():
        put(name, df, out.edges)
    if graph_name and not dry_run:
        store.write_graph(graph_name, graph.definition)
    out.elapsed_seconds = time.monotonic() - began
    return out


@dataclass
class ReloadResult:
    done: list[Action] = field(default_factory=list)
    skipped: list[Action] = field(default_factory=list)
    errors: dict[Action, str] = field(default_factory=dict)


def execute(
    actions: Iterable[Action], store: GraphStore, schema: model.Schema, config: model.MappingConfig, read: Callable[[str], DataFrame], *, graph_name: str = "graph", dry_run: bool = False
) -> ReloadResult:
    """Carry out a reload plan of diff_mappings: only what an action names is rebuilt, and an error
    ends its action only. A dry run lists all actions as skipped."""
    out = ReloadResult()
    graph = project.build_graph(schema, config, read)

    def run(action: Action) -> None:
        if action.kind == "reload":
            store.replace(action.target, graph.vertices[action.target])
        elif action.kind == "reload_edge":
            store.replace(action.target, graph.edges[action.target])
        elif action.kind == "drop":
            store.drop(action.target)
        elif action.kind == "rename":
            store.rename(action.detail, action.target)
        elif action.kind == "rename_field":
            old, new = action.detail.split("->")
            state = store.state(action.target)
            if state is not None and old in state.columns:
                store.replace_state(action.target, state.withColumnRenamed(old, new))
        elif action.kind == "rebuild_graph":
            store.write_graph(graph_name, config.graph_definition())
        else:
            raise ValueError(f"unknown action {action.kind!r}")

    for action in actions:
        if dry_run:
            out.skipped.append(action)
            continue
        try:
            run(action)
            out.done.append(action)
        except Exception as error:
            out.errors[action] = str(error)
    return out
