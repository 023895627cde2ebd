"""Command line: python -m graphloom COMMAND ... (see --help)."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from graphloom import model
from graphloom.plans import catalog, export, governance, inference, mapping


def _show(value: object) -> None:
    plain = lambda v: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else sorted(v) if isinstance(v, (set, frozenset)) else str(v)
    print(json.dumps(value, indent=2, default=plain, ensure_ascii=False))


def _session():
    from pyspark.sql import SparkSession

    from graphloom.plans.runtime import configure

    return configure(SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def _source(args: argparse.Namespace):
    from graphloom.sources.databases import create_source

    return create_source(_session(), args.type, args.connection, args.source_schema)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="graphloom", description="Relational tables and change logs to a property graph")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, source: bool = False, **options: dict) -> None:
        sub = commands.add_parser(name)
        for p in positional:
            sub.add_argument(p)
        if source:
            sub.add_argument("connection")
            sub.add_argument("--type", default="csv", help="csv, postgresql, mysql, sqlserver, snowflake, clickhouse")
            sub.add_argument("--source-schema", default="public")
        for option, settings in options.items():
            sub.add_argument("--" + option.replace("_", "-"), **settings)

    flag = {"action": "store_true"}
    command("ingest-schema", "output", source=True)
    command("generate-config", "schema", "output", expand_partitions=flag)
    command("validate-config", "schema", "config")
    command("validate-schema", "schema")
    command("diff-schema", "old", "new")
    command("migrate-config", "config", "schema", "output")
    command("mapping-diff", "old", "new")
    command("selective-reload", "old", "config", "schema", "store", source=True, dry_run=flag)
    command("infer-fks", "schema", min_confidence={"type": float, "default": 0.4})
    command("analyze-denorm", "schema", min_confidence={"type": float, "default": 0.4}, data={"default": None, "help": "folder of delimited files to probe"})
    command("shared-keys", "schemas", min_confidence={"type": float, "default": 0.4})
    command("export-model", "schema", "config", label_policy={"default": "qualify", "choices": export.LABEL_POLICIES})
    command("export-r2rml", "schema", "config")
    command("generate-import", "config", "folder", "tool")
    command("generate-csv-import", "schema", "config", "folder", "tool")
    command("entitlements-emit", "schema", "config", "folder", threshold={"default": "confidential", "choices": governance.LEVELS}, project={"default": None})
    command("diff-classifications", "old", "new")
    command("entitlements", "schema", "config", threshold={"default": "confidential", "choices": governance.LEVELS})
    command("propose", "schema", "proposal", "output")
    command("validate-data", "schema", source=True, issues={"type": int, "default": 100, "help": "rows listed for each reference"})
    command("inspect", "table", source=True, rows={"type": int, "default": 20})
    command("dump", "output", source=True)
    command("transform", "schema", "config", "output", source=True, limit={"type": int, "default": None})
    command("load", "schema", "config", "store", source=True, graph={"default": "graph"}, on_duplicate={"default": "replace"}, dry_run=flag, skip_existing=flag, drop_collections=flag, since={"default": None}, since_column={"default": None})
    command("apply-log", "schema", "config", "store", "log", "checkpoint", format={"default": "debezium", "choices": ("debezium", "flat", "test_decoding", "wal2json")}, policy={"default": "source_wins"}, threshold={"default": None, "choices": governance.LEVELS}, dead_letters={"default": None})
    command("kafka-start", "schema", "config", "store", "brokers", "topics", "checkpoint", format={"default": "debezium", "choices": ("debezium", "flat")}, policy={"default": "source_wins"}, threshold={"default": None, "choices": governance.LEVELS}, dead_letters={"default": None})
    command("slot-land", "connection", "slot", "folder", most={"type": int, "default": 1000})
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    schema = model.load(model.Schema, args.schema) if getattr(args, "schema", None) else None
    config = model.load(model.MappingConfig, args.config) if getattr(args, "config", None) else None
    name = args.command
    if name == "ingest-schema":
        model.save(_source(args).schema(), args.output)
    elif name == "generate-config":
        model.save(mapping.auto_map(schema, expand_partitions=args.expand_partitions), args.output)
    elif name == "validate-config":
        issues = mapping.validate(schema, config)
        _show(issues)
        return int(bool(issues))
    elif name == "validate-schema":
        order, cycles = mapping.topological_order(schema)
        _show({"tables": order, "cycles": cycles})
    elif name == "diff-schema":
        _show(mapping.diff_schemas(model.load(model.Schema, args.old), model.load(model.Schema, args.new)))
    elif name == "migrate-config":
        moved, report = mapping.migrate(config, schema)
        model.save(moved, args.output)
        _show(report)
    elif name == "mapping-diff":
        _show(mapping.diff_mappings(model.load(model.MappingConfig, args.old), model.load(model.MappingConfig, args.new)))
    elif name == "infer-fks":
        _show(inference.infer_foreign_keys(schema, min_confidence=args.min_confidence))
    elif name == "analyze-denorm":
        _show([f for t in schema.tables.values() for f in inference.analyze_table(t, schema, *_probes(args.data, t), min_confidence=args.min_confidence)])
    elif name == "shared-keys":
        with open(args.schemas, encoding="utf-8") as file:
            given = {k: model.load(model.Schema, v) for k, v in json.load(file).items()}
        found, left = inference.infer_shared_keys(given, min_confidence=args.min_confidence)
        _show({"candidates": found, "suppressed": left})
    elif name == "export-model":
        _show(export.conceptual_model(config, schema, label_policy=args.label_policy))
    elif name == "export-r2rml":
        print(export.r2rml(config, schema))
    elif name == "generate-import":
        print(export.load_script(config, args.folder, args.tool))
    elif name == "generate-csv-import":
        print(export.csv_load_script(config, schema, args.folder, args.tool))
    elif name == "entitlements-emit":
        found = governance.report(config, schema, args.threshold)
        _show(governance.write_artifacts(args.folder, found, found.blocked, args.project))
    elif name == "diff-classifications":
        _show(governance.drift(model.load(model.Schema, args.old), model.load(model.Schema, args.new)))
    elif name == "entitlements":
        found = governance.report(config, schema, args.threshold)
        _show({"manifest": governance.manifest(found, found.blocked), "roles": governance.suggested_roles(found)})
    elif name == "propose":
        with open(args.proposal, encoding="utf-8") as file:
            proposed, left = catalog.from_proposal(schema, json.load(file))
        model.save(proposed, args.output)
        _show(left)
    else:
        return _with_data(args, schema, config)
    return 0


def _probes(folder: str | None, table: model.Table) -> tuple:
    if folder is None:
        return ()
    from graphloom.operators import profile
    from graphloom.sources.files import DelimitedFolder

    source = DelimitedFolder(_session(), folder)
    names = [c for c in inference.sampleable(table)]
    if table.name not in source.tables() or not names:
        return ()
    rows = source.rows(table.name)
    names = [c for c in names if c in rows.columns]
    ratios = {r["column_name"]: r["ratio"] for r in profile.distinct_ratios(rows, names).collect()}  # a row per column
    pairs = [(a, b) for a in inference.determinants(table, ratios) for b in names if a != b]
    strengths = {(r["determinant"], r["dependent"]): r["strength"] for r in profile.fd_strengths(rows, pairs).collect()} if pairs else {}
    rates = {(r["column_name"], r["delimiter"]): r["rate"] for r in profile.delimiter_rates(rows, names).collect()}
    return ratios, strengths, rates


def _with_data(args: argparse.Namespace, schema: model.Schema | None, config: model.MappingConfig | None) -> int:
    from graphloom.operators import profile, project
    from graphloom.plans import loading
    from graphloom.sources import files
    from graphloom.sources.store import GraphStore

    if args.command == "apply-log":
        from graphloom.streaming.apply import run_stream

        spark = _session()
        log = spark.readStream.text(args.log)
        run_stream(log, args.format, GraphStore(spark, args.store), schema, config, args.checkpoint, policy=args.policy, threshold=args.threshold, dead_letters=args.dead_letters).awaitTermination()
        return 0
    if args.command == "kafka-start":
        from graphloom.sources.databases import create_source

        spark = _session()
        topics = create_source(spark, "kafka", args.brokers)
        topics.apply(args.topics, args.format, GraphStore(spark, args.store), schema, config, args.checkpoint, policy=args.policy, threshold=args.threshold, dead_letters=args.dead_letters, available_now=False).awaitTermination()
        return 0
    if args.command == "slot-land":
        from graphloom.sources.databases import Database, Slot

        _show(Slot(Database(_session(), "postgresql", args.connection), args.slot).land(args.folder, args.most))
        return 0
    source = _source(args)
    if args.command == "inspect":
        source.preview(args.table, args.rows).show(args.rows, truncate=False)
    elif args.command == "dump":
        for table in source.schema().tables:
            files.dump_table(source.rows(table), f"{args.output}/{table}")
    elif args.command == "validate-data":
        checks = {
            f"{t.name}.{','.join(fk.columns)}": (source.rows(t.name), fk.columns, source.rows(fk.foreign_table), fk.foreign_columns)
            for t in schema.tables.values()
            for fk in t.foreign_keys
            if fk.foreign_table in schema.tables
        }
        rows = [r.asDict() for r in profile.orphan_summary(checks).collect()] if checks else []  # a row per reference
        keyed = {name: schema.tables[name.split(".")[0]].primary_key or checks[name][1] for name in checks}
        listed = [r.asDict() for r in profile.orphan_issues(checks, keyed, args.issues).collect()] if checks else []  # bounded by the report's length
        _show({"references": rows, "issues": listed})
        return int(any(r["orphans"] for r in rows))
    elif args.command == "transform":
        read = source.rows if args.limit is None else lambda t: source.rows(t).limit(args.limit)
        files.write_graph(project.build_graph(schema, config, read), args.output)
    elif args.command == "load":
        _show(
            loading.load_graph(
                GraphStore(_session(), args.store), schema, config, source.rows, graph_name=args.graph, on_duplicate=args.on_duplicate, dry_run=args.dry_run, skip_existing=args.skip_existing, drop_collections=args.drop_collections, since_value=args.since, since_column=args.since_column
            )
        )
    elif args.command == "selective-reload":
        plan = mapping.diff_mappings(model.load(model.MappingConfig, args.old), config)
        done = loading.execute(plan, GraphStore(_session(), args.store), schema, config, source.rows, dry_run=args.dry_run)
        _show({"done": done.done, "skipped": done.skipped, "errors": {a.target: e for a, e in done.errors.items()}})
        return int(bool(done.errors))
    return 0


if __name__ == "__main__":
    sys.exit(main())
