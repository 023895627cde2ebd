"""Queries of the planes around the rows: stores and files as round trips, expressions that stand
alone, and plans made from the tables' schemas, each as a table of its result."""

from __future__ import annotations

import copy
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions.expressions import rewrite_binds
from graphloom.operators import merge, project, temporal
from graphloom.plans import export, governance, inference, loading, mapping, naming
from graphloom.plans.runtime import ensure_checkpoint_dir, read_table
from graphloom.queries.graph import _classified, _vertices, star_schema
from graphloom.sources.files import DelimitedFolder, dump_table, read_failures, record_failures, write_graph
from graphloom.sources.store import GraphStore


def _shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors and the driver see it: beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- stores and files


def _library(spark: SparkSession, folder: str) -> tuple[model.Schema, dict[str, DataFrame]]:
    """Books and authors, the newest delivery of each id, with the reference between them."""
    frames = {}
    for name in ("authors", "books"):
        df = read_table(spark, folder, name)
        newest = df.groupBy("id").agg(F.max(F.struct("loaded_at", *[c for c in df.columns if c not in ("id", "loaded_at")])).alias("r"))
        frames[name] = newest.select("id", *[F.col(f"r.{c}").alias(c) for c in df.columns if c != "id"])
    schema = model.Schema(
        {
            "authors": project.table_of(frames["authors"], "authors", ["id"]),
            "books": project.table_of(frames["books"], "books", ["id"], [model.ForeignKey(["author_id"], "authors", ["id"])]),
        }
    )
    return schema, frames


def store_load(spark: SparkSession, folder: str) -> DataFrame:
    """A graph loaded into a store, renamed, read back: books with the key of their author."""
    schema, frames = _library(spark, folder)
    store = GraphStore(spark, _shared_folder(spark), buckets=8)
    done = loading.load_graph(store, schema, mapping.auto_map(schema), lambda t: frames[t], graph_name="library")
    if done.errors:
        raise RuntimeError(str(done.errors))
    store.rename("books", "titles")
    edges = store.documents("books_to_authors").select(F.split_part("_from", F.lit("/"), F.lit(2)).alias("_key"), F.split_part("_to", F.lit("/"), F.lit(2)).alias("author"))
    return store.documents("titles").select("_key", "title", "published").join(edges, "_key", "left")


def store_describe(spark: SparkSession, folder: str) -> DataFrame:
    """Collections of a loaded store with their documents and properties."""
    schema, frames = _library(spark, folder)
    store = GraphStore(spark, _shared_folder(spark), buckets=8)
    loading.load_graph(store, schema, mapping.auto_map(schema), lambda t: frames[t])
    found = store.describe()
    return _rows(spark, [(c, store.documents(c).count(), ",".join(sorted(found[c]["properties"]))) for c in store.collections()], "collection string, documents bigint, properties string")


def store_merge_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches of changes to a store, of which the first comes again at the end."""
    store = GraphStore(spark, _shared_folder(spark), buckets=8)
    o = read_table(spark, folder, "orders")
    row = lambda op, n, status: o.select(F.col("o_orderkey").cast("string").alias("_key"), F.lit(op).alias("op"), (F.col("o_orderkey") * 10 + n).alias("seq"), "o_orderkey", status.alias("status"))
    first = row("INSERT", 0, F.col("o_orderstatus"))
    second = row("REPLACE", 2, F.lit("second")).withColumn("op", F.when(F.col("o_orderkey") % 7 == 0, "DELETE").otherwise(F.col("op")))
    third = row("REPLACE", 1, F.lit("late")).withColumn("seq", F.when(F.col("o_orderkey") % 2 == 0, F.col("seq") + 4).otherwise(F.col("seq")))
    for batch in (first, second, third, first):
        store.merge("orders", batch)
    return store.documents("orders")


def files_dump_and_read(spark: SparkSession, folder: str) -> DataFrame:
    """Members dumped as delimited text and read back, typed by their values."""
    at = _shared_folder(spark).removeprefix("file:")
    at = "/" + at.lstrip("/")
    dump_table(read_table(spark, folder, "members").select("id", "name", "city", "joined"), f"file://{at}/members.csv")
    return DelimitedFolder(spark, at).rows("members").withColumn("joined", F.date_format("joined", "yyyy-MM-dd"))


def files_json_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The customer graph as JSON lines and back: edges with the market segment of their start."""
    at = _shared_folder(spark)
    schema = star_schema(spark, folder, ("nation", "customer"))
    write_graph(project.build_graph(schema, mapping.auto_map(schema), lambda t: read_table(spark, folder, t)), at)
    vertices, edges = spark.read.json(f"{at}/customer"), spark.read.json(f"{at}/customer_to_nation")
    return edges.join(vertices.select(F.concat(F.lit("customer/"), "_key").alias("_from"), "c_mktsegment"), "_from").select("_key", "_from", "_to", "c_mktsegment")


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Values that do not cast, recorded as dead letters of a load and read back page by page."""
    at = _shared_folder(spark)
    books = read_table(spark, folder, "books").select("id", F.when(F.col("id") % 9 == 0, "unknown").otherwise(F.col("published").cast("string")).alias("published"))
    table = project.table_of(books, "books", ["id"])
    table.column("published").data_type = "integer"
    record_failures(project.rejects(books, table, model.CollectionMapping("books", "books")), at, "load-1")
    return read_failures(spark, at, "load-1", limit=1_000_000).select("source_table", "column_name", "raw", "reason", F.get_json_object("row_json", "$.id").cast("bigint").alias("id"))


# -- expressions, keys and versions


def expr_casts(spark: SparkSession, folder: str) -> DataFrame:
    texts = {"shown": "TO_STRING(@l_linenumber)", "first": 'COALESCE(null, @l_returnflag, "x")', "none": "COALESCE(null, null)", "truth": "TO_BOOL(@l_quantity)", "number": 'TO_NUMBER(CONCAT(@l_linenumber, ".5"))', "glued": 'CONCAT(TO_STRING(@l_orderkey), "-", TO_STRING(@l_partkey))'}
    fields = [model.FieldExpression(n, [], t) for n, t in texts.items()]
    return _vertices(spark, folder, "lineitem", include_fields=["l_orderkey", "l_partkey", "l_suppkey"], field_expressions=fields)


def vertex_expression_engines(spark: SparkSession, folder: str) -> DataFrame:
    """A blank expression and one for another engine pass their first source on."""
    fields = [model.FieldExpression("named", ["c_name"], " "), model.FieldExpression("c_mktsegment", [], ""), model.FieldExpression("other", ["c_nationkey"], "c_nationkey * 2", engine="python")]
    return _vertices(spark, folder, "customer", include_fields=["c_custkey"], field_expressions=fields)


def bind_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """Binds of expressions over each table's columns, as members of a row."""
    tables = {n: read_table(spark, folder, n).columns for n in ("orders", "customer")}
    return _rows(spark, [(t, c, rewrite_binds(f'CONCAT("@{c}", @{c})')) for t, cs in tables.items() for c in cs], "table_name string, column_name string, rewritten string")


def edge_names(spark: SparkSession, folder: str) -> DataFrame:
    """Two references to one table: the second edge set is named by its columns."""
    nations = [model.ForeignKey(["c_nationkey"], "nation", ["n_nationkey"]), model.ForeignKey(["c_custkey"], "nation", ["n_nationkey"])]
    schema = star_schema(spark, folder, ("nation", "customer"))
    schema.tables["customer"].foreign_keys = nations
    return _rows(spark, [(e.edge_collection, e.from_collection, e.to_collection, ",".join(e.from_fields)) for e in mapping.auto_map(schema).edges], "edge_set string, from_table string, to_table string, columns string")


def temporal_sharded(spark: SparkSession, folder: str) -> DataFrame:
    """Versions whose keys lead with the shard of their field."""
    e = read_table(spark, folder, "events")
    log = e.select(F.col("user_id").cast("string").alias("_key"), F.lit("REPLACE").alias("op"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_type")
    return temporal.versions_from_log(log, temporal.TemporalConfig(smart_field="event_type")).select("_key", "_proxy", "_version", "event_type")


def _raises(run) -> str:
    try:
        run()
        return ""
    except merge.ConflictError:
        return "conflict"


def conflict_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Which loads and policies end with a conflict over the orders."""
    o = read_table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("_key"), "o_orderstatus")
    target, moved = o, o.withColumn("_key", F.concat(F.lit("n"), "_key"))
    state = lambda df: df.withColumn("_seq", F.lit(None).cast("bigint")).withColumn("_deleted", F.lit(False))
    changes = lambda df, op: df.withColumn("op", F.lit(op)).withColumn("seq", F.lit(1).cast("bigint"))
    cases = {
        "load error, keys there": lambda: merge.load(target, o, "error").count(),
        "load error, new keys": lambda: merge.load(target, moved, "error").count(),
        "fail, INSERT of keys there": lambda: merge.apply_changes(state(target), changes(o, "INSERT"), "fail").count(),
        "fail, REPLACE of keys there": lambda: merge.apply_changes(state(target), changes(o, "REPLACE"), "fail").count(),
        "fail, REPLACE of new keys": lambda: merge.apply_changes(state(target), changes(moved, "REPLACE"), "fail").count(),
        "fail, DELETE of new keys": lambda: merge.apply_changes(state(target), changes(moved, "DELETE"), "fail").count(),
    }
    return _rows(spark, [(name, _raises(run)) for name, run in cases.items()], "case string, outcome string")


# -- plans from schemas


def plan_auto_map(spark: SparkSession, folder: str) -> DataFrame:
    """The default mapping of the star tables: collections with their number of columns, edge sets with theirs."""
    schema = star_schema(spark, folder)
    config = mapping.auto_map(schema)
    rows = [("collection", m.target_collection, len(schema.tables[m.source_table].columns)) for m in config.collections.values()] + [("edge", e.edge_collection, len(e.from_fields)) for e in config.edges]
    return _rows(spark, rows, "kind string, name string, columns int")


def plan_load_order(spark: SparkSession, folder: str) -> DataFrame:
    """For each reference whether its target is loaded first."""
    schema = star_schema(spark, folder)
    place = {t: i for i, t in enumerate(mapping.topological_order(schema)[0])}
    return _rows(spark, [(t.name, fk.foreign_table, place[fk.foreign_table] < place[t.name]) for t in schema.tables.values() for fk in t.foreign_keys], "table_name string, foreign_table string, target_first boolean")


def plan_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of a mapping with a dropped column of each table, an unknown table, and a reserved target."""
    schema = star_schema(spark, folder, ("region", "nation", "customer"))
    config = mapping.auto_map(schema)
    for m in config.collections.values():
        m.exclude_fields = ["gone"]
    config.collections["nation"].field_mappings = {"n_name": "_id"}
    config.collections["extra"] = model.CollectionMapping("extra", "extra")
    return _rows(spark, [(text,) for text in mapping.validate(schema, config)], "issue string")


def _changed(spark: SparkSession, folder: str) -> tuple[model.Schema, model.Schema]:
    old = star_schema(spark, folder, ("region", "nation", "customer", "supplier"))
    new = copy.deepcopy(old)
    del new.tables["supplier"]
    new.tables["part"] = project.table_of(read_table(spark, folder, "part"), "part", ["p_partkey"])
    customer = new.tables["customer"]
    customer.columns = [c for c in customer.columns if c.name != "c_mktsegment"]
    customer.column("c_acctbal").data_type = "text"
    return old, new


def plan_schema_diff(spark: SparkSession, folder: str) -> DataFrame:
    found = mapping.diff_schemas(*_changed(spark, folder))
    rows = [("added_table", t, "") for t in found["added_tables"]] + [("removed_table", t, "") for t in found["removed_tables"]]
    for table, changes in found["modified_tables"].items():
        rows += [("removed_column", table, c) for c in changes.get("removed_columns", ())]
        rows += [("type_change", table, c["column"]) for c in changes.get("type_changes", ())]
    return _rows(spark, rows, "change string, table_name string, column_name string")


def plan_migration(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _changed(spark, folder)
    config = mapping.auto_map(old)
    config.collections["customer"].field_mappings = {"c_mktsegment": "segment", "c_name": "name"}
    moved, report = mapping.migrate(config, new)
    rows = [("added", n) for n in report.added_collections] + [("orphaned", n) for n in report.orphaned_collections] + [("removed_edge", n.split(" ")[0]) for n in report.removed_edges]
    rows += [("kept_mapping", n) for n in moved.collections["customer"].field_mappings]
    return _rows(spark, rows, "what string, name string")


def plan_reload(spark: SparkSession, folder: str) -> DataFrame:
    """The steps from one mapping to another in which a collection is renamed and a property too."""
    schema = star_schema(spark, folder, ("region", "nation", "customer"))
    old = mapping.auto_map(schema)
    new = copy.deepcopy(old)
    new.collections["region"].target_collection = "Regions"
    new.collections["customer"].exclude_fields = ["c_acctbal"]
    return _rows(spark, [(a.kind, a.target) for a in mapping.diff_mappings(old, new)], "step string, target string")


def plan_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the star tables' columns by each convention, and as the model's property names."""
    columns = [c for t in ("region", "nation", "orders") for c in read_table(spark, folder, t).columns]
    return _rows(spark, [(c, naming.convert(c, "pascal"), naming.convert(c, "camel"), naming.convert(c, "snake"), export.property_name(c)) for c in columns], "column_name string, pascal string, camel string, snake string, property string")


def plan_plurals(spark: SparkSession, folder: str) -> DataFrame:
    tables = ["authors", "books", "members", "loans", "deletions"]
    return _rows(spark, [(t, naming.singularize(t), naming.pluralize(naming.singularize(t))) for t in tables], "table_name string, one string, many string")


def plan_model(spark: SparkSession, folder: str) -> DataFrame:
    """Entities and relationships of the model document of the star tables."""
    schema = star_schema(spark, folder)
    document = export.conceptual_model(mapping.auto_map(schema), schema)
    if export.check_model(document):
        raise RuntimeError(str(export.check_model(document)))
    rows = [("entity", e["name"], "", "") for e in document["conceptual"]["entities"]] + [("relationship", "", r["from"], r["to"]) for r in document["conceptual"]["relationships"]]
    return _rows(spark, rows, "kind string, name string, start string, end string")


def plan_r2rml(spark: SparkSession, folder: str) -> DataFrame:
    """Object maps per table in the R2RML of the star tables."""
    schema = star_schema(spark, folder, ("region", "nation", "customer", "supplier"))
    text = export.r2rml(mapping.auto_map(schema), schema)
    parts = {p.split(">")[0]: p for p in text.split("<#")[1:]}
    return _rows(spark, [(t, p.count("rr:column"), p.count("rr:termType rr:IRI")) for t, p in parts.items()], "table_name string, properties int, references int")


def plan_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each customer property once the gate has passed over the mapping."""
    schema, config = _classified(spark, folder)
    found = governance.report(config, schema)
    _, taken = governance.gate(config, found)
    became = governance.outcomes(found, taken)
    return _rows(spark, [(p, became[t, p]) for t, p in became if t == "customer"], "property string, outcome string")


def plan_roles(spark: SparkSession, folder: str) -> DataFrame:
    schema, config = _classified(spark, folder)
    found = governance.report(config, schema)
    rows = [(r["clearance"], c) for r in governance.suggested_roles(found) for c in r["collections"]]
    return _rows(spark, rows, "clearance string, readable string")


def plan_layout(spark: SparkSession, folder: str) -> DataFrame:
    schema, config = _classified(spark, folder)
    layout = governance.tier_layout(governance.report(config, schema))
    return _rows(spark, [(level, n) for level, names in layout.items() for n in names], "level string, name string")


def plan_classification_drift(spark: SparkSession, folder: str) -> DataFrame:
    old, _ = _classified(spark, folder)
    new = copy.deepcopy(old)
    new.tables["nation"].column("n_name").classification = None
    governance.annotate(new, {"orders": {"o_totalprice": model.Classification(["Confidential"])}})
    return _rows(spark, governance.drift(old, new), "table_name string, column_name string, old_level string, new_level string")


def plan_denormalization(spark: SparkSession, folder: str) -> DataFrame:
    """Findings on metadata: numbered columns of a widened table, and a key that is a reference."""
    region = read_table(spark, folder, "region")
    wide = region.select("r_regionkey", F.col("r_name").alias("phone_1"), F.col("r_name").alias("phone_2"), F.lit(1).alias("phone_3"), F.lit(1).alias("md5"))
    tables = {"region": project.table_of(region, "region", ["r_regionkey"]), "wide": project.table_of(wide, "wide", ["r_regionkey"], [model.ForeignKey(["r_regionkey"], "region", ["r_regionkey"])])}
    schema = model.Schema(tables)
    return _rows(spark, [(f.kind, ",".join(f.columns), f.confidence) for f in inference.analyze_table(tables["wide"], schema)], "kind string, columns string, confidence double")


QUERIES = {
    f.__name__: f
    for f in (
        store_load, store_describe, store_merge_deltas, files_dump_and_read, files_json_graph, dead_letters, expr_casts, vertex_expression_engines, bind_rewrites, edge_names, temporal_sharded, conflict_errors,
        plan_auto_map, plan_load_order, plan_validate, plan_schema_diff, plan_migration, plan_reload, plan_names, plan_plurals, plan_model, plan_r2rml, plan_outcomes, plan_roles, plan_layout,
        plan_classification_drift, plan_denormalization,
    )
}
