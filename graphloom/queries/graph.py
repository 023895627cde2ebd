"""Queries over the star tables: projection, edges, expressions, profiling, merges, versions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import model
from graphloom.functions.expressions import Typed, parse
from graphloom.functions.masking import mask
from graphloom.functions.types import logical_of_spark
from graphloom.operators import merge, profile, project, temporal
from graphloom.plans import governance, inference, mapping
from graphloom.plans.runtime import read_table
from graphloom.streaming import apply, changelog

#: Primary and foreign keys of the test tables (events refer to customers).
KEYS = {
    "region": (["r_regionkey"], {}),
    "nation": (["n_nationkey"], {"n_regionkey": ("region", "r_regionkey")}),
    "customer": (["c_custkey"], {"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": (["s_suppkey"], {"s_nationkey": ("nation", "n_nationkey")}),
    "part": (["p_partkey"], {}),
    "orders": (["o_orderkey"], {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": ([], {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
    "events": (["event_id"], {"user_id": ("customer", "c_custkey")}),
}


def star_schema(spark: SparkSession, folder: str, tables: tuple[str, ...] = tuple(KEYS)) -> model.Schema:
    out = model.Schema()
    for name in tables:
        pk, fks = KEYS[name]
        out.tables[name] = project.table_of(read_table(spark, folder, name), name, pk, [model.ForeignKey([c], t, [k]) for c, (t, k) in fks.items() if t in tables])
    return out


def star_graph(spark: SparkSession, folder: str, tables: tuple[str, ...] = tuple(KEYS), **options) -> project.Graph:
    schema = star_schema(spark, folder, tables)
    return project.build_graph(schema, mapping.auto_map(schema), lambda t: read_table(spark, folder, t), **options)


def _table(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, model.Table]:
    df = read_table(spark, folder, name)
    pk, fks = KEYS[name]
    return df, project.table_of(df, name, pk, [model.ForeignKey([c], t, [k]) for c, (t, k) in fks.items()])


def _vertices(spark: SparkSession, folder: str, name: str, **fields) -> DataFrame:
    df, table = _table(spark, folder, name)
    return project.vertices(df, table, model.CollectionMapping(name, name, **fields))


# -- vertices


def vertex_customer(spark: SparkSession, folder: str) -> DataFrame:
    return _vertices(spark, folder, "customer")


def vertex_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _vertices(spark, folder, "orders", field_mappings={"o_totalprice": "total", "o_orderdate": "ordered_at"})


def vertex_excludes_and_renames(spark: SparkSession, folder: str) -> DataFrame:
    return _vertices(
        spark,
        folder,
        "part",
        include_fields=["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
        exclude_fields=["p_type"],
        field_mappings={"p_name": "name", "p_brand": "brand"},
        field_expressions=[model.FieldExpression("brand", ["p_brand"], 'CONCAT("<", @p_brand, ">")')],
    )


def vertex_composite_key(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    table = project.table_of(df, "lineitem", df.columns)
    return project.vertices(df, table, model.CollectionMapping("lineitem", "lineitem"), model.MappingConfig(key_separator="-"))


def vertex_key_sanitized_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "events").select("ts", "event_type", "event_id")
    table = project.table_of(df, "events", ["ts", "event_type", "event_id"])
    return project.vertices(df, table).select("_key", "event_id")


def vertex_key_sanitized_text(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "authors").where("name is not null")
    table = project.table_of(df, "authors", ["name", "id"])
    return project.vertices(df, table).select("_key", "id")


def vertex_without_mapping(spark: SparkSession, folder: str) -> DataFrame:
    df, table = _table(spark, folder, "nation")
    return project.vertices(df, table)


def vertex_without_key(spark: SparkSession, folder: str) -> DataFrame:
    return _vertices(spark, folder, "lineitem", include_fields=["l_orderkey", "l_quantity"])


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_orderkey"),
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("whole"),
        F.when(F.col("o_orderkey") % 7 == 0, "1.5").when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("number"),
        F.element_at(F.array(*[F.lit(x) for x in ("true", "T", "on", "0", "YES")]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("flag"),
        F.concat(F.lit('{a,"b"'), F.when(F.col("o_orderkey") % 2 == 0, ",c").otherwise(""), F.lit("}")).alias("tags"),
    )


_TEXT_TYPES = {"whole": "integer", "number": "integer", "flag": "boolean", "tags": "array"}


def coerce_types(spark: SparkSession, folder: str) -> DataFrame:
    df = _as_text(read_table(spark, folder, "orders"))
    table = project.table_of(df, "orders", ["o_orderkey"])
    out = project.vertices(df, table, model.CollectionMapping("orders", "orders"), model.MappingConfig(type_overrides=_TEXT_TYPES))
    return out.withColumn("tags", F.array_join("tags", "+"))


def coerce_rejects(spark: SparkSession, folder: str) -> DataFrame:
    df = _as_text(read_table(spark, folder, "orders"))
    table = project.table_of(df, "orders", ["o_orderkey"])
    found = project.rejects(df, table, model.CollectionMapping("orders", "orders"), model.MappingConfig(type_overrides=_TEXT_TYPES))
    return found.select("source_table", "collection", "column_name", "raw", "reason", F.get_json_object("row_json", "$.o_orderkey").alias("o_orderkey"))


def coerce_event_props(spark: SparkSession, folder: str) -> DataFrame:
    df, table = _table(spark, folder, "events")
    out = project.vertices(df, table, model.CollectionMapping("events", "events", include_fields=["event_id", "props"]), model.MappingConfig(type_overrides={"events.props": "object"}))
    return out.select("_key", F.expr("try_variant_get(props, '$.k', 'bigint')").alias("k"))


# -- edges


def _edges(name: str, table: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df, described = _table(spark, folder, table)
        column, (target, key) = next((c, x) for c, x in KEYS[table][1].items() if f"{table}_to_{x[0]}" == name)
        return project.edges(df, model.EdgeDefinition(name, table, target, [column], [key]), described)

    query.__name__ = f"edge_{table}_{name.rpartition('_')[2]}"
    return query


def edge_null_fk_dropped(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "  ").when(F.col("o_custkey") % 3 == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("ref"))
    table = project.table_of(df, "orders", ["o_orderkey"])
    return project.edges(df, model.EdgeDefinition("orders_to_customer", "orders", "customer", ["ref"], ["c_custkey"]), table)


def edge_join_table(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    table = model.Table("part_supplier", [model.Column("l_partkey", "bigint"), model.Column("l_suppkey", "bigint")], [], [model.ForeignKey(["l_suppkey"], "supplier", ["s_suppkey"]), model.ForeignKey(["l_partkey"], "part", ["p_partkey"])])
    return project.join_table_edges(df, table, model.CollectionMapping("part_supplier", "supplied_by", is_join_table=True))


def edge_composite(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    table = project.table_of(df, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return project.edges(df, model.EdgeDefinition("lineitem_to_stock", "lineitem", "stock", ["l_partkey", "l_suppkey"], []), table)


def edge_nonpk_target(spark: SparkSession, folder: str) -> DataFrame:
    customers, described = _table(spark, folder, "customer")
    orders = read_table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("who"))
    named = customers.withColumn("c_label", F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    table = project.table_of(orders, "orders", ["o_orderkey"])
    return project.edges(orders, model.EdgeDefinition("orders_to_customer", "orders", "customer", ["who"], ["c_label"]), table, target=(named, described))


def graph_all_edges(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, df in star_graph(spark, folder).edges.items():
        one = df.groupBy(F.lit(name).alias("edge_set")).agg(F.count(F.lit(1)).alias("edges"), F.min("_key").alias("least"), F.max("_key").alias("most"))
        out = one if out is None else out.unionByName(one)
    return out


def since_incremental(spark: SparkSession, folder: str) -> DataFrame:
    graph = star_graph(spark, folder, ("customer", "orders"), include_tables=["orders"], since_value="1997-06-01 00:00:00", since_column="o_orderdate")
    return graph.vertices["orders"].select("_key", "o_totalprice")


def degree_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return star_graph(spark, folder, ("customer", "orders")).degrees("orders_to_customer").groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))


def two_hop_region_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per region by three edge sets; the small sets meet first, orders combine per customer."""
    g = star_graph(spark, folder, ("region", "nation", "customer", "orders"))
    per_customer = g.degrees("orders_to_customer")
    of_nation = g.edges["customer_to_nation"].select(F.col("_from").alias("vertex"), F.col("_to").alias("nation")).join(per_customer, "vertex")
    per_nation = of_nation.groupBy("nation").agg(F.sum("degree").alias("orders"))
    of_region = g.edges["nation_to_region"].select(F.col("_from").alias("nation"), F.col("_to").alias("region"))
    names = g.vertices["region"].select(F.concat(F.lit("region/"), "_key").alias("region"), "r_name")
    return per_nation.join(of_region, "nation").join(names, "region").groupBy("r_name").agg(F.sum("orders").alias("orders"))


def dangling_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of loans whose end is no book vertex."""
    loans = read_table(spark, folder, "loans").select("id", "book_id").distinct()
    books = read_table(spark, folder, "books").select("id").distinct()
    graph = project.Graph(
        {"books": project.vertices(books, project.table_of(books, "books", ["id"]))},
        {"loans_to_books": project.edges(loans, model.EdgeDefinition("loans_to_books", "loans", "books", ["book_id"], ["id"]), project.table_of(loans, "loans", ["id"]))},
        [],
    )
    return graph.dangling("loans_to_books", "books")


# -- expressions


def _evaluated(spark: SparkSession, folder: str, table: str, key: list[str], texts: dict[str, str]) -> DataFrame:
    df = read_table(spark, folder, table)
    env = {f.name: Typed(F.col(f.name), logical_of_spark(f.dataType)) for f in df.schema.fields}
    return df.select(*key, *[parse(text).column(env).col.alias(name) for name, text in texts.items()])


def expr_arith(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(
        spark,
        folder,
        "orders",
        ["o_orderkey"],
        {"total": "@o_orderkey + 2 * 3 - 1", "halved": "@o_orderkey / 4", "by_zero": "@o_orderkey / 0", "floor_mod": "(@o_orderkey - 50) % 7", "neg_mod": "@o_orderkey % -7", "mod_zero": "@o_orderkey % 0", "negated": "-@o_custkey", "from_text": '"12.5" * 2', "joined": '@o_orderkey + "#"'},
    )


def expr_strings(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(
        spark,
        folder,
        "customer",
        ["c_custkey"],
        {"up": "UPPER(@c_name)", "low": "LOWER(@c_mktsegment)", "part": "SUBSTRING(@c_name, 2, 4)", "last": "SUBSTRING(@c_name, -3)", "size": "LENGTH(@c_name)", "joined": 'CONCAT(@c_name, "/", null, @c_custkey)', "parts": 'CONCAT_SEPARATOR("-", @c_custkey, null, @c_mktsegment)', "has": 'CONTAINS(@c_mktsegment, "BUILD")', "bare": 'TRIM("\\t x ")', "digits": "LENGTH(@c_custkey)"},
    )


def expr_null_logic(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(
        spark,
        folder,
        "loans",
        ["id", "recorded_at"],
        {"either": "@book_id ?? @member_id ?? -1", "same": "@book_id == @member_id", "none": "@returned_on == null", "less": "@book_id < @member_id", "both": "@book_id && @member_id", "any": "@book_id || @member_id", "not_book": "NOT @book_id", "mixed": '"1" == 1', "truth": "true == 1"},
    )


def expr_ternary(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(
        spark,
        folder,
        "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        {"size": '@l_quantity > 30 ? "large" : @l_quantity > 10 ? "middle" : "small"', "returned": '@l_returnflag == "R" && @l_quantity >= 10 ? 1 : 0'},
    )


def _masked(kind: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _vertices(spark, folder, "customer", include_fields=["c_custkey", "c_name"], field_expressions=[mask("c_name", kind)])

    query.__name__ = f"mask_{kind}"
    return query


# -- profiling


def orphan_check(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 100_000_000).when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("ref"))
    return profile.orphans(orders, ["ref"], read_table(spark, folder, "customer"), ["c_custkey"])


def orphan_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: read_table(spark, folder, n)
    return profile.orphan_summary(
        {
            "loans.book_id": (t("loans"), ["book_id"], t("books"), ["id"]),
            "loans.member_id": (t("loans"), ["member_id"], t("members"), ["id"]),
            "books.author_id": (t("books"), ["author_id"], t("authors"), ["id"]),
            "lineitem.l_orderkey": (t("lineitem"), ["l_orderkey"], t("orders"), ["o_orderkey"]),
        }
    )


def orphan_issues(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: read_table(spark, folder, n)
    checks = {
        "loans": (t("loans"), ["book_id"], t("books"), ["id"]),
        "books": (t("books"), ["author_id"], t("authors"), ["id"]),
        "lineitem": (t("lineitem"), ["l_orderkey", "l_linenumber"], t("lineitem").where("l_quantity > 25"), ["l_orderkey", "l_linenumber"]),
    }
    return profile.orphan_issues(checks, {"loans": ["id", "recorded_at"], "books": ["id"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]})


def value_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_overlap(read_table(spark, folder, "loans"), "member_id", read_table(spark, folder, "members"), "id")


def distinct_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_ratios(read_table(spark, folder, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def _customer_nation(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return read_table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name", "n_regionkey", "c_mktsegment")


def fd_strength(spark: SparkSession, folder: str) -> DataFrame:
    return profile.fd_strengths(_customer_nation(spark, folder), [("c_nationkey", "n_name"), ("c_nationkey", "n_regionkey"), ("n_regionkey", "n_name"), ("c_nationkey", "c_mktsegment"), ("n_name", "c_nationkey")])


def delimiter_rate(spark: SparkSession, folder: str) -> DataFrame:
    return profile.delimiter_rates(read_table(spark, folder, "books"), ["title", "genre"])


def embedded_lookup_candidates(spark: SparkSession, folder: str) -> DataFrame:
    df = _customer_nation(spark, folder)
    table = project.table_of(df, "customer_nation", ["c_custkey"])
    columns = [c for c in df.columns if c != "c_custkey"]
    ratios = {r["column_name"]: r["ratio"] for r in profile.distinct_ratios(df, columns).collect()}  # a row per column
    pairs = [(a, b) for a in inference.determinants(table, ratios) for b in columns if a != b]
    strengths = {(r["determinant"], r["dependent"]): r["strength"] for r in profile.fd_strengths(df, pairs).collect()} if pairs else {}  # a row per pair
    rows = [(f.kind, f.columns[0], ",".join(sorted(f.dependents)), f.confidence) for f in inference.embedded_lookups(table, ratios, strengths)]
    return spark.createDataFrame(rows, "kind string, determinant string, dependents string, confidence double")


def pk_candidates(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "events"):
        df = read_table(spark, folder, name)
        one = profile.key_candidates(df, [c for c, t in df.dtypes if t in ("bigint", "int", "string")]).select(F.lit(name).alias("table_name"), "column_name")
        out = one if out is None else out.unionByName(one)
    return out


def fk_candidates(spark: SparkSession, folder: str) -> DataFrame:
    schema = model.Schema()
    for name in ("authors", "books", "members", "loans"):
        schema.tables[name] = project.table_of(read_table(spark, folder, name), name, ["id"])
    found = inference.infer_foreign_keys(schema)
    return spark.createDataFrame([(c.table, ",".join(c.columns), c.foreign_table, c.method, c.confidence) for c in found], "table_name string, columns string, foreign_table string, method string, confidence double")


def shared_key_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that three sources share, with probes of their values: the catalogue (books, members by
    their keys), the desk (loans) and the reviews (documents)."""
    renamed = {"books": {"id": "book_id"}, "members": {"id": "member_id"}, "loans": {"id": "loan_no"}, "documents": {"item_id": "book_id", "reviewer_id": "member_id"}}
    frames = {n: read_table(spark, folder, n).withColumnsRenamed(names) for n, names in renamed.items()}
    sources = {"catalogue": {"books": ["book_id"], "members": ["member_id"]}, "desk": {"loans": []}, "reviews": {"documents": []}}
    schemas = {source: model.Schema({t: project.table_of(frames[t], t, pk) for t, pk in tables.items()}) for source, tables in sources.items()}
    overlap = lambda a, b: profile.value_overlap(frames[a[1]], a[2], frames[b[1]], b[2]).first()["overlap"]
    found, _ = inference.infer_shared_keys(schemas, overlap=overlap)
    return spark.createDataFrame([(k.key, ".".join(k.hub or ()), k.concept, ";".join(".".join(r) for r in k.references), k.method, k.confidence) for k in found], "key string, hub string, concept string, references string, method string, confidence double")


def _classified(spark: SparkSession, folder: str) -> tuple[model.Schema, model.MappingConfig]:
    schema = star_schema(spark, folder, ("region", "nation", "customer", "orders"))
    governance.annotate(schema, {"customer": {"c_name": model.Classification(["PII.Sensitive"]), "c_acctbal": model.Classification([], "Tier.Tier1")}, "nation": {"n_name": model.Classification(["internal"])}})
    config = mapping.auto_map(schema)
    config.collections["customer"].field_expressions = [model.FieldExpression("greeting", ["c_name"], 'CONCAT("Dear ", @c_name)')]
    return schema, config


def mosaic_levels(spark: SparkSession, folder: str) -> DataFrame:
    schema, config = _classified(spark, folder)
    found = governance.report(config, schema)
    rows = [("collection", *x) for x in found.collections.items()] + [("edge", *x) for x in found.edges.items()]
    return spark.createDataFrame(rows, "kind string, name string, level string")


def gate_excludes(spark: SparkSession, folder: str) -> DataFrame:
    """The customer vertices that the gate lets through: neither the columns nor the computed
    greeting."""
    schema, config = _classified(spark, folder)
    gated, _ = governance.gate(config, governance.report(config, schema))
    return project.vertices(read_table(spark, folder, "customer"), schema.tables["customer"], gated.collections["customer"], gated)


# -- change logs

_ORDERS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """A change log of orders: each is inserted; a third changes its customer later; some are
    deleted, of those some come again. Sequences are 10 * key + 0, 1, 2, 3."""
    o = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    entry = lambda n, op, cust, status: F.struct(F.lit(n).alias("n"), F.lit(op).alias("op"), cust.alias("o_custkey"), status.alias("o_orderstatus"))
    cust, status = F.col("o_custkey"), F.col("o_orderstatus")
    entries = F.array_compact(
        F.array(
            entry(0, "INSERT", cust, status),
            F.when(k % 3 == 0, entry(1, "UPDATE", cust + 1, F.lit("U"))),
            F.when(k % 5 == 0, entry(2, "DELETE", cust, status)),
            F.when(k % 10 == 0, entry(3, "INSERT", cust + 2, F.lit("N"))),
        )
    )
    return o.select("o_orderkey", F.explode(entries).alias("e")).select("o_orderkey", "e.*")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select(
        F.col("o_orderkey").cast("string").alias("_key"), F.when(F.col("op") == "UPDATE", "REPLACE").otherwise(F.col("op")).alias("op"), (F.col("o_orderkey") * 10 + F.col("n")).alias("seq"), "o_orderkey", "o_custkey", "o_orderstatus"
    )


#: Added to keys of orders that are to be found on one side only.
_ELSEWHERE, _NEW = 1_000_000_000, 2_000_000_000


def _shifted(there: Column, by: int) -> Column:
    return F.when(there, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + by)


def _old_target(spark: SparkSession, folder: str) -> DataFrame:
    """What was there: all orders, three quarters of them under keys that no change names; some were
    written at a sequence between their changes."""
    k = F.col("o_orderkey")
    o = read_table(spark, folder, "orders").select(_shifted(k % 4 == 0, _ELSEWHERE).alias("key"), "o_custkey", F.when(k % 8 == 0, k * 10 + 1).alias("_seq"))
    return o.select(F.col("key").cast("string").alias("_key"), F.col("key").alias("o_orderkey"), "o_custkey", F.lit("T").alias("o_orderstatus"), "_seq", F.lit(False).alias("_deleted"))


def _envelopes(spark: SparkSession, folder: str, payload: bool) -> DataFrame:
    row = F.struct("o_orderkey", "o_custkey", "o_orderstatus")
    code = F.create_map(*[F.lit(x) for x in ("INSERT", "c", "UPDATE", "u", "DELETE", "d")])[F.col("op")]
    source = F.struct(F.lit("public").alias("schema"), F.lit("orders").alias("table"), (F.col("o_orderkey") * 10 + F.col("n")).alias("lsn"), F.col("o_orderkey").alias("txId"))
    body = F.struct(F.when(F.col("op") == "DELETE", row).alias("before"), F.when(F.col("op") != "DELETE", row).alias("after"), source.alias("source"), code.alias("op"))
    return _log(spark, folder).select(F.to_json(F.struct(body.alias("payload")) if payload else body).alias("value"))


def _fields(events: DataFrame) -> DataFrame:
    row = F.from_json(F.coalesce("new_row", "old_row"), _ORDERS)
    return events.select("op", "schema_name", "table_name", "lsn", "transaction_id", row["o_orderkey"].alias("o_orderkey"), row["o_custkey"].alias("o_custkey"), row["o_orderstatus"].alias("o_orderstatus"), F.col("old_row").isNotNull().alias("has_old"))


def cdc_debezium_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(changelog.parse_debezium(_envelopes(spark, folder, True).unionByName(spark.createDataFrame([("{",), ('{"op":"x"}',)], "value string"))))


def cdc_flat_parse(spark: SparkSession, folder: str) -> DataFrame:
    row = F.struct("o_orderkey", "o_custkey", "o_orderstatus")
    flat = F.struct(
        F.lower("op").alias("operation"), F.lit("public").alias("schema_name"), F.lit("orders").alias("table_name"), F.when(F.col("op") != "DELETE", row).alias("new_row"), F.when(F.col("op") == "DELETE", row).alias("old_row"), (F.col("o_orderkey") * 10 + F.col("n")).alias("lsn"), F.col("o_orderkey").alias("transaction_id")
    )
    return _fields(changelog.parse_flat(_log(spark, folder).select(F.to_json(flat).alias("value"))))


def cdc_wal2json_parse(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(F.lit("o_orderkey"), F.lit("o_custkey"), F.lit("o_orderstatus"))
    text = F.format_string(
        '{"kind":"%s","schema":"public","table":"orders",%s}',
        F.lower("op"),
        F.when(F.col("op") == "DELETE", F.format_string('"oldkeys":{"keynames":%s,"keyvalues":[%d,%d,"%s"]}', F.to_json(names), "o_orderkey", "o_custkey", "o_orderstatus")).otherwise(
            F.format_string('"columnnames":%s,"columnvalues":[%d,%d,"%s"]', F.to_json(names), "o_orderkey", "o_custkey", "o_orderstatus")
        ),
    )
    documents = _log(spark, folder).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("c"))  # at most four a key
    value = F.format_string('{"xid":%d,"nextlsn":"%d","change":[%s]}', "o_orderkey", F.col("o_orderkey") * 10, F.array_join(F.col("c.t"), ","))
    return _fields(changelog.parse_wal2json(documents.select(value.alias("value"))))


def cdc_test_decoding_parse(spark: SparkSession, folder: str) -> DataFrame:
    columns = F.format_string("o_orderkey[bigint]:%d o_custkey[bigint]:%d o_orderstatus[character varying]:'it''s %s'", "o_orderkey", "o_custkey", "o_orderstatus")
    lines = _log(spark, folder).select(F.concat(F.lit("table public.orders: "), F.col("op"), F.lit(": "), columns).alias("value"), (F.col("o_orderkey") * 10 + F.col("n")).alias("lsn"), F.col("o_orderkey").alias("xid"))
    return _fields(changelog.parse_test_decoding(lines.unionByName(spark.createDataFrame([("BEGIN 7", 1, 7), ("COMMIT 7", 2, 7)], "value string, lsn bigint, xid bigint"))))


def _applied(policy: str, name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return merge.live(merge.apply_changes(_old_target(spark, folder), _changes(spark, folder), policy))

    query.__name__ = name
    return query


def conflict_counts(spark: SparkSession, folder: str) -> DataFrame:
    return merge.conflict_counts(merge.conflicts(_old_target(spark, folder), _changes(spark, folder), "log_and_skip"))


def _load_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All orders, a sixth of them under their own keys, without customers."""
    o = read_table(spark, folder, "orders").select(_shifted(F.col("o_orderkey") % 6 == 0, _NEW).alias("key"), "o_orderstatus")
    return o.select(F.col("key").cast("string").alias("_key"), F.col("key").alias("o_orderkey"), F.lit(None).cast("bigint").alias("o_custkey"), "o_orderstatus")


def _loaded(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return merge.load(_old_target(spark, folder).drop("_seq", "_deleted"), _load_rows(spark, folder), mode)

    query.__name__ = f"load_{mode}"
    return query


def load_then_late_change(spark: SparkSession, folder: str) -> DataFrame:
    """A log, then a bulk load, then changes older than the log: those change nothing, and keys
    that the log deleted stay so unless the load has them."""
    changes = _changes(spark, folder)
    after_log = merge.apply_changes(merge.empty_target(changes), changes)
    after_load = merge.load_state(after_log, _load_rows(spark, folder))
    late = changes.where("op = 'INSERT'").withColumn("seq", F.col("o_orderkey") * 10 - 1).withColumn("o_orderstatus", F.lit("late"))
    return merge.live(merge.apply_changes(after_load, late))


def cdc_long_transaction(spark: SparkSession, folder: str) -> DataFrame:
    """The log as transactions of some thousands of changes with one position each: their place
    in the transaction decides."""
    schema, config = _orders_mapping()
    row = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))
    events = _log(spark, folder).select(
        "op",
        F.lit("orders").alias("table_name"),
        F.when(F.col("op") != "DELETE", row).alias("new_row"),
        F.when(F.col("op") == "DELETE", row).alias("old_row"),
        F.floor(F.col("o_orderkey") / 5000).cast("string").alias("lsn"),
        (F.col("o_orderkey") % 5000 * 4 + F.col("n")).cast("int").alias("ordinal"),
    )
    changes = apply.vertex_changes(apply.sequenced(events), schema.tables["orders"], config.collections["orders"], config)
    return merge.live(merge.apply_changes(merge.empty_target(changes), changes))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The log as flat events; updates carry their old row."""
    row = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))
    old = F.to_json(F.struct("o_orderkey", (F.col("o_custkey") - 1).alias("o_custkey"), "o_orderstatus"))
    return _log(spark, folder).select(
        "op",
        F.lit("public").alias("schema_name"),
        F.lit("orders").alias("table_name"),
        F.when(F.col("op") != "DELETE", row).alias("new_row"),
        F.when(F.col("op") == "DELETE", row).when(F.col("op") == "UPDATE", old).alias("old_row"),
        (F.col("o_orderkey") * 10 + F.col("n")).cast("string").alias("lsn"),
        F.col("o_orderkey").alias("transaction_id"),
    )


def _orders_mapping() -> tuple[model.Schema, model.MappingConfig]:
    orders = model.Table("orders", [model.Column("o_orderkey", "bigint", False, True), model.Column("o_custkey", "bigint"), model.Column("o_orderstatus", "text")], ["o_orderkey"], [model.ForeignKey(["o_custkey"], "customer", ["c_custkey"])])
    schema = model.Schema({"orders": orders})
    return schema, mapping.auto_map(schema)


def cdc_deltas(spark: SparkSession, folder: str) -> DataFrame:
    schema, config = _orders_mapping()
    found = apply.deltas(apply.sequenced(_events(spark, folder)), schema, config)
    return found.select("seq", "collection", "is_edge", "op", "_key", F.get_json_object("doc", "$.o_custkey").cast("bigint").alias("o_custkey"), F.get_json_object("doc", "$._to").alias("_to"))


def cdc_edge_rewire(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that are there after the whole log: one per order at most, its last."""
    schema, config = _orders_mapping()
    changes = apply.edge_changes(apply.sequenced(_events(spark, folder)), config.edges[0], schema.tables["orders"], config)
    return merge.live(merge.apply_changes(merge.empty_target(changes), changes)).select("_key", "_from", "_to", "_label")


# -- versions


def _version_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the log of their users: a signup of the type `purchase` ends the user's state."""
    e = read_table(spark, folder, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").cast("string").alias("_key"), F.when(F.col("event_id") % 17 == 0, "DELETE").otherwise("REPLACE").alias("op"), (micros * 1000 + F.col("event_id") % 1000).alias("seq"), micros.alias("ts"), "event_type", "event_id"
    )


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.versions_from_log(_version_log(spark, folder))


def temporal_versions(spark: SparkSession, folder: str) -> DataFrame:
    return _versions(spark, folder)


#: A moment inside the events, and a second, two weeks later (microseconds).
MOMENT, LATER = 1_704_067_200_000_000 + 10 * 86_400_000_000, 1_704_067_200_000_000 + 24 * 86_400_000_000


def temporal_snapshot_at(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.snapshot_at(_versions(spark, folder), MOMENT).select("_key", "_proxy", "event_id")


def temporal_snapshots_at(spark: SparkSession, folder: str) -> DataFrame:
    moments = spark.range(8).select((F.lit(MOMENT) + F.col("id") * 86_400_000_000).alias("t"))
    return temporal.snapshots_at(_versions(spark, folder), moments).groupBy("t").agg(F.count(F.lit(1)).alias("alive"))


def temporal_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.overlapping(_versions(spark, folder), MOMENT, LATER).select("_key")


def temporal_changed_between(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.changed_between(_versions(spark, folder), MOMENT, LATER).select("_key", "created_in", "expired_in")


def temporal_current(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.current(_versions(spark, folder)).select("_key", "_version", "event_id")


def temporal_history(spark: SparkSession, folder: str) -> DataFrame:
    versions = _versions(spark, folder)
    return temporal.history(versions, temporal.version_edges(versions, "user"), "user", "7").select("_key", "_version", "created", "expired")


def temporal_has_version_edges(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.version_edges(_versions(spark, folder), "user").select("_key", "_from", "_to", "_label")


def temporal_ttl(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.aged(_versions(spark, folder), LATER // 1_000_000 + temporal.RETAIN_SECONDS).select("_key", "ttlExpireAt")


def temporal_proxied_edges(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.proxify(star_graph(spark, folder, ("nation", "customer")).edges["customer_to_nation"])


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of orders with both of their vertices: shows that endpoints resolve."""
    g = star_graph(spark, folder, ("region", "nation", "customer", "orders"))
    orders = g.vertices["orders"].select(F.concat(F.lit("orders/"), "_key").alias("_from"), "o_totalprice")
    customers = g.vertices["customer"].select(F.concat(F.lit("customer/"), "_key").alias("_to"), "c_name", "c_mktsegment")
    return g.edges["orders_to_customer"].join(orders, "_from").join(customers, "_to")


_EDGE_QUERIES = [_edges(f"{t}_to_{x[0]}", t) for t in ("orders", "customer", "nation", "supplier", "events") for x in KEYS[t][1].values()]
QUERIES = {
    f.__name__: f
    for f in (
        flagship, vertex_customer, vertex_orders, vertex_excludes_and_renames, vertex_composite_key, vertex_key_sanitized_timestamp, vertex_key_sanitized_text, vertex_without_mapping, vertex_without_key,
        coerce_types, coerce_rejects, coerce_event_props, *_EDGE_QUERIES, edge_null_fk_dropped, edge_join_table, edge_composite, edge_nonpk_target, graph_all_edges, since_incremental,
        degree_distribution, two_hop_region_orders, dangling_edges, expr_arith, expr_strings, expr_null_logic, expr_ternary, *[_masked(k) for k in ("hash", "tokenize", "redact", "nullify")],
        orphan_check, orphan_summary, orphan_issues, value_overlap, distinct_ratio, fd_strength, delimiter_rate, embedded_lookup_candidates, pk_candidates, fk_candidates, shared_key_candidates, mosaic_levels, gate_excludes,
        cdc_debezium_parse, cdc_flat_parse, cdc_wal2json_parse, cdc_test_decoding_parse, _applied("source_wins", "cdc_apply_source_wins"), _applied("last_write_wins", "cdc_apply_lww"), _applied("log_and_skip", "cdc_apply_log_and_skip"),
        conflict_counts, *[_loaded(m) for m in ("replace", "update", "ignore")], load_then_late_change, cdc_long_transaction, cdc_deltas, cdc_edge_rewire,
        temporal_versions, temporal_snapshot_at, temporal_snapshots_at, temporal_overlap, temporal_changed_between, temporal_current, temporal_history, temporal_has_version_edges, temporal_ttl, temporal_proxied_edges,
    )
}
