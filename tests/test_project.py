import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions.masking import mask
from graphloom.operators import project
from graphloom.plans.mapping import auto_map

ORDERS = model.Table(
    "orders",
    [model.Column("id", "integer", False, True), model.Column("user_id", "integer"), model.Column("total", "numeric(10,2)"), model.Column("tags", "text[]"), model.Column("extra", "jsonb")],
    ["id"],
    [model.ForeignKey(["user_id"], "users", ["id"])],
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("1", "7", "1.5", '{a,"b"}', '{"k": 1}', "x"), ("2", " ", "oops", "[1, 2]", "no json", "x"), (None, "7", None, "{}", None, "x"), ("3", " 8 ", "", None, "", "x"), ("3", " 8 ", "", None, "", "x")],
        "id string, user_id string, total string, tags string, extra string, _key string",
    )


def mapped(**fields):
    return model.CollectionMapping("orders", "Orders", **fields)


def test_vertices_coerce_and_leave_out_undeclared_columns(rows):
    out = project.vertices(rows, ORDERS, mapped()).select("_key", "id", "user_id", "total", "tags", F.to_json("extra").alias("extra")).collect()
    got = [tuple(r) for r in out]
    assert got[0] == ("1", 1, 7, 1.5, ["a", "b"], '{"k":1}')
    assert got[1] == ("2", 2, None, None, ["1", "2"], '"no json"')
    assert len(got) == 4 and got[2] == got[3] == ("3", 3, 8, None, None, None)


def test_rejects_name_value_and_reason(rows):
    out = {(r.column_name, r.raw, r.reason) for r in project.rejects(rows, ORDERS, mapped()).collect()}
    assert out == {("total", "oops", "not castable"), ("id", None, "null primary key")}


def test_include_exclude_rename_and_shadowing(rows):
    fields = dict(include_fields=["id", "total", "user_id"], exclude_fields=["user_id"], field_mappings={"total": "amount"})
    out = project.vertices(rows, ORDERS, mapped(**fields, field_expressions=[model.FieldExpression("amount", ["total"], "@total * 2"), model.FieldExpression("who", ["user_id"]), mask("id", "redact")]))
    assert out.columns == ["_key", "amount", "who", "id"]
    assert tuple(out.first()) == ("1", 3.0, 7, "***")


def test_override_by_table_and_column_wins(rows):
    config = model.MappingConfig(type_overrides={"total": "boolean", "orders.total": "string"})
    assert project.vertices(rows, ORDERS, mapped(), config).first()["total"] == "1.5"


def test_edges_drop_blank_references_and_trim(rows):
    config = auto_map(model.Schema({"orders": ORDERS, "users": model.Table("users", [model.Column("id")], ["id"])}))
    out = [tuple(r) for r in project.edges(rows, config.edges[0], ORDERS, config).collect()]
    assert out[0] == ("1_7", "orders/1", "users/7", "orders_to_users")
    assert [r[0] for r in out] == ["1_7", "3_8", "3_8"]


def test_edges_need_keys_and_columns(rows):
    edge = model.EdgeDefinition("e", "orders", "users", ["nope"], ["id"])
    with pytest.raises(ValueError):
        project.edges(rows, edge, ORDERS)
    with pytest.raises(ValueError):
        project.edges(rows, edge, model.Table("orders"))


def test_join_table(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (3, 4)], "product_id int, order_id int")
    table = model.Table("order_items", [model.Column("product_id"), model.Column("order_id")], ["order_id", "product_id"], [model.ForeignKey(["product_id"], "products", ["id"]), model.ForeignKey(["order_id"], "orders", ["id"])])
    out = [tuple(r) for r in project.join_table_edges(df, table, model.CollectionMapping("order_items", "contains", is_join_table=True)).collect()]
    assert out == [("2_1", "orders/2", "products/1", "contains"), ("4_3", "orders/4", "products/3", "contains")]
    with pytest.raises(ValueError):
        project.join_table_edges(df, model.Table("x"), model.CollectionMapping("x", "x"))


def test_reference_to_other_columns_is_resolved(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, None), (3, "c@x")], "id int, email string")
    table = model.Table("users", [model.Column("id"), model.Column("email")], ["id"])
    mails = spark.createDataFrame([(9, "c@x "), (8, "nobody"), (7, None)], "id int, sender string")
    edge = model.EdgeDefinition("sent", "mails", "users", ["sender"], ["email"])
    out = project.edges(mails, edge, project.table_of(mails, "mails", ["id"]), target=(users, table)).collect()
    assert [tuple(r) for r in out] == [("9_c@x", "mails/9", "users/3", "sent")]


def test_since_is_inclusive_and_absent_columns_do_not_filter(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, d string").selectExpr("id", "cast(d as date) updated_at")
    assert project.since(df, "2024-01-02").count() == 1
    assert project.since(df, "2024-01-02", "nope").count() == 2
    assert project.since(df, None).count() == 2


def test_graph_of_a_schema(spark):
    users = model.Table("users", [model.Column("id", "bigint", False, True)], ["id"])
    boss = model.Table("staff", [model.Column("id", "bigint", False, True), model.Column("boss", "bigint")], ["id"], [model.ForeignKey(["boss"], "staff", ["id"])])
    schema = model.Schema({"users": users, "staff": boss})
    frames = {"users": spark.createDataFrame([(0,)], "id bigint"), "staff": spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 9)], "id bigint, boss bigint")}
    graph = project.build_graph(schema, auto_map(schema), frames.__getitem__)
    assert set(graph.vertices) == {"users", "staff"} and set(graph.edges) == {"staff_to_staff"}
    assert {tuple(r) for r in graph.degrees("staff_to_staff").collect()} == {("staff/0", 2), ("staff/9", 1)}
    assert [r._key for r in graph.dangling("staff_to_staff", "staff").collect()] == ["3_9"]
    assert graph.neighbours("staff_to_staff", "staff").count() == 2
    assert set(project.build_graph(schema, auto_map(schema), frames.__getitem__, exclude_tables=["staff"]).vertices) == {"users"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id string, user_id string, total string, tags string, extra string")
    assert project.vertices(empty, ORDERS, mapped()).count() == 0
    assert project.rejects(empty, ORDERS, mapped()).count() == 0


def test_scan_reads_only_needed_columns_and_pushes_the_filter(spark, tmp_path):
    path = str(tmp_path / "o.parquet")
    spark.range(10).selectExpr("id", "id as user_id", "cast(id as string) as note", "timestamp_ntz'2024-01-01 00:00:00' as updated_at").write.parquet(path)
    df = spark.read.parquet(path)
    table = project.table_of(df, "o", ["id"])
    out = project.edges(project.since(df, "2024-01-01"), model.EdgeDefinition("e", "o", "u", ["user_id"], ["id"]), table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "note" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(updated_at" in plan
